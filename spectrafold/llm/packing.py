"""Packing along a space-filling curve.

Documents become hashed bag vectors of their ids, which a fixed random projection
takes to four dimensions.  The Hilbert key of the projected point orders the
documents, a range sort deals contiguous stretches of the curve to tasks, and each
task fills sequences with neighbouring documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, id_columns, partitions, text_of
from .hilbert import hilbert_key
from .tokens import encoder

DIMS, BITS, BUCKETS = 4, 8, 4096
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _projection(vocabulary: int) -> np.ndarray:
    """A row of DIMS numbers for each id, shared by ids of one hash bucket."""
    table = np.random.default_rng(20).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    bucket = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return table[bucket.astype(np.int64)]


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents given by their ids; a document without ids lies at the origin."""
    table = _projection(vocabulary)
    points = np.zeros((len(ids), DIMS), np.float32)
    sizes = np.array([len(x) for x in ids])
    some = np.flatnonzero(sizes)
    if len(some):
        begin = np.r_[0, np.cumsum(sizes[some])[:-1]]
        points[some] = np.add.reduceat(table[np.concatenate([ids[k] for k in some])], begin) / sizes[some, None]
    # means of projected tokens lie well within (-0.5, 0.5)
    cells = np.clip((points + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


def _powers(n: int) -> list[int]:
    """n as a falling sum of powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], limit: int, first_sequence: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of documents in the given order.

    Every sequence but those of the stream's end is full; the rest, shorter than
    ``limit``, is cut into sequences whose lengths are powers of two, which need no
    padding.
    """
    sequence, fill, open_pieces = first_sequence, 0, []
    for doc_id, ids in docs:
        at = 0
        while at < len(ids):
            n = min(limit - fill, len(ids) - at)
            open_pieces.append((doc_id, at, n, ids[at : at + n], len(ids), sequence, fill))
            at, fill = at + n, fill + n
            if fill == limit:
                yield from open_pieces
                open_pieces, sequence, fill = [], sequence + 1, 0
    rest = iter(_powers(fill))
    room = fill = 0
    for doc_id, start, n, ids, total, _, _ in open_pieces:
        at = 0
        while at < n:
            if fill == room:
                sequence, room, fill = sequence + (room > 0), next(rest), 0
            m = min(room - fill, n - at)
            yield doc_id, start + at, m, ids[at : at + m], total, sequence, fill
            at, fill = at + m, fill + m


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows of ``docs``, one row each: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null texts count as empty and consist of ``end_id`` alone; a null id is an id
    like others; repeated rows are packed as often as they occur; an empty table
    gives no pieces.  Texts of any length are cut at sequence ends.  The ids are
    written once, so no text is encoded again for range bounds or after a loss, and
    the range sort by (key, id) splits runs of equal keys, as copies make them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Workspace(spark, "packing")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                ids = [x.astype("<u4" if enc.size > 65536 else "<u2") for x in enc.each(part["text"].tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"], "no_id": part["no_id"], "key": curve_keys(ids, enc.size), "ids": [x.tobytes() for x in ids], "wide": [x.itemsize == 4 for x in ids]})

    rows = docs.select(*id_columns(id_col), text_of(text_col).alias("text"))
    coded = work.save(rows.mapInPandas(encode, "doc_id long, no_id boolean, key long, ids binary, wide boolean"), "ids")
    ordered = coded.repartitionByRange(partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id", "no_id", "ids")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        part = TaskContext.get().partitionId()

        def stream():
            for b in batches:
                for doc_id, ids, wide in zip(b["doc_id"].astype(object).where(~b["no_id"], None), b["ids"], b["wide"]):
                    yield doc_id, np.append(np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4"), np.uint32(end_id)).astype("<u4")

        out: list[tuple] = []
        for p in pack_stream(stream(), limit, part << 40):
            out.append((p[0], p[1], p[2], p[3].tobytes(), *p[4:]))
            if len(out) == 2000:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)

    return ordered.mapInPandas(fill, _PIECES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out
