"""Token ids as a binary store in ascending document order.

The store is a Parquet folder, so any storage that Spark writes can hold it and
its commit is atomic.  A row is a block of whole documents: part and block number,
ids before it within the part, ids in it, the documents' ids and lengths, and the
range-coded payload (``range_coder``), whose segments are reset and checksummed on
their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_columns, partitions, text_of
from .range_coder import SEGMENT, decode_ids, encode_ids
from .tokens import encoder

_BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row of ``docs`` and write the store.

    Null texts count as empty: such a document is ``end_id`` alone.  Null ids come
    first; rows with equal ids follow one another in the order of their texts, so
    repeated rows are kept.  An empty table makes an empty store.  A block closes at
    SEGMENT ids; a longer document makes a block of its own of several segments.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        number = first = held = 0
        ids, names, lengths = [], [], []

        def close() -> pd.DataFrame:
            nonlocal number, first, held
            row = (part, number, first, held, list(names), list(lengths), encode_ids(np.concatenate(ids), enc.size))
            number, first, held = number + 1, first + held, 0
            for x in (ids, names, lengths):
                x.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

        for b in batches:
            for doc_id, x in _documents(b, enc, end_id):
                if held and held + len(x) > SEGMENT:
                    yield close()
                ids.append(x)
                names.append(None if doc_id is None else int(doc_id))
                lengths.append(len(x))
                held += len(x)
        if held:
            yield close()

    bounded_batches(docs.sparkSession)
    rows = docs.select(*id_columns(id_col), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.desc("no_id"), "doc_id").sortWithinPartitions(F.desc("no_id"), "doc_id", "text")
    ordered.mapInPandas(blocks, _BLOCKS).write.mode("overwrite").option("compression", "none").parquet(path)


def _documents(b: pd.DataFrame, enc, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids of each row, the end id included; a few hundred texts are encoded at a time."""
    for lo in range(0, len(b), 500):
        part = b.iloc[lo : lo + 500]
        names = part["doc_id"].astype(object).where(~part["no_id"], None)
        for doc_id, x in zip(names, enc.each(part["text"].tolist())):
            yield doc_id, np.append(x, x.dtype.type(end_id)).astype("<u4")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the store; ``with_ids`` adds the ids as little-endian uint32.

    Only one number per part comes to the driver.
    """
    bounded_batches(spark)
    store = spark.read.schema(_BLOCKS).parquet(path)
    before, total = {}, 0
    for part, n in sorted(store.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part] = total
        total += n

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, first, names, lengths, payload in zip(b["part"], b["first"], b["doc_ids"], b["lengths"], b["payload"]):
                ids = decode_ids(payload)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths)]
                out = pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in names], "Int64"), "start": before[part] + first + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(c) for c in cut]})
                if with_ids:
                    out["ids"] = cut
                yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return store.select("part", "first", "doc_ids", "lengths", "payload").mapInPandas(decode, schema)
