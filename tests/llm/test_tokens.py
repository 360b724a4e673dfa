import random
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard

from spectrafold.llm import wordtable
from spectrafold.llm.packing import pack, pack_stream
from spectrafold.llm.range_coder import SEGMENT, decode_ids, encode_ids
from spectrafold.llm.token_counts import count_tokens
from spectrafold.llm.token_store import read_ids, write_ids
from spectrafold.llm.tokens import encoder

NAME = "word_bpe_49k.json"
PARTS = ["foo,", "Bar.", "a!, b", "x_, y", "...", ". ", "<|endoftext|>", "<|ENDOFTEXT|>x", "ÉÀ", "é́, z", "İx", "ΣΑΣ ", "don't, we'll", "1234, 5.", "\x1c, q", "a\xa0, b", "’s, t", "ß.", "÷", "×", "a.\n", "%%%\n", "日本語 ", "\t", "\r\n", "\x0b,", " ,", "", "'s", "12.5%", "œuf", '"']
ROWS = [(1, "One two, three.", "a"), (2, None, "a"), (3, "", None), (4, "x " * 3000, "b"), (4, "x " * 3000, "b"), (5, 'say "hi" <|endoftext|>', "b"), (None, "no id", "c")]


def truth(text):
    return encoder(NAME).whole([text or ""])[0]


def test_word_table_equals_library():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = encoder(NAME).each(texts)
    assert [x.tolist() for x in got] == [truth(t) for t in texts]


def test_word_table_long_texts_and_full_table(monkeypatch):
    monkeypatch.setattr(wordtable, "BATCH_BYTES", 64)
    monkeypatch.setattr(wordtable, "_FULL", 50)
    texts = ["ab c " * 100 + "d", "x" * 200, "é" * 30 + " y" * 40, "", "w1 w2"]
    enc = encoder(NAME)
    table = wordtable.WordTable(enc.whole, enc.table.merge)
    for _ in range(3):
        ids, counts = table.batch(texts)
        assert ids.tolist() == [i for t in texts for i in truth(t)]
        assert counts.tolist() == [len(truth(t)) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 2560, 70000, 400000])
@pytest.mark.parametrize("kind", ["even", "same", "skewed"])
def test_range_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    x = {"even": rng.integers(0, 49408, n), "same": np.full(n, 7), "skewed": rng.zipf(1.3, n) % 49408}[kind].astype("<u4")
    code = encode_ids(x, 49408)
    assert (decode_ids(code) == x).all()
    if n:
        broken = bytearray(code)
        broken[-3] ^= 0x55
        broken[len(code) // 2] ^= 0x55
        with pytest.raises(ValueError):
            decode_ids(bytes(broken))


def test_range_coder_beats_plain_compression():
    words = np.random.default_rng(1).integers(0, 40000, 400)
    x = words[(np.random.default_rng(2).zipf(1.2, 200000) % 400)].astype("<u4")
    assert len(encode_ids(x, 49408)) < len(zlib.compress(x.astype("<u2").tobytes()))


def test_range_coder_beats_zstd_on_documents():
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")["text"].fillna("").tolist()
    x = np.concatenate([np.append(y, 1) for y in encoder(NAME).each(texts)]).astype("<u4")
    code = encode_ids(x, 49408)
    assert (decode_ids(code) == x).all()
    assert len(code) < len(zstandard.ZstdCompressor(19).compress(x.astype("<u2").tobytes()))


def test_segments_are_reset():
    x = (np.arange(SEGMENT + 1000) % 300).astype("<u4")
    code = encode_ids(x, 49408)
    assert (decode_ids(code) == x).all()
    assert code.endswith(encode_ids(x[SEGMENT:], 49408))


def test_damaged_heads_fail():
    code = encode_ids(np.arange(2000, dtype="<u4"), 49408)
    for at, value in ((0, 0), (7, 255), (12, 9)):
        broken = bytearray(code)
        broken[at] = value
        with pytest.raises(ValueError):
            decode_ids(bytes(broken))


def test_store_round_trip(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/store"
    write_ids(make_docs(ROWS), path, NAME)
    got = sorted(read_ids(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    want, at = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 0
    assert len(got) == len(want)
    for r, (doc_id, text, _) in zip(got, want):
        ids = np.array([*truth(text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r["ids"]) == ids.tobytes()
        at += len(ids)


def test_store_of_nothing(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/store"
    write_ids(make_docs([]), path, NAME)
    assert read_ids(spark, path).count() == 0


def test_counts_use_and_fill_the_cache(spark, make_docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = make_docs(ROWS)
    for _ in range(2):
        got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, cache, NAME).collect())
        assert got == sorted((i or 0, len((t or "").encode()), len(truth(t))) for i, t, _ in ROWS)
        assert spark.read.parquet(cache).count() == 5  # distinct contents, null and empty being one
    # stored counts are used
    spark.read.parquet(cache).selectExpr("digest", "n_tokens + 100 AS n_tokens", "version").write.parquet(f"{cache}-other")
    assert {r["n_tokens"] for r in count_tokens(docs, f"{cache}-other", NAME).collect()} == {len(truth(t)) + 100 for _, t, _ in ROWS}
    # entries stored twice count once
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert count_tokens(docs, cache, NAME).count() == len(ROWS)


def test_counts_of_nothing_and_of_other_tokenizers(spark, make_docs, tmp_path):
    assert count_tokens(make_docs([]), f"file://{tmp_path}/a", NAME).count() == 0
    import public_tokenizers
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(make_docs(ROWS[:4]), f"file://{tmp_path}/b", "piece_bpe_32k.model").collect()}
    assert got == {i: len(piece.encode(t or "")) for i, t, _ in ROWS[:4]}


def check_pieces(pieces, docs, limit):
    """Every id in exactly one piece, sequences gapless and without needless padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    for doc_id, ids in docs.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p[1]):
            assert p[1] == at and bytes(p[3]) == ids[at : at + p[2]].tobytes() and p[4] == len(ids)
            at += p[2]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at == limit or at & (at - 1) == 0 and at < limit


@pytest.mark.parametrize("sizes", [[1], [2048], [2047, 2], [5000, 1, 1, 700], [1] * 2049])
def test_pack_stream(sizes):
    docs = {k: np.arange(n, dtype="<u4") for k, n in enumerate(sizes)}
    pieces = [(*p[:3], p[3].tobytes(), *p[4:]) for p in pack_stream(iter(docs.items()), 2048, 10)]
    check_pieces(pieces, docs, 2048)


def test_pack_table(spark, make_docs):
    rows = [r for r in ROWS if r[0] is not None][:4] + [(5, ROWS[5][1], "b"), (6, ROWS[3][1], "b")]
    docs = {i: np.array([*truth(t), 1], "<u4") for i, t, _ in rows}
    check_pieces([tuple(r) for r in pack(make_docs(rows), NAME).collect()], docs, 2048)
    assert pack(make_docs([]), NAME).count() == 0
    assert pack(make_docs(ROWS), NAME).filter("doc_id is null").count() == 1


def test_pack_puts_like_documents_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    order = [r["doc_id"] for r in pack(docs, NAME).orderBy("sequence_id", "offset").collect()]
    same = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:])])
    shares = np.unique(list(lang.values()), return_counts=True)[1] / len(lang)
    assert same > (shares**2).sum() + 0.2
