import math
import os
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import quality, toxicity
from spectrafold.llm.queries import op1_toxicity, op10_quality

LABELS = "doc_id long, label int"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def made_texts(seed, n):
    """Pseudo-words, some texts with abuse; held-out ones spell it differently."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9)))
    common = [word() for _ in range(300)]
    texts, labels = [], []
    for k in range(n):
        t = list(rng.choice(common, rng.integers(20, 120)))
        bad = k % 3 == 0
        for _ in range(rng.integers(2, 6) if bad else 0):
            t.insert(rng.integers(len(t)), rng.choice(["dreadfool", "muckbrain", "wretchling"]))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_learns_subwords():
    texts, y = made_texts(1, 600)
    docs, bags = toxicity.encode(texts)
    model = toxicity.train(docs, y.astype(float), bags, steps=300)
    scorer = toxicity._Scorer(model)
    fresh, z = made_texts(2, 150)
    s = np.array(scorer.scores(fresh))
    assert auc(s, z) > 0.98 and ((s >= 0.5) == z).mean() > 0.93
    margins = dict(zip(["muckbrain", "muckbrian", "muckbrainz", "ratetilno"], model.word_margins(["muckbrain", "muckbrian", "muckbrainz", "ratetilno"])))
    assert margins["muckbrainz"] > margins["ratetilno"] and margins["muckbrian"] > margins["ratetilno"]


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_odd_tables(spark, make_docs, fit, score):
    rows = [(1, None, "s"), (2, "", "s"), (3, "word " * 20000, None), (4, "a b", "s"), (4, "a b", "s"), (None, "x", "s"), (5, "\n\n", "s")]
    docs = make_docs(rows)
    for labels in ([], [(1, 1), (4, 0), (4, 1), (None, 1), (3, None)]):
        model = fit(docs, spark.createDataFrame(labels, LABELS))
        got = score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert score(make_docs([]), model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, sf, tmp_path):
    """Turning every held-out label around changes no score."""
    for query, mod, held, column in ((op1_toxicity, 5, 0, "toxic"), (op10_quality, 3, 1, "quality")):
        folder = tmp_path / column
        folder.mkdir()
        os.symlink(f"{sf}/documents.parquet", folder / "documents.parquet")
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        turned = F.when(F.crc32(F.col("doc_id").cast("string")) % mod == held, 1 - F.col(column)).otherwise(F.col(column))
        labels.withColumn(column, turned).write.parquet(f"{folder}/labels.parquet")
        rows = query(spark, sf).collect()
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in rows)
        assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in query(spark, str(folder)).collect()}


def test_scores_match_a_plain_scorer(spark, make_docs):
    """Word by word, gram by gram, without memo or numpy sums."""
    texts, y = made_texts(3, 200)
    docs, bags = toxicity.encode(texts)
    model = toxicity.train(docs, y.astype(float), bags, steps=60)
    said = [*texts[:40], "", None, "muckbrain", "one two three four", " \n ", "Dreadfool! " * 5000]

    def plain(text):
        words = (text or "").lower().split()
        means = [sum(float(model.margins[g]) for g in toxicity.grams([w])[0]) / len(toxicity.grams([w])[0]) for w in words]
        passages = [means[k : k + toxicity.WINDOW] for k in range(0, len(means), toxicity.WINDOW)] or [[0.0]]
        margins = [sum(p) / len(p) + model.bias for p in passages]
        top = max(margins)
        return 1 / (1 + math.exp(-(top + math.log(sum(math.exp(m - top) for m in margins)))))

    got = {r["doc_id"]: r for r in toxicity.score_toxicity(make_docs([(k, t, "s") for k, t in enumerate(said)]), model).collect()}
    for k, t in enumerate(said):
        assert abs(got[k]["score"] - plain(t)) < 1e-5 and got[k]["predicted"] == int(got[k]["score"] >= 0.5)


def test_grams():
    flat, size = toxicity.grams(["abcd", "...", "(abcd)", "a", "añb\ud800"])
    assert size.tolist() == [10, 1, 10, 1, 10] and flat[:10].tolist() == flat[11:21].tolist() and flat.max() < toxicity.BUCKETS
    assert len(set(flat[:10].tolist())) == 10


def test_quality_scores_match_a_plain_scorer(spark, make_docs):
    """Feature by feature and pair by pair, by looking each bin up on its own."""
    texts, y = made_texts(4, 300)
    x = quality._matrix(pd.Series(texts))
    model = quality.train(x, y.astype(float), rounds=10)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(make_docs([(k, t, "s") for k, t in enumerate(texts)]), model).collect()}

    for k in range(0, 300, 7):
        own = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x[k])]
        coarse = [sum(1 for e in edges if e <= v) for edges, v in zip(model.coarse, x[k])]
        z = model.bias + sum(t[c] for t, c in zip(model.tables, own)) + sum(t[coarse[i]][coarse[j]] for i, j, t in model.pairs)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op10_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    y = np.array([label[r["doc_id"]] for r in rows])
    assert auc(np.array([r["score"] for r in rows]), y) > 0.97
    assert np.mean([r["predicted"] for r in rows] == y) > 0.95


def test_quality_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000], rounds=20)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert auc(model.margin(x[3000:]), y[3000:]) > 0.95


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op1_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    y = np.array([label[r["doc_id"]] for r in rows])
    assert auc(np.array([r["score"] for r in rows]), y) > 0.97


def test_toxicity_learns_long_texts(spark, make_docs, monkeypatch):
    """Length doesn't keep a labelled text out of training."""
    sizes = {k: 40_000 if k % 2 else 400 for k in range(20)}
    docs = make_docs([(k, "abcd efgh " * (n // 2), "s") for k, n in sizes.items()])
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in sizes], LABELS)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, bags: seen.append((sorted(map(len, texts)), len(bags))))
    toxicity.fit_toxicity(docs, labels)
    toxicity.fit_toxicity(docs, labels, max_per_class=3)
    assert seen[0] == (sorted(sizes.values()), 2) and len(seen[1][0]) == 6
