"""Disk that near-dedup takes where ids are too many to be broadcast."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from spectrafold.llm import common
from spectrafold.llm.common import Workspace
from spectrafold.llm.near_dedup import near_groups


@pytest.fixture
def shuffled_bytes(spark, docs, monkeypatch):
    """The most bytes of shuffle files on disk after any table was written, beyond those of making the documents."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p: p.stat().st_size for d in disk.localDirs() for p in Path(d.getAbsolutePath()).rglob("shuffle_*.data")}
    old, most = set(files()), [0]
    save = Workspace.save

    def watched(self, *a):
        table = save(self, *a)
        most[0] = max(most[0], sum(n for p, n in files().items() if p not in old))
        return table

    monkeypatch.setattr(Workspace, "save", watched)
    monkeypatch.setattr(common, "FEW", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda: most[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def rows():
    """Long texts without near copies, two families of near copies, a repeated row, one id with two texts, and rows without an id."""
    rng = random.Random(17)
    text = lambda: " ".join(rng.randbytes(6).hex() for _ in range(1500))
    out = [(k, text(), "s") for k in range(300)]
    out += [(1000 + 10 * k + j, t + " more" * j, "s") for k in range(2) for t in [text()] for j in range(3)]
    return out + [(None, text(), "s"), (None, out[0][1], "s"), (5, out[5][1], "s"), (1001, "another text", "s")]


@pytest.fixture
def docs(make_docs, rows):
    return make_docs(rows)


def test_near_stage_shuffles_no_other_texts(spark, docs, shuffled_bytes, rows):
    kept = Workspace(spark, "t").save(corpus_pipeline.near_stage(spark, docs, ""), "kept")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted((i or -1, t) for i, t, _ in rows if i not in {1001, 1002, 1011, 1012})
    assert shuffled_bytes() < sum(len(t) for _, t, _ in rows) / 4


@pytest.mark.parametrize("few", [0, 1000])
def test_without(spark, monkeypatch, few):
    """Rows whose id is null or isn't among the keys, once each, with few keys and many, and few words in a sieve."""
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(common, "SIEVE", 2)
    ids = [*range(-300, 300), None, None, 7, 8]
    gone = Workspace(spark, "t").save(spark.createDataFrame([(k,) for k in range(-300, 300, 7)], "g long"), "gone")
    table = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id int, text string")
    got = [tuple(r) for r in common.without(table, "doc_id", gone, "g").collect()]
    assert sorted(got, key=str) == sorted([(i, str(i)) for i in ids if i is None or (i + 300) % 7], key=str)


def test_near_groups_shuffle_no_other_texts(spark, docs, shuffled_bytes, rows, monkeypatch):
    """Sets of finished steps go, too."""
    dropped, drop = set(), Workspace.drop
    monkeypatch.setattr(Workspace, "drop", lambda self, *names: dropped.update(names) or drop(self, *names))
    got = near_groups(docs, percent=85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == sorted((i or -1, (i if i < 1000 else i // 10 * 10) or -1) if i is not None else (-1, -1) for i, _, _ in rows)
    assert {"members-1", "members-2", "rare", "clustered"} <= dropped
    assert shuffled_bytes() < sum(len(t) for _, t, _ in rows) / 4
