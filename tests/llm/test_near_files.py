"""Near-dedup and components where there are many more shuffle partitions than rows ask for."""

import random

import pytest

from spectrafold.llm.common import Workspace
from spectrafold.llm.components import components
from spectrafold.llm.near_dedup import near_groups

from .test_dedup import brute_components, brute_near


def test_components_where_counts_are_raised(spark, monkeypatch):
    """A session may raise the counts given to repartition with a key: one task's edges then come to many."""
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: dealt(self, max(n, 16) if c and isinstance(n, int) else n, *c))
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()
    want = brute_components(edges, {n for e in edges for n in e})
    assert sorted((r["u"], r["v"]) for r in rows) == sorted((u, v) for u, v in want.items() if u != v)


@pytest.fixture
def many_partitions(spark):
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_of_small_tables(spark, make_docs, many_partitions, monkeypatch):
    """Written tables have a file for each task that runs at a time, not for each shuffle partition."""
    files, save = {}, Workspace.save

    def counted(self, df, name, *a):
        out = save(self, df, name, *a)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = [rng.randbytes(3).hex() for _ in range(60)] if k % 4 == 0 else [*words, rng.randbytes(3).hex()]
        rows.append((k, " ".join(words), "s"))
    got = near_groups(make_docs(rows), percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_near(rows, 85)[0]
    tasks = spark.sparkContext.defaultParallelism
    assert {"sets", "regions", "links-1", "links-2", "roots-2-0"} <= set(files)
    assert max(files.values()) <= tasks, files
    assert got.rdd.getNumPartitions() <= tasks
