"""Near-dedup in rounds: the disk it takes where all texts are near copies, and the links of clusters of many blocks."""

import contextlib
import random
import threading
from pathlib import Path

import pytest

from spectrafold.llm import near_dedup
from spectrafold.llm.common import Workspace
from spectrafold.llm.near_dedup import near_groups

from .test_dedup import brute_near


@pytest.fixture
def shuffle_peak(spark, monkeypatch):
    """Calls a function with small rounds; gives its result and the most bytes of new shuffle files at one time."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [Path(d.getAbsolutePath()) for d in disk.localDirs()]
    monkeypatch.setattr(near_dedup, "ROUND_BYTES", 1 << 16, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def files():
        found = {}
        for p in (p for root in roots for p in root.glob("*/shuffle_*.data")):
            with contextlib.suppress(OSError):  # it went meanwhile
                found[p] = p.stat().st_size
        return found

    def run(call):
        old, most, over = set(files()), [0], threading.Event()

        def watch():
            while not over.wait(0.02):
                most[0] = max(most[0], sum(n for p, n in files().items() if p not in old))

        thread = threading.Thread(target=watch)
        thread.start()
        try:
            return call(), most[0]
        finally:
            over.set()
            thread.join()

    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_all_near_copies_in_rounds(spark, make_docs, shuffle_peak):
    """Every text has a near copy: their sets aren't all sent at a time."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        words = [rng.randbytes(4).hex() for _ in range(1500)]
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join([*words, "more"]), "s")]
    docs = make_docs(rows)
    got, peak = shuffle_peak(lambda: near_groups(docs, percent=85).collect())
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i // 2 * 2) for i, _, _ in rows]
    assert peak < 300 * 1496 * 8 * 3 / 4, peak


def test_cluster_in_rounds(spark, make_docs, monkeypatch):
    """Copies that drift apart make clusters of many blocks, which are compared in several rounds."""
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "ROUND_BYTES", 1)
    made, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, *a: made.append(name) or save(self, df, name, *a))
    rng = random.Random(7)
    base = [rng.randbytes(4).hex() for _ in range(120)]
    rows = []
    for k in range(50):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.randbytes(4).hex()
        rows.append((k, " ".join(copy), "s"))
    component, _ = brute_near(rows, 85)
    assert 1 < len(set(component.values())) < 45
    got = near_groups(make_docs(rows), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert {"links-1-1", "links-2-1"} <= set(made)
