"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, in_few_files


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).collect()[0])


#: Edges that one task contracts: 16 bytes each.
CHUNK = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the partition's edges: every node but the least of its part, with that least node."""
    leader: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while leader.setdefault(root, root) != root:
            root = leader[root]
        while leader[x] != root:
            leader[x], x = root, leader[x]
        return root

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            x, y = find(u), find(v)
            if x != y:
                leader[max(x, y)] = min(x, y)
    found = [(x, find(x)) for x in list(leader)]
    yield pd.DataFrame([p for p in found if p[0] != p[1]], columns=["u", "v"], dtype=np.int64)


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(u, v) for every node u of ``edges`` (columns a, b) that isn't its component's smallest node v.

    Null ends don't count; an empty table gives an empty one.  The edges are dealt
    to tasks of about CHUNK, each of which contracts its own; then large-star and
    small-star steps alternate until nothing changes, about log² of the longest path
    that contraction leaves.  Every step's edges are a written table; minima are
    combined before the shuffle, and adaptive execution splits a hub's side of the
    joins.  Only a count and a checksum reach the driver.
    """
    raw = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and a is not null and b is not null").distinct()
    raw = work.save(in_few_files(raw, 16 * edges.count()), f"{name}-raw")
    count = raw.count()
    tasks, size = -(-count // CHUNK) or 1, 16 * count
    # one task's result is final, so it must be one whatever becomes of a count given with a key
    dealt = raw.repartition(tasks, "v") if tasks > 1 else raw.coalesce(1)
    now, step = work.save(in_few_files(dealt.mapInPandas(_contract, "u long, v long").distinct(), size), f"{name}-0"), 0
    mark = None
    while (new := _mark(now)) != mark and new[0] and (step or tasks > 1):
        mark, step = new, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.col("x"), F.min("v")).alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = work.save(in_few_files(large, size), f"{name}-{step}-large")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        now = work.save(in_few_files(small.distinct(), size), f"{name}-{step}")
    return now
