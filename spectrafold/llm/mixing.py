"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates that meet each source's token target and lie between 0
and a cap, entropy balancing takes those closest to 1 in relative entropy.  The
convex dual has one multiplier for each source, and its solution tilts the rates
exponentially: rate = min(cap, exp(multiplier * size)).  Newton steps on the dual
need, for each source, two sums over the table of sizes; they run in Spark, the
driver holds one number per source.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, literal_rows, text_of

SLOTS = 256


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> dict[str | None, float]:
    """Each source's target: its weight's share of all sizes, at most ``cap`` times its own size.

    What a capped source leaves is shared among the others by weight, until none is
    above its cap.  Sources go by code point, null last; ``weights`` repeat.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    free, left = [s for s, _ in order], float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > cap * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * size[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


#: Up to so many sources are broadcast (some 100 bytes each); tables of more are joined.
MANY = 100_000


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row for each source."""
    table = literal_rows(spark, rows, schema)
    return F.broadcast(table) if len(rows) <= MANY else table


def _source_key(source: Column) -> Column:
    """A key that tells null from every text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def balance(sizes: DataFrame, target: dict[str, float], totals: dict[str, tuple[int, int]], cap: float, steps: int = 60, tolerance: float = 1e-7) -> dict[str, float]:
    """Dual multipliers by source key.  ``sizes``: key, size, n (documents of that size); ``totals``: key -> (documents, size).

    Newton's method on one monotone equation for each source, kept inside a bracket;
    sources that meet their target leave the iteration.  A target at the cap, or a
    source of empty documents, needs no step.
    """
    spark = sizes.sparkSession
    scale = {k: max(1.0, s / max(1, n)) for k, (n, s) in totals.items()}
    found = {k: math.inf for k, t in target.items() if t >= cap * totals[k][1]}
    state = {k: [0.0, -math.inf, math.inf] for k in target if k not in found}
    while state and steps:
        steps -= 1
        now = _table(spark, [(k, float(x[0] / scale[k])) for k, x in state.items()], "k string, m double")
        rate = F.exp(F.least(F.col("m") * F.col("size"), F.lit(50.0)))
        free = rate < cap
        mass = F.col("n") * F.col("size") * F.least(rate, F.lit(float(cap)))
        sums = sizes.join(now, sizes["key"] == now["k"]).groupBy("key").agg(F.sum(mass).alias("f"), F.sum(F.when(free, mass * F.col("size")).otherwise(0.0)).alias("d")).collect()
        for key, f, d in sums:
            x, lo, hi = state[key]
            gap = f - target[key]
            if abs(gap) <= tolerance * max(1.0, target[key]):
                found[key] = x / scale[key]
                del state[key]
                continue
            lo, hi = (lo, x) if gap > 0 else (x, hi)
            new = x - gap * scale[key] / d if d > 0 else math.nan
            if not lo < new < hi:
                new = (lo + hi) / 2 if math.isfinite(lo + hi) else (lo + 1 if hi == math.inf else hi - 1)
            state[key] = [min(max(new, x - 4), x + 4), lo, hi]
    if state:
        warnings.warn(f"{len(state)} sources miss their target after the last Newton step; rounding makes up for it", stacklevel=2)
    return found | {k: x[0] / scale[k] for k, x in state.items()}


def _number(id_col: str, text: Column, seed: int) -> Column:
    """A row's number between 0 and 1, of its id and text."""
    return (F.xxhash64(F.col(id_col), text, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """For every row: doc_id, source, size (words), source_size, target, rate, copies and taken (words).

    Rates are rounded into copies: floor(rate), and one more for the documents whose
    hashed number is smallest against the fraction, as many as the source's target
    asks for.  The last of them, one document or rows that can't be told apart, are
    repeated in part, so a source meets its target within a word for each such row.

    Null texts have size 0 and rate 1, and no words to take; null sources form a source of their
    own, last in order; ids may be null or repeated (numbers hash id and text, so
    repeated rows share them); an empty table, or one without words, takes nothing.
    Sums leave each task as one row per source and size or slot; nothing is grouped by
    document.  The rows per source that reach the driver grow with the number of
    sources, not of documents.  Reruns agree.
    """
    return _decide(docs, weights, cap, id_col, text_col, source_col, seed).drop("u")


def _decide(docs: DataFrame, weights: tuple[float, ...], cap: int, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The rows of :func:`mix`, and u, the number that rounds their rates."""
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    text = text_of(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        _number(id_col, text, seed).alias("u"),
    )
    base = work.save(base, "sizes").withColumn("key", _source_key(F.col("source")))
    counted = work.save(base.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_source = counted.groupBy("key", "source").agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).collect()
    goal = targets([(s, t) for _, s, _, t in by_source], weights, cap)
    goal = {k: goal[s] for k, s, _, _ in by_source}
    totals = {k: (n, t) for k, _, n, t in by_source}
    m = balance(counted, goal, totals, cap)

    rates = _table(spark, [(k, float(t), t_all[1], float(min(m[k], 1e300))) for k, t in goal.items() for t_all in [totals[k]]], "k string, target double, source_size long, m double")
    rate = F.least(F.exp(F.least(F.col("m") * F.col("size"), F.lit(50.0))), F.lit(float(cap)))
    rated = base.join(rates, F.col("key") == F.col("k")).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0)).withColumn("floor", F.floor("rate"))
    # a document is taken once more if its v is below the source's bound, wherever the cap leaves room
    rated = rated.withColumn("v", F.when((F.col("floor") < cap) & (F.col("size") > 0), (F.col("u") - (F.col("rate") - F.col("floor")) + 1) / 2))
    fixed = dict(rated.groupBy("key").agg(F.sum(F.col("floor") * F.col("size"))).collect())
    need = {k: goal[k] - (fixed.get(k) or 0) for k in goal}
    lo, width = {k: 0.0 for k in goal}, 1.0
    part = {k: 0.0 for k in goal}
    for _ in range(6):  # SLOTS ** 6 = 2 ** 48 slots in the end
        width /= SLOTS
        at = _table(spark, [(k, x) for k, x in lo.items()], "b string, lo double")
        slot = F.floor((F.col("v") - F.col("lo")) / width)
        seen = rated.filter("v is not null").join(at, F.col("key") == F.col("b")).withColumn("slot", slot).filter(f"slot between 0 and {SLOTS - 1}").groupBy("key", "slot").agg(F.sum("size")).collect()
        sums: dict[str, list] = {}
        for k, s, n in seen:
            sums.setdefault(k, []).append((s, n))
        for k in goal:
            inside = sorted(sums.get(k, []))
            for s, n in inside:
                if need[k] < n:
                    lo[k], part[k] = lo[k] + s * width, max(0.0, need[k] / n)
                    break
                need[k] -= n
            else:
                lo[k], part[k] = lo[k] + SLOTS * width, 0.0  # all inside are taken
        if not any(part.values()):
            break
    bounds = _table(spark, [(k, lo[k], part[k]) for k in goal], "b string, lo double, part double")
    more = F.when(F.col("v") < F.col("lo"), 1).otherwise(0)
    last = F.when((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + width), F.floor(F.col("size") * F.col("part") + 0.5)).otherwise(0)
    out = rated.join(bounds, F.col("key") == F.col("b")).withColumn("copies", (F.col("floor") + more).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size") + last).cast("long").alias("taken"), "u")


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` takes it, all columns; a partial copy counts from half of the words on.

    Rows find their decision by source, id and the number of their id and text, so
    repeated rows of a source share it and no row is numbered.
    """
    decided = _decide(docs, weights, cap, id_col, text_col, source_col, seed)
    times = F.col("copies") + F.when(2 * (F.col("taken") - F.col("copies") * F.col("size")) >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    decided = decided.select(F.col("doc_id").alias("__id"), F.col("u").alias("__u"), F.col("source").alias("__source"), times.cast("int").alias("__times")).filter("__times > 0").distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source")) & (_number(id_col, text_of(text_col), seed) == F.col("__u"))
    joined = docs.join(decided, same)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
