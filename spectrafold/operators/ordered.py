"""Ordered operators over a whole table without a single-task window.

Rows are dealt to ranges of their order column by approximate quantiles and each
range is a window of its own.  What a range needs of those before it is one row of
totals for each range, carried forward.  The dealt rows are written once, so what
lies below an operator is run twice, once for the quantiles and once for the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

_BUCKET, _CARRY, _LOCAL, _VALUE = "__bucket", "__carry", "__local", "__value"


def quantiles(df: DataFrame, order: str, n: int) -> list:
    """At most n - 1 ascending bounds that deal the values of ``order`` out evenly."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(20 * n))).collect()[0][0]
    return sorted(set(found or []))


def range_of(value: Column, bounds: list) -> Column:
    """Number of bounds below the value; found in two levels, so a row looks at about twice the square root of the bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    top = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inner = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), top)
    return top * step + F.coalesce(below(inner), F.lit(0))


def deal(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Adds the number of the row's range of ``order`` (a number); nulls come first, dealt by their hash to ranges of their own."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(n)).cast("int") - n
    return df.withColumn(_BUCKET, F.when(F.col(order).isNull(), hashed).otherwise(range_of(F.col(order), quantiles(df, order, n))))


def _in_range(order: str, ties: tuple[str, ...]):
    return Window.partitionBy(_BUCKET).orderBy(order, *ties)


def _with_carry(held: DataFrame, carry: list, kind: str, empty) -> DataFrame:
    table = held.sparkSession.createDataFrame(carry or [(0, empty)], f"b int, {_CARRY} {kind}")  # a row for each range
    return held.join(F.broadcast(table), F.col(_BUCKET) == F.col("b")).drop("b")


def running_sum(df: DataFrame, order: str, value: Column, name: str, ties: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including the row, over the whole table in ``order``; nulls add nothing."""
    dealt = deal(df.withColumn(_VALUE, value), order, ranges)
    local = F.sum(_VALUE).over(_in_range(order, ties).rowsBetween(Window.unboundedPreceding, 0))
    held = Workspace(df.sparkSession, "ordered").save(dealt.withColumn(_LOCAL, F.coalesce(local, F.lit(0))), "local")
    carry, at = [], 0
    for bucket, total in sorted((b, t or 0) for b, t in held.groupBy(_BUCKET).agg(F.sum(_VALUE)).collect()):
        carry.append((bucket, at))
        at += total
    return _with_carry(held, carry, "long", 0).withColumn(name, (F.col(_LOCAL) + F.col(_CARRY)).cast("long")).drop(_BUCKET, _CARRY, _VALUE, _LOCAL)


def with_previous(df: DataFrame, order: str, columns: list[str], ties: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds ``prev_<column>`` of the row before in ``order``, null for the first."""
    dealt = deal(df, order, ranges)
    schema = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in dealt.select(*columns).schema)
    held = Workspace(df.sparkSession, "ordered").save(dealt.withColumn(_LOCAL, F.lag(F.struct(*columns)).over(_in_range(order, ties))), "local")
    last = held.groupBy(_BUCKET).agg(F.max(F.struct(order, *ties, *columns)).alias("r")).select(_BUCKET, F.struct(*[F.col("r")[c].alias(c) for c in columns]).alias("r"))
    carry, before = [], None
    for b, r in sorted(last.collect(), key=lambda x: x[0]):
        carry.append((b, before))
        before = r
    joined = _with_carry(held, carry, f"struct<{schema}>", None).withColumn("__p", F.coalesce(_LOCAL, _CARRY))
    return joined.withColumns({f"prev_{c}": F.col("__p")[c] for c in columns}).drop(_BUCKET, _CARRY, _LOCAL, "__p")


def cycle_ids(scans: DataFrame, order: str, starts: Column, name: str = "cycle_id") -> DataFrame:
    """Running count of rows that start a cycle, from -1: rows before the first start have -1."""
    return running_sum(scans, order, F.when(starts, 1).otherwise(0), "__count").withColumn(name, F.col("__count") - 1).drop("__count")


def dense_index(df: DataFrame, order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of the row in the order, from 0."""
    return running_sum(df, order, F.lit(1), "__n", ties).withColumn(name, F.col("__n") - 1).drop("__n")


def offsets(df: DataFrame, order: str, length: Column, name: str = "offset") -> DataFrame:
    """Adds the exclusive prefix sum of lengths."""
    return running_sum(df.withColumn("__len", length), order, F.col("__len"), "__end").withColumn(name, F.col("__end") - F.col("__len")).drop("__end", "__len")


def runs(df: DataFrame, order: str, symbol: str) -> DataFrame:
    """Run-length encoding of the whole table: run_id (from 1), symbol, start (least order value), run.

    Each range is encoded on its own and its runs are written; a range's first run
    joins the run that the ranges before it leave open.
    """
    rows = df.select(order, F.col(symbol).alias("symbol"))
    span = _in_range(order, ())
    marked = deal(rows, order).withColumn("__c", F.when((F.row_number().over(span) > 1) & F.col("symbol").eqNullSafe(F.lag("symbol").over(span)), 0).otherwise(1))
    numbered = marked.withColumn(_LOCAL, F.sum("__c").over(span.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(_BUCKET, _LOCAL).agg(F.first("symbol").alias("symbol"), F.min(order).alias("start"), F.count(F.lit(1)).alias("run"))
    held = Workspace(df.sparkSession, "ordered").save(parts, "runs")
    ends = held.groupBy(_BUCKET).agg(F.max(_LOCAL), F.min_by(F.struct("symbol"), _LOCAL), F.max_by(F.struct("symbol"), _LOCAL)).collect()
    carry, at, open_run = [], 0, None
    for bucket, n, first, last in sorted(ends, key=lambda r: r[0]):
        at -= first == open_run
        carry.append((bucket, at))
        at, open_run = at + n, last
    whole = _with_carry(held, carry, "long", 0).groupBy((F.col(_LOCAL) + F.col(_CARRY)).alias("run_id"))
    return whole.agg(F.first("symbol").alias("symbol"), F.min("start").alias("start"), F.sum("run").alias("run"))
