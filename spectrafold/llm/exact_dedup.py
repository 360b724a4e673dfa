"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are grouped by length, then by a hash of their first characters, both counted
in one scan, as a prefix group lies within its length's group.  Groups of one are
unique and done.  A second scan hashes the full texts of surviving groups only, and
equal full hashes are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, carried, few, text_of

PREFIX = 64
_LENGTH, _PREFIX = "__exact_length", "__exact_prefix"


def _keys(text: Column) -> dict[str, Column]:
    return {_LENGTH: F.octet_length(text), _PREFIX: F.xxhash64(F.substring(text, 1, PREFIX))}


def _survivors(docs: DataFrame, text: Column) -> DataFrame:
    """Length and prefix hash of groups of two texts or more; a row per group and map task is shuffled, no text."""
    keyed = docs.select(*[c.alias(name) for name, c in _keys(text).items()])
    groups = keyed.groupBy(_LENGTH, _PREFIX).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select(F.col(_LENGTH).alias("s_length"), F.col(_PREFIX).alias("s_prefix"))


def _survives() -> Column:
    return (F.col(_LENGTH) == F.col("s_length")) & (F.col(_PREFIX) == F.col("s_prefix"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept and the ``carry`` columns.

    Of equal texts the row with the largest id stays.  Null texts count as empty;
    null ids come before all others; of repeated rows (equal ids and texts) one
    stays; empty tables give empty results.  A carried column named as one of the
    result's is left out.

    Rows are numbered once, in a written table without texts.  Groups are summed up
    on the map side, so a group of a third of all rows sends one row per task; the
    join that hands the group's keeper to its rows carries no texts, and adaptive
    execution splits its skewed side.
    """
    text, work = text_of(text_col), Workspace(docs.sparkSession, "exact-dedup")
    carry = carried(carry, ("doc_id", "keep_id", "group_size", "kept"))
    survivors = work.save(_survivors(docs, text), "survivors")
    read = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *[c.alias(n) for n, c in _keys(text).items()], *[F.col(c).alias(f"__carry_{c}") for c in carry])
    marked = read.join(few(survivors), _survives(), "left")
    full = F.when(F.col("s_length").isNotNull(), F.unhex(F.sha2("__text", 256)))
    hashed = marked.select("__id", F.col(_LENGTH), full.alias("__full"), F.monotonically_increasing_id().alias("__row"), *[f"__carry_{c}" for c in carry])
    hashed = work.save(hashed, "hashed")
    groups = (
        hashed.filter("__full is not null")
        .groupBy(F.col("__full").alias("g_full"), F.col(_LENGTH).alias("g_length"))
        .agg(F.max(F.struct("__id", "__row")).alias("best"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    # a written table, so that both sides of the last join are plain shuffles, which can be split
    groups = work.save(groups, "groups")
    # a row of no group gets a key of its own, so that such rows don't meet in one task
    key = F.coalesce("__full", F.col("__row").cast("string").cast("binary"))
    joined = hashed.withColumn("__key", key).join(groups, (F.col("__key") == F.col("g_full")) & (F.col(_LENGTH) == F.col("g_length")), "left")
    alone = F.col("size").isNull()
    return joined.select(
        F.col("__id").alias("doc_id"),
        F.when(alone, F.col("__id")).otherwise(F.col("best.__id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.__row") == F.col("__row"))).alias("kept"),
        *[F.col(f"__carry_{c}").alias(c) for c in carry],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, under the rules of :func:`exact_groups`.

    Rows outside surviving groups pass as they are; of the others each map task sends
    one row for each text.  Of repeated rows the one with the largest hash of all
    columns stays (maps don't count).
    """
    text = text_of(text_col)
    survivors = Workspace(docs.sparkSession, "exact-dedup").save(_survivors(docs, text), "survivors")
    survivors = few(survivors)
    keyed = docs.withColumns(_keys(text))
    alone = keyed.join(survivors, _survives(), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed.join(survivors, _survives(), "left_semi")
    order = F.struct(F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    best = rows.groupBy(_LENGTH, F.sha2(text, 256).alias("__full")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("best"))
    return alone.unionByName(best.select("best.*"))
