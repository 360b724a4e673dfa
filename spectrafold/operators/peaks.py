"""Operators on peaks (block, mz, intensity) and scans, by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ef_high, ef_low, ef_width, keeps_peak, mz_quantize, sqrt_quantize


def zero_filter(peaks: DataFrame, intensity: str = "intensity", skip_zero: bool = True) -> DataFrame:
    return peaks.filter(keeps_peak(F.col(intensity))) if skip_zero else peaks


def min_peaks(peaks: DataFrame, block: str = "block", least: int = 10) -> DataFrame:
    """Peaks of blocks that have ``least`` raw peaks or more."""
    enough = peaks.groupBy(block).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(F.col(block).alias("__b"))
    return peaks.join(enough, F.col(block) == F.col("__b"), "left_semi")


def quantize(peaks: DataFrame, precision: float = 0.001) -> DataFrame:
    return peaks.withColumns({"q": mz_quantize(F.col("mz"), precision), "d": sqrt_quantize(F.col("intensity"))})


def ordered(block: str, *order: str):
    return Window.partitionBy(block).orderBy(*order)


def prefix_sum(df: DataFrame, value: str, name: str, block: str, *order: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(ordered(block, *order).rowsBetween(Window.unboundedPreceding, 0)))


def delta_decode(df: DataFrame, sums: str, name: str, block: str, *order: str) -> DataFrame:
    return df.withColumn(name, F.col(sums) - F.lag(sums, 1, 0).over(ordered(block, *order)))


def ef_split(df: DataFrame, value: str, block: str, *order: str) -> DataFrame:
    """The logical Elias-Fano code of a non-decreasing column: i, n, width, hi, lo, bitpos."""
    everything = Window.partitionBy(block)
    out = df.withColumns({"n": F.count(F.lit(1)).over(everything), "last": F.max(value).over(everything), "i": F.row_number().over(ordered(block, *order)) - 1})
    out = out.withColumn("width", ef_width(F.col("n"), F.col("last")))
    out = out.withColumns({"hi": ef_high(F.col(value), F.col("width")), "lo": ef_low(F.col(value), F.col("width"))})
    return out.withColumn("bitpos", F.col("hi") + F.col("i"))


def baseline(peaks: DataFrame, block: str, intensity: str, rule) -> DataFrame:
    """Adds ``b``: the rule of intensity and its block's least intensity."""
    return peaks.withColumn("floor", F.min(intensity).over(Window.partitionBy(block))).withColumn("b", rule(F.col(intensity), F.col("floor")))


def collect_peaks(peaks: DataFrame, *by: str, order: tuple[str, ...] = ("mz", "intensity")) -> DataFrame:
    """One row for each block with its ordered arrays."""
    packed = peaks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("peaks"))
    return packed.select(*by, *[F.transform("peaks", lambda p: p[c]).alias(c) for c in order])


def symbol_ranks(df: DataFrame, batch: str, symbol: str) -> DataFrame:
    """Frequency ranks of symbols in a batch, 0 for the most frequent, ties by symbol."""
    counts = df.groupBy(batch, symbol).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc("n"), symbol)) - 1)


def range_join(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Equal keys and low <= point <= high; ``ranges`` names its key ``r_<key>``."""
    return points.join(ranges, (F.col(key) == F.col(f"r_{key}")) & F.col(point).between(F.col(low), F.col(high)))


def dictionary_join(df: DataFrame, dictionary: DataFrame, code: str, key: str, name: str) -> DataFrame:
    """Left lookup; a missing code gives the empty string."""
    return df.join(dictionary, F.col(code) == F.col(key), "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))


def gather(array: Column, index: Column) -> Column:
    """Elements of an array at 0-based places."""
    return F.transform(index, lambda k: F.get(array, k))


def axes_agree(axis: DataFrame, place: str, value: str, digits: int = 6) -> DataFrame:
    """Places at which files disagree beyond a truncation to ``digits``."""
    return axis.groupBy(place).agg(F.count_distinct(F.floor(F.col(value) * 10**digits)).alias("kinds")).filter("kinds > 1")
