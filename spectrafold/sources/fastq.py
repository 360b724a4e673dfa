"""Sequencing reads from FASTQ text, split over tasks by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import bounded_batches

_READ = "file string, read_id long, identifier string, sequence string, quality string, n long"
_NAMES = [c.split()[0] for c in _READ.split(", ")]


def _reads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole reads of each split (n is 4), and the lines of reads that begin or end in another one (n is 1)."""
    name, at, held, first = None, 0, np.zeros(0, object), True

    def single(file, number, lines):
        cells = [[None] * 3 for _ in lines]
        for k, line in enumerate(lines):
            if (number + k) % 4 != 2:
                cells[k][(0, 1, None, 2)[(number + k) % 4]] = line
        return pd.DataFrame([(file, (number + k) // 4, *c, 1) for k, c in enumerate(cells)], columns=_NAMES)

    for b in batches:
        split, file, line, base = (b[c].to_numpy() for c in ("split", "file", "line", "base"))
        cuts = np.flatnonzero((split[1:] != split[:-1]) | (file[1:] != file[:-1])) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(b)]) if len(b) else ():
            if name != (file[lo], split[lo]):
                if len(held):
                    yield single(name[0], at, held)
                name, at, held, first = (file[lo], split[lo]), int(base[lo]), np.zeros(0, object), True
            lines = np.r_[held, line[lo:hi]]
            lead = min(-at % 4, len(lines)) if first else 0
            if lead:  # the end of a read that another split begins
                yield single(name[0], at, lines[:lead])
                at, lines = at + lead, lines[lead:]
            first = first and at % 4 != 0
            whole = len(lines) // 4
            if whole:
                rows = lines[: 4 * whole].reshape(whole, 4)
                yield pd.DataFrame(dict(zip(_NAMES, (name[0], at // 4 + np.arange(whole), rows[:, 0], rows[:, 1], rows[:, 3], 4))))
            at, held = at + 4 * whole, lines[4 * whole :]
    if len(held):
        yield single(name[0], at, held)


def read_fastq(spark: SparkSession, path: str | list[str], continuous: bool = False) -> DataFrame:
    """file, read_id (from 0 in each file, or over all files by name), identifier, sequence, quality.

    Splits are counted first, a row each; then every task cuts its splits into reads,
    and only reads that lie across splits are shuffled.  Carriage returns go; a last
    line without an end counts; the separator line isn't kept; an incomplete last
    read is an error.
    """
    bounded_batches(spark)
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    counts = lines.groupBy(F.col("file").alias("f"), F.col("split").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("f", "s") if continuous else Window.partitionBy("f").orderBy("s")
    before = F.broadcast(counts.select("f", "s", (F.sum("n").over(order) - F.col("n")).alias("base")))  # a row for each split
    numbered = lines.join(before, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select("line", "file", "split", "base")
    cut = numbered.mapInPandas(_reads, _READ)
    across = cut.filter("n < 4").groupBy("file", "read_id").agg(*[F.max(c).alias(c) for c in ("identifier", "sequence", "quality")], F.sum("n").alias("n"))
    reads = cut.filter("n = 4").unionByName(across)
    whole = F.when(F.col("n") == 4, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("incomplete read in "), F.col("file"))).cast("string"))
    return reads.select("file", "read_id", "identifier", whole.alias("sequence"), "quality")


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads as text in order of file and read id, `+` as the separator line."""
    line = F.concat_ws("\n", "identifier", "sequence", F.lit("+"), "quality")
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reads.repartitionByRange(n, "file", "read_id").sortWithinPartitions("file", "read_id").select(line.alias("value")).write.mode("overwrite").text(path)
