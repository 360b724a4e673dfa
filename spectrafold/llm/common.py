"""Small helpers of the operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import BATCH_BYTES, BATCH_ROWS, bounded_batches  # noqa: F401
from ..workspace import Workspace  # noqa: F401

#: Separators of words, as a Java class: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """A text column, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def carried(carry: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
    """The carried columns without those that a result's own columns replace."""
    return tuple(c for c in carry if c.lower() not in own)


def id_columns(name: str = "doc_id") -> list[Column]:
    """An id for a Python stage: its value and whether it is null, since pandas holds integers with nulls as floats."""
    value = F.col(name).cast("long")
    return [F.coalesce(value, F.lit(0)).alias("doc_id"), value.isNull().alias("no_id")]


#: Rows of a written table that may be broadcast, at some 100 bytes each.
FEW = 200_000


def few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it has at most FEW rows; a larger one is joined by shuffles."""
    return F.broadcast(table) if table.count() <= FEW else table


#: Words of a sieve, 64 bits each: a fixed size whatever the table.
SIEVE = 1 << 18


def _sieved(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column may be among a table's keys (whole numbers), and rows whose column isn't, by a broadcast of bits."""
    word = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SIEVE)).cast("int")
    bit = lambda c: F.pmod(F.shiftright(F.xxhash64(F.col(c).cast("long")), 32), F.lit(64)).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key)))
    words = F.broadcast(keys.groupBy(word(key).alias("__word")).agg(bits.alias("__bits")))
    both = rows.join(words, word(column) == F.col("__word"), "left")
    hit = F.coalesce(F.getbit("__bits", bit(column)) == 1, F.lit(False))
    return both.filter(hit).drop("__word", "__bits"), both.filter(~hit).drop("__word", "__bits")


def matching(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows joined with a written table by a whole number.  A table of more than FEW rows is joined by shuffles, to which only rows go whose column may be in it."""
    if table.count() > FEW:
        rows = _sieved(rows, column, table, key)[0]
    return rows.join(few(table), F.col(column) == F.col(key))


def without(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column, a whole number or null, isn't among a written table's keys; of more than FEW keys, other rows aren't shuffled."""
    same = F.col(column) == F.col(key)
    if keys.count() <= FEW:
        return rows.join(F.broadcast(keys), same, "left_anti")
    perhaps, never = _sieved(rows, column, keys, key)
    return never.union(perhaps.join(keys, same, "left_anti"))


#: Bytes of rows that a written table's file has at least, where there are more files than tasks run at a time.
FILE_BYTES = 8 << 20


def in_few_files(df: DataFrame, size: int, deal: bool = False) -> DataFrame:
    """Rows of about ``size`` bytes, to be written by as many tasks as run at a time, or as FILE_BYTES ask for, not by one for each shuffle partition.

    Hadoop starts a process for each file it creates on a local disk, whose memory
    counts as the executor's once more while it starts.  With ``deal`` the rows are
    shuffled first, so costly work before stays with all its tasks.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    if not deal:
        return df.coalesce(tasks)
    return df.repartition(tasks) if tasks < partitions(df.sparkSession) else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from one literal, which takes no Python worker; infinite and missing numbers are kept."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows], allow_nan=True).replace("-Infinity", '"-Infinity"').replace(": Infinity", ': "Infinity"')
    typed = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{typed}>>")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
