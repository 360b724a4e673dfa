"""File-based streaming ingest: scans arrive as Parquet files, blocks leave as Parquet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import encode_scans, filter_scans


def ingest_scans(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_per_trigger: int = 8, precision: float = 0.001, skip_zero: bool = True) -> StreamingQuery:
    """Encodes every scan file that appears in ``folder``; runs until all present files are done.

    A batch is written under its own number, so a repeated batch after a failure
    replaces its first attempt.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        blocks = encode_scans(filter_scans(batch, skip_zero), "binary", precision)
        blocks.withColumn("length", F.octet_length("payload")).write.mode("overwrite").option("compression", "none").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by kind in tumbling windows of event time, with a bound on lateness."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
