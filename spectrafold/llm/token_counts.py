"""Token counts through a digest cache.

A text's count is stored under (content digest, tokenizer version).  Only texts
whose digest is not stored yet are encoded, each distinct one once; their counts
are appended to the cache, and every document gets its count by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried
from .tokens import encoder, tokenizer_digest

_CACHE = "digest binary, n_tokens long, version string"


def _digest(text: Column, tokenizer: str) -> tuple[Column, Column]:
    """The normalised content and its digest: outer blanks go where the tokenizer drops white space anyway."""
    content = F.btrim(text, F.lit(" \t\r\n")) if "word_bpe" in tokenizer else text
    return content, F.unhex(F.sha2(content, 256))


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where the cache doesn't exist yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(path).filter(F.col("version") == version)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "word_bpe_49k.json", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, n_bytes (UTF-8) and n_tokens of every row of ``docs``.

    ``cache`` is a Parquet folder on storage that all executors reach.  Null texts
    count as empty (0 bytes, 0 tokens); repeated rows and copies of a text each get
    their row; an empty table gives an empty one and leaves the cache alone in
    content.  Copies are merged before the shuffle, so a text that fills a third of
    the table moves once per map task; the last join is on digests only, and its
    skewed side is split by adaptive execution.  Carried columns named n_bytes or
    n_tokens give way to those of the result.  Two runs that append the same
    digest at once leave equal entries, which later runs merge as they read.
    """
    spark = docs.sparkSession
    carry = carried(carry, ("n_bytes", "n_tokens"))
    bounded_batches(spark)
    version = tokenizer_digest(tokenizer)
    content, digest = _digest(F.coalesce(F.col(text_col).cast("string"), F.lit("")), tokenizer)
    known = read_cache(spark, cache, version).select("digest")
    missing = docs.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content")).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": enc.batch(b["content"].tolist())[1]})

    missing.mapInPandas(encode, "digest binary, n_tokens long").withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    # two runs at once may have stored an entry twice, with the same count
    stored = read_cache(spark, cache, version).dropDuplicates(["digest"])
    rows = docs.select(*[F.col(c).alias(f"__carry_{c}") for c in carry], F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), digest.alias("__digest"))
    joined = rows.join(stored.select("digest", "n_tokens"), F.col("__digest") == F.col("digest"), "left")
    return joined.select(*[F.col(f"__carry_{c}").alias(c) for c in carry], "n_bytes", "n_tokens")
