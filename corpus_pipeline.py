"""The corpus pipeline: five stages over the table of documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm.common import Workspace, without
from spectrafold.llm.exact_dedup import exact_dedup
from spectrafold.llm.mixing import mix_rows
from spectrafold.llm.near_dedup import near_groups
from spectrafold.llm.packing import pack
from spectrafold.llm.quality import fit_quality, score_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))
    renamed = docs.toDF(*[f"in_{c}" for c in docs.columns])  # a document may have a column named score
    scored = score_quality(renamed, model, text_col="in_text", carry=tuple(renamed.columns))
    return scored.filter("predicted = 1").select(*renamed.columns).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more): the one with the smallest id."""
    work = Workspace(spark, "near-stage", tidy=True)
    gone = near_groups(docs, percent=80, work=work).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Workspace(spark, "near-gone", tidy=True).save(gone, "ids")
    work.drop()
    return without(docs, "doc_id", gone, "__gone")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and a last one where it takes half of the words or more; repeats carry the same id."""
    return mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    pieces = pack(docs, "word_bpe_49k.json", limit=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the coders have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), str(k))
        if k:
            work.drop(str(k - 1))
    return docs
