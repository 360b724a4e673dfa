"""The operators as queries over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import fold, format_chats, parse_chats, turn_events
from .common import Workspace, documents, partitions, text_of
from .exact_dedup import exact_groups
from .fingerprints import as_text, lanes, likeness, with_next
from .mixing import mix
from .near_dedup import near_groups
from .packing import pack
from .quality import fit_quality, score_quality
from .token_counts import count_tokens
from .token_store import read_ids, write_ids
from .toxicity import fit_toxicity, score_toxicity

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels.filter(~held).select("doc_id", F.col("toxic").alias("label")))
    return score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model, carry=("doc_id", "held_out"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "token-store").path("ids")
    write_ids(documents(spark, sf_dir), path, TOKENIZER, end_id=1)
    return read_ids(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(documents(spark, sf_dir), Workspace(spark, "token-counts").path("cache"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), TOKENIZER, limit=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), weights=(1, 2, 3), cap=3).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), percent=85)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = parse_chats(format_chats(fold(turn_events(table.unionByName(own)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    pairs = with_next(docs, partitions(spark))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    both = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "lanes", "next_lanes", edited.alias("edited"))
    done = both.withColumn("edited_lanes", lanes(F.col("edited")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(text_of(), 256).alias("text_sha256"))
    return exact_groups(docs, carry=("text_sha256",))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_quality(docs, labels.filter(~held).select("doc_id", F.col("quality").alias("label")))
    return score_quality(docs.select("doc_id", "text", held.alias("held_out")), model, carry=("doc_id", "held_out"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    here = sys.modules[__name__]
    names = ["op1_toxicity", "op2_token_ids", "op3_token_counts", "op4_packing", "op5_mixing", "op6_near_dedup", "op7_chat", "op8_fingerprints", "op9_exact_dedup", "op10_quality", "pipeline"]
    return {n: getattr(here, n) for n in names}


def oracle_sql() -> dict[str, str]:
    escaped = r"""regexp_replace(replace({}, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\])', '\1\\\2', 'g')"""
    return {
        "op7_chat": f"""
            WITH c AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
            m AS (
                SELECT conv_id, count(*) AS n_turns,
                    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                    coalesce(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
                    CAST(sum(17 + length({escaped.format("role")}) + length({escaped.format("text")})) AS BIGINT) AS formatted_chars
                FROM c GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM m""",
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    }
