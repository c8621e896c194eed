"""The queries of this subpackage: each applies one operator to its whole table. ORACLE has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, dialogue, fingerprint, line_dedup, mixing, near_duplicates, pii, quality, simhash, spelling, token_counts, toxicity
from .common import table
from .oracles import ORACLE  # noqa: F401  (registered with the queries)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, names = mixing.copies(docs)
    size, n = F.col(names["size"]), F.col(names["copies"])
    return out.select("doc_id", size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), (size * n).alias("taken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weak_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    x = F.col(name)
    hit = F.aggregate(x["hits"], F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    ids = F.array_join(x["items"], ",")
    return out.select("doc_id", x["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the probe as conversation -1; rows that the table itself has under that number would be turns of one conversation with it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    return chat.digests(chat.format_chats(turns.union(probe)))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, score = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_lines, n_deleted: lines of the text and how many of them went (null for a null text, 0 for an empty one); kept_sha256: of what stayed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    lines = F.when(F.col("text").isNotNull(), lines)
    kept = line_dedup.dedup_lines(docs.withColumn("n_lines", lines), drop_emptied=False)
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - lines).alias("n_deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, drop_every=97))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_pii, op3_token_counts, op4_quality, op5_ngram_jaccard, op6_decontaminate, op7_chat_format, op8_fingerprint, op9_toxicity, op10_line_dedup, op11_simhash, op12_spelling_variants, op13_conversation_repair)}
