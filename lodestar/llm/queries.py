"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chat, decontaminate, html_text, importance, language, mixing, oracle, rules, secrets, simhash, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secrets.STRONG))
    count = lambda k: F.size(F.filter(spans, lambda s: s["rank"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count(k) for k in secrets.STRONG), F.sha2(secrets.named(base).cast("binary"), 256).alias("base_sha256"), secrets.named(spans).alias("spans"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("log_weight", 9).alias("log_weight"), F.round("key", 6).alias("key"), "selected")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = F.array(*(F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.inline(two)).select(*(F.col(f.name).cast(f.dataType) for f in turns.schema))
    found = chat.formatted(turns.unionByName(extra)).select("conv_id", "formatted", "loss", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    size = lambda c: F.length(c).cast("long")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), size(F.col("learnt")).alias("loss_chars"), digest(F.col("learnt")).alias("loss_sha256"), size(F.col("formatted")).alias("formatted_chars"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_read(spark, sf_dir, "pages"), language.fit(_read(spark, sf_dir, "documents")))
    return found.withColumn("probability", F.round("probability", 6))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(_read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "votes", F.round("posterior", 9).alias("posterior"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination,
        "op2_secret_scan": secret_scan,
        "op3_quality_classifier": quality_classifier,
        "op4_simhash_near_dedup": simhash_near_dedup,
        "op5_chat_formatting": chat_formatting,
        "op6_language_id": language_id,
        "op7_html_extraction": html_extraction,
        "op8_mixing_to_targets": mixing_to_targets,
        "op9_quality_rules": quality_rules,
        "op10_warc_round_trip": warc_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express. doc_ids of the tables are unique, as the SQL for the secret scan takes for granted."""
    return {
        "op2_secret_scan": oracle.secrets(secrets.STRONG, secrets.WEAK, secrets.ROLE, secrets.NEEDS, secrets.SCOPE),
        "op5_chat_formatting": oracle.CHAT,
        "op10_warc_round_trip": oracle.WARC,
    }
