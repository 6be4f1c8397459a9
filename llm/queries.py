"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.collocations import collocations, collocations_sql
from llm.decontaminate import decontaminate
from llm.hard_negatives import hard_negatives, hard_negatives_sql
from llm.language_id import identify_languages
from llm.lm_score import cross_entropy_difference
from llm.mixing import mix_sources, mixing_sql
from llm.near_dedup import near_dedup
from llm.passages import repeated_passages
from llm.quality import MEASURES, clean_lines
from llm.secrets import BASE, as_text, find_secrets
from llm.shared import keep_table, maybe_broadcast, table
from llm.token_counts import count_tokens
from llm.toxicity import fold_of, score_toxicity
from llm.warc import read_archives, write_archives


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Few keys are broadcast, so that the texts are not shuffled for them.
    marked = docs.join(maybe_broadcast(keep_table(good)), F.col("doc_id") == F.col("_good"), "left")
    return cross_entropy_difference(marked, F.col("_good").isNotNull())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *MEASURES, "base_failed", "kept", "lost")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), passage=50, percent=80)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), least=0))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=5, percent=85)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [rule.kind for rule in BASE]
    found = find_secrets(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(number, kinds), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, cover=50)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fold_of(F.col("doc_id")) != 2)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved on by one, so that the nearest rows are not all of the same label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, label=label, positives=5, negatives=3, low=50, high=95, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_score,
        op2_token_counts,
        op3_toxicity,
        op4_clean_lines,
        op5_mix_sources,
        op6_repeated_passages,
        op7_warc,
        op8_decontaminate,
        op9_minhash_near_dedup,
        op10_secrets,
        op11_collocations,
        op12_language_id,
        op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op5_mix_sources": mixing_sql("documents", "doc_id, text, lang, source, n_chars", copy=True),
    "op11_collocations": collocations_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}
