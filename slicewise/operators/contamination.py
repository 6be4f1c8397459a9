"""Benchmark contamination of corpora and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import clamp_sql, share, text_sql, tier_sql
from slicewise.functions.issues import NO_ADVICE, Issue, advice_sql, issues_sql
from slicewise.operators.joining import as_list, cols, is_small, match, materialize
from slicewise.operators.shingles import shingle_rows
from slicewise.operators.text import has_phrase

TABLE_PRINT = "TruthfulQA-style table"


def fingerprint_match(
    summary: DataFrame, prints: Sequence[tuple[str, int, int, float, float]] = K.BENCHMARK_PRINTS
) -> DataFrame:
    """Name the test sets whose line count and mean line length a slice matches.

    The few prints are an array literal filtered per summary row, so this range lookup joins nothing.
    Prints without a line count are skipped.
    """
    tests = ", ".join(
        f"CASE WHEN line_count BETWEEN {least} AND {most} AND avg_raw_length BETWEEN {short} AND {long} "
        f"THEN {text_sql(name)} END"
        for name, least, most, short, long in prints
        if least > 0
    )
    return summary.selectExpr(
        "*",
        f"filter(array({tests}), name -> name IS NOT NULL) AS suspicious_benchmarks",
        "size(suspicious_benchmarks) AS fingerprint_matches",
    )


def phrase_hits(
    lines: DataFrame,
    phrases: Sequence[str] = K.BENCHMARK_PHRASES,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Lines that contain one of the phrases (lower-case); a line counts once."""
    return lines.groupBy(*cols(as_list(by))).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(has_phrase(F.col("line"), phrases)).alias("phrase_hits"),
    )


def with_text_contamination(summary: DataFrame) -> DataFrame:
    """Score rows with ``line_count``, ``avg_raw_length`` and ``phrase_hits``."""
    matched, hit = "fingerprint_matches > 0", "phrase_hits > 0"
    found = Issue(
        matched,
        "BENCHMARK_PRINT",
        "warning",
        "fingerprint_matches",
        "test sets have the same line count and mean length",
        "array_join(suspicious_benchmarks, ', ')",
    )
    told = advice_sql(
        (matched, "Verify that no test split is included"),
        (matched, "Decontaminate against the suspected test sets"),
        (hit, "Decontaminate before evaluating on benchmarks"),
    )
    return fingerprint_match(summary).selectExpr(
        "*",
        f"{clamp_sql('fingerprint_matches * 30D + phrase_hits * 10D')} AS contamination_score",
        f"{tier_sql('contamination_score', K.CONTAMINATION_TIERS)} AS contamination_level",
        f"{issues_sql([found])} AS contamination_issues",
        f"{told} AS contamination_advice",
    )


def text_contamination(
    lines: DataFrame,
    by: str | Sequence[str] = (),
    phrases: Sequence[str] = K.BENCHMARK_PHRASES,
) -> DataFrame:
    """Fingerprint matches, phrase hits and the score they give, per slice, from one scan."""
    counted = (
        lines.groupBy(*cols(as_list(by)))
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.coalesce(F.sum("chars"), F.lit(0).cast("bigint")).alias("char_count"),
            F.count_if(has_phrase(F.col("line"), phrases)).alias("phrase_hits"),
        )
        .withColumn("avg_raw_length", F.try_divide("char_count", "line_count"))
    )
    return with_text_contamination(counted)


def table_contamination(summary: DataFrame) -> DataFrame:
    """Score table summaries by the row and column count of a known kind of test set."""
    alike = "row_count BETWEEN 800 AND 1100 AND column_count IN (2, 3)"
    found = Issue(alike, "BENCHMARK_PRINT", "warning", "row_count", "rows: the shape of a known test set", text_sql(TABLE_PRINT))
    return summary.selectExpr(
        "*",
        f"CASE WHEN {alike} THEN array({text_sql(TABLE_PRINT)}) ELSE {NO_ADVICE} END AS suspicious_benchmarks",
        f"CASE WHEN {alike} THEN 25D ELSE 0D END AS contamination_score",
        f"{tier_sql('contamination_score', K.CONTAMINATION_TIERS)} AS contamination_level",
        f"{issues_sql([found])} AS contamination_issues",
        f"{advice_sql((alike, 'Check where the table comes from'))} AS contamination_advice",
    )


def benchmark_index(
    benchmark: DataFrame, sizes: Sequence[int], text: str = "text", key: str = "item_id"
) -> DataFrame:
    """Inverted index of a benchmark: rows (_n, _a, _b, item), one per distinct shingle of an item.

    Items with a null key or without a shingle are not in it; rows that share a key are one item.
    """
    rows = benchmark.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("_text")
    )
    return shingle_rows(rows, "_text", sizes).distinct().select("_n", "_a", "_b", "item")


PRINT = ["_n", "_a", "_b"]


def _hits(docs: DataFrame, index: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The shingles of documents that are in the index: the columns of ``docs`` but ``_text``, and those of ``PRINT``, one
    row per occurrence.

    The shingles of a document are looked up where it is read. Only if those of the benchmark are too
    many to be sent, both sides are shuffled by shingle, and one of very many documents is split by AQE.
    """
    known = materialize(index.select(*PRINT).distinct())
    if is_small(known):
        return shingle_rows(docs, "_text", sizes, known)
    return shingle_rows(docs, "_text", sizes).join(known, PRINT, "left_semi")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _sizes(n: int | Sequence[int]) -> list[int]:
    sizes = [n] if isinstance(n, int) else list(dict.fromkeys(n))
    if not sizes or min(sizes) < 1:
        raise ValueError("n must be at least 1")
    return sizes


def ngram_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int | Sequence[int] = 5,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Which document shares which ``n``-word shingles with which benchmark item.

    Rows (key, item key, shared_shingles, item_shingles, item_coverage) for every pair with a shared
    shingle; item_coverage is the percentage of the item's distinct shingles. Rows of ``docs`` with the
    same key are one document. Several lengths ``n`` are looked up in one pass and told apart by a column ``n``. A shingle of
    many items and many documents gives a row for each pair; use ``ngram_contamination`` for totals without pairs.
    """
    lengths = _sizes(n)
    index = materialize(benchmark_index(benchmark, lengths, item_text, item_key))
    sizes = materialize(index.groupBy("_n", "item").agg(F.count(F.lit(1)).alias("item_shingles")))
    rows = docs.select(F.col(f"`{key}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    hits = _hits(rows, index, lengths).distinct()
    pairs = hits.join(_bounded(index), PRINT).groupBy("_doc", "_n", "item").agg(F.count(F.lit(1)).alias("shared_shingles"))
    return pairs.join(_bounded(sizes), ["_n", "item"]).select(
        F.col("_doc").alias(key),
        F.col("item").alias(item_key),
        "shared_shingles",
        "item_shingles",
        share("shared_shingles", "item_shingles").alias("item_coverage"),
        *([] if isinstance(n, int) else [F.col("_n").alias("n")]),
    )


def ngram_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int | Sequence[int] = 5,
    by: str | Sequence[str] = (),
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Overlap of every slice of a corpus with a benchmark in ``n``-word shingles, and its score.

    Rows (by…, doc_count, hit_docs, hit_pct, items_hit, max_item_coverage, whole_items,
    contamination_score, …): documents with a shingle of the benchmark, items with a shingle in the
    slice, the greatest percentage of an item's shingles found in it, the items found whole. Ten points
    per item, 100 at most. Every row of ``docs`` is a document. No pairs of documents and items are formed:
    shingles are counted once per document for the documents and once per slice for the items. Several lengths ``n`` are
    looked up in one pass and told apart by a column ``n``.
    """
    by, lengths = as_list(by), _sizes(n)
    index = materialize(benchmark_index(benchmark, lengths, item_text, item_key))
    sizes = index.groupBy("_n", "item").agg(F.count(F.lit(1)).alias("_size"))
    rows = docs.select(*cols(by), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("_text"))
    # A row's hits are in one task: repeats are combined before the shuffle.
    hits = materialize(_hits(rows, index, lengths).distinct())
    keys = [*by, "_n"]
    counts = docs.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias("doc_count"))
    counts = counts.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("_n"))
    touched = hits.select(*cols(keys), "_row").distinct().groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("hit_docs"))
    covered = (
        hits.select(*cols(by), *PRINT)
        .distinct()
        .join(_bounded(index), PRINT)
        .groupBy(*cols(keys), "item")
        .agg(F.count(F.lit(1)).alias("_found"))
        .join(sizes, ["_n", "item"])
        .groupBy(*cols(keys))
        .agg(
            F.count(F.lit(1)).alias("items_hit"),
            F.max(share("_found", "_size")).alias("max_item_coverage"),
            F.count_if(F.col("_found") == F.col("_size")).alias("whole_items"),
        )
    )
    hit = "items_hit > 0"
    found = [
        Issue(hit, "BENCHMARK_OVERLAP", "warning", "items_hit", "benchmark items share word runs with the data"),
        Issue("whole_items > 0", "BENCHMARK_ITEMS", "critical", "whole_items", "benchmark items occur in full"),
    ]
    told = advice_sql(
        (hit, "Decontaminate before evaluating on this benchmark"),
        ("whole_items > 0", "Check whether the benchmark itself was collected as training data"),
    )
    out = (
        match(match(counts, touched, keys), covered, keys)
        .fillna(0, ["hit_docs", "items_hit", "max_item_coverage", "whole_items"])
        .withColumn("hit_pct", share("hit_docs", "doc_count"))
        .selectExpr(
            "*",
            f"{clamp_sql('items_hit * 10D')} AS contamination_score",
            f"{tier_sql('contamination_score', K.CONTAMINATION_TIERS)} AS contamination_level",
            f"{issues_sql(found)} AS contamination_issues",
            f"{told} AS contamination_advice",
        )
    )
    return out.drop("_n") if isinstance(n, int) else out.withColumn("n", F.col("_n")).drop("_n")
