"""Profiles of text lines.

A corpus is read twice for a full profile: once for line facts and once for the vocabulary. Everything
that depends on the content of a line only (length, words, entropy, phrase hit) is computed in the scan
and carried through one aggregation on a 16-byte line fingerprint; totals, duplicates and the length
distribution are then read off the distinct lines. The text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slicewise.functions import constants as K
from slicewise.functions.exprs import (
    clamp_sql,
    fingerprint,
    share,
    share_sql,
    strip,
    tier_sql,
    word_count,
)
from slicewise.functions.exprs import low_entropy as is_low_entropy
from slicewise.functions.issues import Issue, advice_sql, issues_sql
from slicewise.operators.joining import as_list, cols, match
from slicewise.operators.table import histogram


def drop_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    """Strip the lines and drop the empty ones."""
    return lines.withColumn(line, strip(line)).filter(F.length(line) > 0)


def has_phrase(line: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-cased line contains any of the phrases."""
    lowered = F.lower(line)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases], F.lit(False))


def line_facts(
    lines: DataFrame, by: str | Sequence[str] = (), phrases: Sequence[str] = K.BENCHMARK_PHRASES
) -> DataFrame:
    """One row per slice and distinct stripped line, with its number of copies and its properties."""
    by = as_list(by)
    stripped = lines.select(*cols(by), F.col("line").alias("raw"), "chars").withColumn(
        "line", strip("raw")
    )
    scanned = stripped.select(
        *cols(by),
        *fingerprint(F.col("line")),
        "chars",
        F.length("line").alias("length"),
        word_count("line").alias("words"),
        is_low_entropy("line").alias("low_entropy"),
        has_phrase(F.col("raw"), phrases).alias("phrase_hit"),
    )
    return scanned.groupBy(*cols(by), "_fp1", "_fp2").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum("chars").alias("chars"),
        F.max("length").alias("length"),
        F.max("words").alias("words"),
        F.max("low_entropy").alias("low_entropy"),
        F.sum(F.col("phrase_hit").cast("bigint")).alias("phrase_hits"),
    )


def line_stats(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Length and word statistics of the stripped non-blank lines: one pass, one row per slice and task."""
    kept = drop_blank(lines)
    return kept.groupBy(*cols(as_list(by))).agg(
        F.count(F.lit(1)).alias("sampled_lines"),
        F.avg(F.length("line")).alias("avg_line_length"),
        F.max(F.length("line")).cast("bigint").alias("max_line_length"),
        F.min(F.length("line")).cast("bigint").alias("min_line_length"),
        F.avg(word_count("line")).alias("avg_word_count"),
    )


def duplicate_lines(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Non-blank lines, distinct ones and the share of repeats."""
    by = as_list(by)
    kept = drop_blank(lines)
    return (
        kept.select(*cols(by), *fingerprint(F.col("line")))
        .groupBy(*cols(by), "_fp1", "_fp2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*cols(by))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("sampled_lines"),
            F.count(F.lit(1)).alias("unique_lines"),
        )
        .withColumn("duplicate_lines", F.col("sampled_lines") - F.col("unique_lines"))
        .withColumn("duplicate_pct", share("duplicate_lines", "sampled_lines"))
    )


def vocab(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Words, distinct words and type-token ratio. Word counts are combined before the shuffle."""
    by = as_list(by)
    return (
        # Empty parts are filtered after the explode, which stays compiled that way (see also lines_of).
        lines.select(
            *cols(by), F.explode_outer(F.split(F.lower("line"), K.WORD_BREAK)).alias("_word")
        )
        .filter(F.col("_word") != "")
        .groupBy(*cols(by), "_word")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*cols(by))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("word_count"),
            F.count(F.lit(1)).alias("vocab_size"),
        )
        .withColumn(
            "type_token_ratio", F.coalesce(F.try_divide("vocab_size", "word_count"), F.lit(0.0))
        )
    )


def length_counts(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Rows ``(by…, length, n)`` over the stripped non-blank lines."""
    by = as_list(by)
    return (
        drop_blank(lines)
        .select(*cols(by), F.length("line").alias("length"))
        .groupBy(*cols(by), "length")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def length_histogram(lines: DataFrame, by: str | Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Histogram of line lengths, computed from the few distinct lengths."""
    return histogram(length_counts(lines, by), ["length"], by, bins, weight="n").drop("column")


def _mark_outliers(lengths: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """Add the mean, the population deviation and the outlier flag of each distinct length.

    The windows run over distinct lengths, never over lines, and the aggregation per slice that follows
    finds the data already partitioned.
    """
    slice_keys = cols(by)
    if not by:
        lengths = lengths.withColumn("_all", F.lit(0))
        slice_keys = [F.col("_all")]
    whole = Window.partitionBy(*slice_keys)
    length = F.col("length")
    total = F.sum(n).over(whole)
    return (
        lengths.withColumn("_mean", F.try_divide(F.sum(n * length).over(whole), total))
        .withColumn(
            "_std",
            F.sqrt(F.try_divide(F.sum(n * F.pow(length - F.col("_mean"), 2)).over(whole), total)),
        )
        .withColumn("_out", F.abs((length - F.col("_mean")) / (F.col("_std") + F.lit(1e-9))) > 3)
    )


def length_outliers(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Lines whose length is more than three population deviations from the mean of their slice."""
    by = as_list(by)
    n = F.col("n")
    return (
        _mark_outliers(length_counts(lines, by), by, n)
        .groupBy(*cols(by))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("sampled_lines"),
            F.max("_mean").alias("mean_length"),
            F.max("_std").alias("std_length"),
            F.coalesce(F.sum(F.when(F.col("_out"), n)), F.lit(0)).alias("outlier_lines"),
        )
        .withColumn("outlier_pct", share("outlier_lines", "sampled_lines"))
    )


def low_entropy(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Share of stripped non-blank lines with fewer than two bits of entropy per character."""
    return (
        drop_blank(lines)
        .groupBy(*cols(as_list(by)))
        .agg(
            F.count(F.lit(1)).alias("sampled_lines"),
            F.count_if(is_low_entropy("line")).alias("low_entropy_lines"),
        )
        .withColumn("low_entropy_pct", share("low_entropy_lines", "sampled_lines"))
    )


def with_vulnerability(df: DataFrame) -> DataFrame:
    """Score ``outlier_pct`` and ``low_entropy_pct`` columns for injected lines."""
    outlying, repetitive = "outlier_pct > 1", "low_entropy_pct > 5"
    found = [
        Issue(outlying, "LENGTH_OUTLIERS", "warning", "outlier_pct", "percent of the lines have an outlying length"),
        Issue(repetitive, "LOW_ENTROPY", "warning", "low_entropy_pct", "percent of the lines repeat few characters"),
    ]
    told = advice_sql(
        (outlying, "Drop lines whose length is beyond three deviations of the mean"),
        (repetitive, "Drop padding and lines that repeat few characters"),
    )
    return df.selectExpr(
        "*",
        f"{clamp_sql('outlier_pct * 4 + low_entropy_pct * 2')} AS vulnerability_score",
        f"{tier_sql('vulnerability_score', K.VULNERABILITY_TIERS)} AS vulnerability_level",
        f"{issues_sql(found)} AS vulnerability_issues",
        f"{told} AS vulnerability_advice",
    )


def text_vulnerability(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Length outliers, low-entropy lines and the score they give, per slice, from one scan."""
    by = as_list(by)
    by_length = (
        drop_blank(lines)
        .select(*cols(by), F.length("line").alias("length"), is_low_entropy("line").alias("_low"))
        .groupBy(*cols(by), "length")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_low").alias("low"))
    )
    counted = (
        _mark_outliers(by_length, by, F.col("n"))
        .groupBy(*cols(by))
        .agg(
            F.expr("coalesce(sum(n), 0L) AS sampled_lines"),
            F.expr("max(_mean) AS mean_length"),
            F.expr("max(_std) AS std_length"),
            F.expr("coalesce(sum(IF(_out, n, 0L)), 0L) AS outlier_lines"),
            F.expr("coalesce(sum(low), 0L) AS low_entropy_lines"),
        )
        .selectExpr(
            "*",
            f"{share_sql('outlier_lines', 'sampled_lines')} AS outlier_pct",
            f"{share_sql('low_entropy_lines', 'sampled_lines')} AS low_entropy_pct",
        )
    )
    return with_vulnerability(counted)


def profile_text(
    lines: DataFrame, by: str | Sequence[str] = (), phrases: Sequence[str] = K.BENCHMARK_PHRASES
) -> DataFrame:
    """Full text profile, one row per slice: summary, lengths, duplicates, outliers, entropy, phrase
    hits and vocabulary."""
    by = as_list(by)
    solid = F.col("length") > 0
    # Everything a slice needs is a total over its distinct line lengths: one small table feeds the
    # totals and the outliers, so the lines are scanned and shuffled once.
    by_length = (
        line_facts(lines, by, phrases)
        .groupBy(*cols(by), "length")
        .agg(
            F.sum("copies").alias("copies"),
            F.count(F.lit(1)).alias("distinct"),
            F.sum("chars").alias("chars"),
            F.sum(F.col("copies") * F.col("words")).alias("words"),
            F.coalesce(F.sum(F.when(F.col("low_entropy"), F.col("copies"))), F.lit(0)).alias("low"),
            F.sum("phrase_hits").alias("hits"),
        )
    )
    copies = F.when(solid, F.col("copies"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    totals = (
        _mark_outliers(by_length, by, copies)
        .groupBy(*cols(by))
        .agg(
            total(F.col("copies")).alias("line_count"),
            total(F.col("chars")).alias("char_count"),
            total(copies).alias("sampled_lines"),
            total(F.when(solid, F.col("distinct"))).alias("unique_lines"),
            F.coalesce(F.max(F.when(solid, F.col("_mean"))), F.lit(0.0)).alias("avg_line_length"),
            F.coalesce(F.max("length"), F.lit(0)).cast("bigint").alias("max_line_length"),
            F.coalesce(F.min(F.when(solid, F.col("length"))), F.lit(0)).cast("bigint").alias(
                "min_line_length"
            ),
            F.coalesce(
                F.try_divide(F.sum(F.when(solid, F.col("words"))), F.sum(copies)), F.lit(0.0)
            ).alias("avg_word_count"),
            F.max("_std").alias("std_length"),
            total(F.when(solid & F.col("_out"), F.col("copies"))).alias("outlier_lines"),
            total(F.when(solid, F.col("low"))).alias("low_entropy_lines"),
            total(F.col("hits")).alias("phrase_hits"),
        )
    )
    out = match(totals, vocab(lines, by).withColumnsRenamed({"word_count": "_words", "vocab_size": "_vocab", "type_token_ratio": "_ttr"}), by)
    return out.selectExpr(
        "*",
        "coalesce(_words, 0L) AS word_count",
        "coalesce(_vocab, 0L) AS vocab_size",
        "coalesce(_ttr, 0D) AS type_token_ratio",
        "sampled_lines - unique_lines AS duplicate_lines",
        f"{share_sql('duplicate_lines', 'sampled_lines')} AS duplicate_pct",
        f"{share_sql('outlier_lines', 'sampled_lines')} AS outlier_pct",
        f"{share_sql('low_entropy_lines', 'sampled_lines')} AS low_entropy_pct",
        "coalesce(try_divide(char_count, line_count), 0D) AS avg_raw_length",
        "floor(char_count / 4) AS estimated_tokens",
    ).drop("_words", "_vocab", "_ttr")
