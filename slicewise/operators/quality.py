"""Quality dimensions, total scores and grades.

The dimensions are Column functions over profile rows; ``score_table`` and ``score_text`` put them
together. Scores are not rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions.exprs import clamp_sql, grade_sql
from slicewise.functions.issues import ISSUE_TYPE, Issue, advice_sql, issue_sql, issues_sql
from slicewise.operators.joining import as_list, cols, match
from slicewise.operators.table import TableProfile, profile_table
from slicewise.operators.text import profile_text

# Dimension weights and the caps for small data (below that many rows, at most).
TABLE_WEIGHTS = {
    "completeness": 0.20,
    "duplication": 0.15,
    "noise": 0.15,
    "balance": 0.20,
    "structural_integrity": 0.30,
}
TABLE_CAPS = [(10, 20.0), (100, 45.0), (1_000, 65.0)]
TEXT_WEIGHTS = {
    "completeness": 0.20,
    "duplication": 0.25,
    "vocabulary_diversity": 0.25,
    "noise": 0.10,
    "structural_integrity": 0.20,
}
TEXT_CAPS = [(1_000, 20.0), (10_000, 50.0)]
TEXT_COMPLETENESS = 95.0


def _weighted(weights: dict[str, float]) -> str:
    return clamp_sql(" + ".join(f"{name} * {weight}D" for name, weight in weights.items()))


def _capped(score: str, size: str, caps: Sequence[tuple[int, float]]) -> str:
    whens = " ".join(f"WHEN {size} < {below} THEN least({score}, {most}D)" for below, most in caps)
    return f"CASE {whens} ELSE {score} END"


def _ramp(size: str, start: float, low: float, high: float, gain: float, extra: str = "0D") -> str:
    return clamp_sql(f"{start}D + ({size} - {low}D) / {high - low}D * {gain}D + {extra}")


# ---- dimensions of a table: each takes column names or SQL expressions and returns a Column


def completeness(avg_missing: str, max_missing: str) -> Column:
    return F.expr(_completeness(avg_missing, max_missing))


def _completeness(avg_missing: str, max_missing: str) -> str:
    hit = f"CASE WHEN {max_missing} > 50 THEN 8D ELSE 0D END"
    return clamp_sql(f"100D - ({avg_missing}) * 1.8D - {hit}")


def duplication(dup_pct: str) -> Column:
    return F.expr(_duplication(dup_pct))


def _duplication(dup_pct: str) -> str:
    steep = clamp_sql(f"96D - power(greatest(({dup_pct}) - 2, 0D), 1.4D) * 4")
    return f"CASE WHEN {dup_pct} <= 2 THEN {clamp_sql(f'100D - ({dup_pct}) * 2')} ELSE {steep} END"


def noise_by_column(
    stats: DataFrame, hist: DataFrame, by: str | Sequence[str] = ()
) -> DataFrame:
    """Noise of every numeric column with spread: relative deviation plus the share of histogram bins
    that lie wholly beyond three deviations. Deviations are those of the finite values; infinities lie beyond."""
    keys = [*as_list(by), "column"]
    mean, std = F.col("mean"), F.coalesce(F.col("std"), F.lit(0.0))
    reach = F.lit(3.0) * (std + F.lit(1e-9))
    beyond = (F.col("bin_lo") == float("-inf")) | (F.col("bin_hi") == float("inf"))
    far = beyond | (F.col("bin_hi") < mean - reach) | (F.col("bin_lo") > mean + reach)
    moments = stats.filter((F.col("n") >= 2) & (F.col("max") > F.col("min"))).select(
        *cols(keys), F.col("finite_mean").alias("mean"), F.col("finite_std").alias("std")
    )
    tails = (
        match(hist.select(*cols(keys), "bin_lo", "bin_hi", F.col("n").alias("_count")), moments, keys, "inner")
        .groupBy(*cols(keys), "mean", "std")
        .agg(
            (
                F.coalesce(F.sum(F.when(far, F.col("_count"))), F.lit(0))
                / F.greatest(F.sum("_count"), F.lit(1))
            ).alias("outlier_frac")
        )
    )
    cv = (
        F.when(F.abs(mean) > 1e-12, std / F.when(F.abs(mean) > 1e-12, F.abs(mean)))
        .when(std > 0, F.lit(1.5))
        .otherwise(F.lit(0.0))
    )
    return tails.withColumn("cv", cv).withColumn(
        "noise",
        F.least(
            F.lit(0.7) * F.least(F.col("cv"), F.lit(2.0)) + F.lit(3.0) * F.col("outlier_frac"),
            F.lit(1.5),
        ),
    )


def noise(noise_rows: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Mean noise per slice and its score."""
    return (
        noise_rows.groupBy(*cols(as_list(by)))
        .agg(F.coalesce(F.avg("noise"), F.lit(0.0)).alias("avg_noise"))
        .withColumn("noise", noise_score("avg_noise"))
    )


def noise_score(avg_noise: str) -> Column:
    return F.expr(_noise_score(avg_noise))


def _noise_score(avg_noise: str) -> str:
    return clamp_sql(f"100D - ({avg_noise}) * 22")


def balance_score(avg_max: str, avg_entropy_ratio: str) -> Column:
    excess = f"greatest(0D, ({avg_max}) - 0.5D)"
    return F.expr(clamp_sql(f"100D - power({excess}, 1.5D) * 380 + ({avg_entropy_ratio}) * 5"))


def balance(balance_rows: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Balance score per slice with one finding per dominated column."""
    found = Issue(
        "max_prop > 0.65",
        "IMBALANCE",
        "CASE WHEN max_prop > 0.80 THEN 'critical' ELSE 'warning' END",
        "max_prop * 100",
        "percent of the rows have the dominant label",
        "column",
    )
    return (
        balance_rows.groupBy(*cols(as_list(by)))
        .agg(
            F.expr("avg(max_prop) AS avg_max_prop"),
            F.expr("avg(entropy_ratio) AS avg_entropy_ratio"),
            # One entry per categorical column of the schema.
            F.expr(f"CAST(array_sort(collect_list({issue_sql(found)})) AS {ISSUE_TYPE}) AS balance_issues"),
            F.expr("coalesce(max(max_prop > 0.80), false) AS severe_imbalance"),
        )
        .withColumn("balance", balance_score("avg_max_prop", "avg_entropy_ratio"))
    )


def structure(rows: str, columns: str) -> Column:
    return F.expr(_structure(rows, columns))


def _structure(r: str, columns: str) -> str:
    bonus = f"least(10D, log2(greatest({columns}, 1)) * 2.5D)"
    return (
        f"CASE WHEN {r} < 10 THEN 0D WHEN {r} < 100 THEN 10D "
        f"WHEN {r} < 1000 THEN {_ramp(r, 10, 100, 1_000, 35, f'{bonus} * 0.3D')} "
        f"WHEN {r} < 10000 THEN {_ramp(r, 45, 1_000, 10_000, 30, f'{bonus} * 0.5D')} "
        f"WHEN {r} < 100000 THEN {_ramp(r, 75, 10_000, 100_000, 20, f'{bonus} * 0.3D')} "
        f"ELSE 100D END"
    )


def score_table(profile: TableProfile) -> DataFrame:
    """Quality of a table per slice (and column group), from a profile."""
    keys = profile.keys
    gaps = profile.columns.groupBy(*cols(keys)).agg(
        F.avg("missing_pct").alias("avg_missing_pct"), F.max("missing_pct").alias("max_missing_pct")
    )
    repeats = profile.duplicates.select(*cols(keys), "duplicate_count", "duplicate_pct")
    noisy = noise(noise_by_column(profile.columns, profile.histogram, keys), keys)
    balanced = balance(profile.metrics, keys)
    out = profile.summary
    for part in (gaps, repeats, noisy.select(*cols(keys), "avg_noise"), balanced):
        out = match(out, part, keys)
    gappy, copied, rough = "avg_missing_pct > 5", "duplicate_pct > 2", "avg_noise > 0.7"
    tiny, very_small = "row_count < 10", "row_count BETWEEN 10 AND 99"
    small, moderate = "row_count BETWEEN 100 AND 999", "row_count BETWEEN 1000 AND 9999"
    found = [
        Issue(gappy, "MISSING_VALUES", "warning", "avg_missing_pct", "percent of the cells are missing"),
        Issue(copied, "DUPLICATE_ROWS", "warning", "duplicate_pct", "percent of the rows are repeats"),
        Issue(rough, "NOISE", "warning", "avg_noise", "mean noise of the numeric columns"),
        Issue(tiny, "TOO_SMALL", "critical", "row_count", "rows: unusable for training"),
        Issue(very_small, "VERY_SMALL", "warning", "row_count", "rows: toy experiments only"),
        Issue(small, "SMALL", "warning", "row_count", "rows: small models only"),
        Issue(moderate, "MODERATE_SIZE", "warning", "row_count", "rows: small and medium models"),
    ]
    told = advice_sql(
        (gappy, "Fill or drop columns with many missing values"),
        (copied, "Remove duplicate rows before training"),
        (rough, "Look for outliers and normalise the features"),
        ("severe_imbalance", "Reweight or resample dominated classes"),
        (tiny, "Collect at least 1,000 rows"),
        (very_small, "Collect at least 1,000 rows before training"),
        (small, "Aim for 10,000 rows"),
    )
    parts = out.selectExpr(
        *[f"`{k}`" for k in keys],
        "row_count",
        "column_count",
        "coalesce(avg_missing_pct, 0D) AS avg_missing_pct",
        "coalesce(max_missing_pct, 0D) AS max_missing_pct",
        "coalesce(duplicate_count, 0L) AS duplicate_count",
        "coalesce(duplicate_pct, 0D) AS duplicate_pct",
        "coalesce(avg_noise, 0D) AS avg_noise",
        "coalesce(balance, 100D) AS balance",
        "coalesce(severe_imbalance, false) AS severe_imbalance",
        "balance_issues",
    )
    return parts.selectExpr(
        "*",
        f"{_completeness('avg_missing_pct', 'max_missing_pct')} AS completeness",
        f"{_duplication('duplicate_pct')} AS duplication",
        f"{_noise_score('avg_noise')} AS noise",
        f"{_structure('row_count', 'column_count')} AS structural_integrity",
        f"{_weighted(TABLE_WEIGHTS)} AS _total",
        f"{_capped('_total', 'row_count', TABLE_CAPS)} AS total_score",
        f"{grade_sql('total_score')} AS grade",
        f"{issues_sql(found, 'balance_issues', ('QUALITY_OK', 'no major quality issue'))} AS quality_issues",
        f"{told} AS quality_advice",
    ).drop("balance_issues", "severe_imbalance", "_total")


def quality_of_table(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return score_table(profile_table(df, by))


# ---- dimensions of text


def text_duplication(dup_pct: str) -> Column:
    return F.expr(_text_duplication(dup_pct))


def _text_duplication(dup_pct: str) -> str:
    return clamp_sql(f"100D - ({dup_pct}) * 2.2D")


def diversity(ttr: str) -> Column:
    return F.expr(_diversity(ttr))


def _diversity(ttr: str) -> str:
    return clamp_sql(f"log1p(({ttr}) * 20) / log1p(10D) * 100")


def length_noise(max_length: str, avg_length: str) -> Column:
    return F.expr(_length_noise(max_length, avg_length))


def _extreme(max_length: str, avg_length: str) -> str:
    return f"({max_length} > ({avg_length}) * 12 AND {avg_length} > 0)"


def _length_noise(max_length: str, avg_length: str) -> str:
    return f"CASE WHEN {_extreme(max_length, avg_length)} THEN 60D ELSE 82D END"


def text_structure(lines: str) -> Column:
    return F.expr(_text_structure(lines))


def _text_structure(n: str) -> str:
    return (
        f"CASE WHEN {n} < 1000 THEN 0D "
        f"WHEN {n} < 10000 THEN {_ramp(n, 10, 1_000, 10_000, 35)} "
        f"WHEN {n} < 100000 THEN {_ramp(n, 45, 10_000, 100_000, 30)} "
        f"WHEN {n} < 1000000 THEN {_ramp(n, 75, 100_000, 1_000_000, 20)} ELSE 100D END"
    )


def score_text(profile: DataFrame) -> DataFrame:
    """Quality of a corpus per slice: adds the dimensions, total and grade to profile rows."""
    copied, thin = "duplicate_pct > 10", "type_token_ratio < 0.15"
    extreme = _extreme("max_line_length", "avg_line_length")
    tiny, small = "sampled_lines < 1000", "sampled_lines BETWEEN 1000 AND 9999"
    found = [
        Issue(copied, "DUPLICATE_LINES", "warning", "duplicate_pct", "percent of the lines are repeats"),
        Issue(thin, "LOW_DIVERSITY", "warning", "type_token_ratio", "distinct words per word"),
        Issue(extreme, "EXTREME_LENGTH", "warning", "try_divide(max_line_length, avg_line_length)", "times the mean length is the longest line"),
        Issue(tiny, "TOO_SMALL", "critical", "sampled_lines", "lines: far too few for a language model"),
        Issue(small, "SMALL", "warning", "sampled_lines", "lines: fine-tuning of small models only"),
    ]
    told = advice_sql(
        (copied, "Remove repeated lines"),
        (thin, "Add sources with a richer vocabulary"),
        (extreme, "Drop lines whose length is beyond three deviations of the mean"),
        (tiny, "Collect far more lines"),
    )
    return profile.selectExpr(
        "*",
        f"{TEXT_COMPLETENESS}D AS completeness",
        f"{_text_duplication('duplicate_pct')} AS duplication",
        f"{_diversity('type_token_ratio')} AS vocabulary_diversity",
        f"{_length_noise('max_line_length', 'avg_line_length')} AS noise",
        f"{_text_structure('sampled_lines')} AS structural_integrity",
        f"{_weighted(TEXT_WEIGHTS)} AS _total",
        f"{_capped('_total', 'sampled_lines', TEXT_CAPS)} AS total_score",
        f"{grade_sql('total_score')} AS grade",
        f"{issues_sql(found, None, ('QUALITY_OK', 'no major quality issue'))} AS quality_issues",
        f"{told} AS quality_advice",
    ).drop("_total")


def quality_of_text(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return score_text(profile_text(lines, by))


__all__ = [
    "balance",
    "balance_score",
    "completeness",
    "diversity",
    "duplication",
    "length_noise",
    "noise",
    "noise_by_column",
    "noise_score",
    "quality_of_table",
    "quality_of_text",
    "score_table",
    "score_text",
    "structure",
    "text_duplication",
    "text_structure",
]
