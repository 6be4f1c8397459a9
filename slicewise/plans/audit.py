"""The audit: every score of every slice for every scenario, as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.issues import NO_ADVICE, NO_ISSUES
from slicewise.operators.contamination import table_contamination, with_text_contamination
from slicewise.operators.domain import detect_domain, domain_scores, value_evidence
from slicewise.operators.fairness import fairness_table, fairness_text
from slicewise.operators.geometry import geometry_scan
from slicewise.operators.joining import as_list, cols, match, materialize
from slicewise.operators.quality import score_table, score_text
from slicewise.operators.scenario import simulate, token_counts
from slicewise.operators.table import TableProfile, numeric_cols, profile_table
from slicewise.operators.text import profile_text, with_vulnerability
from slicewise.plans.report import advice_rows, issue_rows, report


def text_cards(
    lines: DataFrame,
    by: str | Sequence[str] = (),
    phrases: Sequence[str] = K.BENCHMARK_PHRASES,
) -> DataFrame:
    """Scores of text slices that do not depend on a scenario."""
    profile = profile_text(lines, by, phrases)
    scored = fairness_text(with_vulnerability(score_text(profile)))
    return token_counts(with_text_contamination(scored), "text")


def table_cards(
    df: DataFrame,
    by: str | Sequence[str] = (),
    key: str | Sequence[str] | None = None,
    features: str | Sequence[str] | None = None,
    profile: TableProfile | None = None,
) -> DataFrame:
    """Scores of table slices that do not depend on a scenario, and the detected domain.

    ``key`` identifies a row for the geometry scan; without it that risk stays unknown.
    """
    by = as_list(by)
    if profile is None:
        profile = profile_table(df, by)
    out = score_table(profile)
    if key is not None:
        features = numeric_cols(df, by) if features is None else features
        scan = geometry_scan(df, key, features, by)
        out = match(
            out,
            scan.select(
                *cols(by),
                "vulnerability_score",
                "vulnerability_level",
                "vulnerability_issues",
                "vulnerability_advice",
            ),
            by,
        )
    else:
        out = out.selectExpr(
            "*",
            "CAST(NULL AS DOUBLE) AS vulnerability_score",
            "'UNKNOWN' AS vulnerability_level",
            f"{NO_ISSUES} AS vulnerability_issues",
            f"{NO_ADVICE} AS vulnerability_advice",
        )
    drift = fairness_table(profile.metrics, by)
    out = match(
        out,
        drift.selectExpr(
            *[f"`{k}`" for k in by],
            "drift_score AS _score",
            "drift_level AS _level",
            "drift_issues AS _issues",
            "drift_advice AS _advice",
        ),
        by,
    ).selectExpr(
        "*",
        "coalesce(_score, 10D) AS drift_score",
        "coalesce(_level, 'LOW') AS drift_level",
        f"coalesce(_issues, {NO_ISSUES}) AS drift_issues",
        f"coalesce(_advice, {NO_ADVICE}) AS drift_advice",
    ).drop("_score", "_level", "_issues", "_advice")
    out = token_counts(table_contamination(out), "tabular")

    # Column names are the same in every slice; all values of the slice are looked through.
    labels = value_evidence(df, None, by)
    slices = profile.summary.select(*cols(by))
    keys = by or ["_slice"]
    if not by:
        slices = slices.select(F.lit("all").alias("_slice"))
        labels = labels.withColumn("_slice", F.lit("all"))
    names = slices.withColumn("column", F.explode(F.array(*[F.lit(c) for c in df.columns])))
    detected = detect_domain(domain_scores(names, labels, keys), keys).select(
        *cols(keys),
        "detected_domain",
        F.col("confidence").alias("domain_confidence"),
        "confidences",
    )
    return match(out, detected if by else detected.drop("_slice"), by)


def _finish(cards: DataFrame, scenarios: Sequence[dict], sample_size: str) -> DataFrame:
    # One small row per slice: written once, so no scenario repeats the work behind it.
    return report(simulate(materialize(cards), scenarios), sample_size)


def audit_text(
    lines: DataFrame,
    by: str | Sequence[str] = (),
    scenarios: Sequence[dict] = ({},),
    phrases: Sequence[str] = K.BENCHMARK_PHRASES,
) -> DataFrame:
    return _finish(text_cards(lines, by, phrases), scenarios, "sampled_lines")


def audit_table(
    df: DataFrame,
    by: str | Sequence[str] = (),
    scenarios: Sequence[dict] = ({},),
    key: str | Sequence[str] | None = None,
    features: str | Sequence[str] | None = None,
) -> DataFrame:
    return _finish(table_cards(df, by, key, features), scenarios, "row_count")


def audit(
    df: DataFrame,
    kind: str,
    by: str | Sequence[str] = (),
    scenarios: Sequence[dict] = ({},),
    **options,
) -> DataFrame:
    """Scorecard of ``text`` lines or of a ``tabular`` DataFrame: one row per slice and scenario.

    The data are read a fixed number of times, whatever the number of slices and scenarios: twice for
    text, five times (with only the columns needed) for a table.
    """
    if kind == "text":
        return audit_text(df, by, scenarios, **options)
    if kind == "tabular":
        return audit_table(df, by, scenarios, **options)
    raise ValueError(f"Unsupported data type: {kind}")


def issues(cards: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    return issue_rows(cards, keys)


def recommendations(cards: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    return advice_rows(cards, keys)
