"""Overall risk, findings, advice and verdict of score rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import risk_ci, tier_sql
from slicewise.functions.issues import count_sql
from slicewise.operators.joining import as_list, cols

RISKS = {
    "adversarial": "vulnerability_score",
    "memorization": "leakage_score",
    "fairness": "drift_score",
    "contamination": "contamination_score",
}
ISSUE_COLUMNS = [
    "quality_issues",
    "vulnerability_issues",
    "memorization_issues",
    "drift_issues",
    "contamination_issues",
    "compatibility_issues",
]
ADVICE_COLUMNS = [
    "quality_advice",
    "vulnerability_advice",
    "memorization_advice",
    "drift_advice",
    "contamination_advice",
    "compatibility_advice",
    "cost_advice",
]


def overall_risk(cards: DataFrame) -> DataFrame:
    """Mean of the four risks (a missing one counts as 0), its level, and how many were present."""
    total = " + ".join(f"coalesce({c}, 0D)" for c in RISKS.values())
    present = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in RISKS.values())
    return cards.selectExpr(
        "*",
        f"({total}) / {len(RISKS)} AS average_risk",
        f"{tier_sql('average_risk', K.OVERALL_TIERS)} AS overall_risk_level",
        f"{present} AS risks_present",
    )


def with_intervals(cards: DataFrame, sample_size: str | None = None) -> DataFrame:
    """A confidence interval struct next to every risk score."""
    n = F.lit(K.RISK_SAMPLE) if sample_size is None else F.col(sample_size)
    return cards.withColumns({f"{name}_ci": risk_ci(score, n) for name, score in RISKS.items()})


def collect_findings(cards: DataFrame) -> DataFrame:
    """All findings of a row in one array, their counts by severity, and the advice without repeats."""
    found = ", ".join(c for c in ISSUE_COLUMNS if c in cards.columns)
    told = ", ".join(c for c in ADVICE_COLUMNS if c in cards.columns)
    return cards.selectExpr(
        "*",
        f"concat({found}) AS issues",
        f"{count_sql('issues', 'critical')} AS critical_issues",
        f"{count_sql('issues', 'warning')} AS warnings",
        f"array_distinct(concat({told})) AS recommendations",
    ).drop(*ISSUE_COLUMNS, *ADVICE_COLUMNS)


def verdict_sql(compatibility: str, quality: str, risk: str, critical: str) -> str:
    fit, score = f"coalesce({compatibility}, 0D)", f"coalesce({quality}, 0D)"
    return (
        f"CASE WHEN {critical} > 0 THEN 'NOT_READY' "
        f"WHEN {fit} >= 75 AND {score} >= 70 AND {risk} IN ('LOW', 'MEDIUM') THEN 'READY' "
        f"WHEN {fit} >= 50 OR {score} >= 55 THEN 'CONDITIONALLY_READY' ELSE 'NOT_READY' END"
    )


def report(cards: DataFrame, sample_size: str | None = None) -> DataFrame:
    """Complete a row of scores to the final scorecard row."""
    ready = verdict_sql("compatibility_score", "total_score", "overall_risk_level", "critical_issues")
    out = with_intervals(overall_risk(collect_findings(cards)), sample_size)
    return out.selectExpr("*", f"{ready} AS verdict")


def issue_rows(cards: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """Findings as rows ``(keys…, code, severity, subject, value, message)``."""
    return cards.select(*cols(as_list(keys)), F.inline("issues"))


def advice_rows(cards: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """Distinct recommendations over all rows of a slice, numbered in their order of appearance."""
    keys = as_list(keys)
    return (
        cards.select(*cols(keys), F.posexplode("recommendations").alias("position", "recommendation"))
        .groupBy(*cols(keys), "recommendation")
        .agg(F.min("position").alias("position"))
    )
