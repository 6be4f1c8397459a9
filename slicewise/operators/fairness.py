"""Risk of fairness drift, from class balance or from lexical diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import clamp_sql, share_sql, tier_sql
from slicewise.functions.issues import Issue, advice_sql, issues_sql
from slicewise.operators.joining import as_list, cols


def fairness_table(metrics: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Worst imbalance plus a penalty for the number of imbalanced columns, per slice.

    Input are the rows of ``balance_metrics``. A slice without imbalance scores 10 and gets an info row.
    """
    dominated = Issue("max_prop > 0.50", "DOMINANT_CLASS", "warning", "max_prop * 100", "percent of the rows have the dominant label", "column")
    few = Issue("n_classes < 3", "FEW_CLASSES", "warning", "n_classes", "distinct labels only", "column")
    signal = "CASE WHEN max_prop > 0.70 THEN 1 - gini WHEN max_prop > 0.50 THEN (1 - gini) / 2 END"
    # The list has at most two entries per categorical column of the schema.
    out = metrics.groupBy(*cols(as_list(by))).agg(
        F.expr(f"max({signal}) AS _peak"),
        F.expr(f"count({signal}) AS _signals"),
        F.expr("count_if(max_prop > 0.6) AS skewed_columns"),
        F.expr("count(1) AS categorical_columns"),
        F.expr("coalesce(max(max_prop > 0.70), false) AS _dominated"),
        F.expr(f"array_sort(flatten(collect_list({issues_sql([dominated, few])}))) AS _found"),
    )
    peak = clamp_sql("(_peak + least(0.2D, _signals * 0.05D)) * 100")
    return out.selectExpr(
        "*",
        f"CASE WHEN _signals = 0 THEN 10D ELSE {peak} END AS drift_score",
        f"{tier_sql('drift_score', K.FAIRNESS_TIERS)} AS drift_level",
        f"{share_sql('skewed_columns', 'categorical_columns')} AS shift_vulnerability",
        f"{issues_sql([], '_found', ('FAIRNESS_OK', 'no severe imbalance'))} AS drift_issues",
        f"{advice_sql(('_dominated', 'Sample dominated groups by stratum or weight their loss'))} AS drift_advice",
    ).drop("_peak", "_signals", "_dominated", "_found")


def fairness_text(profile: DataFrame) -> DataFrame:
    """Low lexical diversity and repetition as a sign of a one-sided corpus."""
    narrow, copied = "type_token_ratio < 0.15", "duplicate_pct > 15"
    found = [
        Issue(narrow, "NARROW_VOCABULARY", "warning", "type_token_ratio", "distinct words per word"),
        Issue(copied, "REPEATED_CONTENT", "warning", "duplicate_pct", "percent of the lines are repeats"),
    ]
    told = advice_sql(
        (narrow, "Add sources, styles and perspectives"), (copied, "Remove repeated lines")
    )
    return profile.selectExpr(
        "*",
        f"{clamp_sql('100D - type_token_ratio * 150 + duplicate_pct')} AS drift_score",
        f"{tier_sql('drift_score', K.FAIRNESS_TIERS)} AS drift_level",
        f"{issues_sql(found)} AS drift_issues",
        f"{told} AS drift_advice",
    )
