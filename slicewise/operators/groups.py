"""Column groups of a mixed table: each domain's columns profiled and scored on their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import pick_sql, text_sql
from slicewise.functions.issues import advice_sql
from slicewise.operators.domain import assign_columns
from slicewise.operators.joining import as_list, cols, match, materialize
from slicewise.operators.quality import score_table
from slicewise.operators.summary import catalog
from slicewise.operators.table import TableProfile, null_map, plain_cols, profile_table

GROUP_NUMERIC = 8
GROUP_CATEGORICAL = 5


def column_groups(df: DataFrame, by: str | Sequence[str] = ()) -> dict[str, list[str]]:
    """Domain → columns of a table. Reads the schema only: one row per column comes back."""
    rows = assign_columns(catalog(df, "table")).select("column", "domain").collect()
    domain_of = {row["column"]: row["domain"] for row in rows}
    columns = plain_cols(df, as_list(by))
    groups = {d: [c for c in columns if domain_of[c] == d] for d in K.DOMAINS}
    return {d: members for d, members in groups.items() if members}


def group_sufficiency(rows: str = "row_count", domain: str = "domain") -> list[str]:
    """Select expressions that hold rows against the number recommended for a domain."""
    wanted = {k: f"{v}L" for k, v in K.GROUP_ROWS.items()}
    return [
        f"{pick_sql(domain, wanted, wanted[K.FALLBACK_DOMAIN])} AS recommended_rows",
        f"{rows} / recommended_rows AS sufficiency_ratio",
        "CASE WHEN sufficiency_ratio >= 2 THEN 'ABUNDANT' WHEN sufficiency_ratio >= 1 THEN 'SUFFICIENT' "
        "WHEN sufficiency_ratio >= 0.5 THEN 'MARGINAL' WHEN sufficiency_ratio >= 0.1 THEN 'INSUFFICIENT' "
        "ELSE 'CRITICALLY_INSUFFICIENT' END AS sufficiency",
    ]


def profile_groups(
    df: DataFrame, groups: dict[str, list[str]] | None = None, by: str | Sequence[str] = ()
) -> TableProfile:
    """Profile of every column group, with the group as a further slice column ``domain``."""
    groups = column_groups(df, by) if groups is None else groups
    return profile_table(df, by, groups, GROUP_NUMERIC, GROUP_CATEGORICAL)


@dataclass(frozen=True)
class MultiDomain:
    """``groups``: one row per slice and group, ranked. ``overall``: one row per slice."""

    groups: DataFrame
    overall: DataFrame
    null_map: DataFrame
    profile: TableProfile


def multi_domain(df: DataFrame, by: str | Sequence[str] = ()) -> MultiDomain:
    """Score, sufficiency, rank and advice of every column group, and their weighted quality."""
    by = as_list(by)
    groups = column_groups(df, by)
    profile = profile_groups(df, groups, by)
    n_columns = sum(len(members) for members in groups.values())
    names = {d: f"array({', '.join(map(text_sql, members))})" for d, members in groups.items()}
    gaps = profile.columns.groupBy(*cols([*by, "domain"])).agg(
        F.try_divide(F.sum("n"), F.sum("row_count")).alias("data_coverage"),
        F.array_sort(F.collect_list(F.when(F.col("missing_pct") > 20, F.struct("position", "column"))))
        .getField("column")
        .alias("high_null_columns"),
    )
    order = ", ".join(f"`{k}`" for k in by)
    told = advice_sql(
        ("sufficiency IN ('CRITICALLY_INSUFFICIENT', 'INSUFFICIENT')", "Collect more rows for this group"),
        ("total_score < 55", "Raise the quality of this group"),
        ("size(high_null_columns) > 0", "Fill or drop its columns with many nulls"),
    )
    # At most eight groups per slice are ranked.
    scored = (
        match(score_table(profile), gaps, [*by, "domain"])
        .selectExpr(
            "*",
            f"{pick_sql('domain', names, 'array()')} AS columns",
            f"column_count / {n_columns}D AS column_share",
            *group_sufficiency(),
            "total_score / 100 * 0.6D + least(sufficiency_ratio, 2D) / 2 * 0.4D AS rank_score",
            f"{told} AS group_advice",
        )
        .selectExpr(
            "*",
            f"row_number() OVER (PARTITION BY {order or '0'} ORDER BY rank_score DESC, domain) AS rank",
        )
    )
    scored = materialize(scored)
    overall_advice = advice_sql(
        ("weighted_quality < 60", "Solve the problems of the groups before training on all of them"),
        ("weighted_quality >= 60 AND _advice = 0", "All groups have enough rows and quality"),
    )
    overall = (
        scored.groupBy(*cols(by))
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("n_groups"),
            F.sum(F.col("total_score") * F.col("column_share")).alias("weighted_quality"),
            F.max(F.when(F.col("rank") == 1, F.col("domain"))).alias("dominant_domain"),
            F.max(F.when(F.col("rank") == 1, F.col("column_share"))).alias("dominant_column_share"),
            F.max(F.size("group_advice")).alias("_advice"),
        )
        .selectExpr("*", f"{overall_advice} AS overall_advice")
        .drop("_advice")
    )
    nulls = profile.columns.groupBy(*cols(by)).agg(F.avg("missing_pct").alias("global_null_pct"))
    return MultiDomain(
        groups=scored,
        overall=match(overall, nulls, by),
        null_map=null_map(df, None, by),
        profile=profile,
    )
