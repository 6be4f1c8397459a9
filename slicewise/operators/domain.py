"""Domain detection from column names and values, and the check against a chosen domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slicewise.functions import constants as K
from slicewise.functions.exprs import name_tokens, text_array, text_sql
from slicewise.operators.joining import as_list, cols, match
from slicewise.operators.table import categorical_cols

EMPTY_WORDS = "CAST(array() AS array<string>)"
Signatures = dict[str, tuple[float, Sequence[str], Sequence[str]]]


def _domain_rows(signatures: Signatures) -> Column:
    """The signatures as an array literal: (domain, position, weight, names, values)."""
    rows = [(d, i, w, n, v) for i, (d, (w, n, v)) in enumerate(signatures.items())]
    rows.append((K.FALLBACK_DOMAIN, len(rows), 0.0, [], []))

    def word_list(words: Sequence[str]) -> str:
        return f"array({', '.join(map(text_sql, words))})" if words else EMPTY_WORDS

    structs = ", ".join(
        f"named_struct('domain', {text_sql(domain)}, 'position', {position}, 'weight', {weight}D, "
        f"'names', {word_list(names)}, 'values', {word_list(values)})"
        for domain, position, weight, names, values in rows
    )
    return F.expr(f"array({structs})")


def value_words(signatures: Signatures = K.DOMAIN_SIGNATURES) -> list[str]:
    return sorted({word for _, _, values in signatures.values() for word in values})


def _is_value_word(value: str, signatures: Signatures) -> Column:
    listed = ", ".join(map(text_sql, value_words(signatures)))
    return F.expr(f"`{value}` IN ({listed})")


def value_evidence(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    signatures: Signatures = K.DOMAIN_SIGNATURES,
) -> DataFrame:
    """Distinct lower-cased values of the categorical columns that are value words of some domain.

    All values are looked at. The filter on the few hundred words comes first, so hardly anything is
    left to shuffle.
    """
    by = as_list(by)
    columns = categorical_cols(df, by) if columns is None else list(columns)
    if not columns:
        return df.select(*cols(by), F.lit(None).cast("string").alias("value")).filter("false")
    # Lower-casing never takes characters away, so longer values cannot be value words.
    longest = max(map(len, value_words(signatures)))
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    values = F.array(*[F.when(F.length(t) <= longest, F.lower(t)) for t in texts])
    return (
        df.select(*cols(by), F.explode(values).alias("value"))
        .filter(_is_value_word("value", signatures))
        .distinct()
    )


def name_evidence(
    catalog: DataFrame, keys: Sequence[str], signatures: Signatures = K.DOMAIN_SIGNATURES
) -> DataFrame:
    """Score of every column name in every domain: rows ``(keys…, column, domain, points, …)``.

    Words of the name that are in the signature count twice the weight each. Only if there is none, a
    signature word inside the name counts the weight once.
    """
    name = F.lower("column")
    spread = catalog.select(*cols(keys), "column", F.inline(_domain_rows(signatures)))
    exact = F.size(F.array_intersect(name_tokens("column"), F.col("names")))
    inside = F.exists("names", lambda word: F.contains(name, word))
    return spread.select(
        *cols(keys),
        "column",
        "domain",
        "position",
        F.when(exact > 0, F.col("weight") * exact * 2)
        .when(inside, F.col("weight"))
        .otherwise(F.lit(0.0))
        .alias("points"),
        ((exact > 0) | inside).alias("hit"),
    )


def domain_scores(
    catalog: DataFrame,
    values: DataFrame | None = None,
    keys: str | Sequence[str] = "dataset",
    signatures: Signatures = K.DOMAIN_SIGNATURES,
) -> DataFrame:
    """Confidence of every domain per dataset: rows ``(keys…, domain, score, confidence, rank, hits)``.

    ``catalog`` lists ``(keys…, column)``; ``values`` lists ``(keys…, value)``, for instance from
    ``value_evidence``. A column name equal to a value word counts as a value, too. Without any
    evidence the fallback domain ranks first, with confidence 0.
    """
    keys = as_list(keys)
    names = (
        name_evidence(catalog, keys, signatures)
        .groupBy(*cols(keys), "domain", "position")
        .agg(
            F.sum("points").alias("name_points"),
            # Names of one dataset's columns.
            F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("column")))).alias("hits"),
        )
    )
    tokens = catalog.select(*cols(keys), F.lower("column").alias("value"))
    if values is not None:
        tokens = tokens.unionByName(values.select(*cols(keys), F.lower("value").alias("value")))
    tokens = tokens.filter(_is_value_word("value", signatures)).distinct()
    found = (
        tokens.select(*cols(keys), "value", F.inline(_domain_rows(signatures)))
        .filter(F.array_contains("values", F.col("value")))
        .groupBy(*cols(keys), "domain")
        .agg((F.sum("weight") * 0.5).alias("value_points"))
    )
    total = F.sum("score").over(Window.partitionBy(*cols(keys)))
    fallback_first = F.when(
        (F.col("_total") == 0) & (F.col("domain") == K.FALLBACK_DOMAIN), -1
    ).otherwise(F.col("position"))
    order = Window.partitionBy(*cols(keys)).orderBy(F.col("confidence").desc(), fallback_first)
    return (
        match(names, found, [*keys, "domain"])
        .withColumn("score", F.col("name_points") + F.coalesce("value_points", F.lit(0.0)))
        # Eight rows per dataset.
        .withColumn("_total", total)
        .withColumn(
            "confidence",
            F.when(F.col("_total") > 0, F.try_divide("score", "_total")).otherwise(F.lit(0.0)),
        )
        .withColumn("rank", F.row_number().over(order))
        .select(*cols(keys), "domain", "score", "confidence", "rank", "hits")
    )


def detect_domain(scores: DataFrame, keys: str | Sequence[str] = "dataset") -> DataFrame:
    """The best domain per dataset with its evidence; a runner-up is named above 0.25."""
    keys = as_list(keys)
    first, second = F.col("rank") == 1, F.col("rank") == 2
    return (
        scores.groupBy(*cols(keys))
        .agg(
            F.max(F.when(first, F.col("domain"))).alias("detected_domain"),
            F.max(F.when(first, F.col("confidence"))).alias("confidence"),
            F.max(F.when(first, F.col("hits"))).alias("column_hits"),
            F.max(F.when(second & (F.col("confidence") > 0.25), F.col("domain"))).alias("runner_up"),
            F.map_from_entries(F.collect_list(F.struct("domain", "confidence"))).alias("confidences"),
        )
        .withColumn("low_confidence", F.col("confidence") < 0.35)
    )


def with_mismatch(detected: DataFrame, selected: str) -> DataFrame:
    """Compare the detected domain with the one in column ``selected``.

    Adds ``mismatch``, ``mismatch_severity`` and ``score_gap``. Below a confidence of 0.20 nothing can
    be said; the fallback domain agrees with all others.
    """
    related = " OR ".join(
        f"(detected_domain = {text_sql(domain)} AND `{selected}` IN ({', '.join(map(text_sql, others))}))"
        for domain, others in K.RELATED_DOMAINS.items()
    )
    agrees = f"detected_domain = `{selected}` OR detected_domain = {text_sql(K.FALLBACK_DOMAIN)} OR {related}"
    return detected.selectExpr(
        "*",
        f"coalesce(confidence >= 0.20D AND NOT ({agrees}), false) AS mismatch",
        f"IF(mismatch, confidence - coalesce(try_element_at(confidences, `{selected}`), 0D), NULL) AS score_gap",
        "CASE WHEN NOT mismatch THEN 'NONE' WHEN score_gap > 0.40D THEN 'HIGH' "
        "WHEN score_gap > 0.20D THEN 'MEDIUM' ELSE 'LOW' END AS mismatch_severity",
    )


def domain_mismatch(
    scores: DataFrame,
    selected: Sequence[str] = tuple(K.DOMAINS),
    keys: str | Sequence[str] = "dataset",
) -> DataFrame:
    """The check for several choices at once: one row per dataset and chosen domain."""
    choices = detect_domain(scores, keys).withColumn(
        "selected_domain", F.explode(text_array(list(selected)))
    )
    return with_mismatch(choices, "selected_domain").select(
        *cols(as_list(keys)),
        "selected_domain",
        "detected_domain",
        "confidence",
        "mismatch",
        "mismatch_severity",
        "score_gap",
    )


def assign_columns(
    catalog: DataFrame,
    keys: str | Sequence[str] = "dataset",
    signatures: Signatures = K.DOMAIN_SIGNATURES,
) -> DataFrame:
    """The domain of every column by its name alone; ties go to the first domain, no hit to General.

    Whole words count twice, every signature word inside the name 0.8, times the weight.
    """
    name = F.lower("column")
    best = F.array_max(
        F.transform(
            _domain_rows(signatures),
            lambda d: F.struct(
                (
                    d["weight"]
                    * (
                        F.size(F.array_intersect(name_tokens("column"), d["names"])) * 2.0
                        + F.size(F.filter(d["names"], lambda word: F.contains(name, word))) * 0.8
                    )
                ).alias("points"),
                (-d["position"]).alias("order"),
                d["domain"].alias("domain"),
            ),
        )
    )
    return (
        catalog.withColumn("_best", best)
        .withColumn(
            "domain",
            F.when(F.col("_best.points") > 0, F.col("_best.domain")).otherwise(K.FALLBACK_DOMAIN),
        )
        .select(*cols(as_list(keys)), "column", "domain", F.col("_best.points").alias("points"))
    )
