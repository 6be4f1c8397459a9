"""Profiles of tabular data: missing values, duplicates, distributions, balance, correlation.

Aggregations over many columns are one wide ``agg`` unpivoted afterwards with ``inline``, so the scan
is read once and only one row per slice and task is shuffled. Only what needs the values themselves
(labels; distinct counts of very many columns) is unpivoted first, and then pre-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.functions.exprs import fingerprint, share, text_sql
from slicewise.operators.joining import as_list, attach, cols, match, materialize
from slicewise.operators.quantiles import as_number, quantiles
from slicewise.operators.sampling import hash_sample, ranked_top

BINS = 30
#: Binary logarithm of the buckets of a sketch of distinct values.
SKETCH_BITS = 12
WIDE_PAIRS = 45
#: Numbers of the Gram matrices that a task holds.
GRAM_CELLS = 1 << 23
#: Scans in which exact distinct counts of one table are made, give or take one.
COUNT_SCANS = 16
#: Types whose 64-bit hash is one-to-one on their values.
NARROW = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def categorical_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every atomic column that is not numeric: text, booleans, dates and times alike."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.NumericType)
    return [
        f.name for f in df.schema if not isinstance(f.dataType, nested) and f.name not in exclude
    ]


def plain_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    numeric, other = set(numeric_cols(df)), set(categorical_cols(df))
    return [c for c in df.columns if (c in numeric or c in other) and c not in exclude]


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return as_number(name)
    return F.col(f"`{name}`")


#: What a numeric column has besides its counts.
MOMENTS = ("mean", "std", "min", "max", "skewness", "finite_mean", "finite_std", "lo", "hi", "below", "above")


def _finite(name: str) -> Column:
    """A numeric column as double, without NaN and infinities."""
    return F.when(F.abs(as_number(name)) < float("inf"), as_number(name))


def _finite_aggregates(name: str, i: int) -> list[Column]:
    v = _finite(name)
    return [
        F.avg(v).alias(f"_mean{i}"),
        F.stddev_samp(v).alias(f"_std{i}"),
        F.min(v).alias(f"_lo{i}"),
        F.max(v).alias(f"_hi{i}"),
        F.skewness(v).alias(f"_skew{i}"),
        F.count_if(as_number(name) == float("-inf")).cast("double").alias(f"_below{i}"),
        F.count_if(as_number(name) == float("inf")).cast("double").alias(f"_above{i}"),
    ]


def _moments(i: int) -> dict[str, Column]:
    """Moments of a numeric column from its finite values and the number of infinite ones."""
    n, below, above = F.col(f"_n{i}"), F.col(f"_below{i}"), F.col(f"_above{i}")
    mean, std, lo, hi = (F.col(f"_{m}{i}") for m in ("mean", "std", "lo", "hi"))
    corrected = F.col(f"_skew{i}") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    least = F.when(below > 0, F.lit(float("-inf"))).when((above > 0) & lo.isNull(), F.lit(float("inf"))).otherwise(lo)
    most = F.when(above > 0, F.lit(float("inf"))).when((below > 0) & hi.isNull(), F.lit(float("-inf"))).otherwise(hi)
    infinite = below + above > 0
    nan = F.lit(float("nan"))
    return {
        "mean": F.when((below > 0) & (above > 0), nan).when(above > 0, F.lit(float("inf"))).when(below > 0, F.lit(float("-inf"))).otherwise(mean),
        "std": F.when(infinite, F.when(n > 1, nan)).otherwise(std),
        "min": least,
        "max": most,
        "skewness": F.when(n > 2, F.when(most == least, F.lit(0.0)).when(infinite, nan).otherwise(corrected)),
        "finite_mean": mean,
        "finite_std": std,
        "lo": lo,
        "hi": hi,
        "below": below,
        "above": above,
    }


def column_stats(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """One row per slice and column: rows, nulls and, for numeric columns, moments and range.

    ``skewness`` is bias-corrected; it is 0 for a constant column and null below three values. ``below`` and
    ``above`` count negative and positive infinities; ``finite_mean``, ``finite_std``, ``lo`` and ``hi`` are those of
    the other values.
    """
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    numeric = set(numeric_cols(df))
    empty = F.lit(None).cast("double")
    aggregates: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    items: list[Column] = []
    for i, c in enumerate(columns):
        aggregates.append(F.count(_present(df, c)).alias(f"_n{i}"))
        n = F.col(f"_n{i}")
        moments = {m: empty for m in MOMENTS}
        if c in numeric:
            aggregates += _finite_aggregates(c, i)
            moments = _moments(i)
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                F.lit("numeric" if c in numeric else "categorical").alias("kind"),
                F.col("_rows").alias("row_count"),
                n.alias("n"),
                (F.col("_rows") - n).alias("nulls"),
                share(F.col("_rows") - n, F.col("_rows")).alias("missing_pct"),
                *[m.alias(name) for name, m in moments.items()],
            )
        )
    return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))


def missing(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Missing values per slice and column. A column without any value is ``all_null``."""
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    aggregates += [F.count(_present(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)]
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
            share(F.col("_rows") - F.col(f"_n{i}"), F.col("_rows")).alias("missing_pct"),
            (F.col(f"_n{i}") == 0).alias("all_null"),
            (F.col(f"_n{i}") == F.col("_rows")).alias("complete"),
        )
        for i, c in enumerate(columns)
    ]
    return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))


def complete_columns(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """The columns without any missing value, per slice."""
    by = as_list(by)
    return missing(df, columns, by).filter("complete").select(*cols(by), "column")


def coverage(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Share of filled cells and mean share of missing values over the columns, per slice."""
    by = as_list(by)
    return (
        missing(df, columns, by)
        .groupBy(*cols(by))
        .agg(
            F.coalesce(F.lit(1) - F.try_divide(F.sum("nulls"), F.sum("row_count")), F.lit(0.0)).alias(
                "data_coverage"
            ),
            F.avg("missing_pct").alias("global_null_pct"),
        )
    )


def duplicates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    groups: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Exact duplicate rows per slice; missing values equal each other.

    Rows are grouped on a 128-bit fingerprint, so 16 bytes per distinct row are shuffled and copies
    are combined before the shuffle. ``groups`` counts duplicates of several column sets in one pass
    and adds the column ``domain``.
    """
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    if groups is None:
        keyed = df.select(*cols(by), *fingerprint(*[_present(df, c) for c in columns]))
        slice_keys = by
    else:
        items = []
        for name, members in groups.items():
            one, two = fingerprint(*[_present(df, c) for c in members])
            items.append(F.struct(F.lit(name).alias("domain"), one, two))
        keyed = df.select(*cols(by), F.inline(F.array(*items)))
        slice_keys = [*by, "domain"]
    return (
        keyed.groupBy(*cols(slice_keys), "_fp1", "_fp2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*cols(slice_keys))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("distinct_rows"),
        )
        .withColumn("duplicate_count", F.col("row_count") - F.col("distinct_rows"))
        .withColumn("duplicate_pct", share("duplicate_count", "row_count"))
    )


def numeric_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Moments, range, skewness and median of numeric columns with at least two values.

    ``exact=False`` takes the median from a sketch in the same pass and starts no job here.
    """
    by = as_list(by)
    columns = numeric_cols(df, by) if columns is None else list(columns)
    keys = [*by, "column"]
    wanted = [*cols(keys), "n", "nulls", "mean", "std", "min", "max", "skewness"]
    stats = column_stats(df, columns, by).select(*wanted)
    if exact:
        stats = materialize(stats)
        medians = quantiles(df, columns, [0.5], by, stats)
        medians = medians.select(*cols(keys), F.col("value").alias("median"))
    else:
        aggregates = [
            F.percentile_approx(as_number(c), 0.5, 10_000).alias(f"_m{i}")
            for i, c in enumerate(columns)
        ]
        items = [
            F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("median"))
            for i, c in enumerate(columns)
        ]
        medians = df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))
    return match(stats, medians, keys).filter(F.col("n") >= 2)


def _finite_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Least and greatest finite value per slice and column."""
    aggregates = [f(_finite(c)).alias(f"_{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    items = [F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi")) for i, c in enumerate(columns)]
    return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))


def histogram(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    bins: int = BINS,
    weight: str | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Equal-width histogram per slice and column; empty bins are listed, the last bin is closed.

    Edges are ``lo + i * (hi - lo) / bins``; a value goes to the bin whose edges enclose it, also where
    rounding of the quotient says otherwise. A constant column spans ±0.5 around its value. The edges are
    those of the finite values; where there are infinities, bin 0 counts the negative and bin ``bins + 1`` the positive
    ones. A column without a finite value, or whose range is no finite number, has no rows. ``weight`` names a
    column of row multiplicities. ``bounds`` may hand in a materialised result with ``by…, column, lo, hi``.
    """
    by = as_list(by)
    columns = numeric_cols(df, by) if columns is None else list(columns)
    keys = [*by, "column"]
    if bounds is None:
        bounds = materialize(_finite_ranges(df, columns, by))
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.filter(F.col("hi") - F.col("lo") < F.lit(float("inf"))).select(
        *cols(keys),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    # One row of bounds per slice, so that a data row is joined once and not once per column.
    wide = bounds.groupBy(*cols(by)).agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(end))).alias(f"_{end}{i}")
            for i, c in enumerate(columns)
            for end in ("lo", "hi")
        ]
    )
    extra = [] if weight is None else [F.col(f"`{weight}`").alias("_weight")]
    values = [as_number(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = df.select(*cols(by), *extra, *values)
    if by:
        rows = attach(rows, wide, by)
    else:
        rows = rows.withColumns({c: F.lit(v).cast("double") for c, v in wide.first().asDict().items()})
    items = ", ".join(
        f"named_struct('column', {text_sql(c)}, 'value', _v{i}, 'lo', _lo{i}, 'hi', _hi{i})"
        for i, c in enumerate(columns)
    )
    rows = rows.select(
        *cols(by), *[F.col("_weight") for _ in extra], F.expr(f"inline(array({items}))")
    ).filter("value IS NOT NULL AND lo IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    # Infinities are counted beside the bins, as -1 and ``bins``.
    beyond = F.col("value").isin(float("-inf"), float("inf"))
    place = (F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))
    guess = F.least(F.floor(F.when(~beyond, place)), F.lit(bins - 1))
    counted = (
        rows.withColumn("_bin", guess)
        .withColumn("_bin", F.col("_bin") - (F.col("value") < edge(F.col("_bin"))).cast("int"))
        .withColumn(
            "_bin",
            F.col("_bin")
            + (
                (F.col("_bin") < bins - 1) & (F.col("value") >= edge(F.col("_bin") + 1))
            ).cast("int"),
        )
        .withColumn("_bin", F.when(beyond, F.when(F.col("value") > 0, bins).otherwise(-1)).otherwise(F.col("_bin")))
        .groupBy(*cols(keys), "_bin")
        .agg(
            (F.count(F.lit(1)) if weight is None else F.sum("_weight")).alias("_n"),
            F.max("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    # At most `bins` entries per slice and column.
    filled = (
        counted.groupBy(*cols(keys))
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"),
            F.max("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        .withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(bins))))
        .filter(F.col("_i").between(0, bins - 1) | F.try_element_at("_counts", F.col("_i").cast("bigint")).isNotNull())
    )
    i = F.col("_i")
    return filled.select(
        *cols(keys),
        (i + 1).alias("bin"),
        F.when(i < 0, F.lit(float("-inf"))).otherwise(edge(i)).alias("bin_lo"),
        F.when(i == bins, F.lit(float("inf"))).otherwise(edge(i + 1)).alias("bin_hi"),
        F.coalesce(F.try_element_at("_counts", i.cast("bigint")), F.lit(0)).cast("bigint").alias("n"),
    )


def label_counts(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Occurrences of every label: rows ``(by…, column, label, n)``, combined before the shuffle."""
    by = as_list(by)
    columns = categorical_cols(df, by) if columns is None else list(columns)
    items = [
        F.struct(F.lit(c).alias("column"), _present(df, c).cast("string").alias("label"))
        for c in columns
    ]
    return (
        df.select(*cols(by), F.inline(F.array(*items)))
        .filter(F.col("label").isNotNull())
        .groupBy(*cols([*by, "column"]), "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_balance(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    top: int = 20,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The ``top`` labels per slice and column with their share of all non-null rows.

    Ties go to the label that sorts first.
    """
    by = as_list(by)
    keys = [*by, "column"]
    if counts is None:
        counts = label_counts(df, columns, by)
    totals = counts.groupBy(*cols(keys)).agg(F.sum("n").alias("_total"))
    leaders = ranked_top(counts, top, [F.col("n").desc(), F.col("label")], keys)
    return match(leaders, totals, keys).select(
        *cols(keys), "label", "n", (F.col("n") / F.col("_total")).alias("proportion"), "rank"
    )


def _named(columns: Sequence[str], number: str = "_column") -> Column:
    """The name of a column from its number; rows carry the number only."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(number) + 1).alias("column")


def label_moments(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """What balance measures need to know about *all* labels: rows ``(by…, column, n, n_classes, most,
    least, squares, n_log_n)`` with the number of labelled rows and of labels, the greatest and least count,
    and the sums of n² and n·log2(n). Columns without a label have no row.

    Labels are counted by a 128-bit fingerprint, combined before the shuffle; no text leaves its task.
    """
    by = as_list(by)
    columns = categorical_cols(df, by) if columns is None else list(columns)
    items = []
    for i, c in enumerate(columns):
        label = _present(df, c).cast("string")
        items.append(F.struct(F.lit(i).alias("_column"), label.isNotNull().alias("_seen"), *fingerprint(label)))
    n = F.col("_n").cast("double")
    return (
        df.select(*cols(by), F.inline(F.array(*items)))
        .filter("_seen")
        .groupBy(*cols(by), "_column", "_fp1", "_fp2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*cols(by), "_column")
        .agg(
            F.sum("_n").alias("n"),
            F.count(F.lit(1)).alias("n_classes"),
            F.max("_n").alias("most"),
            F.min("_n").alias("least"),
            F.sum(n * n).alias("squares"),
            F.sum(n * F.log2(n)).alias("n_log_n"),
        )
        .select(*cols(by), _named(columns), "n", "n_classes", "most", "least", "squares", "n_log_n")
    )


def balance_metrics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    moments: DataFrame | None = None,
) -> DataFrame:
    """Gini impurity, entropy, entropy ratio and extreme shares per slice and column, over all labels.

    ``moments`` may hand in a result of ``label_moments``.
    """
    by = as_list(by)
    if moments is None:
        moments = label_moments(df, columns, by)
    total, classes = F.col("n"), F.col("n_classes")
    entropy = F.greatest(F.log2(total) - F.col("n_log_n") / total, F.lit(0.0))
    return moments.select(
        *cols([*by, "column"]),
        "n_classes",
        (F.col("most") / total).alias("max_prop"),
        (F.col("least") / total).alias("min_prop"),
        (F.lit(1.0) - F.col("squares") / (total.cast("double") * total)).alias("gini"),
        entropy.alias("entropy"),
        (entropy / F.when(classes > 1, F.log2(classes)).otherwise(F.lit(1.0))).alias("entropy_ratio"),
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Distinct non-null values per slice and column.

    Exact counts shuffle one fingerprint per distinct value and task: 8 bytes of values of up to 8 bytes, whose hash is
    one-to-one, 16 of others. Columns are counted apart, each in a scan of its own, so columns of few values
    fill no table with those of many; beyond ``COUNT_SCANS`` columns several share a scan. ``exact=False`` uses a
    HyperLogLog sketch in one wide aggregation.
    """
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    if not exact:
        aggregates = [
            F.approx_count_distinct(_present(df, c)).alias(f"_u{i}") for i, c in enumerate(columns)
        ]
        items = [
            F.struct(F.lit(c).alias("column"), F.col(f"_u{i}").alias("unique"))
            for i, c in enumerate(columns)
        ]
        return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))

    def prints(c: str) -> list[Column]:
        value = _present(df, c)
        found = fingerprint(value) if not isinstance(df.schema[c].dataType, NARROW) else [F.xxhash64(value)]
        return [F.when(value.isNotNull(), x).alias(f"_fp{i}") for i, x in enumerate(found)]

    counts = []
    for narrow in (True, False):
        alike = [c for c in columns if isinstance(df.schema[c].dataType, NARROW) == narrow]
        together = -(-len(columns) // COUNT_SCANS)
        for first in range(0, len(alike), together):
            part = alike[first : first + together]
            if len(part) == 1:
                rows = df.select(*cols(by), F.lit(part[0]).alias("column"), *prints(part[0]))
            else:
                items = [F.struct(F.lit(c).alias("column"), *prints(c)) for c in part]
                rows = df.select(*cols(by), F.inline(F.array(*items)))
            counts.append(rows.distinct().groupBy(*cols(by), "column").agg(F.count("_fp0").alias("unique")))
    if not counts:
        return df.limit(0).select(*cols(by), F.lit("").alias("column"), F.lit(0).cast("bigint").alias("unique"))
    return reduce(DataFrame.unionByName, counts)


def null_map(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Nulls, share of nulls, fill rate, distinct values and type per slice and column."""
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    dtype = F.when(F.lit(False), F.lit(""))
    for c in columns:
        dtype = dtype.when(F.col("column") == c, F.lit(df.schema[c].dataType.simpleString()))
    keys = [*by, "column"]
    gaps = missing(df, columns, by)
    return match(gaps, distinct_counts(df, columns, by, exact), keys).select(
        *cols(keys),
        F.col("nulls").alias("null_count"),
        F.col("missing_pct").alias("null_pct"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        dtype.alias("dtype"),
        F.coalesce(
            F.try_divide(F.col("row_count") - F.col("nulls"), F.col("row_count")), F.lit(0.0)
        ).alias("fill_rate"),
    )


def light_state(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Mergeable state of a light profile: rows ``(by…, column, row_count, nulls, sketch)``.

    ``sketch`` is a HyperLogLog of the values; the row with a null column has one of whole rows. One wide
    aggregation, whose size does not depend on the data: states can be kept per file or day and merged later.
    """
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    items = []
    for i, c in enumerate([None, *columns]):
        prints = fingerprint(*[_present(df, x) for x in (columns if c is None else [c])])
        seen = F.lit(True) if c is None else _present(df, c).isNotNull()
        aggregates += [
            F.count_if(~seen).alias(f"_nulls{i}"),
            F.hll_sketch_agg(F.when(seen, prints[0]), F.lit(SKETCH_BITS)).alias(f"_sketch{i}"),
        ]
        items.append(
            F.struct(
                F.lit(c).cast("string").alias("column"),
                F.col("_rows").alias("row_count"),
                F.col(f"_nulls{i}").alias("nulls"),
                F.col(f"_sketch{i}").alias("sketch"),
            )
        )
    return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))


def merge_states(states: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """One state per slice and column from those of its parts; ``by`` may be fewer columns than before."""
    return states.groupBy(*cols(as_list(by)), "column").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def light_profile(states: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Profile of tables too large for more, from states: rows ``(by…, column, row_count, nulls,
    missing_pct, distinct, duplicate_pct)``. Distinct values are estimated, within about 2 %; ``duplicate_pct`` is
    that of whole rows, in the row with a null column."""
    distinct = F.hll_sketch_estimate("sketch")
    repeats = F.greatest(F.col("row_count") - distinct, F.lit(0))
    return states.select(
        *cols([*as_list(by), "column"]),
        "row_count",
        "nulls",
        share("nulls", "row_count").alias("missing_pct"),
        distinct.alias("distinct"),
        F.when(F.col("column").isNull(), share(repeats, F.col("row_count"))).alias("duplicate_pct"),
    )


def describe_all(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Descriptive statistics of all columns: moments and quartiles of numeric ones, distinct labels
    and the most frequent label (ties: the one that sorts first) of the others."""
    by = as_list(by)
    columns = plain_cols(df, by) if columns is None else list(columns)
    keys = [*by, "column"]
    numeric = [c for c in columns if c in set(numeric_cols(df))]
    other = [c for c in columns if c not in set(numeric)]
    out = materialize(
        column_stats(df, columns, by).select(*cols(keys), "n", "mean", "std", "min", "max")
    )
    if numeric:
        wide = (
            quantiles(df, numeric, [0.25, 0.5, 0.75], by, out.filter(F.col("column").isin(numeric)))
            .groupBy(*cols(keys))
            .agg(
                *[
                    F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                    for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
                ]
            )
        )
        out = match(out, wide, keys)
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(q) for q in ("q25", "q50", "q75")])
    if other:
        labels = (
            label_counts(df, other, by)
            .groupBy(*cols(keys))
            .agg(
                F.count(F.lit(1)).alias("unique"),
                F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top"),
                F.max("n").alias("freq"),
            )
        )
        out = match(out, labels, keys)
    else:
        out = out.select(
            "*",
            F.lit(None).cast("bigint").alias("unique"),
            F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("bigint").alias("freq"),
        )
    return out.select(
        *cols(keys), "n", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation matrix in long form, over the rows where both columns are present.

    Columns without spread (in the slice) are left out; an undefined coefficient, as with an infinite value, is 0. Few columns are
    one wide aggregation; for many, tasks sum Gram matrices that are added afterwards.
    """
    by = as_list(by)
    columns = numeric_cols(df, by) if columns is None else list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spread = [F.max(as_number(c)) > F.min(as_number(c)) for c in columns]

    def coefficient(x: Column, y: Column) -> Column:
        r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
        return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))

    def masked(a: str, b: str) -> tuple[Column, Column]:
        x, y = as_number(a), as_number(b)
        return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    if len(pairs) <= WIDE_PAIRS:
        index = {c: i for i, c in enumerate(columns)}
        position = {p: i for i, p in enumerate(pairs)}
        entries = []
        for a in columns:
            for b in columns:
                r = "1D" if a == b else f"_r{position[(a, b) if index[a] < index[b] else (b, a)]}"
                entries.append(
                    f"IF(_spread{index[a]} AND _spread{index[b]}, named_struct('col_a', {text_sql(a)}, "
                    f"'col_b', {text_sql(b)}, 'r', {r}), NULL)"
                )
        return (
            df.groupBy(*cols(by))
            .agg(
                *[s.alias(f"_spread{i}") for i, s in enumerate(spread)],
                *[coefficient(*masked(a, b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)],
            )
            .selectExpr(
                *[f"`{k}`" for k in by],
                f"inline(filter(array({', '.join(entries)}), e -> e IS NOT NULL))",
            )
        )
    return _correlation_of_many(df, columns, by)


def _correlation_of_many(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Correlations from Gram matrices: every task sums products of its rows, slice by slice, and the sums
    are added per (slice, pair). The plan has the same size for any number of columns.

    Values are taken relative to the mean of their slice and divided by its widest deviation, so the sums of
    products keep their digits and stay finite.
    """
    # One row per slice; numbered where it is written.
    means = materialize(
        df.groupBy(*cols(by))
        .agg(
            F.array(
                *[F.struct(F.avg(_finite(c)).alias("m"), (F.max(_finite(c)) - F.min(_finite(c))).alias("w")) for c in columns]
            ).alias("_scale"),
            F.array(*[F.max(as_number(c)) > F.min(as_number(c)) for c in columns]).alias("_alive"),
        )
        .withColumn("_slice", F.monotonically_increasing_id())
    )
    values = F.array(*[as_number(c) for c in columns])
    rows = attach(df.select(*cols(by), values.alias("_x")), means.drop("_alive"), by)
    centred = F.zip_with("_x", "_scale", lambda x, s: F.when(s["w"] > 0, (x - s["m"]) / s["w"]).otherwise(x - s["m"]))
    sums = _gram_sums(rows.select("_slice", centred.alias("_x")), len(columns))
    # Nothing is divided where no row has both.
    n, x, y = F.when(F.col("n") > 1, F.col("n")), F.col("sx"), F.col("sy")
    # Sums over the rows where both columns are present.
    cross = F.col("sxy") - x * y / n
    spread = F.sqrt(F.greatest(F.col("sxx") - x * x / n, F.lit(0.0)) * F.greatest(F.col("syy") - y * y / n, F.lit(0.0)))
    # A column that is constant on the common rows leaves rounding only.
    flat = spread <= F.lit(1e-14) * F.sqrt(F.col("sxx") * F.col("syy"))
    coefficient = F.when(flat | (F.col("infinite") > 0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(cross, spread), F.lit(0.0)))
    upper = sums.select("_slice", "i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(coefficient).alias("r"))
    lower = upper.filter("i <> j").select("_slice", F.col("j").alias("i"), F.col("i").alias("j"), "r")
    alive = lambda c: F.element_at("_alive", F.col(c) + 1)
    return (
        match(upper.unionByName(lower), means, ["_slice"], "inner")
        .filter(alive("i") & alive("j"))
        .select(*cols(by), _named(columns, "i").alias("col_a"), _named(columns, "j").alias("col_b"), "r")
    )


def _gram_sums(rows: DataFrame, width: int) -> DataFrame:
    """(_slice, i, j, n, sx, sy, sxx, syy, sxy, infinite) for i <= j over the rows (_slice, _x) where both x_i and
    x_j are present; infinite ones are only counted. A task holds the sums of as many slices as ``GRAM_CELLS`` allows and hands them on beyond that."""
    first, second = np.triu_indices(width)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "infinite"]
    most = max(1, GRAM_CELLS // (len(names) * width * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for s, sums in held.items():
                parts = [m[first, second] for m in sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), s)), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *map(pa.array, parts)],
                    ["_slice", "i", "j", *names],
                )
            held.clear()

        for batch in batches:
            slices = batch.column("_slice").to_numpy()
            cells = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for s in np.unique(slices).tolist():
                x = cells[slices == s].astype(np.float64)
                here, beyond = (~np.isnan(x)).astype(np.float64), np.isinf(x).astype(np.float64)
                there = here - beyond
                x = np.where(there > 0, x, 0.0)
                # sx: x_i where x_j is present; sy: x_j where x_i is present.
                sx, sxx = x.T @ there, (x * x).T @ there
                sums = [there.T @ there, sx, sx.T, sxx, sxx.T, x.T @ x, beyond.T @ here + here.T @ beyond]
                if s not in held and len(held) >= most:
                    yield from flush()
                held[s] = [a + b for a, b in zip(held[s], sums, strict=True)] if s in held else sums
        yield from flush()

    partial = rows.mapInArrow(run, "_slice bigint, i int, j int, " + ", ".join(f"{c} double" for c in names))
    return partial.groupBy("_slice", "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def custom_stats(
    df: DataFrame,
    *aggregates: Column,
    by: str | Sequence[str] = (),
    key: str | Sequence[str] = (),
    fraction: float = 1.0,
) -> DataFrame:
    """Caller-supplied aggregates next to the row count, optionally on a key-hash sample."""
    if fraction < 1.0:
        df = hash_sample(df, key, fraction)
    return df.groupBy(*cols(as_list(by))).agg(F.count(F.lit(1)).alias("row_count"), *aggregates)


@dataclass(frozen=True)
class TableProfile:
    """The tidy results of a profile; ``keys`` are the slice columns of all of them.

    ``balance`` lists the most frequent labels, for reading; ``metrics`` describes all of them."""

    keys: list[str]
    summary: DataFrame
    columns: DataFrame
    duplicates: DataFrame
    histogram: DataFrame
    balance: DataFrame
    metrics: DataFrame
    df: DataFrame
    by: list[str]
    numeric: list[str]
    categorical: list[str]

    def correlation(self) -> DataFrame:
        return correlation(self.df, self.numeric, self.by)

    def describe(self) -> DataFrame:
        return describe_all(self.df, None, self.by)

    def numeric_stats(self) -> DataFrame:
        return numeric_stats(self.df, self.numeric, self.by)


def profile_table(
    df: DataFrame,
    by: str | Sequence[str] = (),
    groups: dict[str, Sequence[str]] | None = None,
    max_numeric: int | None = 10,
    max_categorical: int | None = 5,
    top: int = 20,
) -> TableProfile:
    """Profile of a table, per slice and, if ``groups`` maps names to columns, per column group.

    Distributions cover all columns, so scores do not depend on the order of columns. ``numeric`` and
    ``categorical`` list the first ``max_numeric`` and ``max_categorical`` of them (of each group), as a
    profile is meant to be read; ``None`` lifts the limit. Scores read the data four times (statistics,
    duplicates, histogram, label fingerprints), each time with only the columns needed; the labels
    themselves are read only if ``balance`` is looked at.
    """
    by = as_list(by)
    everything = plain_cols(df, by)
    members = {"": everything} if groups is None else {g: list(c) for g, c in groups.items()}
    is_numeric = set(numeric_cols(df))
    numeric: list[str] = []
    categorical: list[str] = []
    for columns in members.values():
        numeric += [c for c in columns if c in is_numeric][:max_numeric]
        categorical += [c for c in columns if c not in is_numeric][:max_categorical]
    covered = [c for columns in members.values() for c in columns]
    scored_numeric = [c for c in covered if c in is_numeric]
    scored_categorical = [c for c in covered if c not in is_numeric]

    group_of = F.when(F.lit(False), F.lit(""))
    size_of = F.when(F.lit(False), F.lit(0))
    for g, columns in members.items():
        group_of = group_of.when(F.col("column").isin(columns), F.lit(g))
        size_of = size_of.when(F.col("domain") == g, F.lit(len(columns)))

    def grouped(result: DataFrame) -> DataFrame:
        return result if groups is None else result.withColumn("domain", group_of)

    stats = materialize(column_stats(df, covered, by))
    bounds = stats.filter(F.col("column").isin(scored_numeric) & (F.col("n") >= 2))
    doubles = duplicates(df, None, by, groups)
    hist = histogram(df, scored_numeric, by, bounds=bounds) if scored_numeric else None
    balance = class_balance(df, scored_categorical, by, top) if scored_categorical else None
    metrics = balance_metrics(df, scored_categorical, by) if scored_categorical else None
    keys = by if groups is None else [*by, "domain"]

    summary = grouped(stats).groupBy(*cols(keys)).agg(F.max("row_count").alias("row_count"))
    if groups is None:
        summary = summary.withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))
    else:
        summary = summary.withColumn("column_count", size_of.cast("bigint"))
    spark = df.sparkSession
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}," for f in df.schema if f.name in by)
    if hist is None:
        hist = spark.createDataFrame(
            [], types + "column string, bin int, bin_lo double, bin_hi double, n bigint"
        )
    if balance is None:
        balance = spark.createDataFrame(
            [], types + "column string, label string, n bigint, proportion double, rank int"
        )
    if metrics is None:
        metrics = spark.createDataFrame(
            [],
            types + "column string, n_classes bigint, max_prop double, min_prop double, gini double, "
            "entropy double, entropy_ratio double",
        )
    return TableProfile(
        keys=keys,
        summary=summary,
        columns=grouped(stats),
        duplicates=doubles,
        histogram=grouped(hist),
        balance=grouped(balance),
        metrics=grouped(metrics),
        df=df,
        by=by,
        numeric=numeric,
        categorical=categorical,
    )


__all__ = [
    "TableProfile",
    "balance_metrics",
    "categorical_cols",
    "class_balance",
    "column_stats",
    "complete_columns",
    "correlation",
    "coverage",
    "custom_stats",
    "describe_all",
    "distinct_counts",
    "duplicates",
    "histogram",
    "label_counts",
    "label_moments",
    "light_profile",
    "light_state",
    "merge_states",
    "missing",
    "null_map",
    "numeric_cols",
    "numeric_stats",
    "plain_cols",
    "profile_table",
]
