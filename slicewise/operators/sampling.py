"""Samples and limits. All of them are explicit; no other operator samples on its own account.

Random choices are functions of the row key (md5), so the same rows are chosen for any partitioning,
on any cluster and after any retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slicewise.functions import constants as K
from slicewise.functions.exprs import column, key_md5
from slicewise.operators.joining import as_list, attach, cols, match, materialize

SPREAD = 128


def sample_fraction(size: int, rows: int) -> float:
    """Share of rows to keep for a target size, between 0.01 % and all."""
    return max(0.0001, min(1.0, size / rows)) if rows else 1.0


def hash_sample(df: DataFrame, key: str | Sequence[str], fraction: float) -> DataFrame:
    """Bernoulli sample by key hash: an ordinary filter, no shuffle.

    The first 8 hexadecimal digits of the md5 are compared with the threshold as text; for digits of
    fixed width that is the numeric order.
    """
    threshold = math.ceil(fraction * 2**32)
    if threshold >= 2**32:
        return df
    return df.filter(F.substring(key_md5(as_list(key)), 1, 8) < F.lit(f"{max(threshold, 0):08x}"))


def ranked_top(
    df: DataFrame,
    n: int,
    order: Sequence[Column],
    by: str | Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows per slice in the given (total) order, with their rank, in two steps.

    Step one ranks within (slice, group of input partitions): Spark cuts every map task's output to
    ``n`` rows per slice before the shuffle (WindowGroupLimit), and one hot slice is spread over
    ``SPREAD`` tasks. Step two ranks the at most ``SPREAD * n`` survivors of each slice. The result is
    exact whatever rows share a group. Without slices the first step is a top-k per group as well,
    and the last one a TakeOrderedAndProject.
    """
    keys = cols(as_list(by))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    survivors = (
        df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        .withColumn(rank, F.row_number().over(first))
        .filter(F.col(rank) <= n)
        .drop("_part", rank)
    )
    if keys:
        final = Window.partitionBy(*keys).orderBy(*order)
        return survivors.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)
    # At most n rows are left here, so ranking them in one task is cheap.
    top = survivors.orderBy(*order).limit(n).withColumn("_all", F.lit(0))
    return top.withColumn(
        rank, F.row_number().over(Window.partitionBy("_all").orderBy(*order))
    ).drop("_all")


def top_hash(
    df: DataFrame,
    key: str | Sequence[str],
    n: int,
    by: str | Sequence[str] = (),
    rank: str | None = None,
) -> DataFrame:
    """Fixed-size sample without replacement: the ``n`` rows (per slice) with the smallest key hash.

    ``key`` must identify a row; rows with the same key may replace each other.

    Hashes are uniform, so the size of a slice tells below which hash its first ``n`` rows lie, give or
    take. Large slices are therefore cut with a plain filter before anything is sorted. The rows that
    pass are written (a little over ``n`` per slice) and counted; should a slice have kept fewer than
    ``n``, which takes keys that repeat, the uncut table is ranked instead.
    """
    keys, by = as_list(key), as_list(by)
    order = [key_md5(keys), *cols(keys)]
    cut = _below_threshold(df, keys, n, by)
    out = ranked_top(df if cut is None else cut, n, order, by, rank or "_rank")
    return out if rank else out.drop("_rank")


def _below_threshold(
    df: DataFrame, keys: Sequence[str], n: int, by: Sequence[str]
) -> DataFrame | None:
    """Rows whose hash is below the threshold of their slice; None if there is nothing to gain or if a
    slice would miss rows."""
    slack = n + 8 * math.sqrt(n) + 64
    sizes = materialize(df.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias("_size")))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    if largest < 4 * slack:
        return None
    part = F.least(F.lit(1.0), F.lit(slack) / F.col("_size"))
    limits = sizes.withColumn(
        "_limit", F.lpad(F.lower(F.hex(F.floor(part * (2**32 - 1)))), 8, "0")
    ).select(*cols(by), "_limit")
    digits = F.substring(key_md5(keys), 1, 8)
    if by:
        kept = attach(df, materialize(limits), by).filter(digits <= F.col("_limit")).drop("_limit")
    else:
        kept = df.filter(digits <= F.lit(limits.first()["_limit"]))
    kept = materialize(kept)
    found = kept.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias("_kept"))
    short = match(sizes, found, by).filter(
        F.coalesce(F.col("_kept"), F.lit(0)) < F.least(F.col("_size"), F.lit(n))
    )
    return kept if short.isEmpty() else None


def head_lines(
    lines: DataFrame,
    n: int | None,
    order: str | Sequence[str],
    by: str | Sequence[str] = (),
) -> DataFrame:
    """First ``n`` lines (per slice) in the given order; ``None`` keeps all of them."""
    if n is None:
        return lines
    return ranked_top(lines, n, cols(as_list(order)), by, "_rank").drop("_rank")


def auto_sample_size(rows: Column | str, requested: int | None = None) -> Column:
    """Sample size for a table of ``rows`` rows: all of a small table, a shrinking share of a large one."""
    rows = column(rows).cast("bigint")
    if requested is not None:
        wanted = F.lit(requested).cast("bigint")
    else:
        part = F.when(F.lit(False), F.lit(0.0))
        for below, part_of_rows in K.SAMPLE_SHARES:
            part = part.when(rows < below, F.lit(part_of_rows))
        wanted = F.floor(rows * part.otherwise(F.lit(K.LAST_SAMPLE_SHARE)))
    bounded = F.greatest(
        F.lit(K.MIN_SAMPLE).cast("bigint"), F.least(wanted, F.lit(K.MAX_SAMPLE).cast("bigint"), rows)
    )
    return (
        F.when(rows == 0, F.lit(K.MIN_SAMPLE).cast("bigint"))
        .when(rows <= K.MIN_SAMPLE, rows)
        .otherwise(bounded)
    )
