"""Mixing sources to target weights: hash-seeded Poisson replication.

A source's target repetition rate is its share of the target weights times the size of the whole corpus,
over its own size. Each document draws its number of copies by inverting the Poisson distribution of that
mean at a uniform number, which is a hash of the seed and its key: the draw depends on no order, no
partitioning and no repeated task. Means above ``PIECE`` are sums of independent draws of smaller means,
so that the inversion never underflows. Documents are exploded by their count and shuffled globally by
a hash of (seed, key, copy), which spreads a source or a document of any size evenly.

Sizes are one row per source, aggregated in the tasks before the shuffle; they are broadcast if they
are few and joined by a shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import free_name, keep, maybe_broadcast

PIECE = 16.0
#: Terms of the inversion: the chance of more at a mean of 16 is below 2^-52, the step of the hash.
TERMS = 80
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits: the first 13 hexadecimal digits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def poisson(mean: Column, u: Column) -> Column:
    """The least k whose distribution function exceeds ``u``; ``mean`` at most PIECE."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))
    step = lambda s, j: F.when(
        u < s["cdf"], s
    ).otherwise(
        F.struct((s["p"] * mean / j).alias("p"), (s["cdf"] + s["p"] * mean / j).alias("cdf"), j.alias("k"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, targets: Mapping[str, float] | None, by: str) -> DataFrame:
    """(source, rate) per source, nulls as a source of their own; sizes are numbers of rows."""
    sizes = keep(docs.groupBy(F.col(f"`{by}`").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")))
    if targets is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("target weights must not be negative")
        pairs = [(s, float(w)) for s, w in targets.items()]
        given = docs.sparkSession.createDataFrame(pairs, "wanted string, weight double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("wanted")), "left").fillna(0.0, ["weight"]).drop("wanted")
    whole = weighted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    return keep(
        weighted.crossJoin(F.broadcast(whole))  # one row
        .select("source", (F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")).alias("rate"))
        .fillna(0.0, ["rate"])
    )


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str, float] | None = None,
    by: str = "source",
    key: str = "doc_id",
    seed: str = SEED,
    copy: str | None = "copy",
) -> DataFrame:
    """``docs`` with each row repeated 0, 1, 2, ... times, so that the expected numbers of rows of the
    sources are in proportion to ``targets`` and their sum is that of the input.

    ``targets`` maps sources to weights; sources it does not name have weight 0 and go; None gives every
    source the same. A null source is a source of its own, named None in ``targets``. With ``copy``, a
    column of that name numbers the copies from 1; a column of that name in ``docs`` is replaced. Rows
    with equal keys, null among them, get the same count each. Texts are not looked at, so null, empty
    and very long ones count as any other. An empty table gives an empty one. Without any weight on a
    source that occurs nothing is left.
    """
    source, rate, number, place = (free_name(docs, n) for n in ("_source", "_rate", "_number", "_place"))
    table = rates(docs, targets, by).select(F.col("source").alias(source), F.col("rate").alias(rate))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    pieces = F.greatest(F.ceil(F.col(rate) / PIECE), F.lit(1)).cast("int")
    count = F.aggregate(
        F.sequence(F.lit(1), pieces),
        F.lit(0),
        lambda total, piece: total
        + poisson(F.col(rate) / pieces, uniform(F.lit(seed), name, piece.cast("string"))),
    )
    columns = [F.col(f"`{c}`") for c in docs.columns if c != copy]
    many = (
        docs.join(maybe_broadcast(table), F.col(f"`{by}`").cast("string").eqNullSafe(F.col(source)))
        .withColumn(number, count)
        .filter(F.col(number) > 0)
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col(number))).alias(number))
        .withColumn(place, F.md5(F.concat_ws(":", F.lit(f"{seed}/place"), name, F.col(number).cast("string"))))
    )
    mixed = many.repartition(place).sortWithinPartitions(place)
    return mixed.select(*columns, *([F.col(number).alias(copy)] if copy else []))


def mixing_sql(source: str, columns: str, copy: bool) -> str:
    """DuckDB SQL for ``mix_sources`` with equal weights over a table or query ``source``."""
    shown = f"{columns}, k::INTEGER AS copy" if copy else columns
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT *, row_number() OVER () AS row_no FROM {source}),
sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate,
         greatest(ceil(1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE / n / 16.0), 1)::BIGINT AS pieces
  FROM sizes),
cdf AS (
  SELECT source, 0 AS k, exp(-rate / pieces) AS p, exp(-rate / pieces) AS f, rate / pieces AS mean FROM rates
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), f + p * mean / (k + 1), mean FROM cdf WHERE k < {TERMS}),
draws AS (
  SELECT row_no, d.source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || piece), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, pieces + 1)) AS piece)),
counts AS (
  SELECT row_no, sum(own) AS n FROM (
    SELECT w.row_no, w.u, least(count(c.k), {TERMS}) AS own
    FROM draws w LEFT JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.f <= w.u
    GROUP BY w.row_no, w.u) GROUP BY row_no)
SELECT {shown} FROM docs JOIN counts USING (row_no), LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS k)
"""
