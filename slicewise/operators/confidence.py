"""Confidence intervals: bootstrap of a mean, and the normal approximation for risk scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import key_md5, risk_ci
from slicewise.operators.joining import as_list, cols, match

def _poisson_steps() -> list[int]:
    """Cumulative Poisson(1) probabilities as thresholds on 32 bits."""
    steps, upto, term, k = [], 0.0, math.exp(-1), 0
    while math.ceil((upto + term) * 2**32) < 2**32:
        upto += term
        steps.append(math.ceil(upto * 2**32))
        k += 1
        term /= k
    return steps


POISSON_STEPS = np.array(_poisson_steps(), np.int64)
BITS = 2**32 - 1
#: An odd factor whose products with 32 bits are longs.
FACTOR = 0x45D9F3B
#: Weights that are made at once, and slices whose sums a task holds.
BLOCK_WEIGHTS, HELD_SLICES = 1 << 20, 4096


def poisson_weights(first: np.ndarray, step: np.ndarray, reps: int) -> np.ndarray:
    """A Poisson(1) weight per row and replicate: 32 bits start at ``first``, go on by ``step`` with every
    replicate, are scrambled by multiplication and looked up in the inverse distribution."""
    bits = (first[:, None] + np.arange(reps) * step[:, None]) & BITS
    for _ in range(2):
        bits = (((bits >> 16) ^ bits) * FACTOR) & BITS
    return np.searchsorted(POISSON_STEPS, bits, "right").astype(np.float64)


def _replicate_sums(rows: DataFrame, by: Sequence[str], reps: int) -> DataFrame:
    """(by…, rep, _w, _wx) of rows (by…, _x, _first, _step): sums of weights and of weighted values."""
    keys = [f"_k{i}" for i in range(len(by))]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for values, sums in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([v] * reps, kind) for v, kind in zip(values, kinds, strict=True)],
                        pa.array(np.arange(reps, dtype=np.int32)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                    ],
                    [*keys, "rep", "_w", "_wx"],
                )
            held.clear()

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            x, first, step = (batch.column(c).to_numpy() for c in ("_x", "_first", "_step"))
            group = np.zeros(len(x), np.int64)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                _, group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
            order = np.argsort(group, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
            start = 0
            for end in ends.tolist() if len(order) else []:
                rows_of = order[start:end]
                values = tuple(batch.column(k)[int(rows_of[0])].as_py() for k in keys)
                if values not in held and len(held) >= HELD_SLICES:
                    yield from flush()
                sums = held.setdefault(values, np.zeros((2, reps)))
                for part in range(0, len(rows_of), max(1, BLOCK_WEIGHTS // reps)):
                    some = rows_of[part : part + max(1, BLOCK_WEIGHTS // reps)]
                    weights = poisson_weights(first[some], step[some], reps)
                    sums[0] += weights.sum(axis=0)
                    sums[1] += x[some] @ weights
                start = end
        yield from flush()

    named = rows.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], "_x", "_first", "_step")
    schema = ", ".join([*[f"{k} {types[b]}" for b, k in zip(by, keys, strict=True)], "rep int, _w double, _wx double"])
    return (
        named.mapInArrow(run, schema)
        .groupBy(*keys, "rep")
        .agg(F.sum("_w").alias("_w"), F.sum("_wx").alias("_wx"))
        .withColumnsRenamed(dict(zip(keys, by, strict=True)))
    )


def bootstrap_ci(
    df: DataFrame,
    value: str,
    key: str | Sequence[str],
    reps: int = 100,
    by: str | Sequence[str] = (),
    level: float = 0.95,
) -> DataFrame:
    """Poisson bootstrap of the mean of a column, per slice.

    In every replicate a row has a Poisson(1) weight, so replicates are weighted means. All weights of a row
    come from one md5 of its key, so the result is the same for any partitioning. Rows are not repeated:
    tasks add up the replicates of their rows as arrays, and one partial sum per slice and replicate leaves them.
    An empty slice has zeros, a single value no width.
    """
    by, keys = as_list(by), as_list(key)
    number = F.col(f"`{value}`").cast("double")
    x = F.when(~F.isnan(number), number)
    digits = key_md5(keys)
    rows = df.select(
        *cols(by),
        x.alias("_x"),
        F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint").alias("_first"),
        F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint").alias("_step"),
    ).filter(F.col("_x").isNotNull())
    means = _replicate_sums(rows, by, reps).withColumn("_mean", F.try_divide("_wx", "_w"))
    tail = (1 - level) / 2
    spread = means.groupBy(*cols(by)).agg(
        F.percentile("_mean", F.lit(tail)).alias("_lower"),
        F.percentile("_mean", F.lit(1 - tail)).alias("_upper"),
        F.stddev_samp("_mean").alias("_error"),
    )
    points = df.groupBy(*cols(by)).agg(
        F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("point_estimate")
    )
    one = F.col("n") <= 1
    point = F.col("point_estimate")
    return match(points, spread, by).select(
        *cols(by),
        "n",
        "point_estimate",
        F.when(one, point).otherwise(F.col("_lower")).alias("lower_bound"),
        F.when(one, point).otherwise(F.col("_upper")).alias("upper_bound"),
        F.lit(level).alias("confidence_level"),
        F.when(one, F.lit(0.0)).otherwise(F.col("_error")).alias("standard_error"),
    )


def risk_intervals(
    cards: DataFrame,
    scores: dict[str, str],
    keys: str | Sequence[str],
    sample_size: str | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Long form of the risk scores with their normal intervals: rows ``(keys…, risk, …)``.

    ``scores`` maps risk names to score columns; a missing score has no interval. Without a column of
    sample sizes 1,000 is assumed.
    """
    n = F.lit(K.RISK_SAMPLE) if sample_size is None else F.col(sample_size)
    items = [
        F.struct(
            F.lit(name).alias("risk"),
            F.col(c).cast("double").alias("value"),
            risk_ci(c, n, level).alias("_ci"),
        )
        for name, c in scores.items()
    ]
    return cards.select(*cols(as_list(keys)), F.inline(F.array(*items))).select(
        *cols(as_list(keys)),
        "risk",
        "value",
        F.col("_ci.lower_bound").alias("lower_bound"),
        F.col("_ci.upper_bound").alias("upper_bound"),
        F.col("_ci.standard_error").alias("standard_error"),
    )
