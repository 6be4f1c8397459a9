"""Exact quantiles of numeric columns per slice, without gathering a slice in one task.

``percentile`` keeps every distinct value of a group in one buffer. That is used only while the largest
slice is known to be small. Beyond that the wanted ranks are narrowed down: each round counts the values
of the current bracket of a rank in ``CELLS`` equal cells (partial counts are combined before the
shuffle, so only cell counts travel), picks the cell that holds the rank and shrinks the bracket to the
least and greatest value in it. Cells are equal in value and, every other round while a bracket spans more
than one power of two, in logarithm: a few rounds reach neighbouring doubles whatever the distribution.
Rounds end as soon as no bracket of several values holds more than ``ENOUGH`` rows; then the distinct
values left in the brackets are counted and ranked. Rounds read the data once each and shuffle next to nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slicewise.operators.joining import as_list, attach, cols, match, materialize

SINGLE_PASS_ROWS = 1_000_000
CELLS = 4096
ENOUGH = 100_000


def as_number(name: str) -> Column:
    """A numeric column as double, NaN as null."""
    value = f"CAST(`{name}` AS DOUBLE)"
    return F.expr(f"CASE WHEN NOT isnan({value}) THEN {value} END")


def long_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Unpivot numeric columns to rows ``(by…, column, value)`` without nulls. No shuffle."""
    items = [F.struct(F.lit(c).alias("column"), as_number(c).alias("value")) for c in columns]
    return df.select(*cols(by), F.inline(F.array(*items))).filter(F.col("value").isNotNull())


def ranges(df: DataFrame, columns: Sequence[str], by: str | Sequence[str] = ()) -> DataFrame:
    """Count, least and greatest value per slice and column, from one wide aggregation."""
    by = as_list(by)
    aggregates, items = [], []
    for i, c in enumerate(columns):
        aggregates += [
            F.count(as_number(c)).alias(f"_n{i}"),
            F.min(as_number(c)).alias(f"_lo{i}"),
            F.max(as_number(c)).alias(f"_hi{i}"),
        ]
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_n{i}").alias("n"),
                F.col(f"_lo{i}").alias("min"),
                F.col(f"_hi{i}").alias("max"),
            )
        )
    return df.groupBy(*cols(by)).agg(*aggregates).select(*cols(by), F.inline(F.array(*items)))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: str | Sequence[str] = (),
    stats: DataFrame | None = None,
    single_pass_rows: int = SINGLE_PASS_ROWS,
    enough: int = ENOUGH,
) -> DataFrame:
    """Rows ``(by…, column, prob, value)``, linearly interpolated between neighbouring ranks.

    ``stats`` may hand in a materialised result with ``by…, column, n, min, max``.
    """
    by = as_list(by)
    if stats is None:
        stats = materialize(ranges(df, columns, by))
    largest = stats.agg(F.max("n")).first()[0] or 0
    if largest <= single_pass_rows:
        return _single_pass(df, columns, probs, by)
    return _narrowed(df, columns, probs, by, stats, enough)


def _single_pass(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]
) -> DataFrame:
    wanted = [float(p) for p in probs]
    aggregates = [
        F.percentile(as_number(c), F.array(*[F.lit(p) for p in wanted])).alias(f"_q{i}")
        for i, c in enumerate(columns)
    ]
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(p).alias("prob"),
            F.get(F.col(f"_q{i}"), F.lit(j)).alias("value"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(wanted)
    ]
    return (
        df.groupBy(*cols(by))
        .agg(*aggregates)
        .select(*cols(by), F.inline(F.array(*items)))
        .filter(F.col("value").isNotNull())
    )


def _narrowed(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str],
    stats: DataFrame,
    enough: int,
) -> DataFrame:
    keys = [*by, "column"]
    bracket = [*keys, "lo", "hi"]
    numbers = long_numbers(df, columns, by)

    position = F.col("prob") * (F.col("n") - 1)
    wanted = (
        stats.filter(F.col("n") > 0)
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select(
            *cols(keys),
            "prob",
            F.floor(position).alias("low_rank"),
            F.ceil(position).alias("high_rank"),
            (position - F.floor(position)).alias("weight"),
            F.col("min").alias("lo"),
            F.col("max").alias("hi"),
            "n",
        )
    )
    ranks = (
        wanted.withColumn("rank", F.explode(F.array("low_rank", "high_rank")))
        .select(
            *cols(keys),
            "rank",
            "lo",
            "hi",
            F.lit(0).cast("bigint").alias("below"),
            F.col("n").alias("inside"),
        )
        .distinct()
    )
    wanted = materialize(wanted)
    ranks = materialize(ranks)

    logarithmic = False
    # Each round takes at least one value from every open bracket.
    while True:
        fullest = ranks.filter(F.col("lo") < F.col("hi")).agg(F.max("inside")).first()[0]
        if fullest is None or fullest <= enough:
            break
        open_brackets = ranks.filter(F.col("lo") < F.col("hi")).select(*cols(bracket)).distinct()
        ranks = materialize(_shrink(numbers, ranks, materialize(open_brackets), keys, bracket, logarithmic))
        logarithmic = not logarithmic

    left = materialize(ranks.filter(F.col("lo") < F.col("hi")).select(*cols(bracket)).distinct())
    counted = (
        _inside(numbers, left, keys)
        .groupBy(*cols(bracket), "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    window = Window.partitionBy(*cols(bracket)).orderBy("value")
    steps = counted.withColumn("upto", F.sum("n").over(window)).withColumn(
        "start", F.col("upto") - F.col("n")
    )
    within = F.col("rank") - F.col("below")
    resolved = (
        match(ranks.filter(F.col("lo") < F.col("hi")), steps, bracket, "inner")
        .filter((within >= F.col("start")) & (within < F.col("upto")))
        .select(*cols(keys), "rank", "value")
        .unionByName(
            ranks.filter(F.col("lo") == F.col("hi")).select(
                *cols(keys), "rank", F.col("lo").alias("value")
            )
        )
    )
    low = resolved.withColumnsRenamed({"rank": "low_rank", "value": "low"})
    high = resolved.withColumnsRenamed({"rank": "high_rank", "value": "high"})
    both = match(match(wanted, low, [*keys, "low_rank"]), high, [*keys, "high_rank"])
    return both.select(
        *cols(keys),
        "prob",
        _between(F.col("low"), F.col("high"), F.col("weight")).alias("value"),
    )


def _between(low: Column, high: Column, weight: Column) -> Column:
    """Interpolated as ``percentile`` does it for infinite ends."""
    infinite = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    return (
        F.when(low == high, low)
        .when(infinite, (1 - weight) * low + weight * high)
        .otherwise(low + weight * (high - low))
    )


def _magnitude(value: Column) -> Column:
    """Grows with a double, by one for each power of two; finite for infinities."""
    return F.when(value == 0, 0.0).otherwise(
        F.signum(value) * (F.least(F.log2(F.abs(value)), F.lit(1025.0)) + 1080)
    )


def _inside(numbers: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values that lie in an open bracket. Brackets of one column do not overlap, so no row repeats."""
    return attach(numbers, brackets, keys).filter(
        (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    )


def _shrink(
    numbers: DataFrame,
    ranks: DataFrame,
    brackets: DataFrame,
    keys: Sequence[str],
    bracket: Sequence[str],
    logarithmic: bool,
) -> DataFrame:
    width = F.col("hi") - F.col("lo")
    finite = width < F.lit(float("inf"))
    least, spread = _magnitude(F.col("lo")), _magnitude(F.col("hi")) - _magnitude(F.col("lo"))
    by_power = (spread > 1) & F.lit(logarithmic)
    cell = (
        F.when(F.col("value") == F.col("lo"), 0)
        .when(F.col("value") == F.col("hi"), CELLS - 1)
        .when(
            by_power,
            F.least(
                F.floor(F.when(by_power, (_magnitude(F.col("value")) - least) / spread * CELLS)), F.lit(CELLS - 1)
            ),
        )
        # An infinite end gets a cell of its own; the finite values between share one this round.
        .when(~finite, 1)
        .otherwise(
            F.least(
                F.floor(F.when(finite, (F.col("value") - F.col("lo")) / width * CELLS)),
                F.lit(CELLS - 1),
            )
        )
    )
    cells = (
        _inside(numbers, brackets, keys)
        .withColumn("cell", cell.cast("int"))
        .groupBy(*cols(bracket), "cell")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("new_lo"), F.max("value").alias("new_hi")
        )
    )
    # At most CELLS rows per bracket.
    window = Window.partitionBy(*cols(bracket)).orderBy("cell")
    cells = cells.withColumn("start", F.sum("n").over(window) - F.col("n"))
    within = F.col("rank") - F.col("below")
    narrowed = (
        match(ranks.filter(F.col("lo") < F.col("hi")), cells, bracket, "inner")
        .filter((within >= F.col("start")) & (within < F.col("start") + F.col("n")))
        .select(
            *cols(keys),
            "rank",
            F.col("new_lo").alias("lo"),
            F.col("new_hi").alias("hi"),
            (F.col("below") + F.col("start")).alias("below"),
            F.col("n").alias("inside"),
        )
    )
    return narrowed.unionByName(ranks.filter(F.col("lo") == F.col("hi")))
