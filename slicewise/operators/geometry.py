"""Outliers in feature space: distances of probes to their nearest neighbours among all rows of their slice.

Means and scales come from all rows. The probes are a fixed-size sample per slice; every row of the slice is
held against them, block by block: the probes of a bounded number of slices are broadcast, tasks keep
the least distance per probe, and only these minima are shuffled. Pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slicewise.functions import constants as K
from slicewise.functions.exprs import clamp_sql, fingerprint, share_sql, tier_sql
from slicewise.functions.issues import Issue, advice_sql, issues_sql
from slicewise.operators.joining import as_list, attach, cols, match, materialize
from slicewise.operators.sampling import top_hash

SAMPLE_ROWS = 10_000
PROBES = 500
LEAST_ROWS = 50
#: Numbers of a broadcast block of probes, and of a block of rows that is held against them.
BLOCK_CELLS, ROW_CELLS = 1 << 21, 1 << 16
#: Rounding of a distance: per unit of a coordinate before it is standardised, and of the distance itself.
ROUNDING, RELATIVE_ROUNDING = 1e-13, 1e-12


def _vector(features: str | Sequence[str]) -> Column:
    """Features as one array of doubles: a vector column or several numeric columns. What is not a finite
    number is null; a null vector stays null."""

    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < float("inf"), x)

    if isinstance(features, str):
        return F.transform(F.col(f"`{features}`"), lambda x: finite(x.cast("double")))
    return F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in features])


def feature_scale(rows: DataFrame, by: str | Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """Mean and scale of every dimension that no vector of the slice lacks.

    The scale is the population deviation, 1 for a constant dimension. One row per slice: ``vectors``, their
    number, and ``scale``, an array of (dim, mean, width) in order of the dimensions. A dimension that is null in one
    vector or beyond the end of a short one is left out; null vectors do not count.
    """
    by = as_list(by)
    width = F.stddev_pop("_x")
    # A leading one counts the vectors of the slice, whatever their length.
    padded = F.concat(F.array(F.lit(1.0)), F.col(vec))
    whole = Window.partitionBy(*(cols(by) or [F.lit(0)]))
    dims = (
        rows.filter(F.col(vec).isNotNull())
        .select(*cols(by), F.posexplode(padded).alias("_dim", "_x"))
        .groupBy(*cols(by), "_dim")
        .agg(
            F.count("_x").alias("_n"),
            F.avg("_x").alias("mean"),
            F.when(width > 0, width).otherwise(F.lit(1.0)).alias("width"),
        )
    )
    complete = (F.col("_dim") > 0) & (F.col("_n") == F.col("_all"))
    # At most one entry per dimension.
    return (
        dims.withColumn("_all", F.max(F.when(F.col("_dim") == 0, F.col("_n"))).over(whole))
        .groupBy(*cols(by))
        .agg(
            F.max("_all").alias("vectors"),
            F.array_sort(
                F.collect_list(F.when(complete, F.struct((F.col("_dim") - 1).alias("dim"), "mean", "width")))
            ).alias("scale"),
        )
    )


def standardize(
    rows: DataFrame, scale: DataFrame, by: str | Sequence[str] = (), vec: str = "vec"
) -> DataFrame:
    """Replace vectors by standardised ones (complete dimensions only). ``scale`` must be materialised; it is
    broadcast if it is small. Rows with a null vector, or of slices without a complete dimension, are dropped."""
    usable = scale.filter(F.size("scale") > 0)
    scaled = F.transform(
        F.col("scale"), lambda s: (F.get(F.col(vec), s["dim"]) - s["mean"]) / s["width"]
    )
    return attach(rows.filter(F.col(vec).isNotNull()), usable, as_list(by)).withColumn(vec, scaled).drop("scale")


def _least_distances(rows: np.ndarray, points: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distance of every point to the nearest row; ``own`` lists the (rows, points) that share a key.

    Inner products find the nearest rows but for rounding; those within its bounds are compared exactly."""
    rough = (rows**2).sum(axis=1)[:, None] - 2 * rows @ points.T
    rough[own[0], own[1]] = np.inf
    least = rough.min(axis=0)
    size = (rows**2).sum(axis=1).max() + (points**2).sum(axis=1)
    near, of = np.nonzero(rough <= least + 1e-12 * (size + 1))
    out = np.full(len(points), np.inf)
    for part in range(0, len(near), ROW_CELLS):
        r, p = near[part : part + ROW_CELLS], of[part : part + ROW_CELLS]
        exact = ((rows[r] - points[p]) ** 2).sum(axis=1)
        exact[np.isinf(rough[r, p])] = np.inf
        np.minimum.at(out, p, exact)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest_in_block(rows: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(_slice, _rank, distance): least distance of the block's probes to the rows of their slice."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {s: np.full(len(ranks), np.inf) for s, (ranks, _, _) in sent.value.items()}
        for batch in batches:
            slices = batch.column("_slice").to_numpy()
            prints = np.stack([batch.column(c).to_numpy() for c in ("_fp1", "_fp2")], axis=1)
            for s in np.unique(slices).tolist():
                _, own, points = sent.value[s]
                at = np.flatnonzero(slices == s)
                vectors = _matrix(batch.column("vec").take(pa.array(at)))
                step = max(1, ROW_CELLS // max(1, len(points)))
                for a in range(0, len(at), step):
                    # A probe is not its own neighbour: rows with its key are left out.
                    some = prints[at[a : a + step]]
                    first = np.searchsorted(own[:, 0], some[:, 0])
                    count = np.searchsorted(own[:, 0], some[:, 0], "right") - first
                    row = np.repeat(np.arange(len(some)), count)
                    point = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                    same = (own[point] == some[row]).all(axis=1)
                    found = _least_distances(vectors[a : a + step], points, (row[same], point[same]))
                    np.minimum(least[s], found, out=least[s])
        for s, found in least.items():
            seen = np.flatnonzero(np.isfinite(found))
            if len(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), s)), pa.array(sent.value[s][0][seen]), pa.array(np.sqrt(found[seen]))],
                    ["_slice", "_rank", "distance"],
                )

    partial = rows.select("_slice", "_fp1", "_fp2", "vec").mapInArrow(run, "_slice bigint, _rank bigint, distance double")
    return partial.groupBy("_slice", "_rank").agg(F.min("distance").alias("distance"))


def nn_distance(
    probes: DataFrame,
    rows: DataFrame,
    key: str | Sequence[str],
    by: str | Sequence[str] = (),
    vec: str = "vec",
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Distance of each probe to the nearest of ``rows`` in its slice: rows ``(by…, _rank, distance)``.

    ``probes`` has (by…, key…, _rank, vec) and a bounded number of rows per slice; the vectors of a slice have one
    length. Rows with a probe's key are not its neighbours; a probe without a neighbour has no row here. The probes go
    to the tasks in blocks of at most ``block_cells`` numbers (one slice at least), each with its own pass over the rows.
    """
    by, keys = as_list(by), as_list(key)
    prints = fingerprint(*cols(keys))
    # One row per slice with probes; numbered where they are written, dealt to blocks by hash.
    sizes = materialize(probes.groupBy(*cols(by)).agg(F.sum(F.size(vec)).alias("_cells")))
    cells = sizes.agg(F.sum("_cells")).first()[0] or 0
    dealt = F.pmod(F.xxhash64(F.lit(0), *cols(by)), F.lit(max(1, -(-cells // block_cells))))
    sizes = materialize(sizes.select(*cols(by), F.monotonically_increasing_id().alias("_slice"), dealt.alias("_block")))
    numbered = match(probes, sizes, by, "inner").select("_block", "_slice", F.col("_rank").cast("bigint"), *prints, F.col(vec).alias("vec"))
    numbered = materialize(numbered)
    own = rows.select(*cols(by), *prints, F.col(vec).alias("vec"))
    out = None
    for (number,) in sizes.select("_block").distinct().collect():
        part = numbered.filter(F.col("_block") == number).orderBy("_slice", "_fp1").toArrow().combine_chunks()
        where = part.column("_slice").to_numpy()
        block = {}
        for s in np.unique(where).tolist():
            mine = part.take(pa.array(np.flatnonzero(where == s))).combine_chunks()
            ids = np.stack([mine.column(c).to_numpy() for c in ("_fp1", "_fp2")], axis=1)
            block[s] = mine.column("_rank").to_numpy(), ids, _matrix(mine.column("vec").chunk(0))
        found = _nearest_in_block(attach(own, sizes.filter(F.col("_block") == number), by), block)
        found = match(sizes.drop("_block"), materialize(found), ["_slice"], "inner").drop("_slice")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = probes.select(*cols(by), F.col("_rank").cast("bigint"), F.lit(None).cast("double").alias("distance")).filter("false")
    return out


def geometry_scan(
    df: DataFrame,
    key: str | Sequence[str],
    features: str | Sequence[str],
    by: str | Sequence[str] = (),
    probes: int = PROBES,
    against: str = "all",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Vulnerability of a table to injected points, per slice.

    Features are scaled and ``probes`` rows (smallest key hashes) compared with all rows of their slice;
    with ``against="sample"`` a fixed-size sample of ``sample_rows`` sets the scale and the probes are compared with
    each other. ``outlier_pct`` counts probes whose distance is more than three deviations from the mean. ``isolated_pct``
    counts those above the 95th percentile, which is about 5 % by construction (less if distances tie there: what differs
    by rounding only is equal) and kept because the score is defined with it.

    ``vectors`` counts the rows that took part, ``missing_vectors`` those with a null vector. A dimension that a vector lacks
    (null, not finite, too short) is left out for the slice. Slices with fewer than 50 vectors or without a complete
    dimension have no score and the level ``UNKNOWN``.
    """
    if probes < 2:
        raise ValueError("probes must be at least 2")
    if against not in ("all", "sample"):
        raise ValueError(f"Unknown neighbours: {against}")
    by, keys = as_list(by), as_list(key)
    rows = df.select(*cols(dict.fromkeys([*by, *keys])), _vector(features).alias("vec"))
    present = rows.filter(F.col("vec").isNotNull())
    if against == "sample":
        present = materialize(top_hash(present, keys, sample_rows, by, rank="_rank"))
        chosen = present.filter(F.col("_rank") <= probes)
    else:
        chosen = materialize(top_hash(present, keys, probes, by, rank="_rank"))
    scale = materialize(feature_scale(present, by))
    chosen = materialize(standardize(chosen, scale.drop("vectors"), by))
    if against == "sample":
        others = chosen
    else:
        others = standardize(present, scale.drop("vectors"), by)
    distances = materialize(nn_distance(chosen, others, keys, by))
    sizes = rows.groupBy(*cols(by)).agg(F.count_if(F.col("vec").isNull()).alias("missing_vectors"))
    sizes = match(sizes, scale.select(*cols(by), "vectors"), by).fillna(0, ["vectors"])
    moments = distances.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("distance").alias("_mean"),
        F.stddev_pop("distance").alias("_std"),
        F.percentile("distance", F.lit(0.95)).alias("_p95"),
    )
    z = (F.col("distance") - F.col("_mean")) / (F.col("_std") + F.lit(1e-9))
    largest = F.array_max(F.transform("scale", lambda s: F.abs(s["mean"] / s["width"])))
    moments = match(moments, scale.select(*cols(by), (F.lit(ROUNDING) * (largest + 1)).alias("_rounding")), by, "inner")
    tied = F.col("_rounding") + F.lit(RELATIVE_ROUNDING) * F.col("_p95")
    counts = (
        match(distances, moments, by, "inner")
        .groupBy(*cols(by))
        .agg(
            F.count(F.lit(1)).alias("_analyzed"),
            F.count_if(F.abs(z) > 3).alias("_outliers"),
            F.count_if(F.col("distance") > F.col("_p95") + tied).alias("_isolated"),
        )
    )
    enough = f"vectors >= {LEAST_ROWS} AND coalesce(_analyzed, 0) > 0"
    outlying, isolated = "outlier_pct > 2", "isolated_pct > 5"
    found = [
        Issue(outlying, "GEOMETRIC_OUTLIERS", "warning", "outlier_pct", "percent of the probes are outliers"),
        Issue(isolated, "ISOLATED_POINTS", "warning", "isolated_pct", "percent of the probes lie apart"),
        Issue("vulnerability_score < 20", "GEOMETRY_OK", "info", "vulnerability_score", "the geometry looks robust"),
    ]
    told = advice_sql(
        (outlying, "Inspect the outlying points"), (isolated, "Filter points in sparse regions")
    )
    return match(sizes, counts, by).selectExpr(
        "*",
        f"CASE WHEN {enough} THEN _analyzed END AS samples_analyzed",
        f"CASE WHEN {enough} THEN _outliers END AS outlier_count",
        f"CASE WHEN {enough} THEN {share_sql('_outliers', '_analyzed')} END AS outlier_pct",
        f"CASE WHEN {enough} THEN {share_sql('_isolated', '_analyzed')} END AS isolated_pct",
        f"{clamp_sql('outlier_pct * 5 + isolated_pct * 2')} AS vulnerability_score",
        f"{tier_sql('vulnerability_score', K.VULNERABILITY_TIERS)} AS vulnerability_level",
        f"{issues_sql(found)} AS vulnerability_issues",
        f"{told} AS vulnerability_advice",
    ).drop("_analyzed", "_outliers", "_isolated")
