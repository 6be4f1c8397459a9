"""Nearest-neighbour geometry against brute force, and incomplete vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import slicewise as S
from slicewise.operators import joining
from slicewise.operators.geometry import nn_distance

SCHEMA = "id long, k string, v array<double>"


def points(rng, n, dims=4):
    return [[rng.gauss(0, 1 + d) for d in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("block_cells", [1 << 21, 50])
@pytest.mark.parametrize("bound", [200_000, 1])
def test_distances_to_all_rows(spark, monkeypatch, block_cells, bound):
    monkeypatch.setattr(joining.attach, "__defaults__", (bound, 64))
    rng = random.Random(block_cells + bound)
    rows = [(i, [None, "a", "b", "c"][i % 4], v) for i, v in enumerate(points(rng, 300))]
    rows += [(1000, "a", rows[1][2]), (1001, "b", rows[2][2]), (5, "a", rows[5][2]), (2000, "lonely", [0.0] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    probes = df.filter("id % 6 < 3 OR id = 5 OR k = 'lonely'").withColumn("_rank", F.col("id"))
    found = {(r["k"], r["_rank"]): r["distance"] for r in nn_distance(probes, df, "id", "k", "v", block_cells).collect()}
    want = {}
    for i, k, v in rows:
        if i % 6 < 3 or i == 5 or k == "lonely":
            near = [math.dist(v, w) for j, own, w in rows if own == k and j != i]
            if near:
                want[k, i] = min(near)
    assert found.keys() == want.keys()
    assert [found[x] for x in want] == pytest.approx(list(want.values()), abs=1e-9)


def test_near_points_far_from_the_origin(spark):
    rng = random.Random(2)
    rows = [(i, "x", [1e6 + rng.random(), 1e6 + rng.random()]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["_rank"]: r["distance"] for r in nn_distance(df.withColumn("_rank", F.col("id")), df, "id", (), "v").collect()}
    for i, _, v in rows:
        assert found[i] == pytest.approx(min(math.dist(v, w) for j, _, w in rows if j != i), rel=1e-9)


def scan(spark, rows, **options):
    return S.geometry_scan(spark.createDataFrame(rows, SCHEMA), "id", "v", "k", **options).first()


def expected(vectors):
    x = np.array(vectors)
    width = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(width > 0, width, 1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = d.min(axis=1)
    outlying = (np.abs((near - near.mean()) / (near.std() + 1e-9)) > 3).mean() * 100
    isolated = (near > np.percentile(near, 95)).mean() * 100
    return min(100, 5 * outlying + 2 * isolated)


def test_missing_vectors_and_dimensions(spark):
    rng = random.Random(7)
    vectors = points(rng, 200)
    vectors[0] = [40.0, 0.0, 0.0, 0.0]
    rows = [(i, "s", v) for i, v in enumerate(vectors)]
    whole = scan(spark, rows)
    assert whole["vulnerability_score"] == pytest.approx(expected(vectors))
    assert (whole["vectors"], whole["missing_vectors"], whole["samples_analyzed"]) == (200, 0, 200)
    gone = scan(spark, [(i, k, None if i == 9 else v) for i, k, v in rows])
    assert (gone["vectors"], gone["missing_vectors"]) == (199, 1)
    assert gone["vulnerability_score"] == pytest.approx(expected(vectors[:9] + vectors[10:]))
    assert gone["vulnerability_level"] == whole["vulnerability_level"]
    for broken in ([1.0, 2.0], [1.0, 2.0, None, float("nan")], [1.0, 2.0, float("inf"), float("-inf")]):
        # The last two dimensions are incomplete and left out for all rows.
        row = scan(spark, [(i, k, broken if i == 9 else v) for i, k, v in rows])
        assert row["vectors"] == 200
        assert row["vulnerability_score"] == pytest.approx(expected([[1.0, 2.0] if i == 9 else v[:2] for i, v in enumerate(vectors)]))
    for broken in ([], [None] * 4):
        row = scan(spark, [(i, k, broken if i == 9 else v) for i, k, v in rows])
        assert (row["vulnerability_score"], row["vulnerability_level"]) == (None, "UNKNOWN")
    nothing = scan(spark, [(i, k, None) for i, k, _ in rows])
    assert (nothing["vectors"], nothing["missing_vectors"], nothing["vulnerability_level"]) == (0, 200, "UNKNOWN")
    assert S.geometry_scan(spark.createDataFrame([], SCHEMA), "id", "v", "k").collect() == []


def test_neighbours_in_the_sample_only(spark):
    rng = random.Random(3)
    vectors = points(rng, 400)
    rows = [(i, "s", v) for i, v in enumerate(vectors)]
    both = [scan(spark, rows, against=a, probes=400) for a in ("all", "sample")]
    assert both[0]["vulnerability_score"] == pytest.approx(both[1]["vulnerability_score"])
    few = scan(spark, rows, against="sample", probes=100, sample_rows=200)
    assert (few["vectors"], few["samples_analyzed"]) == (200, 100)
    with pytest.raises(ValueError, match="neighbours"):
        scan(spark, rows, against="none")


def test_distances_shuffle_only_minima(spark):
    df = spark.range(2000).selectExpr("id", "'s' AS k", "array(CAST(id AS DOUBLE)) AS v")
    probes = df.filter("id < 40").withColumn("_rank", F.col("id"))
    plan = nn_distance(probes, df, "id", "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_equal_distances_are_not_split_by_rounding(spark):
    """Steps of a hundredth differ in their last bits only: no probe lies above the others."""
    rows = [(i, "x", [round(90_000 + i * 0.07, 2)]) for i in range(3000)]
    row = scan(spark, rows)
    assert (row["samples_analyzed"], row["outlier_count"], row["isolated_pct"]) == (500, 0, 0)
