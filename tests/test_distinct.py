"""Exact distinct counts per slice and column, by hand."""

from __future__ import annotations

import pytest

import slicewise as S

TYPES = {
    "whole": "id % 7", "big": "id * 1000000007", "part": "IF(id % 5 = 0, NULL, id % 11 * 0.5D)", "nan": "IF(id % 3 = 0, double('nan'), id % 4 / 8)",
    "zero": "IF(id % 2 = 0, -0.0D, 0.0D)", "word": "concat('w', id % 13)", "none": "CAST(NULL AS string)", "day": "date_add(DATE'2024-01-01', CAST(id % 9 AS INT))",
    "flag": "id % 2 = 0", "cash": "CAST(id % 17 AS DECIMAL(30, 2))", "`odd.name`": "id % 3",
}
UNIQUE = {"whole": 7, "big": 300, "part": 11, "nan": 4, "zero": 1, "word": 13, "none": 0, "day": 9, "flag": 2, "cash": 17, "odd.name": 3}


@pytest.mark.parametrize("times", [1, 3])
def test_distinct_counts_of_all_types(spark, times):
    """Also beyond the number of columns that are scanned one by one."""
    columns = [f"{e} AS {n[:-1] + str(t) + '`' if n.endswith('`') else n + str(t)}" for t in range(times) for n, e in TYPES.items()]
    df = spark.range(600).selectExpr("IF(id < 300, 'a', NULL) AS k", *[c.replace("id", "(id % 300)") for c in columns])
    found = {(r["k"], r["column"]): r["unique"] for r in S.null_map(df, None, "k").collect()}
    assert found == {(k, f"{n}{t}"): u for k in ("a", None) for t in range(times) for n, u in UNIQUE.items()}
    assert {r["column"]: r["unique"] for r in S.null_map(df.drop("k")).collect()} == {f"{n}{t}": u for t in range(times) for n, u in UNIQUE.items()}
    assert S.null_map(df.limit(0), None, "k").collect() == []


def test_columns_are_counted_apart(spark):
    """One hash table for all columns made a row of every cell; a column of its own needs no unpivoting."""
    df = spark.range(100).selectExpr("id % 2 AS k", "id", "id % 5 AS few", "CAST(id AS STRING) AS text")
    plan = S.null_map(df, None, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "_fp1" in plan
