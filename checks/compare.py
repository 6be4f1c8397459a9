"""Run the registered queries on Spark and DuckDB and compare the results.

``python -m checks.compare [folder] [query …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES, TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "as_integer_ratio") or hasattr(value, "is_signed"):
        return round(float(value), 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple(str(c) for c in r))


def difference(spark, con, name: str, folder: str) -> str | None:
    """A description of the first difference, or None."""
    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows vs {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(ours[0], a, b, strict=True) if x != y]
            return f"{bad} in {a}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(str(Path(folder)))
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            found = f"error {str(error)[:1500]}"
        bad += found is not None
        print(f"\nCHECK {name} {time.time() - start:.2f}s {'ok' if found is None else found}", flush=True)
    print(f"\nCHECK {len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
