"""Row and line counts, schema catalog, previews."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions.issues import Issue, issues_sql
from slicewise.operators.joining import as_list, cols, match
from slicewise.operators.sampling import ranked_top


def table_summary(
    df: DataFrame, by: str | Sequence[str] = (), slices: DataFrame | None = None
) -> DataFrame:
    """Row and column count per slice. Slices listed in ``slices`` but absent from the data get 0 rows."""
    by = as_list(by)
    out = df.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias("row_count"))
    if slices is not None:
        out = match(slices.select(*cols(by)).distinct(), out, by)
    empty = Issue("row_count = 0", "EMPTY", "warning", "0", "no data rows")
    return out.fillna(0, ["row_count"]).selectExpr(
        *[f"`{k}`" for k in by],
        "row_count",
        f"{len(df.columns)}L AS column_count",
        f"{issues_sql([empty])} AS issues",
    )


def catalog(df: DataFrame, dataset: str) -> DataFrame:
    """Schema as rows ``(dataset, column, position, dtype)``."""
    fields = list(df.schema)
    # An Arrow table becomes a local relation: no tasks, and its size is known to the planner.
    rows = pa.table(
        {
            "dataset": pa.array([dataset] * len(fields), pa.string()),
            "column": pa.array([f.name for f in fields], pa.string()),
            "position": pa.array(range(len(fields)), pa.int32()),
            "dtype": pa.array([f.dataType.simpleString() for f in fields], pa.string()),
        }
    )
    return df.sparkSession.createDataFrame(rows)


def preview(
    df: DataFrame, n: int = 5, order: str | Sequence[str] = (), by: str | Sequence[str] = ()
) -> DataFrame:
    """A few rows as text, nulls as empty strings; the first ones in ``order`` if it is given."""
    order, by = as_list(order), as_list(by)
    if order:
        head = ranked_top(df, n, cols(order), by, "_rank").drop("_rank")
    else:
        head = df.limit(n)
    return head.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def text_summary(lines: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Line count (blank ones included), characters with line breaks, mean length, token estimate."""
    return (
        lines.groupBy(*cols(as_list(by)))
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.coalesce(F.sum("chars"), F.lit(0).cast("bigint")).alias("char_count"),
        )
        .withColumn("avg_raw_length", F.try_divide("char_count", "line_count"))
        .withColumn("estimated_tokens", F.floor(F.col("char_count") / 4))
    )
