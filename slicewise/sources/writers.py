"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_scorecard(
    df: DataFrame,
    path: str,
    partition_by: str | Sequence[str] = (),
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Write a result as Parquet or JSON, one folder per value of the partition columns."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"Unsupported result format: {fmt}")
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    writer = df.write.mode(mode).format(fmt)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(path)
