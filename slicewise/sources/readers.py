"""Tabular and text scans."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLE_SUFFIXES = {".csv": "csv", ".parquet": "parquet"}
LINE_SUFFIXES = (".txt", ".jsonl", ".json")


FEW_PARTITIONS = 32


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a plain scan that has fewer partitions than the cluster has task slots.

    Small files, or files with few row groups, would leave work as heavy as text scanning to one or two
    tasks. Above that the scan is returned as it is, so large data are never shuffled for this. Only
    for scans: counting the partitions of a plan with a shuffle would run it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < max(slots, FEW_PARTITIONS):
        return df.repartition(slots)
    return df


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    infer: bool = True,
) -> DataFrame:
    """Scan a CSV or Parquet table.

    CSV files have a header; malformed rows are skipped. Types come from ``schema`` or are inferred
    (one extra pass over the file); ``infer=False`` reads strings only, which suits previews.
    """
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if fmt != "csv":
        raise ValueError(f"Unsupported table format: {fmt}")
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    df = reader.csv(path)
    # The parser only notices what is wrong with the columns it converts. A condition on all of them,
    # always true, makes a row malformed or not whatever columns a query reads (even for a count).
    return df.filter(F.xxhash64(*[f"`{c}`" for c in df.columns]).bitwiseOR(F.lit(1)) != 0)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan text files as lines ``(file, line_no, line, chars)``; JSON files are lines, too.

    ``line_no`` grows within a file but has gaps. Bytes that are not UTF-8 are dropped. ``chars``
    counts the line break.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("line_no"),
            F.when(F.is_valid_utf8("value"), F.col("value"))
            .otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
            .alias("line"),
        )
        .withColumn("chars", F.length("line").cast("bigint") + 1)
    )


def lines_of(df: DataFrame, text: str, keep: str | Sequence[str] = ()) -> DataFrame:
    """Lines of a text column: the kept columns plus ``(line_no, line, chars)``.

    Lines end with CRLF, CR or LF. An empty text has no lines and a final line break opens no further
    line. ``chars`` counts the line break as one character, if there is one. No shuffle.
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    # Plain replaces leave LF as the only break, and splitting on one character needs no regex engine.
    # The number of parts is computed below the explode, once per text, and not once per line. The outer
    # explode keeps the optimizer from adding a filter that would split every text a second time; the
    # row it makes of a null text is dropped by the filter that follows.
    unified = F.replace(
        F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")
    )
    return (
        df.select(*keep, F.split(unified, "\n").alias("_texts"))
        .select(*keep, "_texts", F.size("_texts").alias("_parts"))
        .select(*keep, "_parts", F.posexplode_outer("_texts").alias("line_no", "line"))
        .filter((F.col("line_no") < F.col("_parts") - 1) | (F.col("line") != ""))
        .select(
            *keep,
            "line_no",
            "line",
            (
                F.length("line").cast("bigint")
                + (F.col("line_no") < F.col("_parts") - 1).cast("bigint")
            ).alias("chars"),
        )
    )


def read_any(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Choose the reader by the file suffix: tables for CSV and Parquet, lines for text and JSON."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in TABLE_SUFFIXES:
        return read_table(spark, path, TABLE_SUFFIXES[suffix], schema)
    if suffix in LINE_SUFFIXES:
        return read_lines(spark, path)
    known = sorted([*TABLE_SUFFIXES, *LINE_SUFFIXES])
    raise ValueError(f"Unsupported file type: {suffix or path}. Supported: {known}")
