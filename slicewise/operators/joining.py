"""Joining per-slice results back onto data, and materialising small ones.

Rules followed here:

* A per-slice result grows with the number of slices, so it is broadcast only after its rows and bytes
  have been counted; above the bounds the join is shuffled on the slice key *and* a salt, so that a slice
  holding a third of all rows is spread over many tasks.
* Slice keys may be null; they match each other (``<=>``).
* A small result that is used more than once is written with ``checkpoint()`` to the shared folder of
  the cluster, which survives the loss of executors.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 64


def as_list(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="slicewise-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def materialize(df: DataFrame) -> DataFrame:
    """Write a small result to the checkpoint folder and read it from there afterwards."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """About the size of a row in a broadcast: a word per value and what strings and arrays hold besides."""
    size = F.lit(16 + 8 * len(df.columns))
    for f in df.schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            # Numbers and short structs, as slice results have them.
            size = size + F.coalesce(F.size(value), F.lit(0)) * 40
    return size


def is_small(df: DataFrame, bound: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a (materialised) result has at most ``bound`` rows and ``most_bytes``; counts no further."""
    counted = df.select(_row_bytes(df).alias("_size")).limit(bound + 1)
    rows, size = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return rows <= bound and size <= most_bytes


def match(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast: bool = False,
) -> DataFrame:
    """Null-safe equi-join. Without keys both sides are one-row totals, put side by side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys}) if keys else right
    if broadcast:
        renamed = F.broadcast(renamed)
    condition = F.expr(" AND ".join(f"`{k}` <=> `_r_{k}`" for k in keys) or "true")
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys]) if keys else joined


def attach(
    rows: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    bound: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner-join a materialised per-slice result onto row-level data without shuffling the rows.

    ``small`` is broadcast if it has at most ``bound`` rows and ``BROADCAST_BYTES``. Beyond that both sides are shuffled on
    (keys, salt): each small row is repeated once per salt, each data row gets one salt.
    """
    if is_small(small, bound):
        return match(rows, small, keys, "inner", broadcast=True)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The salt is the number of the input partition: a re-run task gives its rows the same salt again,
    # and identical rows of many partitions are spread (a hash of the row would keep copies together).
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return match(salted, spread, [*keys, "_salt"], "inner").drop("_salt")
