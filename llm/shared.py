"""Files and small results shared between jobs of the operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcasts of data-dependent size happen below this many rows only; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a partition in ``packed``.
PACK_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{_checkpoints(spark)}/{uuid.uuid4().hex}"


def _checkpoints(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder once, read from there afterwards."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """As ``keep``, as compressed Parquet with column pruning; for results with wide or many rows."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int = PACK_ROWS) -> DataFrame:
    """As ``keep``, in partitions of about ``rows`` rows; for narrow rows. What fits in one partition is then
    grouped, and joined with others like it, without a shuffle."""
    kept = keep(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a kept result has at most ``bound`` rows; counts no further than that."""
    return df.limit(bound + 1).count() <= bound


def maybe_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a kept result of narrow rows if it is small; else leave the join to the shuffle."""
    return F.broadcast(df) if small(df, bound) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called so."""
    while any(c.lower() == name.lower() for c in df.columns):
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, run: Callable) -> DataFrame:
    """``mapInArrow`` to rows of the same columns, whatever their names; ``run`` finds them by position."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema)])
    return df.toDF(*plain.names).mapInArrow(run, plain).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def send(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of this package; tasks call the result to get it, once each.

    A plain broadcast would name its class, which an executor without a copy of this package cannot import;
    this one holds the class as well."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
