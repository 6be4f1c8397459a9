"""The training-data pipeline: five stages over ``documents``.

Each stage is written as Parquet to the shared folder and read again by the next one, so a lost
executor costs tasks of one stage only. All stages but the last return the columns of ``documents``; in
``n_chars`` they keep the length of the text as it is after the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.decontaminate import cut_benchmark
from llm.mixing import mix_sources
from llm.near_dedup import drop_near_duplicates
from llm.secrets import mask_secrets
from llm.shared import keep_table, table
from llm.toxicity import drop_toxic


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    length = F.coalesce(F.length("text"), F.col("n_chars"))
    return docs.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 80 % of their five-word shingles in common stays."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of which no word is left go."""
    return _measured(cut_benchmark(docs, table(spark, sf_dir, "benchmark"), size=10))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds; all documents stay."""
    return _measured(mask_secrets(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same expected number of rows, in global random order; copies are numbered."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir))
    return docs
