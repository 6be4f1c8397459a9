"""One query per operator, over whole tables. Each takes a session and the folder of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import slicewise as S
from slicewise.functions import constants as K
from slicewise.functions.exprs import grade, risk_ci, risk_tier
from slicewise.operators.joining import _ensure_checkpoint_dir
from slicewise.operators.quality import noise_by_column
from slicewise.plans.audit import text_cards
from slicewise.sources.readers import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SIZES = [{"model_size": s, "param_count_millions": p} for s, p in (("Small", 10.0), ("Medium", 125.0), ("Large", 7000.0))]
GRID = [
    {"ai_type": a, "model_size": m, "architecture": r, "domain": d, "task_type": t, "param_count_millions": p}
    for a, m, r, t, p in (
        ("NLP", "Small", "Transformer", "Classification", 10.0),
        ("NLP", "Large", "RNN", "Detection", 7000.0),
        ("Recommendation", "Medium", "MoE", "Generation", 20.0),
        ("Computer Vision", "Medium", "CNN", "Detection", 50.0),
    )
    for d in ("General", "Healthcare", "Social Media", "NLP/Text")
]
PHRASES = [*K.BENCHMARK_PHRASES, "is the", "of the"]
SHINGLES = (5, 8, 13)
#: SQL that Spark and DuckDB read alike.
WIDE = [
    *[f"CAST((l_orderkey * {k} + l_partkey) % {m} AS DOUBLE)" for k, m in ((1, 7), (3, 101), (5, 1009), (7, 53))],
    "l_quantity * l_discount",
    "l_extendedprice + 1000000000",
    "l_extendedprice * l_tax",
    "CASE WHEN l_suppkey % 3 = 0 THEN l_quantity - l_linenumber END",
]
LINEITEM_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return S.read_table(spark, f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over all task slots if its file has few row groups."""
    return spread(table(spark, folder, name).select(*columns))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles of a result, as late as possible."""
    return df.select(
        *[
            F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with missing values: the supplied tables have none."""
    return (
        table(spark, folder, "lineitem")
        .withColumn("l_linenumber", F.nullif(F.col("l_linenumber"), F.lit(7)))
        .withColumn("l_quantity", F.when(F.col("l_quantity") != 23, F.col("l_quantity")))
        .withColumn("l_tax", F.when(F.col("l_tax") < 0.08, F.col("l_tax")))
        .withColumn("l_comment", F.lit(None).cast("string"))
    )


def orders_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority"
    )


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn(
        "value", F.when(F.col("value") >= 20, F.col("value"))
    )


def doc_lines(spark: SparkSession, folder: str, keep: str | list[str]) -> DataFrame:
    keep = [keep] if isinstance(keep, str) else keep
    return S.lines_of(texts(spark, folder, "documents", *keep, "text"), "text", keep)


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every text table, with the table and its part as the slice."""
    parts = [
        ("documents", "lang", "text"),
        ("conversations", "role", "text"),
        ("benchmark", None, "text"),
        ("pages", None, "html"),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            S.lines_of(
                texts(spark, folder, name, *([part] if part else []), text).select(
                    F.concat(F.lit(name + "/"), F.col(part) if part else F.lit("all")).alias("corpus"),
                    F.col(text).alias("text"),
                ),
                "text",
                "corpus",
            )
            for name, part, text in parts
        ],
    )


def all_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            S.table_summary(table(spark, folder, name)).select(
                F.lit(name).alias("dataset"), "row_count", "column_count"
            )
            for name in TABLES
        ],
    )


def all_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def full_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [S.catalog(df, name) for name, df in tables.items()])


def catalog_scores(spark: SparkSession, folder: str) -> DataFrame:
    tables = all_tables(spark, folder)
    values = reduce(
        DataFrame.unionByName,
        [
            S.value_evidence(df.withColumn("dataset", F.lit(name)), by="dataset")
            for name, df in tables.items()
        ],
    )
    return S.domain_scores(full_catalog(tables), values)


def wide_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_acctbal") >= 2500, F.col("c_acctbal"))
    )
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def doc_cards(spark: SparkSession, folder: str, by: str) -> DataFrame:
    return text_cards(doc_lines(spark, folder, by), by, PHRASES)


# ---- queries


def table_summary_lineitem(spark, folder):
    return S.table_summary(table(spark, folder, "lineitem"), "l_returnflag").drop("issues")


def preview_customer(spark, folder):
    return S.preview(table(spark, folder, "customer"), 5, "c_custkey")


def missing_lineitem(spark, folder):
    return rounded(S.missing(gappy_lineitem(spark, folder), None, "l_linestatus"))


def complete_columns_lineitem(spark, folder):
    return S.complete_columns(gappy_lineitem(spark, folder), None, "l_linestatus")


def coverage_lineitem(spark, folder):
    return rounded(S.coverage(gappy_lineitem(spark, folder), None, "l_linestatus"))


def null_map_lineitem(spark, folder):
    return rounded(S.null_map(gappy_lineitem(spark, folder), None, "l_linestatus").drop("dtype"))


def duplicates_lineitem(spark, folder):
    columns = ["l_returnflag", "l_linestatus", "l_quantity"]
    return rounded(S.duplicates(table(spark, folder, "lineitem"), columns, "l_returnflag"))


def numeric_stats_lineitem(spark, folder):
    return rounded(
        S.numeric_stats(gappy_lineitem(spark, folder), LINEITEM_NUMBERS, "l_returnflag"), 4
    )


def quantiles_lineitem(spark, folder):
    """Quantiles by narrowing ranks down, as for slices too large for one buffer."""
    return rounded(
        S.quantiles(
            gappy_lineitem(spark, folder),
            LINEITEM_NUMBERS,
            [0.05, 0.5, 0.95],
            "l_returnflag",
            single_pass_rows=0,
            enough=100,
        ),
        4,
    )


def histogram_orders(spark, folder):
    return rounded(S.histogram(table(spark, folder, "orders"), ["o_totalprice"], "o_orderstatus"), 4)


def correlation_lineitem(spark, folder):
    df = gappy_lineitem(spark, folder).withColumn("constant", F.lit(1.0))
    columns = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]
    return rounded(S.correlation(df, columns, "l_returnflag"))


def wide_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with gaps and WIDE more numbers made of its own."""
    return gappy_lineitem(spark, folder).selectExpr("l_returnflag", *LINEITEM_NUMBERS, *[f"{e} AS w{i}" for i, e in enumerate(WIDE)])


def correlation_wide_lineitem(spark, folder):
    """So many pairs of columns that they are counted by Gram matrices."""
    return rounded(S.correlation(wide_lineitem(spark, folder), None, "l_returnflag"))


def class_balance_orders(spark, folder):
    return rounded(S.class_balance(orders_by_year(spark, folder), None, "year"))


def balance_metrics_orders(spark, folder):
    return rounded(
        S.balance_metrics(orders_by_year(spark, folder), None, "year")
    )


def balance_metrics_parts(spark, folder):
    """Columns of up to as many labels as rows: all of them count."""
    return rounded(S.balance_metrics(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"]))


def class_balance_part_names(spark, folder):
    """More than twenty labels, with ties: the report keeps the first twenty."""
    return rounded(S.class_balance(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"]))


def class_balance_labels(spark, folder):
    labels = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string")
    )
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return rounded(S.class_balance(docs.join(labels, "doc_id"), ["quality", "toxic"], "lang"))


def describe_part(spark, folder):
    return rounded(S.describe_all(table(spark, folder, "part")), 4)


def custom_stats_events(spark, folder):
    return rounded(
        S.custom_stats(
            table(spark, folder, "events"),
            F.countDistinct("user_id").alias("users"),
            F.avg("value").alias("mean_value"),
            F.max_by("event_id", F.struct("value", "event_id")).alias("top_event"),
            by="event_type",
        )
    )


def light_profile_events(spark, folder):
    """Row count, missing values and duplicates: the profile of tables too large for more."""
    events = table(spark, folder, "events").select("user_id", "event_type", "value", "props")
    gaps = S.missing(events).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.avg("missing_pct").alias("avg_missing_pct"),
    )
    repeats = S.duplicates(events).select("row_count", "duplicate_count", "duplicate_pct")
    return rounded(gaps.join(repeats, "row_count"))


def light_states_events(spark, folder):
    """States of every day and type, merged to types. Estimated columns are left out: SQL counts exactly."""
    events = gappy_events(spark, folder).withColumn("day", F.to_date("ts"))
    states = S.merge_states(S.light_state(events, ["user_id", "value", "props"], ["day", "event_type"]), "event_type")
    return rounded(S.light_profile(states, "event_type").drop("distinct", "duplicate_pct"))


def hash_sample_events(spark, folder):
    return S.hash_sample(table(spark, folder, "events"), "event_id", 0.1).select(
        "event_id", "event_type"
    )


def top_hash_events(spark, folder):
    top = S.top_hash(table(spark, folder, "events"), "event_id", 100, "event_type", rank="rank")
    return top.select("event_type", "event_id", "rank")


def auto_sample_sizes(spark, folder):
    return all_counts(spark, folder).select(
        "dataset",
        "row_count",
        S.auto_sample_size("row_count").alias("sample_size"),
        S.auto_sample_size("row_count", 5000).alias("requested_size"),
    )


def text_summary_docs(spark, folder):
    return rounded(S.text_summary(doc_lines(spark, folder, "lang"), "lang"))


def head_lines_docs(spark, folder):
    lines = doc_lines(spark, folder, ["lang", "doc_id"])
    return S.head_lines(lines, 5, ["doc_id", "line_no"], "lang").select(
        "lang", "doc_id", "line_no", "line"
    )


def line_profile_docs(spark, folder):
    return rounded(S.profile_text(doc_lines(spark, folder, "lang"), "lang", PHRASES))


def line_stats_conversations(spark, folder):
    return rounded(
        S.line_stats(S.lines_of(table(spark, folder, "conversations"), "text", "role"), "role")
    )


def duplicate_lines_corpora(spark, folder):
    return rounded(S.duplicate_lines(corpus_lines(spark, folder), "corpus"))


def vocab_conversations(spark, folder):
    return rounded(
        S.vocab(S.lines_of(table(spark, folder, "conversations"), "text", "role"), "role")
    )


def length_histogram_docs(spark, folder):
    return rounded(S.length_histogram(doc_lines(spark, folder, "lang"), "lang"))


def length_outliers_docs(spark, folder):
    return rounded(S.length_outliers(doc_lines(spark, folder, "source"), "source"))


def low_entropy_corpora(spark, folder):
    return rounded(S.low_entropy(corpus_lines(spark, folder), "corpus"))


def text_vulnerability_docs(spark, folder):
    return rounded(
        S.text_vulnerability(doc_lines(spark, folder, "lang"), "lang").drop(
            "vulnerability_issues", "vulnerability_advice"
        )
    )


def quality_events(spark, folder):
    return rounded(
        S.quality_of_table(gappy_events(spark, folder), "event_type").drop(
            "quality_issues", "quality_advice"
        )
    )


def noise_events(spark, folder):
    profile = S.profile_table(gappy_events(spark, folder), "event_type")
    return rounded(noise_by_column(profile.columns, profile.histogram, "event_type"))


def quality_docs(spark, folder):
    scored = S.quality_of_text(doc_lines(spark, folder, "lang"), "lang")
    return rounded(
        scored.select(
            "lang",
            "completeness",
            "duplication",
            "vocabulary_diversity",
            "noise",
            "structural_integrity",
            "total_score",
            "grade",
        )
    )


def geometry_embeddings(spark, folder):
    scan = S.geometry_scan(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(scan.drop("vulnerability_issues", "vulnerability_advice"))


def geometry_lineitem(spark, folder):
    """l_tax and l_linenumber have missing values and drop out of the geometry."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
    scan = S.geometry_scan(gappy_lineitem(spark, folder), key, LINEITEM_NUMBERS, "l_returnflag")
    return rounded(scan.drop("vulnerability_issues", "vulnerability_advice"))


def fingerprint_corpora(spark, folder):
    summary = S.text_summary(corpus_lines(spark, folder), "corpus")
    return rounded(
        S.fingerprint_match(summary).select(
            "corpus",
            "line_count",
            "avg_raw_length",
            F.array_join("suspicious_benchmarks", ",").alias("suspicious"),
            F.col("fingerprint_matches").cast("bigint").alias("fingerprint_matches"),
        )
    )


def phrase_hits_docs(spark, folder):
    return S.phrase_hits(doc_lines(spark, folder, "source"), PHRASES, "source")


def text_contamination_corpora(spark, folder):
    scored = S.text_contamination(corpus_lines(spark, folder), "corpus", PHRASES)
    return rounded(
        scored.select("corpus", "phrase_hits", "contamination_score", "contamination_level")
    )


def table_fingerprint(spark, folder):
    return S.table_contamination(all_counts(spark, folder)).select(
        "dataset", "row_count", "column_count", "contamination_score", "contamination_level"
    )


def ngram_overlap_docs(spark, folder):
    """Documents and benchmark items that share runs of 5, 8 and 13 words."""
    docs, bench = texts(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark")
    return rounded(S.ngram_overlap(docs, bench, SHINGLES))


def ngram_contamination_docs(spark, folder):
    """The same per source, without pairs."""
    docs, bench = texts(spark, folder, "documents", "source", "text"), table(spark, folder, "benchmark")
    return rounded(S.ngram_contamination(docs, bench, SHINGLES, "source").drop("contamination_issues", "contamination_advice"))


def memorization_docs(spark, folder):
    lines = doc_lines(spark, folder, "source")
    repeats = S.duplicate_lines(lines, "source").select("source", "duplicate_pct")
    tokens = S.token_counts(S.text_summary(lines, "source"), "text").join(repeats, "source")
    scored = S.memorization(S.with_scenarios(tokens, SIZES))
    return rounded(
        scored.select(
            "source",
            "model_size",
            "token_count",
            "token_to_param_ratio",
            "effective_ratio",
            "memorization_level",
            "memorization_probability",
            "leakage_score",
            "privacy_flag",
        )
    )


def training_cost_docs(spark, folder):
    lines = doc_lines(spark, folder, "lang")
    tokens = S.token_counts(S.text_summary(lines, "lang"), "text")
    costs = S.gpu_costs(S.training_cost(S.with_scenarios(tokens, SIZES)))
    return rounded(
        costs.select(
            "lang",
            "model_size",
            "gpu",
            "token_count",
            "model_params_millions",
            "chinchilla_ratio",
            "total_pflops",
            "data_sufficiency",
            "hours",
            "cost_usd",
        )
    )


def fairness_orders(spark, folder):
    drift = S.fairness_table(S.balance_metrics(skewed_orders(spark, folder), None, "year"), "year")
    return rounded(drift.drop("drift_issues", "drift_advice"))


def skewed_orders(spark, folder) -> DataFrame:
    """Order status and priority by year, and three dominated columns made of them."""
    return orders_by_year(spark, folder).select(
        "*",
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("normal").alias("urgency"),
        F.when(
            (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "late"
        )
        .otherwise("fine")
        .alias("delay"),
    )


def fairness_docs(spark, folder):
    scored = S.fairness_text(S.profile_text(doc_lines(spark, folder, "source"), "source"))
    return rounded(scored.select("source", "type_token_ratio", "drift_score", "drift_level"))


def domain_scores_catalog(spark, folder):
    return rounded(
        catalog_scores(spark, folder).select(
            "dataset", "domain", "score", "confidence", "rank", F.array_join("hits", ",").alias("hits")
        )
    )


def detect_domain_catalog(spark, folder):
    found = S.detect_domain(catalog_scores(spark, folder))
    return rounded(
        found.select("dataset", "detected_domain", "confidence", "runner_up", "low_confidence")
    )


def domain_mismatch_catalog(spark, folder):
    return rounded(S.domain_mismatch(catalog_scores(spark, folder)))


def assign_columns_catalog(spark, folder):
    return rounded(S.assign_columns(full_catalog(all_tables(spark, folder))))


def column_groups_customer(spark, folder):
    groups = S.multi_domain(wide_customer(spark, folder)).groups
    return rounded(
        groups.select(
            "domain",
            "row_count",
            "column_count",
            "column_share",
            "avg_missing_pct",
            "data_coverage",
            "duplicate_count",
            "duplicate_pct",
            "completeness",
            "duplication",
            "noise",
            "balance",
            "structural_integrity",
            "total_score",
            "grade",
            "recommended_rows",
            "sufficiency_ratio",
            "sufficiency",
            "rank_score",
            "rank",
            F.array_join("high_null_columns", ",").alias("high_null_columns"),
            F.size("group_advice").cast("bigint").alias("n_advice"),
        )
    )


def multi_domain_customer(spark, folder):
    overall = S.multi_domain(wide_customer(spark, folder)).overall
    return rounded(
        overall.select(
            "row_count", "n_groups", "weighted_quality", "dominant_domain",
            "dominant_column_share", "global_null_pct",
        )
    )


def compatibility_docs(spark, folder):
    cards = doc_cards(spark, folder, "lang")
    fits = S.compatibility(S.with_scenarios(cards, GRID))
    return rounded(
        fits.select(
            "lang",
            "ai_type",
            "model_size",
            "architecture",
            "domain",
            "task_type",
            "type_fit",
            "architecture_fit",
            "data_size",
            "required_size",
            "size_fit",
            "quality_fit",
            "compatibility_score",
            "suitability",
            "size_verdict",
            "best_ai_type",
            "best_model_size",
        )
    )


def simulate_grid(spark, folder):
    """The whole what-if grid over the languages, including cost and memorization."""
    result = S.simulate(doc_cards(spark, folder, "lang"), GRID)
    return rounded(
        result.select(
            "lang",
            "ai_type",
            "model_size",
            "domain",
            "compatibility_score",
            "model_params_millions",
            "chinchilla_ratio",
            "total_pflops",
            "data_sufficiency",
            "effective_ratio",
            "memorization_level",
            "leakage_score",
        )
    )


def bootstrap_events(spark, folder):
    return rounded(
        S.bootstrap_ci(table(spark, folder, "events"), "value", "event_id", 100, "event_type").drop(
            "confidence_level"
        )
    )


RISK_COLUMNS = {
    "adversarial": "vulnerability_score",
    "fairness": "drift_score",
    "contamination": "contamination_score",
    "quality": "total_score",
}


def risk_ci_docs(spark, folder):
    cards = doc_cards(spark, folder, "source")
    return rounded(S.risk_intervals(cards, RISK_COLUMNS, "source", "sampled_lines"))


def issues_docs(spark, folder):
    cards = S.audit(doc_lines(spark, folder, "source"), "text", "source", SIZES, phrases=PHRASES)
    return rounded(
        S.issues(cards, ["source", "model_size"]).select(
            "source", "model_size", "code", "severity", "value"
        )
    )


def recommendations_docs(spark, folder):
    cards = S.audit(doc_lines(spark, folder, "source"), "text", "source", SIZES, phrases=PHRASES)
    return S.recommendations(cards, "source").select("source", "recommendation")


AUDIT_COLUMNS = [
    "domain",
    "model_size",
    "total_score",
    "grade",
    "vulnerability_score",
    "vulnerability_level",
    "leakage_score",
    "memorization_level",
    "drift_score",
    "drift_level",
    "contamination_score",
    "contamination_level",
    "average_risk",
    "overall_risk_level",
    "compatibility_score",
    "suitability",
    "size_verdict",
    "data_sufficiency",
    "critical_issues",
    "warnings",
    "verdict",
]


def _card(df: DataFrame, *keys: str) -> DataFrame:
    df = df.withColumn("critical_issues", F.col("critical_issues").cast("bigint")).withColumn(
        "warnings", F.col("warnings").cast("bigint")
    )
    interval = [
        F.col("adversarial_ci.lower_bound").alias("adversarial_low"),
        F.col("adversarial_ci.upper_bound").alias("adversarial_high"),
    ]
    return rounded(df.select(*keys, *AUDIT_COLUMNS, *interval))


def audit_docs_by_source(spark, folder):
    cards = S.audit(doc_lines(spark, folder, "source"), "text", "source", SIZES, phrases=PHRASES)
    return _card(cards, "source")


def audit_events_by_type(spark, folder):
    scenarios = [
        {"ai_type": "Recommendation", "model_size": "Small", "domain": "Social Media", "param_count_millions": 2.0},
        {"ai_type": "NLP", "model_size": "Medium", "domain": "Healthcare", "param_count_millions": 125.0},
    ]
    cards = S.audit(
        gappy_events(spark, folder),
        "tabular",
        "event_type",
        scenarios,
        key="event_id",
        features=["event_id", "user_id", "value"],
    )
    return _card(cards, "event_type", "detected_domain", "domain_confidence", "mismatch_severity")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}/{name}"


def csv_roundtrip(spark, folder):
    """orders written as CSV and read back with inferred types; an empty table keeps its zero rows."""
    path = _scratch(spark, "orders.csv")
    table(spark, folder, "orders").write.option("header", True).csv(path)
    back = S.read_any(spark, path)
    return rounded(
        S.custom_stats(
            back,
            F.sum("o_totalprice").alias("total_price"),
            F.countDistinct("o_custkey").alias("customers"),
            by=["o_orderstatus", "o_orderpriority"],
        ),
        2,
    )


def csv_strings_roundtrip(spark, folder):
    """customer written as CSV and read back as strings only: every column is a label."""
    path = _scratch(spark, "customer.csv")
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return rounded(S.balance_metrics(S.read_table(spark, path, "csv", infer=False)))


def empty_slices_events(spark, folder):
    """Large events per day and type; a day without any is a slice of no rows, with a finding."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    found = S.table_summary(events.filter("value > 200"), ["day", "event_type"], events)
    return found.select("day", "event_type", "row_count", F.size("issues").cast("long").alias("findings"))


def lines_roundtrip(spark, folder):
    """Texts written as text files and read back as lines."""
    path = _scratch(spark, "documents.txt")
    table(spark, folder, "documents").select("text").write.text(path)
    lines = S.read_any(spark, path)
    return rounded(S.line_stats(lines))


def scorecard_roundtrip(spark, folder):
    """A result written to partitioned Parquet and read back."""
    path = _scratch(spark, "scores.parquet")
    scores = text_cards(doc_lines(spark, folder, "lang"), "lang").select(
        "lang", "grade", "total_score", "contamination_level"
    )
    S.write_scorecard(scores, path, "contamination_level")
    return rounded(S.read_any(spark, path))


def grades_docs(spark, folder):
    """Grade, tier and interval expressions applied to raw numbers of every document."""
    docs = table(spark, folder, "documents")
    score = (F.col("n_chars") % 1009) / 10.0
    ci: Column = risk_ci("score", "n_chars")
    return rounded(
        docs.select("doc_id", "n_chars", score.alias("score")).select(
            "doc_id",
            "score",
            grade("score").alias("grade"),
            risk_tier("score", K.VULNERABILITY_TIERS).alias("tier"),
            ci["lower_bound"].alias("lower_bound"),
            ci["upper_bound"].alias("upper_bound"),
        )
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        table_summary_lineitem,
        preview_customer,
        missing_lineitem,
        complete_columns_lineitem,
        coverage_lineitem,
        null_map_lineitem,
        duplicates_lineitem,
        numeric_stats_lineitem,
        quantiles_lineitem,
        histogram_orders,
        correlation_lineitem,
        correlation_wide_lineitem,
        class_balance_orders,
        balance_metrics_orders,
        balance_metrics_parts,
        class_balance_part_names,
        class_balance_labels,
        describe_part,
        custom_stats_events,
        light_profile_events,
        light_states_events,
        hash_sample_events,
        top_hash_events,
        auto_sample_sizes,
        text_summary_docs,
        head_lines_docs,
        line_profile_docs,
        line_stats_conversations,
        duplicate_lines_corpora,
        vocab_conversations,
        length_histogram_docs,
        length_outliers_docs,
        low_entropy_corpora,
        text_vulnerability_docs,
        quality_events,
        noise_events,
        quality_docs,
        geometry_embeddings,
        geometry_lineitem,
        fingerprint_corpora,
        phrase_hits_docs,
        text_contamination_corpora,
        table_fingerprint,
        ngram_overlap_docs,
        ngram_contamination_docs,
        memorization_docs,
        training_cost_docs,
        fairness_orders,
        fairness_docs,
        domain_scores_catalog,
        detect_domain_catalog,
        domain_mismatch_catalog,
        assign_columns_catalog,
        column_groups_customer,
        multi_domain_customer,
        compatibility_docs,
        simulate_grid,
        bootstrap_events,
        risk_ci_docs,
        issues_docs,
        recommendations_docs,
        audit_docs_by_source,
        audit_events_by_type,
        csv_roundtrip,
        csv_strings_roundtrip,
        empty_slices_events,
        lines_roundtrip,
        scorecard_roundtrip,
        grades_docs,
    )
}
