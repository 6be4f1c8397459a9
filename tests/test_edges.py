"""Edge cases, invariants and brute-force comparisons."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import slicewise as S
from slicewise.functions.constants import WHITESPACE
from slicewise.functions.exprs import char_entropy, key_md5, low_entropy, strip, words
from slicewise.operators import confidence
from slicewise.operators import table as table_module
from slicewise.operators.joining import attach, is_small, match
from slicewise.operators.quantiles import quantiles
from slicewise.operators.sampling import ranked_top
from slicewise.operators.table import column_stats, profile_table
from slicewise.operators.text import duplicate_lines, line_facts
from slicewise.sources.readers import spread


def python_lines(text: str) -> list[str]:
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


TEXTS = [
    "",
    "\n",
    "one",
    "one\n",
    "a\r\nb\rc\n\n  \n　d　\n",
    "x y\x0bz",
    "\U0001f600\U0001f600 café\n  \n",
    "  lead and trail \t\n" * 3,
]


def test_lines_split_like_universal_newlines(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    found: dict[int, list] = {}
    for r in S.lines_of(df, "text", "k").orderBy("k", "line_no").collect():
        found.setdefault(r["k"], []).append((r["line"], r["chars"]))
    for k, text in enumerate(TEXTS):
        assert [line for line, _ in found.get(k, [])] == python_lines(text)
        normal = text.replace("\r\n", "\n").replace("\r", "\n")
        assert sum(chars for _, chars in found.get(k, [])) == len(normal)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\U0001f600'\\") + list(WHITESPACE)), max_size=30), min_size=1, max_size=20))
def test_string_expressions(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    rows = df.select("k", strip("s").alias("t"), words("s").alias("w"), char_entropy("s").alias("h"), low_entropy("s").alias("low")).collect()
    for r in rows:
        text = texts[r["k"]]
        assert r["t"] == text.strip()
        assert r["w"] == text.lower().split()
        h = entropy(text) if text else 0.0
        assert r["h"] == pytest.approx(h, abs=1e-9)
        if abs(h - 2.0) > 1e-9:
            assert r["low"] == (h < 2.0)


def test_low_entropy_shortcut_is_exact(spark):
    rng = random.Random(3)
    alphabets = ["ab", "abcd", "abcdefgh", " eaint", " eaintxyz", "一丁丂七丄"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 3, 8, 40, 200)]
    texts += ["abcd", "aabbccdd", "abc" * 4 + "ddd"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", low_entropy("s").alias("low")).collect():
        assert r["low"] == (entropy(r["s"]) < 2.0), r["s"]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id long, name string, value double")
    row = S.table_summary(empty).first()
    assert (row["row_count"], row["issues"][0]["code"]) == (0, "EMPTY")
    assert S.duplicates(empty).first()["duplicate_count"] == 0
    assert S.quality_of_table(empty).first()["total_score"] == 20.0
    slices = spark.createDataFrame([("a",), ("b",)], "name string")
    data = spark.createDataFrame([(1, "a", 1.0)], "id long, name string, value double")
    counts = {r["name"]: r["row_count"] for r in S.table_summary(data, "name", slices).collect()}
    assert counts == {"a": 1, "b": 0}
    blank = S.lines_of(spark.createDataFrame([("k", "\n \n\t\n")], "k string, text string"), "text", "k")
    row = S.quality_of_text(blank, "k").first()
    assert (row["line_count"], row["sampled_lines"], row["type_token_ratio"]) == (3, 0, 0.0)
    assert row["total_score"] == 20.0


def test_single_row_and_constant_columns(spark):
    one = spark.sql("SELECT 1L AS id, 2.5D AS x, 'a' AS label")
    assert S.numeric_stats(one).count() == 0
    assert S.quality_of_table(one).first()["grade"] == "F"
    flat = spark.range(60).select("id", F.lit(7.0).alias("x"), F.lit(None).cast("double").alias("gone"))
    rows = {r["column"]: r for r in S.numeric_stats(flat).collect()}
    assert set(rows) == {"id", "x"}
    assert (rows["x"]["std"], rows["x"]["skewness"]) == (0, 0)
    hist = [r for r in S.histogram(flat, ["x", "gone"]).collect() if r["n"]]
    assert [(r["column"], r["bin"], r["bin_lo"], r["bin_hi"]) for r in hist] == [("x", 16, 7.0, pytest.approx(7 + 1 / 30))]
    pairs = {(r["col_a"], r["col_b"]) for r in S.correlation(flat).collect()}
    assert pairs == {("id", "id")}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    row = column_stats(df).first()
    assert (row["n"], row["nulls"], row["mean"]) == (2, 2, 2.0)
    assert S.duplicates(df).first()["duplicate_count"] == 1


def test_histogram_matches_numpy(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=500), np.arange(31) / 10, np.round(rng.uniform(size=400), 1), np.array([0.1, 0.2, 0.3, 0.7])):
        counts, edges = np.histogram(values, bins=30)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        rows = S.histogram(df, ["x"]).orderBy("bin").collect()
        assert [r["n"] for r in rows] == counts.tolist()
        assert [r["bin_lo"] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_many_labels_with_ties(spark):
    rows = [(f"l{i:02d}",) for i in range(30) for _ in range(3 if i < 5 else 2)] + [(None,)]
    out = S.class_balance(spark.createDataFrame(rows, "label string")).orderBy("rank").collect()
    assert [r["label"] for r in out] == [f"l{i:02d}" for i in range(20)]
    assert out[0]["proportion"] == pytest.approx(3 / 65)


@pytest.mark.parametrize("shape", ["normal", "heavy", "points", "few"])
def test_narrowed_quantiles_are_exact(spark, shape):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=3000),
        "heavy": np.exp(rng.normal(scale=12, size=3000)),
        "points": rng.choice([1.0, 2.0, 2.5, 1e9], size=3000),
        "few": np.array([3.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(values)], "k string, x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    for enough in (0, 10, 100_000):
        rows = quantiles(df, ["x"], probs, "k", single_pass_rows=0, enough=enough).collect()
        out = {(r["k"], r["prob"]): r["value"] for r in rows}
        for k in ("a", None):
            group = [v for i, v in enumerate(values) if (i % 3 > 0) == (k == "a")]
            for p in probs:
                assert out[(k, p)] == pytest.approx(np.quantile(group, p), rel=1e-12)


def test_salted_join_equals_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(1).alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    small = rows.select("k").distinct().withColumn("w", F.coalesce("k", F.lit(0)) * 10)
    assert is_small(small, 7) and not is_small(small, 6)
    one = attach(rows, small, ["k"]).groupBy("k", "w").count()
    two = attach(rows, small, ["k"], bound=0, salts=8).groupBy("k", "w").count()
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert two.count() == 7


def test_top_rows_with_a_hot_slice(spark):
    df = spark.range(0, 2000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    out = ranked_top(df, 5, [F.col("id").desc()], "k").collect()
    for k in {r["k"] for r in out}:
        ids = sorted((i for i in range(2000) if ("hot" if i % 3 == 0 else str(i % 50)) == k), reverse=True)[:5]
        assert [r["id"] for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["rank"])] == ids
    assert [r["id"] for r in ranked_top(df, 3, [F.col("id")]).orderBy("rank").collect()] == [0, 1, 2]


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") % 5).cast("string").alias("k"), F.sin("id").alias("x"))
    for n in (1, 7):
        part = df.repartition(n, "x")
        assert sorted(r["id"] for r in S.hash_sample(part, "id", 0.1).collect()) == sorted(r["id"] for r in S.hash_sample(df, "id", 0.1).collect())
        assert sorted(r["id"] for r in S.top_hash(part, "id", 9, "k").collect()) == sorted(r["id"] for r in S.top_hash(df, "id", 9, "k").collect())
        a = S.bootstrap_ci(part, "x", "id", 20).first()
        b = S.bootstrap_ci(df, "x", "id", 20).first()
        assert a["lower_bound"] == pytest.approx(b["lower_bound"])
        g, h = (S.geometry_scan(d, "id", ["x"], "k").orderBy("k").collect() for d in (part, df))
        assert [r["outlier_pct"] for r in g] == [r["outlier_pct"] for r in h]


def test_slices_add_up(spark):
    folder = "/root/testdata/sf0.001"
    docs = S.read_table(spark, f"{folder}/documents.parquet")
    lines = S.lines_of(docs, "text", "lang")
    per = S.profile_text(lines, "lang").agg(F.sum("line_count"), F.sum("char_count"), F.sum("word_count")).first()
    whole = S.profile_text(lines).first()
    assert tuple(per) == (whole["line_count"], whole["char_count"], whole["word_count"])
    assert whole["char_count"] == docs.agg(F.sum(F.length("text"))).first()[0]
    rows = S.audit(lines, "text", "lang").collect()
    for r in rows:
        for score in ("total_score", "vulnerability_score", "leakage_score", "drift_score", "contamination_score", "compatibility_score", "average_risk"):
            assert 0 <= r[score] <= 100


def test_bootstrap_sizes(spark):
    none = spark.createDataFrame([], "id long, x double")
    row = S.bootstrap_ci(none, "x", "id").first()
    assert (row["n"], row["point_estimate"], row["lower_bound"], row["standard_error"]) == (0, 0, 0, 0)
    row = S.bootstrap_ci(spark.sql("SELECT 1L AS id, 4D AS x"), "x", "id").first()
    assert (row["lower_bound"], row["upper_bound"], row["standard_error"]) == (4, 4, 0)
    row = S.bootstrap_ci(spark.range(400).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x"), "x", "id").first()
    assert row["lower_bound"] < 4.5 < row["upper_bound"]
    assert row["standard_error"] == pytest.approx(2.8723 / 20, rel=0.35)


def test_geometry_bounds(spark):
    few = spark.range(49).select("id", F.col("id").cast("double").alias("x"))
    row = S.geometry_scan(few, "id", ["x"]).first()
    assert (row["vulnerability_score"], row["vulnerability_level"]) == (None, "UNKNOWN")
    gaps = spark.range(60).select("id", F.when(F.col("id") > 3, F.col("id")).cast("double").alias("x"))
    assert S.geometry_scan(gaps, "id", ["x"]).first()["vulnerability_level"] == "UNKNOWN"
    same = spark.range(100).select("id", F.lit(1.0).alias("x"))
    row = S.geometry_scan(same, "id", ["x"]).first()
    assert (row["outlier_count"], row["vulnerability_score"]) == (0, 0.0)
    with pytest.raises(ValueError, match="probes"):
        S.geometry_scan(same, "id", ["x"], probes=1)
    row = S.geometry_scan(same, "id", ["x"], probes=100_000).first()
    assert (row["samples_analyzed"], row["outlier_count"]) == (100, 0)


def test_column_groups(spark):
    df = spark.range(30).select(
        F.col("id").alias("patient_id"), F.lit("x").alias("diagnosis"), F.col("id").alias("price"), F.lit(1).alias("zzz")
    )
    result = S.multi_domain(df)
    groups = {r["domain"]: r for r in result.groups.collect()}
    assert groups["Healthcare"]["columns"] == ["patient_id", "diagnosis"]
    assert groups["Finance"]["columns"] == ["price"]
    assert groups["General"]["columns"] == ["zzz"]
    assert groups["General"]["duplicate_count"] == 29
    assert groups["Finance"]["sufficiency"] == "CRITICALLY_INSUFFICIENT"
    overall = result.overall.first()
    assert overall["n_groups"] == 3
    assert overall["weighted_quality"] == pytest.approx(sum(g["total_score"] * g["column_share"] for g in groups.values()))


def test_many_correlated_columns(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)], (F.col("id") % 2).cast("string").alias("k"))
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in S.correlation(df, names).collect()}
    assert len(wide) == 144
    for a, b in (("c0", "c1"), ("c3", "c11")):
        assert wide[(a, b)] == pytest.approx(df.stat.corr(a, b), abs=1e-9)
        assert wide[(b, a)] == pytest.approx(wide[(a, b)])


@pytest.mark.parametrize("cells", [1 << 23, 1])
def test_gram_matrices_equal_the_wide_aggregation(spark, monkeypatch, cells):
    df = spark.range(300).selectExpr(
        "CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN NULL ELSE 'c' END AS k",
        "CAST((id * 37) % 101 AS DOUBLE) AS x",
        "IF(id % 3 = 0, NULL, 1e9 + sin(id)) AS y",
        "IF(id % 5 = 0, double('NaN'), CAST((id * 7) % 13 AS FLOAT)) AS z",
        "IF(id % 3 = 0, id, NULL) AS rare",
        "IF(id % 4 = 1, 5, (id * 11) % 17) AS flat_in_b",
        "CAST(NULL AS DOUBLE) AS nothing",
        "IF(id = 7, double('Infinity'), CAST(id AS DOUBLE)) AS infinite",
        "1e-9 * id AS tiny",
        "CAST(id * 1e200 AS DOUBLE) AS huge",
    ).repartition(5)
    columns = df.columns[1:-1]
    wide = {(r["k"], r["col_a"], r["col_b"]): r["r"] for r in S.correlation(df, columns, "k").collect()}
    monkeypatch.setattr(table_module, "WIDE_PAIRS", 0)
    monkeypatch.setattr(table_module, "GRAM_CELLS", cells)
    gram = {(r["k"], r["col_a"], r["col_b"]): r["r"] for r in S.correlation(df, columns, "k").collect()}
    assert gram.keys() == wide.keys() and len(gram) > 100
    assert {p: (gram[p], r) for p, r in wide.items() if abs(gram[p] - r) > 1e-7} == {}
    huge = {(r["col_a"], r["col_b"]): r["r"] for r in S.correlation(df, ["x", "huge", "tiny"]).collect()}
    assert huge["huge", "tiny"] == pytest.approx(1.0)
    assert S.correlation(df.limit(0), columns, "k").collect() == []


def test_two_hundred_columns(spark):
    df = spark.range(500).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(200)])
    start = time.monotonic()
    out = S.correlation(df)
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 200_000
    assert out.count() == 200 * 200
    assert time.monotonic() - start < 120


def test_readers_and_writers(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("id,name,value\n1,a,2.5\n2,b,x\n", encoding="utf-8")
    df = S.read_table(spark, str(csv), "csv", schema="id long, name string, value double")
    assert [r["id"] for r in df.collect()] == [1]
    assert df.count() == 1
    assert [r["id"] for r in df.select("id").collect()] == [1]
    assert dict(S.read_table(spark, str(csv), "csv", infer=False).dtypes)["id"] == "string"
    (tmp_path / "e.csv").write_text("id,name,value\n", encoding="utf-8")
    assert S.table_summary(S.read_any(spark, str(tmp_path / "e.csv"))).first()["row_count"] == 0
    (tmp_path / "d.jsonl").write_bytes(b'{"a": 1}\nbad \xff byte\n')
    lines = [r["line"] for r in S.read_any(spark, str(tmp_path / "d.jsonl")).orderBy("line_no").collect()]
    assert lines == ['{"a": 1}', "bad  byte"]
    with pytest.raises(ValueError, match="Unsupported file type"):
        S.read_any(spark, str(tmp_path / "x.xyz"))
    cards = spark.sql("SELECT 'a' AS k, 1D AS score UNION ALL SELECT 'b', 2D")
    S.write_scorecard(cards, str(tmp_path / "out.json"), "k", fmt="json")
    assert sorted(p.name for p in (tmp_path / "out.json").glob("k=*")) == ["k=a", "k=b"]
    with pytest.raises(ValueError, match="Unsupported result format"):
        S.write_scorecard(cards, str(tmp_path / "o"), fmt="xml")
    assert S.preview(cards.withColumn("n", F.lit(None).cast("int")), 1, "k").first().asDict() == {"k": "a", "score": "1.0", "n": ""}


def test_plans_have_no_row_level_cross_join(spark):
    folder = "/root/testdata/sf0.001"
    lines = S.lines_of(S.read_table(spark, f"{folder}/documents.parquet"), "text", "source")
    for df in (S.profile_text(lines, "source"), S.text_vulnerability(lines, "source"), S.class_balance(lines.select("source", "line"), ["line"], "source")):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = line_facts(lines, "source")._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") : plan.index("Exchange") + 200]
    assert "hashpartitioning(source" in exchange and "_fp1" in exchange
    scan = duplicate_lines(lines, "source")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in scan


def test_null_keys_match(spark):
    left = spark.sql("SELECT CAST(NULL AS STRING) AS k, 1 AS a UNION ALL SELECT 'x', 2")
    right = spark.sql("SELECT CAST(NULL AS STRING) AS k, 3 AS b UNION ALL SELECT 'x', 4")
    assert sorted(r["b"] for r in match(left, right, ["k"], "inner").collect()) == [3, 4]


def test_profile_without_some_kinds_of_columns(spark):
    numbers = spark.range(20).select("id")
    words_only = spark.range(20).select(F.col("id").cast("string").alias("w"))
    assert S.score_table(profile_table(numbers)).first()["balance"] == 100
    assert S.score_table(profile_table(words_only)).first()["noise"] == 100


def test_spread(spark):
    few = S.read_table(spark, "/root/testdata/sf0.001/documents.parquet")
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert spread(many).rdd.getNumPartitions() == 64


def test_fixed_size_samples(spark):
    """Large slices are cut by a hash threshold first; repeated keys make it fall back."""
    df = spark.range(0, 20000, 1, 8).select("id", (F.col("id") % 997 % 2).cast("string").alias("k"), (F.col("id") % 3).alias("same"))
    md5 = F.md5(F.expr("concat(length(CAST(id AS STRING)), ':', id)"))
    for by in ([], ["k"]):
        found = S.top_hash(df, "id", 40, by)
        everything = df.select("*", md5.alias("h")).orderBy("h").collect()
        for k in {None} if not by else {"0", "1"}:
            want = [r["id"] for r in everything if k is None or r["k"] == k][:40]
            got = [r["id"] for r in found.collect() if k is None or r["k"] == k]
            assert sorted(got) == sorted(want)
    assert S.top_hash(df, "same", 40, "k").count() == 80
    assert S.top_hash(df, "id", 50_000).count() == 20000


def test_quantiles_of_infinities_are_the_same_on_both_paths(spark):
    inf = float("inf")
    for values in ([float(i) for i in range(10)] + [inf] * 15, [-inf, 1.0, 2.0, inf], [-inf, -inf, 3.0, 4.0], [-1.7e308, 5e-324, 0.0, 1.7e308, inf]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = []
        for options in ({}, {"single_pass_rows": 0}, {"single_pass_rows": 0, "enough": 1}):
            rows = S.quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.75, 1.0], **options).orderBy("prob").collect()
            got.append([r["value"] for r in rows])
        for other in got[1:]:
            assert other == pytest.approx(got[0], rel=1e-12, nan_ok=True)


def test_scores_do_not_depend_on_the_order_of_columns(spark):
    labels = [f"CAST(id % 4 AS STRING) AS c{i}" for i in range(5)]
    numbers = [f"CAST(id % 97 AS DOUBLE) AS x{i}" for i in range(10)]
    odd = ["'same' AS odd", "CASE WHEN id < 3 THEN 1e6D ELSE id % 7 END AS wild"]
    base = spark.range(400)
    scores = [S.score_table(profile_table(base.selectExpr(*columns))).first().asDict() for columns in ([*labels, *numbers, *odd], [*odd, *labels, *numbers])]
    for name in ("balance", "noise", "total_score"):
        assert scores[0][name] == pytest.approx(scores[1][name])


def test_all_labels_count(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS label", "IF(id < 2000, 'x', CAST(id AS STRING)) AS other")
    found = {r["column"]: r for r in S.balance_metrics(rows).collect()}
    assert found["label"]["n_classes"] == 3000
    assert found["label"]["entropy"] == pytest.approx(math.log2(3000))
    assert found["label"]["entropy_ratio"] == pytest.approx(1.0)
    assert found["label"]["gini"] == pytest.approx(1 - 1 / 3000)
    assert (found["other"]["n_classes"], found["other"]["max_prop"]) == (1001, pytest.approx(2 / 3))
    p = [2 / 3] + [1 / 3000] * 1000
    assert found["other"]["entropy"] == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert S.fairness_table(S.balance_metrics(rows, ["other"])).first()["drift_score"] == pytest.approx(
        100 * (sum(x * x for x in p) / 2 + 0.05)
    )


def test_constant_labels_have_no_entropy(spark):
    row = S.balance_metrics(spark.range(7).selectExpr("'a' AS label")).first()
    assert (row["n_classes"], row["gini"], row["entropy"], row["entropy_ratio"]) == (1, 0.0, 0.0, 0.0)
    assert S.balance_metrics(spark.range(7).selectExpr("CAST(NULL AS STRING) AS label")).collect() == []


def test_counting_labels_shuffles_no_text(spark):
    rows = spark.range(50).selectExpr("CAST(id AS STRING) AS label", "id % 3 AS k")
    plan = S.balance_metrics(rows, ["label"], "k")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("label" in line for line in exchanges)


def test_audit_sees_every_column_and_label(spark):
    """A hit word among many labels, and a far point in the last of twelve numeric columns."""
    numbers = ", ".join(f"CAST((id * {7 + i}) % 101 AS DOUBLE) AS n{i}" for i in range(11))
    table = spark.range(300).selectExpr(
        "id", "CAST(id AS STRING) AS code", *numbers.split(", "),
        "IF(id = 5, 1000000D, CAST(id % 10 AS DOUBLE)) AS last",
    )
    scores = [
        S.audit(table.select("id", *order), "tabular", key="id").first()
        for order in (table.columns[1:], table.columns[:0:-1])
    ]
    for name in ("vulnerability_score", "drift_score", "total_score", "verdict"):
        assert scores[0][name] == scores[1][name]
    without = S.audit(table.drop("last"), "tabular", key="id").first()
    assert without["vulnerability_score"] != scores[0]["vulnerability_score"]
    words = spark.range(200).selectExpr("id", "IF(id >= 197, element_at(array('diabetes', 'asthma', 'hypertension'), CAST(id - 196 AS INT)), CAST(id AS STRING)) AS code")
    assert S.audit(words, "tabular").first()["detected_domain"] == "Healthcare"


def test_bootstrap_of_slices(spark, monkeypatch):
    rows = spark.range(500).selectExpr(
        "id AS `i.d`", "IF(id % 7 = 0, NULL, id % 3) AS `k.1`", "IF(id % 2 = 0, 'x', NULL) AS k2", "IF(id % 11 = 0, double('NaN'), CAST(id % 13 AS DOUBLE)) AS v"
    )
    whole = {(r[0], r[1]): r for r in S.bootstrap_ci(rows, "v", "i.d", 40, ["k.1", "k2"]).collect()}
    assert len(whole) == 8
    for r in whole.values():
        assert r["lower_bound"] < r["point_estimate"] < r["upper_bound"]
    monkeypatch.setattr(confidence, "HELD_SLICES", 1)
    again = {(r[0], r[1]): r for r in S.bootstrap_ci(rows.repartition(7), "v", "i.d", 40, ["k.1", "k2"]).collect()}
    assert again.keys() == whole.keys()
    for k, r in whole.items():
        assert list(again[k])[2:] == pytest.approx(list(r)[2:])
    weights = confidence.poisson_weights(np.arange(1, 20_001) * 214_013 % 2**32, np.arange(20_001, 1, -1) * 69_069 % 2**32, 50)
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.03)


def test_keys_with_nulls_and_dots(spark):
    rows = spark.createDataFrame([(None, "x", 1), ("x", None, 2), ("x", "", 3), ("", "x", 4), ("1:x", None, 5), ("n", "n", 6)], "`a.b` string, c string, n int")
    hashes = {r[0] for r in rows.select(key_md5(["a.b", "c"])).collect()}
    assert len(hashes) == 6
    assert S.hash_sample(rows, ["a.b", "c"], 0.999999).count() >= 5
    assert S.top_hash(rows, ["a.b", "c"], 4).count() == 4


def test_infinities_are_counted_beside_the_bins(spark):
    inf = float("inf")
    values = [float(i % 50) for i in range(300)]
    odd = [*values, inf, inf, -inf, float("nan")]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in odd] + [("c", inf), ("c", -inf)], "k string, v double")
    found = {(r["k"], r["bin"]): r for r in S.histogram(rows, ["v"], "k").collect()}
    plain = {b: r for (k, b), r in found.items() if k == "a"}
    assert sorted(plain) == list(range(1, 31))
    assert sorted(b for k, b in found if k == "b") == list(range(32))
    for b, r in plain.items():
        assert list(found["b", b])[2:] == list(r)[2:]
    assert (found["b", 0]["n"], found["b", 0]["bin_lo"], found["b", 31]["n"], found["b", 31]["bin_hi"]) == (1, -inf, 2, inf)
    assert not any(k == "c" for k, _ in found)
    stats = {r["k"]: r for r in column_stats(rows, ["v"], "k").collect()}
    assert (stats["b"]["n"], stats["b"]["nulls"], stats["b"]["below"], stats["b"]["above"]) == (303, 1, 1, 2)
    assert (stats["b"]["min"], stats["b"]["max"]) == (-inf, inf) and math.isnan(stats["b"]["mean"])
    assert stats["b"]["finite_mean"] == stats["a"]["mean"] and stats["b"]["finite_std"] == stats["a"]["std"]
    assert (stats["c"]["lo"], stats["c"]["min"], stats["c"]["max"]) == (None, -inf, inf)
    clean, noisy = (S.quality_of_table(rows.filter(F.col("k") == k).select("v")).first() for k in "ab")
    assert noisy["avg_noise"] == pytest.approx(clean["avg_noise"] + 3 * 3 / 303)
    assert noisy["noise"] < clean["noise"]


def test_light_profile_of_merged_states(spark):
    rows = spark.range(20_000).selectExpr(
        "id % 2 AS part", "IF(id % 3 = 0, NULL, 'g') AS k", "id % 7000 AS a", "IF(id % 4 = 0, NULL, CAST(id AS STRING)) AS b", "IF(id % 5 = 0, double('NaN'), 1D) AS c"
    )
    columns = ["a", "b", "c"]
    whole = S.light_profile(S.light_state(rows, columns, "k"), "k").collect()
    merged = S.light_profile(S.merge_states(S.light_state(rows, columns, ["part", "k"]), "k"), "k").collect()
    assert sorted(map(str, merged)) == sorted(map(str, whole)) and len(whole) == 8
    total = {r["column"]: r for r in S.light_profile(S.merge_states(S.light_state(rows, columns, "k"))).collect()}
    assert (total["b"]["row_count"], total["b"]["nulls"], total["b"]["missing_pct"]) == (20_000, 5_000, 25)
    assert total["c"]["nulls"] == 4_000 and total["c"]["distinct"] == 1
    assert total["a"]["distinct"] == pytest.approx(7_000, rel=0.05)
    assert total["b"]["distinct"] == pytest.approx(15_000, rel=0.05)
    assert total[None]["distinct"] == pytest.approx(rows.select(columns).distinct().count(), rel=0.05)
    assert S.light_profile(S.light_state(rows.limit(0), columns, "k"), "k").collect() == []
    assert {r["distinct"] for r in S.light_profile(S.light_state(rows.limit(0), columns)).collect()} == {0}
