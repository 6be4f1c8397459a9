"""Known results of small tables and texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import slicewise as S
from slicewise.functions.exprs import clamp, grade, risk_ci, risk_tier
from slicewise.functions import constants as K

DIMENSIONS = ("completeness", "duplication", "noise", "balance", "structural_integrity")


@pytest.mark.parametrize(
    ("name", "dimensions", "total", "letter"),
    [
        ("parcels", (100, 100, 91.651086, 100, 17.185891), 65, "C"),
        ("late_parcels", (100, 100, 91.092116, 0, 38.410944), 60.1871, "C"),
        ("holes", (32, 100, 90.743263, 100, 10), 45, "D"),
        ("repeats", (100, 0, 98.399687, 65.930066, 0), 20, "F"),
        ("trials", (100, 100, 90.921287, 100, 48.64787), 83.2326, "B"),
        ("ward", (100, 100, 96.192133, 100, 12.519224), 65, "C"),
        ("ledger", (100, 100, 91.072802, 100, 12.519224), 65, "C"),
    ],
)
def test_table_quality(request, name, dimensions, total, letter):
    row = S.quality_of_table(request.getfixturevalue(name)).first()
    assert [row[d] for d in DIMENSIONS] == pytest.approx(dimensions, abs=1e-4)
    assert row["total_score"] == pytest.approx(total, abs=1e-4)
    assert row["grade"] == letter
    assert row["quality_issues"]


def test_duplicates_and_missing(repeats, holes):
    row = S.duplicates(repeats).first()
    assert (row["row_count"], row["duplicate_count"]) == (7, 3)
    gaps = {r["column"]: r["missing_pct"] for r in S.missing(holes).collect()}
    assert gaps == {"reading": 0, "upper_probe": 25, "lower_probe": 75}
    assert S.quality_of_table(holes).first()["avg_missing_pct"] == pytest.approx(100 / 3)


def test_fairness(late_parcels, parcels):
    def drift(df, columns):
        return S.fairness_table(S.balance_metrics(df, columns)).first()

    row = drift(late_parcels, ["status"])
    assert row["drift_score"] == pytest.approx(100 * (0.95**2 + 0.05**2 + 0.05))
    assert row["drift_level"] == "CRITICAL"
    row = drift(parcels, ["barcode", "depot"])
    assert row["drift_score"] == 10.0
    assert [i["severity"] for i in row["drift_issues"]] == ["info"]


def test_text_profile(corpora):
    lines = S.lines_of(corpora, "text", "corpus")
    rows = {r["corpus"]: r for r in S.quality_of_text(lines, "corpus").collect()}
    expected = {
        "prose": (120, 6989, 1747, 100 * 116 / 120, 1230, 34, 31.7883, 20),
        "notes": (3, 35, 8, 0.0, 7, 7, 77.2, 20),
        "exam": (120, 6719, 1679, 97.5, 1120, 23, 30.7875, 20),
    }
    for corpus, (n, chars, tokens, dup, words, vocab, _, total) in expected.items():
        row = rows[corpus]
        assert (row["line_count"], row["char_count"], row["estimated_tokens"]) == (n, chars, tokens)
        assert row["duplicate_pct"] == pytest.approx(dup)
        assert (row["word_count"], row["vocab_size"]) == (words, vocab)
        assert row["total_score"] == total
        assert row["outlier_lines"] == 0
        weighted = (
            row["completeness"] * 0.2
            + row["duplication"] * 0.25
            + row["vocabulary_diversity"] * 0.25
            + row["noise"] * 0.1
            + row["structural_integrity"] * 0.2
        )
        assert weighted == pytest.approx(expected[corpus][6], abs=5e-2)
    assert rows["exam"]["phrase_hits"] == 120
    assert rows["prose"]["phrase_hits"] == 0


def test_text_risks(corpora):
    lines = S.lines_of(corpora, "text", "corpus")
    rows = {r["corpus"]: r for r in S.text_contamination(lines, "corpus").collect()}
    assert rows["exam"]["contamination_score"] == 100
    assert rows["exam"]["contamination_level"] == "CRITICAL"
    assert rows["prose"]["contamination_score"] == 0
    drift = {r["corpus"]: r["drift_score"] for r in S.fairness_text(S.profile_text(lines, "corpus")).collect()}
    assert drift == {"prose": 100, "exam": 100, "notes": 0}


def test_table_contamination(parcels, late_parcels):
    assert S.table_contamination(S.table_summary(parcels)).first()["contamination_score"] == 0
    row = S.table_contamination(S.table_summary(late_parcels)).first()
    assert (row["contamination_score"], row["contamination_level"]) == (25, "MEDIUM")


def test_memorization(spark):
    rows = [("a", 2_500_000_000, 0.0), ("b", 2_500_000_000, 10.0), ("c", 62_500_000, 0.0)]
    slices = spark.createDataFrame(rows, "k string, token_count long, duplicate_pct double").withColumn(
        "data_type", F.lit("text")
    )
    out = {r["k"]: r for r in S.memorization(slices, "125").collect()}
    assert out["a"]["token_to_param_ratio"] == pytest.approx(20)
    assert out["a"]["memorization_level"] == "MEDIUM"
    assert out["a"]["memorization_probability"] == pytest.approx(0.0834, abs=1e-4)
    assert out["b"]["effective_ratio"] == pytest.approx(16.6667, abs=1e-4)
    assert out["b"]["leakage_score"] == pytest.approx(9.5, abs=0.05)
    assert out["c"]["memorization_level"] == "CRITICAL"
    assert out["c"]["privacy_flag"]
    assert out["c"]["memorization_probability"] == pytest.approx(0.6352, abs=1e-4)


def test_memorization_without_parameters_or_tokens(spark):
    slices = spark.sql("SELECT 0L AS token_count, 0D AS duplicate_pct, 'text' AS data_type")
    row = S.memorization(slices, "0").first()
    assert row["memorization_level"] == "CRITICAL"
    assert 0 <= row["leakage_score"] <= 100


def test_training_cost(spark):
    slices = spark.sql("SELECT 2500000000L AS token_count, 'text' AS data_type")
    costs = S.training_cost(S.with_scenarios(slices, [{"model_size": "Medium"}]))
    row = costs.first()
    assert row["chinchilla_ratio"] == pytest.approx(1.0)
    assert row["data_sufficiency"] == "SUFFICIENT"
    assert row["total_pflops"] == pytest.approx(1875)
    gpus = {r["gpu"]: (round(r["hours"], 2), round(r["cost_usd"], 2)) for r in S.gpu_costs(costs).collect()}
    assert gpus == {
        "A100": (4.17, 12.52),
        "H100": (1.32, 10.52),
        "V100": (10.42, 26.04),
        "A10G": (18.34, 27.51),
        "T4": (20.03, 10.02),
    }
    small = spark.sql("SELECT 201000000L AS token_count, 'text' AS data_type")
    row = S.training_cost(S.with_scenarios(small, [{"model_size": "Small"}])).first()
    assert (row["chinchilla_ratio"], row["total_pflops"]) == pytest.approx((1.005, 12.06))
    empty = spark.sql("SELECT 0L AS token_count, 'text' AS data_type")
    row = S.gpu_costs(S.training_cost(S.with_scenarios(empty, [{}]))).first()
    assert (row["data_sufficiency"], row["hours"]) == ("CRITICALLY_INSUFFICIENT", 0)


def test_compatibility(parcels):
    cards = S.token_counts(S.quality_of_table(parcels), "tabular")
    vision = {"ai_type": "Computer Vision", "architecture": "CNN"}
    row = S.compatibility(S.with_scenarios(cards, [vision])).first()
    assert row["compatibility_score"] <= 35
    assert "KIND_MISMATCH" in {i["code"] for i in row["compatibility_issues"]}
    rnn = {"architecture": "RNN", "task_type": "Detection"}
    row = S.compatibility(S.with_scenarios(cards, [rnn])).first()
    assert row["architecture_fit"] == 30
    good = {"ai_type": "Recommendation", "model_size": "Small"}
    row = S.compatibility(S.with_scenarios(cards, [good])).first()
    assert (row["type_fit"], row["size_fit"], row["quality_fit"]) == (100, 24, 100)
    assert row["best_ai_type"] == "Recommendation"


def test_domain_penalty(parcels):
    cards = S.token_counts(S.quality_of_table(parcels), "tabular").withColumn(
        "mismatch_severity", F.lit("HIGH")
    )
    plain = S.compatibility(S.with_scenarios(cards.withColumn("mismatch_severity", F.lit("NONE")), [{}]))
    lowered = S.compatibility(S.with_scenarios(cards, [{}])).first()
    assert lowered["compatibility_score"] == pytest.approx(plain.first()["compatibility_score"] * 0.8)
    assert {"DOMAIN_MISMATCH", "DOMAIN_PENALTY"} <= {i["code"] for i in lowered["compatibility_issues"]}


def test_bad_scenarios_are_rejected(parcels):
    with pytest.raises(ValueError, match="Invalid ai_type"):
        S.with_scenarios(parcels, [{"ai_type": "Magic"}])
    with pytest.raises(ValueError, match="Unknown scenario fields"):
        S.with_scenarios(parcels, [{"size": "Small"}])


@pytest.mark.parametrize(("name", "domain", "other"), [("ward", "Healthcare", "Finance"), ("ledger", "Finance", "Healthcare")])
def test_domains(request, name, domain, other):
    df = request.getfixturevalue(name).withColumn("dataset", F.lit(name))
    scores = S.domain_scores(S.catalog(df.drop("dataset"), name), S.value_evidence(df, by="dataset"))
    row = S.detect_domain(scores).first()
    assert row["detected_domain"] == domain
    checks = {r["selected_domain"]: r for r in S.domain_mismatch(scores).collect()}
    assert not checks[domain]["mismatch"]
    assert checks[other]["mismatch"]
    assert checks[other]["mismatch_severity"] in ("LOW", "MEDIUM", "HIGH")


def test_no_evidence_is_general(spark):
    df = spark.sql("SELECT 1 AS zzz, 'x' AS qqq")
    row = S.detect_domain(S.domain_scores(S.catalog(df, "d"))).first()
    assert (row["detected_domain"], row["confidence"]) == ("General", 0.0)


def test_grades_tiers_and_bounds(spark):
    rows = [(85.0,), (84.99,), (70.0,), (69.99,), (55.0,), (54.99,), (40.0,), (39.99,), (0.0,)]
    df = spark.createDataFrame(rows, "s double")
    assert "".join(r[0] for r in df.select(grade("s")).collect()) == "ABBCCDDFF"
    rows = [(0.0,), (14.99,), (15.0,), (39.99,), (40.0,), (69.99,), (70.0,), (None,)]
    df = spark.createDataFrame(rows, "s double")
    assert [r[0] for r in df.select(risk_tier("s", K.CONTAMINATION_TIERS)).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "UNKNOWN",
    ]
    rows = [(50.0,), (-10.0,), (150.0,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "s double")
    assert [r[0] for r in df.select(clamp("s")).collect()] == [50, 0, 100, None, None]


def test_risk_intervals(spark):
    rows = [(50.0, 100), (50.0, 1000), (50.0, 10000), (50.0, 1), (None, 100)]
    df = spark.createDataFrame(rows, "score double, n long")
    out = [r[0] for r in df.select(risk_ci("score", "n")).collect()]
    bounds = [(round(c["lower_bound"], 4), round(c["upper_bound"], 4)) for c in out[:4]]
    assert bounds == [(48.04, 51.96), (49.3802, 50.6198), (49.804, 50.196), (50, 50)]
    assert out[4] is None


def test_auto_sample_sizes(spark):
    rows = [(0,), (5_000,), (50_000,), (500_000,), (5_000_000,), (100_000_000,), (1_000_000,)]
    df = spark.createDataFrame(rows, "n long")
    assert [r[0] for r in df.select(S.auto_sample_size("n")).collect()] == [
        1000, 5000, 25000, 100000, 250000, 1000000, 50000,
    ]
    wanted = spark.sql("SELECT 1000000L AS n")
    assert wanted.select(S.auto_sample_size("n", 50_000)).first()[0] == 50_000
    assert wanted.select(S.auto_sample_size("n", 100)).first()[0] == 1000


@pytest.mark.parametrize(("n", "isolated"), [(50, 3), (100, 5), (500, 25)])
def test_isolated_share(spark, n, isolated):
    points = spark.range(n).select("id", (F.col("id") * F.col("id")).cast("double").alias("x"))
    row = S.geometry_scan(points, "id", ["x"]).first()
    assert row["isolated_pct"] == pytest.approx(isolated / n * 100)


def test_verdicts(spark, parcels):
    row = S.audit(parcels, "tabular", scenarios=[{"ai_type": "Recommendation", "model_size": "Small"}]).first()
    assert row["vulnerability_level"] == "UNKNOWN"
    assert row["risks_present"] == 3
    assert row["verdict"] == "NOT_READY"
    assert row["critical_issues"] >= 1
    assert len(row["recommendations"]) == len(set(row["recommendations"]))


def test_audit_checks_the_domain(ward):
    scenarios = [
        {"ai_type": "Recommendation", "model_size": "Small", "domain": d} for d in ("Healthcare", "Finance")
    ]
    rows = {r["domain"]: r for r in S.audit(ward, "tabular", scenarios=scenarios, key="patient_no").collect()}
    assert rows["Healthcare"]["detected_domain"] == "Healthcare"
    assert rows["Healthcare"]["mismatch_severity"] == "NONE"
    assert rows["Finance"]["mismatch"]
    assert rows["Finance"]["compatibility_score"] < rows["Healthcare"]["compatibility_score"]
    assert rows["Finance"]["risks_present"] == 4
