"""Word-run overlap with a benchmark against brute force, and its edge cases."""

from __future__ import annotations

import random

import pytest

import slicewise as S
from slicewise.operators import contamination, joining

BENCH = "item_id long, text string, source string, a int"
DOCS = "doc_id long, text string, source string, item long, b int"


def runs(text, n):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, bench, n):
    items, texts = {}, {}
    for key, text, *_ in bench:
        if key is not None:
            items.setdefault(key, set()).update(runs(text, n))
    for key, text, *_ in docs:
        texts.setdefault(key, set()).update(runs(text, n))
    return sorted(
        (d, i, len(found & r), len(r), round(100 * len(found & r) / len(r), 9))
        for d, found in texts.items()
        for i, r in items.items()
        if found & r
    )


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(21)
    prose = lambda k: " ".join(rng.choice("ab bc cd de ef fg gh hi".split()) for _ in range(k))
    bench = [(i, prose(rng.randint(3, 30)), "x", 1) for i in range(25)]
    bench += [(3, prose(12), "x", 1), (100, None, "x", 1), (101, "", "x", 1), (None, prose(9), "x", 1), (102, "too short", "x", 1)]
    docs = [(i, prose(rng.randint(0, 60)), ["s", "t"][i % 2], 0, 0) for i in range(80)]
    docs += [(200, "intro\n" + bench[0][1].upper() + "  end", "s", 0, 0), (201, None, "s", 0, 0), (202, "", None, 0, 0), (203, bench[1][1], None, 0, 0)]
    docs += [(203, bench[2][1], None, 0, 0), (204, bench[4][1], "t", 0, 0), (205, bench[4][1], "t", 0, 0)]
    return docs, bench


@pytest.mark.parametrize("n", [2, 5])
@pytest.mark.parametrize("broadcast", [True, False])
def test_overlap_equals_brute_force(spark, monkeypatch, sample, n, broadcast):
    if not broadcast:
        monkeypatch.setattr(contamination, "is_small", lambda df: False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, bench = sample
        frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
        found = S.ngram_overlap(*frames, n=n).collect()
        assert sorted((*r[:4], round(r[4], 9)) for r in found) == brute(docs, bench, n)
        slices = {r["source"]: r for r in S.ngram_contamination(*frames, n=n, by="source").collect()}
        for source in ("s", "t", None):
            own = [d for d in docs if d[2] == source]
            pairs = brute([(0, *d[1:]) for d in own], bench, n)
            everything = set().union(*(runs(b[1], n) for b in bench if b[0] is not None))
            row = slices[source]
            assert row["doc_count"] == len(own)
            assert row["hit_docs"] == sum(bool(runs(d[1], n) & everything) for d in own)
            # Shingles of different documents of a slice add up.
            merged = set().union(*(runs(d[1], n) for d in own))
            items = {}
            for b in bench:
                if b[0] is not None:
                    items.setdefault(b[0], set()).update(runs(b[1], n))
            covered = {i: len(r & merged) / len(r) for i, r in items.items() if r & merged}
            assert row["items_hit"] == len(covered) == len(pairs)
            assert row["whole_items"] == sum(c == 1 for c in covered.values())
            assert row["max_item_coverage"] == pytest.approx(100 * max(covered.values(), default=0))
            assert row["contamination_score"] == min(100, 10 * len(covered))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlap_of_empty_tables(spark, sample):
    docs, bench = (spark.createDataFrame(r, s) for r, s in zip(sample, (DOCS, BENCH), strict=True))
    assert S.ngram_overlap(docs, bench.limit(0)).collect() == []
    assert S.ngram_overlap(docs.limit(0), bench).collect() == []
    assert S.ngram_contamination(docs.limit(0), bench, by="source").collect() == []
    row = S.ngram_contamination(docs, bench.limit(0)).first()
    assert (row["hit_docs"], row["items_hit"], row["contamination_score"], row["contamination_level"]) == (0, 0, 0, "LOW")
    row = S.ngram_contamination(docs.limit(0), bench).first()
    assert (row["doc_count"], row["hit_pct"], row["contamination_level"]) == (0, 0, "LOW")


def test_long_document_with_an_item(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words[40_000:40_020]))], "item_id long, text string")
    row = S.ngram_overlap(docs, bench, n=13).first()
    assert (row["shared_shingles"], row["item_shingles"], row["item_coverage"]) == (8, 8, 100)


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(100).selectExpr("repeat('x', 1000) AS s", "array_repeat(1D, 50) AS v")
    assert joining.is_small(wide)
    assert not joining.is_small(wide, most_bytes=100_000)
    assert not joining.is_small(wide, bound=99)


def test_lengths_in_one_pass_and_all_white_space(spark, sample):
    """Several lengths cost one pass over the texts; words end at the same characters as elsewhere in the library."""
    docs, bench = sample
    odd = " ".join(["Ärger", "und", "İx"]) + " z　é\x1fy\u0085w €â"
    docs = [*docs, (300, odd, "s", 0, 0), (301, "x " + odd.replace(" ", "\r\n"), "t", 0, 0)]
    bench = [*bench, (200, odd.replace(" ", "  "), "x", 1)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
    scans = []
    whole = contamination.shingle_rows
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(contamination, "shingle_rows", lambda *a, **k: scans.append(a) or whole(*a, **k))
        found = S.ngram_overlap(*frames, n=[2, 5, 7]).collect()
    assert len(scans) == 2
    for n in (2, 5, 7):
        assert sorted((*r[:4], round(r[4], 9)) for r in found if r["n"] == n) == brute(docs, bench, n)
    assert {(r["doc_id"], r["item_coverage"]) for r in found if r["n"] == 7 and r["item_id"] == 200} == {(300, 100.0), (301, 100.0)}
    totals = S.ngram_contamination(*frames, n=[2, 5], by="source").collect()
    for n in (2, 5):
        alone = {r["source"]: r.asDict() for r in S.ngram_contamination(*frames, n=n, by="source").collect()}
        assert {r["source"]: {k: v for k, v in r.asDict().items() if k != "n"} for r in totals if r["n"] == n} == alone
