"""Collocations, language identification and hard negatives: brute force, held-out accuracy, edge cases."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import _rows, connect
from llm import collocations, hard_negatives, language_id
from llm.queries import ORACLES, QUERIES
from llm.toxicity import fold_of

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["op5_mix_sources", "op11_collocations", "op13_hard_negatives"])
def test_query_agrees_with_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    con = connect(FOLDER)
    cursor = con.execute(ORACLES[name])
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == theirs
    con.close()


def brute_collocations(rows, longest, least, top, cover):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    frequent = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in total:
        found = []
        for (of, phrase), a in frequent.items():
            if of != lang:
                continue
            inside = any(
                o == lang and len(longer) > len(phrase) and 100 * n >= cover * a and phrase in [longer[i : i + len(phrase)] for i in range(len(longer))]
                for (o, longer), n in frequent.items()
            )
            if inside:
                continue
            cuts = []
            for k in range(1, len(phrase)):
                left, right = count[lang, phrase[:k]], count[lang, phrase[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "share", "top"), [(3, 4, 2000), (3, 50, 15), (2, 4, 2000), (4, 7, 2000)])
def test_collocations_equal_brute_force(spark, longest, share, top):
    rng = random.Random(longest * share)
    words = ["an", "An", "ba", "çö", "de", "x1", "the", "of", "日本", "q-r"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!?", "\x0b"]) for _ in range(rng.randint(0, 60)))
        if i % 9 == 0:
            text += " Rare words only here in a fixed row"
        rows.append((text, ["en", "de", None][i % 3]))
    rows += [(None, "en"), ("", "fr"), ("one two", "fr"), (" ,. ", "es")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = collocations.collocations(docs, longest=longest, least=10, top=top, cover=50, share=share)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, longest, 10, top, 50)


def test_a_sample_that_proposes_nothing_changes_no_count(spark):
    rows = [("a b c d a b c", "en")] * 30
    found = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), share=10**6)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 3, 10, 2000, 50)


def test_full_bit_tables_change_no_count(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(80)), "en") for _ in range(150)]
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    found = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 3, 10, 2000, 50)


def test_long_texts_are_cut_at_pieces_only(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["ab", "cd", "ef"]) + rng.choice([" ", " ", ". ", "\n"]) for _ in range(4000)) + " z" * 700
    monkeypatch.setattr(collocations, "SLICE", 512)
    found = collocations.collocations(spark.createDataFrame([(text, "en"), ("ab cd", "en")], "text string, lang string"))
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations([(text, "en"), ("ab cd", "en")], 3, 10, 2000, 50)


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a, part = 3_000_000_019, 4_000_000_007
    ratio = "(1000000BD * cast(a AS decimal(16,0)) * a) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(part).alias("l"), F.lit(part).alias("r")).selectExpr(f"{ratio} AS s").first()
    assert row["s"] == 1000000 * a * a // (part * part)


def test_mining_edges(spark):
    rows = [
        (1, None, None, None, None),
        (None, "no key", "en", "a", 1),
        (2, "", "en", "a", 0),
        (3, "12 34 ... —", "en", "a", 3),
        (4, "same words twice", "en", "b", 3),
        (4, "same words twice", "en", "b", 3),
        (5, "Ünï codé " * 30_000, "fr", "b", 9),
        (6, "日本語の文章", None, "b", 9),
        (7, "w" * 3_000_000, "fr", "b", 9),
    ]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS + ", lang_pred string, score int, `a.b` int")
    found = {r["doc_id"]: r for r in language_id.identify_languages(docs, F.lit(True)).collect() if r["doc_id"] != 4}
    assert len(found) == 7
    for key in (1, 2, 3):
        assert (found[key]["lang_pred"], found[key]["score"], found[key]["rejected"]) == ("und", 0.0, True)
    assert found[5]["lang_pred"] == "fr" and found[5]["score"] > 0.5
    assert found[6]["lang_pred"] in ("en", "fr") and found[6]["rejected"]
    assert language_id.identify_languages(docs.limit(0), F.lit(True)).collect() == []
    nothing = language_id.identify_languages(docs, F.lit(False)).collect()
    assert len(nothing) == len(rows) and {r["lang_pred"] for r in nothing} == {"und"}
    one = language_id.identify_languages(docs.filter("doc_id = 4"), F.lit(True)).collect()
    assert [(r["lang_pred"], round(r["score"], 5), r["rejected"]) for r in one] == [("en", 1.0, False)] * 2
    found = collocations.collocations(docs, least=2).collect()
    assert {r["phrase"] for r in found if r["lang"] == "en"} == {"same words twice"}
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_gram_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abÉé .1\n-ß") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", " ", "a"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    counts = language_id.gram_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for text, line in zip(texts, counts, strict=True):
        words = re.findall(rb"[a-z\x80-\xff]+", re.sub("[A-ZÉ]", lambda m: m[0].lower(), text).encode())
        want = 0
        for word in words:
            bounded = b" " + word + b" "
            want += sum(max(0, len(bounded) - size + 1) for size in language_id.SIZES)
        assert line.sum() == want


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op12_language_id"](spark, folder).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in found.collect()]
    assert len(right) > 200 and sum(right) >= 0.99 * len(right)


def test_texts_unlike_anything_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(12)
    strange = [(-i, " ".join("".join(rng.choice("zxqjkw") for _ in range(6)) for _ in range(80)), None) for i in range(1, 41)]
    both = docs.unionByName(spark.createDataFrame(strange, docs.schema))
    found = language_id.identify_languages(both, fold_of(F.col("doc_id")) != 2).collect()
    assert all(r["rejected"] for r in found if r["doc_id"] < 0)
    assert sum(r["rejected"] for r in found if r["doc_id"] >= 0) <= 0.08 * len(found)


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    used = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if all(abs(x * scale) < 2**62 for x in vector):
            used.append((key, [math.floor(float(scale) * x) for x in vector], label))
    out = []
    for i, (anchor, v, label) in enumerate(used):
        if anchor % 50:
            continue
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), key, own) for j, (key, w, own) in enumerate(used) if j != i and key != anchor]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and -low * score <= -100 * s[0] <= -high * score)
            for rank, (other, negative, _) in enumerate(inside[:negatives], 1):
                out.append((anchor, positive, rank, negative, -score, -other))
    return sorted(out)


@pytest.mark.parametrize(("block_cells", "shard_rows"), [(1 << 21, 8192), (16, 8192), (40, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block_cells, shard_rows):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard_rows)
    rng = random.Random(block_cells + shard_rows)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        vector = [round(x + rng.gauss(0, 0.05), rng.choice([1, 4])) for x in c]
        rows.append((i, vector, rng.randrange(3)))
    rows += [(450, rows[0][1], 1), (451, rows[0][1], 0), (450, rows[3][1], 1), (500, [0.0] * 8, 2), (550, [1.0], 0), (551, [0.5, 0.5], 1), (552, [], 1)]
    rows += [(None, [1.0] * 8, 1), (600, None, 1), (601, [float("nan")] * 8, 1), (602, [1.0, None], 1), (603, [float("inf")], 1), (650, [1.0], None), (700, [1e300] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("score", F.lit(1)).withColumn("id", F.lit(1))
    found = hard_negatives.hard_negatives(table.repartition(3), block_cells=block_cells)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)


def test_large_numbers_are_scored_exactly(spark):
    rng = random.Random(77)
    for size in (1e3, 1e9, 1e14, 1e16):
        rows = [(i, [rng.uniform(-size, size) for _ in range(4)], i % 3) for i in range(60)]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
        assert sorted(tuple(r) for r in hard_negatives.hard_negatives(table).collect()) == brute_negatives(rows), size


def test_hard_negatives_of_empty_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [], 1), (50, [], 1)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect() == []


def test_a_walk_ends_at_its_threshold():
    rng = np.random.default_rng(3)
    cells = np.round(rng.normal(0, 8, (20_000, 4))).astype(np.int64)
    order = np.argsort(cells, axis=0, kind="stable").T
    walk = hard_negatives._Walk(cells, order, np.int64)
    anchor = np.array([5, -3, 1, 0])
    truth = np.sort(cells @ anchor)[::-1]
    met, held = 0, np.zeros(0, np.int64)
    for rows, scores, bound in walk.meet(anchor):
        met += len(rows)
        held = np.sort(np.concatenate([held, scores]))[::-1][:5]
        if bound is not None and bound < held[-1]:
            break
    assert held.tolist() == truth[:5].tolist() and met < 6_000
