"""Operators against brute force, and their edge cases, on small tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm import fm_index, lm_score, mixing, near_dedup, passages, quality, secrets, token_counts, toxicity, warc
from llm.decontaminate import cut_benchmark, decontaminate
from llm.lm_score import cross_entropy_difference
from llm.shared import keep_table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "no key at all here", "en", "a", 1),
    (3, " \n\t ", "en", "a", 3),
    (4, "same words in two rows of one key", "en", "b", 3),
    (4, "same words in two rows of one key", "en", "b", 3),
    (5, "Ünï codé " * 30_000, "fr", "b", 9),
]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(*r, "clash", 1) for r in EDGES]
    return spark.createDataFrame(rows, SCHEMA + ", kept string, score int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, "two rows of one"), (8, None), (None, "x"), (9, "")], "item_id bigint, text string")


def by_operator(docs, labels, bench):
    yield "lm", cross_entropy_difference(docs, F.col("lang") == "fr")
    yield "tokens", token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    yield "toxicity", toxicity.score_toxicity(docs, labels)
    yield "quality", quality.clean_lines(docs)
    yield "mix", mixing.mix_sources(docs)
    yield "passages", passages.repeated_passages(docs)
    yield "leaks", decontaminate(docs, bench)
    yield "dedup", near_dedup.near_dedup(docs)
    yield "secrets", secrets.find_secrets(docs)


def test_edges(edges, labels, bench):
    keyed = {"lm": 6, "passages": 5, "mix": None}
    for name, out in by_operator(edges, labels, bench):
        n = len(out.collect())
        want = keyed.get(name, len(EDGES))
        assert want is None or n == want, name
    for name, out in by_operator(edges.limit(0), labels.limit(0), bench.limit(0)):
        assert out.collect() == [], name


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["", "a<|endoftext|>b", "  x \n\n y", "日本 😀", "a" * 2000, "don't we'll", "\x00\r\n"]
    texts += [prose(rng, 60) for _ in range(20)] + ["".join(rng.choice("ab 'é\n1.") for _ in range(300)) for _ in range(20)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Transducer(*token_counts.read_vocabulary(path)).chunk(texts).tolist() == want


def test_toxic_words_are_found_in_held_out_documents(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(1200):
        words = prose(rng, rng.randint(20, 120)).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(max(2, len(words) // 10)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilebad", "nastybad", "awfulbad"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    held = found.filter(toxicity.fold_of(F.col("doc_id")) == 2).select("doc_id", "score").collect()
    hits = Counter((r["doc_id"] % 8 == 0, r["score"] >= 0.3) for r in held)
    assert hits[True, True] >= 0.9 * (hits[True, True] + hits[True, False])
    assert hits[False, True] <= 0.03 * (hits[False, True] + hits[False, False])


def test_toxic_stems_are_found_with_endings_not_seen_before(spark):
    rng = random.Random(47)
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows, marks = [], []
    for i in range(1600):
        words = prose(rng, rng.randint(60, 400)).split()
        if i % 8 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "schlecht"]) + rng.choice(ends) + rng.choice(ends))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    held = found.filter(toxicity.fold_of(F.col("doc_id")) == 2).select("doc_id", "score").collect()
    hits = Counter((r["doc_id"] % 8 == 0, r["score"] >= 0.3) for r in held)
    assert hits[True, True] >= 0.9 * (hits[True, True] + hits[True, False])
    assert hits[False, True] <= 0.03 * (hits[False, True] + hits[False, False])


def test_one_oversize_text_leaves_its_class_in_the_sample(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, 40) + (" vilebad nastybad vilebad" if i % 3 == 0 else "")) for i in range(600)]
    fitted = spark.range(600).filter(toxicity.fold_of(F.col("id")) != 2).filter("id % 3 <> 0")
    first = fitted.orderBy(F.xxhash64("id"), "id").first()[0]
    rows[first] = (first, prose(rng, 70_000))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    found = toxicity.score_toxicity(docs, labels, sample_bytes=1 << 18).collect()
    assert sum(r["score"] < 0.3 for r in found if r["doc_id"] % 3) >= 380
    assert sum(r["score"] >= 0.3 for r in found if r["doc_id"] % 3 == 0) >= 190


def test_loss_differences_do_not_depend_on_buckets_and_hot_grams(spark):
    rng = random.Random(53)
    rows = [(None if i % 97 == 0 else i // 2, f"the {prose(rng, rng.randint(0, 40))} of the" if i % 5 else None, i % 3 == 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, good boolean").repartition(5)

    def scored(**sizes):
        return sorted(map(tuple, cross_entropy_difference(docs, F.col("good"), **sizes).collect()), key=str)

    whole = scored()
    assert len(whole) > 900 and all((d is None) == (n == 0) for _, n, d in whole)
    for got in (scored(bucket=1000), scored(hot=200), scored(hot=200, bucket=1000)):
        assert [r[:2] for r in got] == [r[:2] for r in whole]
        assert max(abs(a[2] - b[2]) for a, b in zip(got, whole) if a[2] is not None) < 1e-8


def test_pairs_of_documents_are_compared_side_by_side(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(0, 1 << 40, 400).astype(np.uint64)
    other = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    edited = np.concatenate([other[:90], text[100:130], text[132:200], other[90:]])
    line = np.tile(text[:7], 60)
    pairs = [(edited, text, [10, -10, 3]), (other, text, [0]), (line, line[:200], list(range(-140, 350, 7)))]
    together = passages.repeats_of(pairs, 50, 80)
    assert together == [passages.repeats_of([pair], 50, 80)[0] for pair in pairs]
    assert together == [[(90, 188)], [], [(0, 420)]]
    # What is known to be repeated is not compared again.
    compared = []
    monkeypatch.setattr(passages, "banded", lambda texts, *_: compared.extend(texts) or [[] for _ in texts])
    assert passages.repeats_of(pairs[2:], 50, 80) == [[(0, 420)]] and not compared


def test_only_texts_that_may_share_a_passage_are_sent():
    rng = np.random.default_rng(6)
    text, other = rng.integers(0, 1 << 16, (2, 300)).astype(np.uint16)
    other[40:45] = text[60:65]
    near = other.copy()
    near[100:150] = text[200:250]
    near[100:150:5] = 0
    assert not passages._hopeful(other, text, [-20], 50, 80)
    assert passages._hopeful(near, text, [-20, -100], 50, 80)


def test_what_buckets_send_back_does_not_grow_with_their_number(spark, monkeypatch):
    rng = random.Random(54)
    docs = spark.createDataFrame([(i, prose(rng, 60), i % 3 == 0) for i in range(400)], "doc_id bigint, text string, good boolean").repartition(2)
    kept = []
    monkeypatch.setattr(lm_score, "keep_table", lambda df: kept.append(keep_table(df)) or kept[-1])
    assert cross_entropy_difference(docs, F.col("good"), bucket=2000).count() == 400
    assert [df.count() for df in kept] == [402]


def test_loss_difference_is_the_mean_of_the_words_losses(spark):
    rng = random.Random(43)
    vocabulary = [a + b for a in "abcde" for b in "xyz"]
    texts = ["ax", "ax by", "by ax", "ax ax ax", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(60))]
    good = {i for i in range(len(texts)) if i % 3 == 0}
    split = [t.split() for t in texts]
    grams = {1: [(i, (w,)) for i, t in enumerate(split) for w in t], 2: [(i, p) for i, t in enumerate(split) for p in zip(t, t[1:])]}
    every = {k: Counter(g for _, g in v) for k, v in grams.items()}
    target = {k: Counter(g for i, g in v if i in good) for k, v in grams.items()}

    def p(counts, gram):
        k = len(gram)
        return (counts[k][gram] + 0.5) / (sum(counts[k].values()) + 0.5 * len(every[k]))

    def loss(counts, t):
        first = -math.log(p(counts, (t[0],)))
        return first - sum(math.log(p(counts, pair) / p(counts, pair[:1])) for pair in zip(t, t[1:]))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in cross_entropy_difference(docs, F.col("doc_id") % 3 == 0).collect():
        t = split[r["doc_id"]]
        assert r["n_tokens"] == len(t)
        assert r["loss_difference"] == pytest.approx((loss(target, t) - loss(every, t)) / len(t), abs=2e-9)


def test_quality_measures_and_lines(spark):
    texts = ["a b c\na b c\nx", "q\n\nq\n", "one | two | three\nA full sentence stands here.\nAll rights reserved"]
    rows = quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["n_dup_lines"] for r in rows] == [1, 1, 0]
    assert [r["n_repeat_words"] for r in rows] == [6, 0, 0]
    assert rows[2]["cleaned"] == "A full sentence stands here."


def test_boilerplate_phrases_fail_brief_lines_only():
    long = " ".join(["Words that stand here for the content of the page."] * 9)
    for phrase in ("privacy policy", "sign in", "design in"):
        assert quality.clean(f"{long} The {phrase} is mentioned here. {long}")[1] == 0
    assert quality.line_verdict("They work on design in the large hall.") is None
    assert quality.line_verdict("Please sign in to read on.") == "boilerplate"
    assert quality.line_verdict("lorem ipsum " * 30) == "boilerplate"


def test_mixing_equals_its_sql(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else (None if i % 2 else f"s{i % 5}"), 2) for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(mixing.mixing_sql("documents", "doc_id, text, lang, source, n_chars", True)).df()
    assert sorted(zip(got.doc_id, got["copy"])) == sorted(zip(want.doc_id, want["copy"]))
    only = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), {"hot": 1.0}).select("source").distinct().collect()
    assert [r[0] for r in only] == ["hot"]


def test_passages(spark):
    rng = random.Random(9)
    shared = prose(rng, 60)
    near = shared.split()
    near[20] = near[41] = "zzz"
    rows = [(i, prose(rng, 300)) for i in range(20)]
    rows += [(30, prose(rng, 80) + " " + shared + " " + prose(rng, 90)), (31, prose(rng, 10) + " " + shared), (32, " ".join(near) + " " + prose(rng, 40))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[31]["sources"] == [30] and [tuple(s) for s in got[31]["spans"]] == [(10, 70)]
    assert got[32]["sources"] and got[32]["n_repeated"] >= 50
    assert all(not got[i]["sources"] for i in [*range(20), 30])


def test_window_centres_are_those_of_all_long_windows():
    rng = np.random.default_rng(1)
    for trial in range(60):
        of = np.concatenate([[0], np.cumsum(rng.integers(0, 60, rng.integers(0, 6)))]).astype(np.int64)
        values, least = rng.integers(0, [3, 50, 2**62][trial % 3], of[-1]).astype(np.uint64), int(rng.integers(1, 30))
        want = set()
        for row in range(len(of) - 1):
            for c in range(of[row], of[row + 1]):
                left, right = c, c
                while left > of[row] and values[left - 1] > values[c]:
                    left -= 1
                while right + 1 < of[row + 1] and values[right + 1] >= values[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((row, c))
        row, centre = passages.window_centres(values, of, least)
        assert len(row) == len(want) and set(zip(row.tolist(), centre.tolist())) == want


def test_alignments_compared_together_are_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = []
    for trial in range(300):
        words = rng.integers(2, [4, 30, 250][trial % 3], (2, 300)).astype(np.uint64) << np.uint64(56)
        a, b = words[0, : rng.integers(20, 300)], words[1, : rng.integers(20, 300)]
        x, y, n, more = (int(rng.integers(0, k)) for k in (len(a), len(b), 120, 18))
        middle = a[x : x + n].copy()
        middle[rng.random(len(middle)) < [0, 0.1, 0.2][trial % 3]] = 7 << 56
        b = np.concatenate([b[:y], middle[: n // 2], words[1, :more], middle[n // 2 :], b[y:]])
        pairs.append((b, a, [s for s in (y - x + 20, y - x, y - x - 9, 5) if -len(a) < s < len(b)]))
    prints = [(*(passages.prints_of(x).tobytes() for x in pair[:2]), pair[2]) for pair in pairs]

    def near(b, a, shift):
        places = np.arange(len(b))[:, None] - shift + np.arange(-passages.BAND, passages.BAND + 1)
        return ((places >= 0) & (places < len(a)) & (a[np.clip(places, 0, len(a) - 1)] == b[:, None])).any(axis=1)

    def alone(pair):
        return passages.repeats_of([pair], 50, 80)[0]

    want = [alone(pair) for pair in pairs]
    assert 50 < sum(map(bool, want)) < 300
    hopeful = passages._hopeful(prints, 50, 80)
    for (b, a, shifts), spans, yes in zip(pairs, want, hopeful.tolist(), strict=True):
        runs = [len(passages.runs_in(near(b, a, s), [len(b)], 50, 80)[0]) for s in shifts] if min(len(a), len(b)) >= 50 else []
        # Runs by the edge of the band reach out of the words that are compared.
        assert yes <= any(runs) and bool(spans) <= yes
    for many in (1 << 21, 400):
        monkeypatch.setattr(passages, "LAID", many)
        monkeypatch.setattr(passages, "ROWS", many)
        assert passages.repeats_of(pairs, 50, 80) == want and (passages._hopeful(prints, 50, 80) == hopeful).all()


def test_passages_between_the_ends_of_a_group(spark):
    """The first document has only phrases of the passage; those in the middle repeat each other, not it."""
    rng = random.Random(31)
    shared = prose(rng, 60).split()
    # Every shingle of the passage as the least of some window, but no long run of the passage.
    phrases = " ".join(" ".join(shared[k : k + 5]) + f" filler{j}" * 60 for j in range(8) for k in range(56))
    rows = [(0, phrases), *((i, prose(rng, 70) + " " + " ".join(shared) + " " + prose(rng, 70)) for i in range(1, 6))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["n_repeated"] for i in range(6)] == [0, 0, 60, 60, 60, 60]
    assert all(got[i]["sources"] and min(got[i]["sources"]) >= 1 for i in range(2, 6))


def test_passages_around_a_line_that_many_documents_have(spark, monkeypatch):
    """All share a line, few a passage around it: the others are not held against each other."""
    rng = random.Random(41)
    line, words = prose(rng, 12), [f"w{k}" for k in range(20_000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    before, after = some(30), some(30)
    rows = [(i, f"{some(100)} {line} {some(100)}") for i in range(150)]
    # In the middle of the group: neither its first nor its last member has the passage.
    for i in (60, 70, 80):
        near = f"{before} {line} {after}".split()
        near[i // 10], near[i // 2 + 20] = "yyy", "zzz"
        rows[i] = (i, f"{some(100)} {' '.join(near)} {some(100)}")
    # Windows in a row of one word, too.
    rows += [(150 + i, f"{some(60)} {'again ' * 200} {some(60)}") for i in range(3)]
    sent, verified = [], passages._verified
    monkeypatch.setattr(passages, "_verified", lambda pairs, *rest: sent.append(pairs.count()) or verified(pairs, *rest))
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i in got if got[i]["n_repeated"]} == {70, 80, 151, 152}
    assert got[70]["sources"] == [60] and got[80]["sources"][0] in (60, 70) and min(got[i]["n_repeated"] for i in (70, 80)) >= 68
    assert min(got[i]["n_repeated"] for i in (151, 152)) >= 200
    # All pairs of windows on the line would be tens of thousands.
    assert sum(sent) < 150 * 2 * 12


def test_members_of_a_hot_group_meet_only_those_that_may_share_a_passage():
    """All have a line; the words around it are few, so that any two share rare ones by chance."""
    rng = np.random.default_rng(8)
    reach, line = 49 + passages.BAND, rng.integers(0, 1 << 16, 12)
    near, of_line = rng.integers(0, 3000, (1500, 2 * reach + 5)), np.arange(reach - 4, reach + 8)
    near[:, of_line] = line
    # A passage with 10 words in 50 changed, one with words put into the earlier text, and a word that comes again and again.
    near[900] = near[400]
    near[900, reach - 30 : reach + 30 : 6] = 60_000
    near[901] = near[401]
    for k in range(6):
        near[401, reach + 10 + 5 * k :] = np.concatenate([[60_001 + k], near[401, reach + 10 + 5 * k : -1]])
    for i, n in ((300, 30), (500, 44), (902, 44)):
        near[i] = np.arange(20_000 + 200 * i, 20_000 + 200 * i + near.shape[1]) % (1 << 16)
        near[i, reach : reach + n] = 7
    rows = pa.table(
        {
            "value": np.full(1500, 5),
            "id": np.arange(1500),
            "c": np.full(1500, reach),
            "open": np.ones(1500, bool),
            "lead": np.full(1500, reach),
            "near": pa.array([x.astype(np.uint16).tobytes() for x in near], pa.binary()),
        }
    )
    looked = []
    near_ = passages._near
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(passages, "_near", lambda later, *rest: looked.append(len(later)) or near_(later, *rest))
        met = {pair for later, earlier in passages._sharing(rows, 50, 80) for pair in zip(later.tolist(), earlier.tolist(), strict=True)}
    assert met == {(900, 400), (901, 401), (902, 500)}
    # Words alone, 3 of the rarest 13 of a run, would be shared by tens of thousands.
    assert sum(looked) < 1500


def test_alignments_in_a_row_share_paths_only_where_they_are_many():
    row = [3, 40, *range(60, 120), 130, 131]
    assert passages._apart(row) == row
    row = [3, 40, *range(60, 200), 230, 231]
    some = passages._apart(row)
    assert set(some) >= {3, 40, 60, 199, 230, 231} and len(some) < 40
    assert all(min(abs(x - y) for y in some) <= passages.BAND // 4 for x in row)


def test_groups_of_windows_are_those_of_sorted_rows(spark):
    rng = random.Random(17)
    rows = sorted({(rng.randrange(30), rng.randrange(12) if i % 3 else 100 + i, rng.randrange(40)) for i in range(900)})
    sizes = {i: rng.randrange(50, 90) for i in range(30)}
    groups = {}
    for i, value, c in sorted(rows):
        groups.setdefault(value, []).append((i, c))
    stars, others = set(), set()
    for value, group in groups.items():
        if group[0][0] == group[-1][0]:
            continue
        for n, (i, c) in enumerate(group):
            for j, d in (group[0], group[-1]):
                (x, p), (y, q) = max((i, c), (j, d)), min((i, c), (j, d))
                along = [k for k in range(sizes[x]) if any(0 <= k - (p - q) + step < sizes[y] for step in (-passages.BAND, 0, passages.BAND))]
                if i != j and len(along) >= 60:
                    stars.add((x, y, p - q, sizes[x] < sizes[y]))
            inner = 0 < n < len(group) - 1 and group[n - 1] == (i, c - 1) and group[n + 1] == (i, c + 1) and c % passages.BAND
            if len(group) > 2 and n and not inner:
                others.add((i, value, c, i != group[0][0] and 1 < n < len(group) - 1))
    found = passages.grouped(spark.createDataFrame([(i, value, (sizes[i] << 32) + c) for i, value, c in rows], "id bigint, value bigint, at bigint"), 60).collect()
    assert {tuple(r)[1:] for r in found if r["star"]} == stars and {tuple(r)[1:] for r in found if not r["star"]} == others
    pairs = passages.aligned(spark.createDataFrame(found).filter("star")).collect()
    assert {(r["id"], r["source"], shift, r["ahead"]) for r in pairs for shift in r["shifts"]} == stars
    assert len(pairs) == len({s[:2] for s in stars})


def test_passages_with_an_inserted_or_deleted_word(spark):
    rng = random.Random(37)
    rows = []
    for i, n in enumerate([60, 75] * 6):
        shared = prose(rng, n).split()
        edited = [*shared[: n // 2], *([] if i % 4 > 1 else ["zzz"]), *shared[n // 2 + (i % 4 > 1) :]]
        rows += [(2 * i, prose(rng, 60) + " " + " ".join(shared) + " " + prose(rng, 60)), (2 * i + 1, prose(rng, 80) + " " + " ".join(edited) + " " + prose(rng, 40))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, n in enumerate([60, 75] * 6):
        assert got[2 * i]["n_repeated"] == 0
        assert got[2 * i + 1]["sources"] == [2 * i] and n - 3 <= got[2 * i + 1]["n_repeated"] <= n + 24


def test_warc_round_trip_and_damage(spark):
    rows = [(1, "http://a/é b", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "u", "same")]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted((tuple(r) for r in warc.read_archives(archives).select("record_id", "record_type", "refers_to", "payload_bytes").collect()), key=str)
    want = [(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4)]
    assert got == sorted(want + [(5, "response", None, 300_000)] * 2, key=str)
    good = warc.record(1, "u", b"payload", None)
    assert [b for _, b in warc.read_records(memoryview(good * 3))] == [b"payload"] * 3
    with pytest.raises(warc.BrokenArchive):
        list(warc.read_records(memoryview(good[:-9])))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 10, 4, 12])]
    docs = [(0, prose(rng, 50)), (1, prose(rng, 9) + " " + items[0][1].upper() + ". " + prose(rng, 5)), (2, items[2][1]), (3, items[1][1] + "," + items[3][1])]
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for row in decontaminate(frame, bench).collect():
        own, hit, found = words(docs[row["doc_id"]][1]), set(), set()
        for item, text in items:
            w = words(text)
            for k in range(max(1, len(w) - 9)):
                window = w[k : k + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(str(item))
        assert (row["n_words"], row["n_hit"], row["items"]) == (len(own), len(hit), sorted(found))
    left = {r["doc_id"]: r["text"] for r in cut_benchmark(frame, bench).collect()}
    assert left[0] == docs[0][1] and set(left) == {0, 1} and items[0][1].upper() not in left[1]


def test_similar_sets_meet_under_a_rare_shingle(spark):
    rng = random.Random(29)
    common = list(range(40))
    rows = []
    for i in range(60):
        base = [*common[: rng.randint(0, 40)], *rng.sample(range(100, 5000), rng.randint(1, 60))]
        rows.append((2 * i, base))
        rows.append((2 * i + 1, [*base[rng.randint(0, max(1, len(base) // 9)) :], *range(9000 + 9 * i, 9000 + 9 * i + rng.randint(0, 4))]))
    sets = {i: set(found) for i, found in rows if found}
    frame = spark.createDataFrame([(i, list(found)) for i, found in sets.items()], "id bigint, found array<bigint>")
    rest = {(r["bucket"], r["id"]): (r["rest"], r["few"]) for r in near_dedup.rare_groups(frame, 85).collect()}
    links = 0
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if (len(sets[a]), a) < (len(sets[b]), b) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                assert any(
                    (t, b) in rest and rest.get((t, a), (0, False))[1] and 185 * min(rest[t, a][0], rest[t, b][0]) >= 85 * (len(sets[a]) + len(sets[b]))
                    for t in sets[a] & sets[b]
                )
    assert links > 20


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 80)) for i in range(10)]
    for i in range(10, 40):
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))

    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    found = {i: sets(t) for i, t in rows}
    least = {i: i for i in found}
    for _ in rows:
        for a in found:
            for b in found:
                if 100 * len(found[a] & found[b]) >= 85 * len(found[a] | found[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in found.items()}


def test_bands_follow_from_the_similarity(spark, monkeypatch):
    assert near_dedup.bands_for(85) == 24
    asked = []
    whole = near_dedup.sketch
    monkeypatch.setattr(near_dedup, "sketch", lambda *a: asked.append(a[4:]) or whole(*a))
    corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), "")
    (bands, rows), = asked
    assert (1 - 0.8**rows) ** bands <= (1 - 0.85**5) ** 24


def test_secrets_against_expressions(spark):
    texts = ['token=abcdef', 'é API_KEY: "abc/def=" x', "passwd==abc123 token=token=zzzzzz", "AKIA" + "B" * 16 + " " + "0f" * 12, "secret: ab", ""]
    rules = [(k, re.compile(p), n) for k, p, n in (("assign", secrets.OPENING.replace("(?i:", "(?:(?i:").replace("_?key)", "_?key))") + r"([A-Za-z0-9+/_.=-]+)", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), rules=secrets.BASE)
    for row in got.collect():
        want = [(m.start(), i, k, m.end()) for i, (k, p, n) in enumerate(rules) for m in p.finditer(texts[row["doc_id"]]) if len(m[1]) >= n]
        assert [tuple(s) for s in row["secrets"]] == [(k, s, e) for s, _, k, e in sorted(want)]


def test_fm_index_finds_all_occurrences():
    import numpy as np

    rng = np.random.default_rng(1)
    sequence = np.append(rng.integers(1, 4, 400), 0).astype(np.int32)
    index = fm_index.FMIndex(sequence, 4)
    phrases = rng.integers(1, 4, (30, 4))
    phrase, at = index.locate(*index.search(phrases, np.full(30, 4)))
    want = {(p, i) for p in range(30) for i in range(397) if (sequence[i : i + 4] == phrases[p]).all()}
    assert set(zip(phrase.tolist(), at.tolist())) == want


def test_pipeline_stages(spark):
    """Each stage on the small tables: columns stay, and its own decision is checked on its own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.keep_table(stage(spark, docs, folder))
        assert after.columns == (names if name != "mixing" else [*names, "copy"])
        ids, before = {r[0] for r in after.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "secrets":
            assert ids == before and sum(len(r["secrets"]) for r in secrets.find_secrets(after, rules=secrets.BASE).collect()) == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert decontaminate(after, bench).filter("n_hit > 0").count() == 0
        if name == "near_duplicates":
            assert near_dedup.near_dedup(after, percent=80).filter("NOT kept").count() == 0
        docs = after
