"""What the scans of text lines compute per line."""

from __future__ import annotations

from pyspark.sql import functions as F

import slicewise as S
from slicewise.functions.constants import WHITESPACE, WORD_BREAK
from slicewise.functions.exprs import char_entropy, low_entropy, word_count, words


def test_words_end_at_white_space_only(spark):
    """At every character of the list and at no other one, whatever the regex engine calls a space."""
    points = [c for c in [*range(1, 0x3100), *range(0xD7F0, 0x10000), 0x1D173, 0xE0020] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}{chr(c)}b") for c in points], "c int, s string")
    split = {r["c"] for r in df.filter(F.size(F.split("s", WORD_BREAK)) == 2).select("c").collect()}
    assert split == {ord(c) for c in WHITESPACE}
    # A look at the character's type, not one test for each range of a list.
    assert len(WORD_BREAK) < 20


def test_words_of_odd_lines(spark):
    texts = [None, "", " ", "a", "a b", " A b\x1f", "x\x85y　　z", "​a", "a\x1cb\xa0c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, s string")
    found = {r["k"]: (r["w"], r["n"]) for r in df.select("k", words("s").alias("w"), word_count("s").alias("n")).collect()}
    assert found[0] == (None, None)
    for i, t in enumerate(texts[1:], 1):
        want = [w for w in t.lower().split() if w]
        assert found[i][0] == want, t
        if t == t.strip():
            assert found[i][1] == len(want), t
    counted = S.vocab(df.select(F.col("k"), F.col("s").alias("line"))).first()
    assert counted["word_count"] == sum(len(t.split()) for t in texts if t)


def test_low_entropy_reads_the_length_of_the_line_only(spark):
    texts = [None, "", " ", "a", "aaab", "ab" * 50, "eaint " * 9, "é" * 40, "éèêë" * 9, "日本語のテキスト", "日日日日 e", "e\u2003t" * 30, "The rain in Spain"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", low_entropy("s").alias("low"), (char_entropy("s") < 2).alias("want"))
    assert all(r["low"] == r["want"] for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length(replace(" in plan and "- length(replace(" not in plan
