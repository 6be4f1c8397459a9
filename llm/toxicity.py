"""Toxicity by class-conditional Kneser-Ney models: length-normalised log-likelihoods compared.

Each class has an interpolated Kneser-Ney bigram model. It backs off to the class's continuation counts
of the word, and a word is spelt byte by byte: the next byte given the word's beginning, up to ``SPELT`` bytes, which backs
off to a uniform distribution. So an expression that neither class has is judged by its beginning (a stem with an ending
not seen before), and a rare beginning is smoothed alike in both classes.

A document's evidence is the difference of the two log-likelihoods per word, for the whole text and for
its most toxic word and run of 2, of 8 and of 32 words (runs are cut at the text's end, not averaged away by a long
text). Logistic regression turns the five into a probability. It is fitted on evidence from models
that have not seen the document's fold.

Models are fitted on a bounded sample of labelled documents, ``sample_bytes`` of text in each class at
most, so their size is bounded too and they are broadcast. Counting is a Spark aggregation; only counts of the more frequent
words, beginnings and bigrams of the sample, and of contexts of the latter, come to the driver. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.shared import keep, keep_table, send
from llm.words import LETTERS, ODD, Words, hashes, mix, slices, split

SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 16 << 20
#: A key's texts have at most this part of ``sample_bytes`` in the sample, so each class keeps that many keys or all.
LEAST_KEYS = 64
RUNS = (1, 2, 8, 32)
#: Taken from every count of a class: an expression this rare in it is left to the counts it backs off to.
DISCOUNT = 5
#: Bytes of a word that are spelt; what follows them is one more symbol.
SPELT = 8
#: The uniform distribution of the next byte.
UNIFORM = 1 / 256
BEGINNINGS = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(SPELT + 1)], np.uint64)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += np.uint64(0x20)
START = np.uint64(0x5851F42D4C957F2D)
FOLDS = (0, 1, 3)


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Word hashes, the hashes of the words before them, and the words."""
    words = split(data, offsets, LETTERS)
    here = hashes(data, words.starts, words.ends)
    before = np.empty_like(here)
    before[1:] = here[:-1]
    before[words.of[:-1][np.diff(words.of) > 0]] = START
    return before, here, words


def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first ``SPELT`` bytes of each word as a number, A-Z as a-z; no word has a zero byte, so zeros end a shorter one."""
    head = np.zeros(len(starts), np.uint64)
    for k in range(SPELT):
        byte = LOWER[data[np.minimum(starts + k, ends - 1)]]
        head = (head << np.uint64(8)) | np.where(starts + k < ends, byte, np.uint64(0))
    return head


def _sizes(head: np.ndarray) -> np.ndarray:
    """How many bytes of each word are in its head."""
    return sum((head & BEGINNINGS[k]) != (head & BEGINNINGS[k - 1]) for k in range(1, SPELT + 1))


def _both(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    return mix(before * ODD[0] + here * ODD[1])


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and which are there."""
    place = np.searchsorted(table, keys)
    place[place == len(table)] = 0
    return place, (table[place] == keys if len(table) else np.zeros(len(keys), bool))


@dataclass
class Ratio:
    """log p(word | before, toxic) - log p(word | before, ordinary), tabulated."""

    pairs: np.ndarray
    pair_ratio: np.ndarray
    words: np.ndarray
    word_ratio: np.ndarray
    #: Per length of a beginning, from 0: that of words that go on in a way not tabulated.
    heads: list[np.ndarray]
    head_ratio: list[np.ndarray]
    contexts: np.ndarray
    backoff_ratio: np.ndarray

    def of(self, data: np.ndarray, before: np.ndarray, here: np.ndarray, words: Words) -> np.ndarray:
        out = np.zeros(len(here))
        at, known = _place(self.words, here)
        out[known] = self.word_ratio[at[known]]
        other = np.flatnonzero(~known)
        head = _heads(data, words.starts[other], words.ends[other])
        for k in range(len(self.heads) - 1, -1, -1):
            at, known = _place(self.heads[k], head & BEGINNINGS[k])
            out[other[known]] = self.head_ratio[k][at[known]]
            other, head = other[~known], head[~known]
        at, known = _place(self.contexts, before)
        out[known] += self.backoff_ratio[at[known]]
        at, known = _place(self.pairs, _both(before, here))
        out[known] = self.pair_ratio[at[known]]
        return out


@dataclass
class Statistics:
    """What the models need of the distinct bigrams of the sample, in versions: one without each fold, and last
    one of all.

    Per word and per beginning of words: distinct bigrams of each class that end in it (k0, k1). Per context:
    occurrences (m0, m1) and what is taken from them (t0, t1). Per bigram: occurrences (c0, c1). Words, beginnings and
    bigrams of which no class has more than ``DISCOUNT`` need no entry: both classes leave them to what they back off to, as they
    leave unseen ones; nor do contexts without such a bigram."""

    words: pa.Table
    beginnings: pa.Table
    contexts: pa.Table
    pairs: pa.Table


def kneser_ney(counts: Statistics, version: int) -> Ratio:
    """The ratio of one version of the counts."""

    def sums(table: pa.Table, name: str) -> np.ndarray:
        return np.stack([table.column(f"{name}{k}_{version}").to_numpy().astype(np.float64) for k in (0, 1)])

    def longs(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().view(np.uint64)

    def over(count: np.ndarray) -> np.ndarray:
        return np.maximum(count - DISCOUNT, 0)

    level = counts.beginnings.column("level").to_numpy()
    rows = [np.flatnonzero(level == k) for k in range(SPELT + 1)]
    begun, heads = sums(counts.beginnings, "k"), longs(counts.beginnings, "head")
    rows = [r[np.argsort(heads[r])] for r in rows]
    if not len(rows[0]) or (begun[:, rows[0][0]] == 0).any():
        none, zero = np.zeros(0, np.uint64), np.zeros(0)
        return Ratio(none, zero, none, zero, [], [], none, zero)
    levels = [heads[r] for r in rows]
    kinds = [begun[:, r] for r in rows]
    here, head, ended = longs(counts.words, "here"), longs(counts.words, "head"), sums(counts.words, "k")
    size = _sizes(head)
    # What a beginning passes on is what its longer ones and words have beyond the discount; the rest is left to the uniform distribution.
    passed = [np.zeros_like(n) for n in kinds]
    up = [np.zeros(0, np.int64)] + [np.searchsorted(levels[k - 1], levels[k] & BEGINNINGS[k - 1]) for k in range(1, SPELT + 1)]
    own = np.zeros(len(here), np.int64)
    for k in range(SPELT + 1):
        at = np.flatnonzero(size == k)
        own[at] = np.searchsorted(levels[k], head[at])
        for c in (0, 1):
            passed[k][c] += np.bincount(own[at], over(ended[c, at]), len(levels[k]))
            if k < SPELT:
                passed[k][c] += np.bincount(up[k + 1], over(kinds[k + 1][c]), len(levels[k]))
    left = [np.where(n > 0, (n - t) / np.maximum(n, 1), 1.0) for n, t in zip(kinds, passed, strict=True)]
    logs = [np.zeros((2, len(levels[0])))]
    for k in range(1, SPELT + 1):
        step = over(kinds[k]) / np.maximum(kinds[k - 1][:, up[k]], 1) + left[k - 1][:, up[k]] * UNIFORM
        logs.append(logs[k - 1][:, up[k]] + np.log(step))
    word_logs = np.zeros((2, len(here)))
    for k in range(SPELT + 1):
        at = np.flatnonzero(size == k)
        word_logs[:, at] = logs[k][:, own[at]] + np.log(over(ended[:, at]) / np.maximum(kinds[k][:, own[at]], 1) + left[k][:, own[at]] * UNIFORM)
    by_word = np.argsort(here)
    here, word_logs = here[by_word], word_logs[:, by_word]

    # Bigrams, their words by the same tables.
    first, second, last = longs(counts.pairs, "before"), longs(counts.pairs, "here"), longs(counts.pairs, "head")
    before = longs(counts.contexts, "before")
    by_context = np.argsort(before)
    before = before[by_context]
    mass, taken = sums(counts.contexts, "m")[:, by_context], sums(counts.contexts, "t")[:, by_context]
    backoff = np.where(mass > 0, taken / np.maximum(mass, 1), 1.0)
    at, known = _place(here, second)
    p_word = np.zeros((2, len(second)))
    p_word[:, known] = word_logs[:, at[known]]
    size, open_ = _sizes(last), np.flatnonzero(~known)
    for k in range(SPELT, -1, -1):
        at, known = _place(levels[k], last[open_] & BEGINNINGS[k])
        found, at = open_[known], at[known]
        p_word[:, found] = logs[k][:, at] + np.log(left[k][:, at]) + (size[found] - k + 1) * np.log(UNIFORM)
        open_ = open_[~known]
    h = np.searchsorted(before, first)
    pair_logs = np.log(over(sums(counts.pairs, "c")) / np.maximum(mass[:, h], 1) + backoff[:, h] * np.exp(p_word))
    hashed = _both(first, second)
    order = np.argsort(hashed)

    def ratio(of: np.ndarray) -> np.ndarray:
        return (of[1] - of[0]).astype(np.float32)

    return Ratio(
        hashed[order],
        ratio(pair_logs)[order],
        here,
        ratio(word_logs),
        levels,
        [ratio(p + np.log(rest)) for p, rest in zip(logs, left, strict=True)],
        before,
        ratio(np.log(backoff)),
    )


def _statistics(counted: DataFrame) -> Statistics:
    """From the distinct bigrams (before, here, head, n0 …) of the sample."""

    def count(k: int, version: int) -> Column:
        folds = [f for f in FOLDS if version == len(FOLDS) or f != FOLDS[version]]
        return sum((F.col(f"n{4 * k + f}") for f in folds), F.lit(0))

    whole = len(FOLDS)
    both = [(k, v) for v in range(whole + 1) for k in (0, 1)]

    def often(name: str) -> Column:
        return F.greatest(F.col(f"{name}0_{whole}"), F.col(f"{name}1_{whole}")) > DISCOUNT

    words = keep_table(
        counted.groupBy("here", "head").agg(*[F.count_if(count(k, v) > 0).cast("int").alias(f"k{k}_{v}") for k, v in both])
    )
    masks = [F.lit(int(m)) for m in BEGINNINGS.view(np.int64)]

    def beginning(level: Column) -> Column:
        return F.col("head").bitwiseAND(F.element_at(F.array(*masks), level + 1))

    # A word has no beginnings beyond its length.
    begun = words.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(SPELT)))).filter(
        (F.col("level") == 0) | (beginning(F.col("level")) != beginning(F.greatest(F.col("level") - 1, F.lit(0))))
    )
    beginnings = (
        begun.groupBy("level", beginning(F.col("level")).alias("head"))
        .agg(*[F.sum(f"k{k}_{v}").cast("int").alias(f"k{k}_{v}") for k, v in both])
        .filter((F.col("level") == 0) | often("k"))
    )
    contexts = (
        counted.groupBy("before")
        .agg(
            *[F.sum(count(k, v)).cast("int").alias(f"m{k}_{v}") for k, v in both],
            *[F.sum(F.least(count(k, v), F.lit(DISCOUNT))).cast("int").alias(f"t{k}_{v}") for k, v in both],
        )
        .filter(" OR ".join(f"m{k}_{whole} > t{k}_{whole}" for k in (0, 1)))
    )
    pairs = counted.select("before", "here", "head", *[count(k, v).alias(f"c{k}_{v}") for k, v in both]).filter(often("c"))
    return Statistics(words.filter(often("k")).toArrow(), beginnings.toArrow(), contexts.toArrow(), pairs.toArrow())


def evidence(ratio: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per row: mean ratio per word, and the highest mean of any run of RUNS words (of the whole text,
    filled with zeros, if it is shorter). Zeros without words."""
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    n = np.diff(of)
    out = np.zeros((len(n), 1 + len(RUNS)))
    out[:, 0] = (sums[of[1:]] - sums[of[:-1]]) / np.maximum(n, 1)
    row_end = np.repeat(of[1:], n)
    start = np.arange(len(ratio))
    for k, run in enumerate(RUNS, 1):
        full = start + run <= row_end
        # A run that would pass the end is used only if it is the whole text.
        usable = full | (start == np.repeat(of[:-1], n))
        mean = (sums[np.minimum(start + run, row_end)] - sums[start]) / run
        mean[~usable] = -np.inf
        some = np.flatnonzero(n > 0)
        if len(some):
            out[some, k] = np.maximum.reduceat(mean, of[:-1][some])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a small ridge: means, scales and coefficients (the constant last)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 1e-2), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * b
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


@dataclass
class Model:
    ratio: Ratio
    mean: np.ndarray
    scale: np.ndarray
    b: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.b[:-1] + self.b[-1], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, held: int, rows: int, most: int) -> DataFrame:
    """(toxic, fold, text) of at most ``rows`` documents and ``most`` bytes per class, in hash order."""
    named = (
        labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic"))
        .filter("id IS NOT NULL AND toxic IN (0, 1)")
        .withColumn("fold", fold_of(F.col("id")).cast("int"))
        .filter(F.col("fold") != held)
        .withColumn("place", F.xxhash64("id"))
    )
    # A key with several labels counts as toxic if one of them says so.
    named = named.groupBy("id", "fold", "place").agg(F.max("toxic").alias("toxic"))
    first = [named.filter(F.col("toxic") == k).orderBy("place", "id").limit(rows) for k in (0, 1)]
    chosen = keep(first[0].unionByName(first[1]))  # at most 2 * rows
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "id")
    share = most // LEAST_KEYS
    sizes = keep(found.groupBy("id", "toxic", "place").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")))
    running = Window.partitionBy("toxic").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.withColumn("sum", F.sum(F.least("bytes", F.lit(share))).over(running)).filter(F.col("sum") <= most)
    # A character has four bytes at most.
    part = F.when(F.col("bytes") > share, F.expr(f"left(text, int({share} div (4 * n)))")).otherwise(F.col("text"))
    named = chosen.join(fitting.select("id", "bytes", "n"), "id")
    return keep(texts.join(F.broadcast(named), "id").select("toxic", "fold", part.alias("text")))


def fit(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, held: int, rows: int, most: int) -> Model:
    spark = docs.sparkSession
    sample = _sample(docs, labels, text, key, label, held, rows, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
            for first, last, data, offsets in slices(batch.column(2)):
                before, here, words = _bigrams(data, offsets)
                own = np.repeat(group[first:last], np.diff(words.of))
                head = _heads(data, words.starts, words.ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), *(pa.array(x.view(np.int64)) for x in (before, here, head))],
                    ["own", "before", "here", "head"],
                )

    groups = [4 * k + f for k in (0, 1) for f in FOLDS]
    counted = keep_table(
        sample.mapInArrow(count, "own int, before bigint, here bigint, head bigint")
        .groupBy("before", "here", "head")
        .agg(*(F.count(F.when(F.col("own") == g, 1)).cast("int").alias(f"n{g}") for g in groups))
    )
    counts = _statistics(counted)
    sent = send(spark, {f: kneser_ney(counts, v) for v, f in enumerate(FOLDS)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = sent()
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for first, last, data, offsets in slices(batch.column(2)):
                before, here, words = _bigrams(data, offsets)
                x = np.zeros((last - first, 1 + len(RUNS)))
                for f, ratio in others.items():
                    own = fold[first:last] == f
                    x[own] = evidence(ratio.of(data, before, here, words), words.of)[own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *(pa.array(x[:, k]) for k in range(x.shape[1]))],
                    ["toxic", *(f"x{k}" for k in range(x.shape[1]))],
                )

    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(1 + len(RUNS)))
    # At most 2 * rows rows, ordered so that sums do not depend on the tasks.
    points = sample.mapInArrow(measure, schema).toPandas().sort_values(list(f"x{k}" for k in range(1 + len(RUNS))))
    shares = {r["toxic"]: r["n"] for r in labels.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{label}`").cast("int").alias("toxic")).agg(F.count(F.when(fold_of(F.col(f"`{key}`")) != held, 1)).alias("n")).filter("toxic IN (0, 1)").collect()}
    y = points["toxic"].to_numpy(float)
    x = points.drop(columns="toxic").to_numpy(float)
    whole = kneser_ney(counts, len(FOLDS))
    if len(y) == 0 or y.min() == y.max():
        constant = 0.0 if len(y) == 0 else float(y[0])
        zero = np.zeros(1 + len(RUNS))
        return Model(whole, zero, zero + 1, np.append(zero, 30 * (2 * constant - 1)))
    # The sample holds the classes in other shares than the labels do.
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    return Model(whole, *fit_logistic(x, y, weight * len(y) / weight.sum()))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    held: int = 2,
    rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs``: key, score (0 to 1), mean_ratio, run1_ratio, run2_ratio, run8_ratio, run32_ratio.

    Labels are learnt from documents of ``fit_on`` (default ``docs``) whose crc32(key as text) mod 4 is
    not ``held``: of each class the first ``rows`` in hash order, as far as their texts have no more than
    ``sample_bytes`` together. If a key's texts have more than a ``LEAST_KEYS``-th of that, only the start of each is
    used for fitting (together no more than this share); scores are always of whole texts. Only texts are inputs of a score. Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. Null, empty and wordless texts have no evidence
    and get the score of that. Labels that are null or neither 0 nor 1 are ignored; of several for a key
    the highest counts. Without labels, or with one class, all scores are the share of that class (0 if
    there is none). Keys may be null or repeat; each row is scored by itself. Other columns are ignored.
    """
    model = fit(docs if fit_on is None else fit_on, labels, text, key, label, held, rows, sample_bytes)
    return _scored(docs, model, text, [key]).select(F.col("c0").alias(key), *_names())


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", key: str = "doc_id", label: str = "toxic"
) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; columns and other rows stay as they
    are. Cases as in ``score_toxicity``."""
    model = fit(docs, labels, text, key, label, 2, SAMPLE_ROWS, SAMPLE_BYTES)
    scored = _scored(docs, model, text, docs.columns).filter(F.col("score") < threshold)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _names() -> list[str]:
    return ["score", "mean_ratio", *(f"run{r}_ratio" for r in RUNS)]


def _scored(docs: DataFrame, model: Model, text: str, kept: list[str]) -> DataFrame:
    """The columns ``kept`` as c0, c1, ..., and the score with its evidence."""
    sent = send(docs.sparkSession, model)
    sources = [*kept, *([] if text in kept else [text])]
    place = sources.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(place)):
                before, here, words = _bigrams(data, offsets)
                x = evidence(own.ratio.of(data, before, here, words), words.of)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, last - first) for i in range(len(kept))),
                        pa.array(own.score(x)),
                        *(pa.array(x[:, k]) for k in range(x.shape[1])),
                    ],
                    [*(f"c{i}" for i in range(len(kept))), *_names()],
                )

    types = [docs.schema[c].dataType.simpleString() for c in kept]
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + [f"{n} double" for n in _names()])
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sources))).mapInArrow(run, schema)
