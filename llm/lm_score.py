"""LM scoring by cross-entropy difference of a target and a background bigram model.

Both models count n-grams over one vocabulary, that of all documents, with the same smoothing. The
conditional probability of a word is the bigram's over its first word's, so a word's loss difference
is the bigram's log-ratio less that of the word before it; the first word's is its own log-ratio. Per document the mean is
taken over all words.

Counts come from all documents and are never collected or broadcast as a whole. Texts are read in slices, and a slice sends
each of its distinct grams once, sorted and packed, to buckets that are ranges of hashes. A bucket's task adds up
the slices' counts and sends them back in the same order. They meet the slice's texts again, which travel as numbers of words: so what is shuffled
does not depend on how many buckets there are, and a gram that all documents have costs a bucket one number per slice.
What the size of the models adds to a log-ratio is the same for all grams of an order, so it is added to a document's sum at
the end. Buckets grow in number with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import keep_table
from llm.words import LETTERS, ODD, hashes, mix, slices, split

ALPHA = 0.5
#: Bytes of text per slice and per bucket.
TEXT_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20

#: Columns of rows between the tasks, beside the slice and its keys.
PACKED = "bucket int, size bigint, grams binary, n binary, t binary, words binary, distinct binary, length bigint, places binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, compressed byte place by byte place."""
    places = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize)
    return pa.compress(places.T.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpack(packed: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    places = np.frombuffer(pa.decompress(packed, decompressed_size=count * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(places.reshape(size, count).T).view(kind).ravel()


def _pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that another one of their text follows, and the hashes of these pairs, with the lowest bit set."""
    follows = np.ones(len(words), bool)
    follows[np.cumsum(counts)[counts > 0] - 1] = False
    at = np.flatnonzero(follows)
    return at, mix(words[at] * ODD[0] + words[np.minimum(at + 1, len(words) - 1)] * ODD[1]) | np.uint64(1)


def _dealt(given: DataFrame, buckets: int, most: int) -> DataFrame:
    """Per slice of texts a row for each bucket, with its distinct grams in order and how often all texts and those of the
    target have them, and a row with the texts: keys, numbers of words, distinct words, the commonest first, and word by word
    its place among these."""
    kind = given.schema["key"].dataType.simpleString()
    names = [c.split()[0] for c in PACKED.split(", ")]

    def rows_of(number: int, words: np.ndarray, counts: np.ndarray, own: np.ndarray) -> Iterator[dict]:
        of_target = np.repeat(own, counts)
        at, pairs = _pairs(words, counts)
        gram, n, t = [], [], []
        for values, good in ((words, of_target), (pairs, of_target[at])):
            distinct, which = np.unique(values, return_inverse=True)
            gram.append(distinct)
            n.append(np.bincount(which, minlength=len(distinct)))
            t.append(np.bincount(which[good], minlength=len(distinct)))
            if len(gram) == 1:
                common = np.argsort(-n[0], kind="stable")
                place = np.empty(len(common), np.uint32)
                place[common] = np.arange(len(common))
                text = {"words": _pack(counts.astype(np.uint32)), "distinct": _pack(distinct[common]), "size": len(distinct), "places": _pack(place[which]), "length": len(words)}
        gram, n, t = (np.concatenate(x) for x in (gram, n, t))
        order = np.argsort(gram, kind="stable")
        gram, n, t = gram[order], n[order].astype(np.uint64), t[order].astype(np.uint64)
        # Buckets go up with the hashes.
        of = (gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edge = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64)).tolist()
        for b in range(buckets):
            here = slice(edge[b], edge[b + 1])
            if edge[b] < edge[b + 1]:
                grams = _pack(np.diff(gram[here], prepend=np.uint64(0)))
                yield {"bucket": b, "size": edge[b + 1] - edge[b], "grams": grams, "n": _pack(n[here]), "t": _pack(t[here])}
        # Any bucket will do for the texts themselves.
        yield {"bucket": number % buckets} | text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held, size = TaskContext.get().partitionId(), 0, [], 0

        def sent() -> pa.RecordBatch:
            words, counts, own = (np.concatenate([x[i] for x in held]) for i in range(3))
            keys = pa.concat_arrays([x[3] for x in held])
            held.clear()
            rows = list(rows_of(task + done, words, counts, own))
            lists = pa.ListArray.from_arrays(pa.array([0] * len(rows) + [len(keys)], pa.int32()), keys)
            packed = pa.RecordBatch.from_pylist(rows, kinds).columns
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | done] * len(rows), pa.int64()), lists, *packed], ["slice", "keys", *names])

        for batch in batches:
            for first, last, data, offsets in slices(batch.column(0)):
                words = split(data, offsets, LETTERS)
                hashed = hashes(data, words.starts, words.ends) & ~np.uint64(1)
                part = batch.slice(first, last - first)
                # A copy of the keys, as the column itself would hold the whole batch.
                keys = part.column(1).take(pa.array(np.arange(last - first)))
                held.append((hashed, np.diff(words.of), part.column(2).to_numpy(zero_copy_only=False), keys))
                size += len(data)
                if size >= most:
                    yield sent()
                    size, done = 0, done + 1
        if held:
            yield sent()

    kinds = pa.schema([(n, {"bucket": pa.int32(), "size": pa.int64(), "length": pa.int64()}.get(n, pa.binary())) for n in names])
    return given.mapInArrow(run, f"slice bigint, keys array<{kind}>, {PACKED}")


def cross_entropy_difference(
    docs: DataFrame, target: Column, text: str = "text", key: str = "doc_id", alpha: float = ALPHA, hot: int | None = None, bucket: int = BUCKET_BYTES
) -> DataFrame:
    """Per key: n_tokens, loss_difference (mean over its words of target loss less background loss; the
    lower, the more alike to the target).

    The target model counts the rows where ``target`` is true, the background model all rows. Words
    are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; a text of one word is scored by that word.
    Texts without words, null among them, have n_tokens 0 and a null loss_difference. Rows of equal keys, and
    those of the null key, are scored together. Without any target row all differences follow from
    smoothing alone. Other columns are ignored. ``hot`` has no effect any more: no gram is sent more than once per slice.
    """
    given = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"), F.coalesce(target, F.lit(False)).alias("own"))
    kind = given.schema["key"].dataType.simpleString()
    buckets = (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket + 1

    def counted(table: pa.Table) -> pa.Table:
        """Rows with the counts of all slices in place of the slice's own, and one with sums per level."""
        with_grams = pc.is_valid(table.column("grams"))
        given, texts = table.filter(with_grams), table.filter(pc.invert(with_grams))
        sizes = given.column("size").to_pylist()
        gram = [np.cumsum(_unpack(x.as_buffer(), k, np.uint64), dtype=np.uint64) for x, k in zip(given.column("grams"), sizes, strict=True)]
        if not gram:
            return table
        grams, which = np.unique(np.concatenate(gram), return_inverse=True)
        del gram
        sums = [
            np.bincount(which, np.concatenate([_unpack(x.as_buffer(), k, np.uint64) for x, k in zip(given.column(c), sizes, strict=True)]), len(grams)).astype(np.uint64)
            for c in ("n", "t")
        ]
        ends = np.cumsum(sizes)
        for name, values in zip(("n", "t"), sums, strict=True):
            packed = pa.array([_pack(values[which[end - k : end]]) for end, k in zip(ends, sizes, strict=True)], pa.binary())
            given = given.set_column(given.column_names.index(name), name, packed)
        given = given.set_column(given.column_names.index("grams"), "grams", pa.array([b""] * len(sizes), pa.binary()))
        level = (grams & np.uint64(1)).astype(np.int64)
        levels = np.array([np.bincount(level, x, 2) for x in (np.ones(len(level)), *sums)]).T.astype(np.int64)
        total = pa.Table.from_pylist([{"slice": -1, "bucket": 0, "n": levels.tobytes()}], table.schema)
        return pa.concat_tables([given.cast(table.schema), texts, total])

    def scored(table: pa.Table) -> pa.Table:
        found = pa.schema([("key", table.schema.field("keys").type.value_type), *columns])
        if table.column("slice")[0].as_py() < 0:
            levels = sum(np.frombuffer(x.as_buffer(), np.int64).reshape(2, 3) for x in table.column("n"))
            return pa.Table.from_pylist([{"level": k + 1, "kinds": int(x[0]), "n": int(x[1]), "t": int(x[2])} for k, x in enumerate(levels)], found)
        with_grams = pc.is_valid(table.column("grams"))
        values = table.filter(with_grams).sort_by("bucket")
        (texts,) = (x for x in table.filter(pc.invert(with_grams)).to_batches() if x.num_rows)
        length, size = (texts.column(c)[0].as_py() for c in ("length", "size"))
        keys = texts.column("keys").flatten()
        counts = _unpack(texts.column("words")[0].as_buffer(), len(keys), np.uint32).astype(np.int64)
        places = _unpack(texts.column("places")[0].as_buffer(), length, np.uint32)
        distinct = _unpack(texts.column("distinct")[0].as_buffer(), size, np.uint64)
        at, pairs = _pairs(distinct[places], counts)
        pairs, which = np.unique(pairs, return_inverse=True)
        every, good = (
            np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_buffer(), k.as_py(), np.uint64) for x, k in zip(values.column(c), values.column("size"), strict=True))])
            for c in ("n", "t")
        )
        if len(every) != size + len(pairs):
            raise RuntimeError("a slice of the texts was not the same when it was read again")
        value = np.empty(len(every))
        value[np.argsort(np.concatenate([distinct, pairs]), kind="stable")] = np.log(every + alpha) - np.log(good + alpha)
        some = np.flatnonzero(counts)
        total = np.bincount(np.repeat(np.arange(len(counts)), counts)[at], value[size:][which] - value[places[at]], len(counts)).astype(np.float64)
        total[some] += value[places[(np.cumsum(counts) - counts)[some]]]
        own = {"key": keys, "words": pa.array(counts), "some": pa.array((counts > 0).astype(np.int64)), "total": pa.array(total)}
        return pa.table([own[n] if n in own else pa.nulls(len(counts), found.field(n).type) for n in found.names], found)

    numbers = "words bigint, some bigint, total double, level int, kinds bigint, n bigint, t bigint"
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    columns = [(name, kinds[of]) for name, of in (c.split() for c in numbers.split(", "))]
    dealt = _dealt(given, buckets, TEXT_BYTES).repartition(2 * buckets, "bucket")
    back = dealt.groupBy("bucket").applyInArrow(counted, dealt.schema).repartition(2 * buckets, "slice")
    sums = keep_table(back.groupBy("slice").applyInArrow(scored, f"key {kind}, {numbers}"))
    # One row per level.
    totals = sums.filter("level IS NOT NULL").groupBy("level").agg(*[F.sum(c).alias(c) for c in ("kinds", "n", "t")]).collect()
    size = {r["level"]: (r["kinds"], r["n"], r["t"]) for r in totals}

    def models(level: int) -> Column:
        """What the models' sizes add to each log-ratio of a level."""
        kinds, n, t = size.get(level, (0, 0, 0))
        return F.lit(float(np.log(t + alpha * kinds) - np.log(n + alpha * kinds)) if kinds else 0.0)

    return (
        sums.filter("level IS NULL")
        .groupBy(F.col("key").alias(key))
        .agg(F.sum("words").alias("n_tokens"), F.sum("some").alias("_some"), F.sum("total").alias("_total"))
        # The weights of a text of n words sum up to 2 - n for words and n - 1 for bigrams.
        .withColumn("_total", F.col("_total") + (2 * F.col("_some") - F.col("n_tokens")) * models(1) + (F.col("n_tokens") - F.col("_some")) * models(2))
        .select(key, "n_tokens", F.when(F.col("n_tokens") > 0, F.round(F.col("_total") / F.col("n_tokens"), 9)).alias("loss_difference"))
    )
