"""Phrase collocations by Toivonen's mining: a sample proposes, full passes decide.

Single words are counted in full; their totals are parts of every score. For longer phrases

1. a sample of the documents proposes the phrases that reach a lowered count in it;
2. one pass over all documents counts these and their negative border exactly: every occurring phrase
   whose two longest parts are proposed (words: frequent), whether the sample proposed it or not;
3. a border phrase that turns out to be frequent is a failure of the sample: phrases longer than it were
   no candidates. A further pass counts those, and so on until no pass finds new failures.

Tasks learn from bit tables whether a part is proposed or frequent. A table has a fixed greatest
size and may say yes too often, which only adds counted phrases; what is counted is counted exactly,
so results do not depend on the sample or on the tables. Nothing else about the corpus reaches the driver.

A word is known by a 64-bit hash of its language and letters: among a billion different words two
share one with a chance of 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.shared import keep_table
from llm.words import ODD, _table, buffers, hashes, mix, slices, split

BREAKS = [*range(0x0A, 0x0E), *b".,;:!?"]
#: Words end at blanks and tabs, pieces at the bytes of BREAKS.
IN_WORD = _table([0x20, 0x09, *BREAKS])
IS_BREAK = ~_table(BREAKS)
SLICE = 1 << 20
#: Bits of a table for one entry, and of any table.
BITS_EACH, MOST_BITS = 16, 27
#: Parts into which a language's candidates are dealt before they are ranked.
DEALT = 64


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as in ``slices``; a longer text is cut at ends of pieces, which no phrase crosses."""
    for first, last, data, offsets in slices(batch.column("text"), SLICE):
        if len(data) <= SLICE:
            yield first, last, data, offsets
            continue
        ends = np.flatnonzero(IS_BREAK[data]) + 1
        start = 0
        while start < len(data):
            at = int(np.searchsorted(ends, start + SLICE, "right")) - 1
            if at < 0 or ends[at] <= start:
                at += 1
            end = int(ends[at]) if at < len(ends) else len(data)
            yield first, last, data[start:end], np.array([0, end - start])
            start = end


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(words, keys, whether a word follows the one before it in a piece, languages, bytes) per slice."""
    tongue = batch.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)
    for first, last, data, offsets in _slices(batch):
        words = split(data, offsets, IN_WORD)
        if not len(words.starts):
            continue
        keys = mix(hashes(data, words.starts, words.ends) + (tongue[first:last] * ODD[63])[words.rows])
        piece = np.cumsum(IS_BREAK[data], dtype=np.int32)[words.starts]
        follows = np.zeros(len(keys), bool)
        follows[1:] = piece[1:] == piece[:-1]
        follows[words.of[:-1][np.diff(words.of) > 0]] = False
        yield words, keys, follows, batch.column("lang").slice(first, last - first), data


def _has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys >> np.uint64(64 - int(table[0]))
    return (table[1 + (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _after(flags: np.ndarray) -> np.ndarray:
    """The flag of the word before."""
    out = np.zeros(len(flags), bool)
    out[1:] = flags[:-1]
    return out


def _phrase_key(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(parts[0]), np.uint64(len(parts)))
    for k, part in enumerate(parts):
        total += part * ODD[k]
    return mix(total)


def _bit_table(rows: DataFrame, length: int) -> np.ndarray:
    """The phrases of ``rows`` (w1, w2, …) as set bits; the first entry is the binary logarithm of the size."""
    size = min(MOST_BITS, max(10, math.ceil(math.log2(BITS_EACH * max(1, rows.count())))))
    names = [f"w{k + 1}" for k in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]
            at = (parts[0] if length == 1 else _phrase_key(parts)) >> np.uint64(64 - size)
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"]
            )

    set_bits = rows.select(*names).mapInArrow(run, "place bigint, bits bigint")
    found = set_bits.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 + max(1, (1 << size) >> 6), np.uint64)
    table[0] = size
    table[1 + found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _count_words(texts: DataFrame) -> DataFrame:
    """(lang, w1, word, n) per distinct word, and per language a row of null word with the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, keys, _, langs, data in _words(batch):
                _, at, n = np.unique(keys, return_index=True, return_counts=True)
                raw = data.tobytes().lower()
                spans = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
                rows = np.flatnonzero(np.diff(words.of))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([langs.take(pa.array(words.rows[at])), langs.take(pa.array(rows))]),
                        pa.concat_arrays([pa.array(keys[at].view(np.int64)), pa.nulls(len(rows), pa.int64())]),
                        pa.concat_arrays([pa.array([raw[a:b] for a, b in spans], pa.binary()), pa.nulls(len(rows), pa.binary())]),
                        pa.array(np.concatenate([n, np.diff(words.of)[rows]])),
                    ],
                    ["lang", "w1", "word", "n"],
                )

    counted = texts.mapInArrow(run, "lang string, w1 bigint, word binary, n bigint")
    return counted.groupBy("lang", "w1", "word").agg(F.sum("n").alias("n"))


def _count_phrases(texts: DataFrame, passes: list[list[np.ndarray]], longest: int) -> DataFrame:
    """(lang, w1 … , n) of the phrases whose two longest parts are in the tables of the last pass, but
    not both in those of an earlier one: these are counted already. ``passes[p][m - 1]`` is the table of the
    phrases of ``m`` words."""
    sent = texts.sparkSession.sparkContext.broadcast(passes)
    names = [f"w{k + 1}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = sent.value
        for batch in batches:
            for words, keys, follows, langs, _ in _words(batch):
                fits, own, rows = np.ones(len(keys), bool), keys, words.rows
                for m in range(2, longest + 1):
                    # ``own``: the phrases of m - 1 words that end at each word, where one ``fits`` in its piece.
                    known = [fits & _has(tables[m - 2], own) for tables in passes]
                    fits = _after(fits) & follows
                    wanted = fits & known[-1] & _after(known[-1])
                    for earlier in known[:-1]:
                        wanted &= ~(earlier & _after(earlier))
                    own = np.zeros(len(keys), np.uint64)
                    at = np.flatnonzero(fits if m < longest else wanted)
                    own[at] = _phrase_key([keys[at - m + 1 + k] for k in range(m)])
                    at = np.flatnonzero(wanted)
                    _, first, n = np.unique(own[at], return_index=True, return_counts=True)
                    at = at[first]
                    if len(at):
                        parts = [pa.array(keys[at - m + 1 + k].view(np.int64)) for k in range(m)]
                        parts += [pa.nulls(len(at), pa.int64()) for _ in range(longest - m)]
                        yield pa.RecordBatch.from_arrays(
                            [langs.take(pa.array(rows[at])), *parts, pa.array(n)], ["lang", *names, "n"]
                        )

    schema = "lang string, " + ", ".join(f"{n} bigint" for n in names) + ", n bigint"
    return texts.mapInArrow(run, schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _of_length(phrases: DataFrame, m: int, longest: int) -> DataFrame:
    """Phrases of exactly ``m`` words."""
    found = phrases.filter(F.col(f"w{m}").isNotNull())
    return found if m == longest else found.filter(F.col(f"w{m + 1}").isNull())


def _missed(rows: DataFrame, tables: list[np.ndarray], m: int) -> bool:
    """Whether a phrase of ``m`` words is missing in the tables: the sample has failed on it."""
    sent = rows.sparkSession.sparkContext.broadcast(tables[m - 1])
    names = [f"w{k + 1}" for k in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]
            yield batch.filter(pa.array(~_has(sent.value, _phrase_key(parts))))

    return not rows.select(*names).mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).isEmpty()


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): what occurs at least ``least`` times in its language, with exact counts.

    ``words`` has (lang, w1, word, n) and per language a row of null word with the number of all words.
    ``phrases`` has (lang, w1 … w``longest``, n); keys beyond a phrase's length are null. The sample is one
    row in ``share``; a phrase is proposed if it has three quarters of the count expected there, twice at least.
    """
    own = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    texts = docs.select(own.alias("lang"), F.xxhash64(own).alias("tongue"), F.col(f"`{text}`").alias("text")).filter(
        F.octet_length("text") > 0
    )
    words = keep_table(_count_words(texts).filter((F.col("n") >= least) | F.col("word").isNull()))
    first = _bit_table(words.filter(F.col("word").isNotNull()), 1)
    # Numbered rows: copies of a text are sampled one by one.
    sample = texts.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(share)) == 0)
    tables = [first]
    for m in range(2, longest):
        reached = max(2, least * 3 // (4 * share))
        counted = _of_length(_count_phrases(sample, [tables], m), m, m).filter(F.col("n") >= reached)
        tables = [*tables, _bit_table(keep_table(counted.select(*[f"w{k + 1}" for k in range(m)])), m)]
    passes = [tables]
    phrases = keep_table(_count_phrases(texts, passes, longest).filter(F.col("n") >= least))
    while any(_missed(_of_length(phrases, m, longest), passes[-1], m) for m in range(2, longest)):
        frequent = [_bit_table(_of_length(phrases, m, longest), m) for m in range(2, longest)]
        passes = [*passes, [first, *frequent]]
        more = _count_phrases(texts, passes, longest).filter(F.col("n") >= least)
        phrases = keep_table(phrases.unionByName(more))
    return words, phrases


def _sequence(longest: int) -> Column:
    """The keys of a phrase as an array."""
    return F.filter(F.array(*[F.col(f"w{k + 1}") for k in range(longest)]), lambda w: w.isNotNull())


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    cover: int = 50,
    share: int = 4,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language by score.

    Returns lang, rank, phrase, a (occurrences), l and r (of the parts at the lowest-scoring cut), n (words of
    the language) and score, floor(1000000 a² / (l r)). A phrase inside a longer frequent one with at least
    ``cover`` percent of its occurrences is dropped. Order: score, then a, both descending, then phrase.

    Texts are read with A-Z lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at blanks and
    tabs. A null language is ``und``, null and empty texts have no words, every row counts for itself, other columns
    are ignored. An empty table, or one without a frequent phrase, gives no rows. Exact below 10^15 occurrences.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    words, phrases = frequent_phrases(docs, text, lang, longest, least, share)
    candidates = phrases.select("lang", _sequence(longest).alias("keys"), F.col("n").alias("a"))
    single = words.filter(F.col("word").isNotNull())
    parts = candidates.select("lang", "keys", F.col("a").alias("n")).unionByName(
        single.select("lang", F.array("w1").alias("keys"), "n")
    )

    def counted(name: str, count: str) -> DataFrame:
        return parts.select(F.col("lang"), F.col("keys").alias(name), F.col("n").alias(count))

    size = F.size("keys")
    cuts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .withColumn("left", F.slice("keys", F.lit(1), F.col("k")))
        .withColumn("right", F.slice("keys", F.col("k") + 1, size - F.col("k")))
        .join(counted("left", "l"), ["lang", "left"])
        .join(counted("right", "r"), ["lang", "right"])
    )
    # As decimals of 38 digits; `div` gives the floor, as nothing is negative.
    ratio = "(1000000BD * cast(a AS decimal(16,0)) * a) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    scored = (
        cuts.withColumn("cut", F.struct(F.expr(ratio).alias("score"), "k", "l", "r"))
        .groupBy("lang", "keys", "a")
        .agg(F.min("cut").alias("cut"))
        .select("lang", "keys", "a", "cut.l", "cut.r", "cut.score")
    )
    if longest > 2:
        inner = (
            candidates.filter(size > 2)
            .withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
            .withColumn("from", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
            .groupBy("lang", F.slice("keys", F.col("from"), F.col("m")).alias("keys"))
            .agg(F.max("a").alias("longer"))
        )
        covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(cover) * F.col("a"), F.lit(False))
        scored = scored.join(inner, ["lang", "keys"], "left").filter(~covered).drop("longer")
    # First without the words, ties kept; then with them.
    best = [F.col("score").desc(), F.col("a").desc()]
    dealt = F.pmod(F.xxhash64("keys"), F.lit(DEALT))
    near = (
        scored.withColumn("part", dealt)
        .withColumn("rank", F.rank().over(Window.partitionBy("lang", "part").orderBy(*best)))
        .filter(F.col("rank") <= top)
    )
    spelled = (
        near.select("*", F.posexplode("keys").alias("place", "w1"))
        .join(single.select("lang", "w1", "word"), ["lang", "w1"])
        .groupBy("lang", "part", "keys", "a", "l", "r", "score")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelled"))
        .withColumn("phrase", F.array_join(F.transform("spelled", lambda s: s["word"].cast("string")), " "))
    )
    best.append(F.col("phrase").asc())
    first = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    ranked = first.filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    )
    totals = words.filter(F.col("word").isNull()).select("lang", "n")
    return (
        ranked.filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    )


def collocations_sql(least: int = 10, top: int = 2000, cover: int = 50) -> str:
    """DuckDB SQL of ``collocations`` on ``documents`` for phrases of up to three words."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, greatest(1, len(ws) - m + 2)), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(ws) >= m
), counted AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE m > 1 AND f >= {least}
), split_up AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, [lang, array_to_string(ws[1:k], ' ')] AS x, [lang, array_to_string(ws[k + 1:], ' ')] AS y
  FROM candidates JOIN (VALUES (1), (2)) AS ks(k) ON k < m
), parts AS MATERIALIZED (
  SELECT [lang, phrase] AS part, f FROM counted WHERE m < 3 AND f >= {least}
), with_left AS MATERIALIZED (
  SELECT s.*, p.f AS l FROM split_up s JOIN parts p ON p.part = s.x
), cuts AS MATERIALIZED (
  SELECT s.lang, phrase, a, k, l, p.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * p.f) AS score
  FROM with_left s JOIN parts p ON p.part = s.y
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM candidates WHERE m = 3)
  GROUP BY lang, part
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.part = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < {cover} * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= {top}
"""
