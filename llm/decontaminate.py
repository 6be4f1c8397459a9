"""Benchmark decontamination: an FM-index per training shard, searched for the test phrases.

A shard is a run of documents of one task (about ``SHARD_BYTES``). Its words are mapped to the ids of
the benchmark's vocabulary; runs of known words shorter than the shortest phrase hold no phrase and are
left out. Over the rest an FM-index is built: phrases are found by backward search through wavelet
ranks, located by sampled suffix positions, and their word spans merged per document.

Documents are read once and not shuffled. The benchmark is the query set: it is cut into blocks of at
most about ``BLOCK_BYTES`` of text, each sent to the tasks, so a larger benchmark takes more passes
over a shard, not more memory. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.fm_index import FMIndex
from llm.shared import keep_table, map_batches, send
from llm.words import LETTERS, Words, buffers, hashes, replaced, slices, split

SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20


@dataclass
class Phrases:
    """Windows of one block of the benchmark, as rows of word ids (1, 2, ...)."""

    vocabulary: np.ndarray
    likely: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_of: np.ndarray
    item_from: np.ndarray

    @property
    def least(self) -> int:
        return int(self.lengths.min(initial=2**31))

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Id of each word hash, 0 for words that are in no phrase."""
        out = np.zeros(len(words), np.int32)
        maybe = np.flatnonzero(self.likely[(words >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, words[maybe])
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == words[maybe]
        out[maybe[known]] = place[known] + 1
        return out


def compile_phrases(rows: list[tuple[str, str]], size: int) -> Phrases:
    """Windows of ``size`` words; a text of fewer words, but not none, is one window."""
    rows = sorted(rows)
    items = sorted({item for item, _ in rows})
    number = {item: i for i, item in enumerate(items)}
    data, offsets = buffers(pa.array([text for _, text in rows], pa.string()))
    words = split(data, offsets, LETTERS)
    found = hashes(data, words.starts, words.ends)
    vocabulary = np.unique(found)
    likely = np.zeros(1 << 20, bool)
    likely[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    ids = np.searchsorted(vocabulary, found) + 1
    pairs = set()
    for i, (item, _) in enumerate(rows):
        own = ids[words.of[i] : words.of[i + 1]].tolist()
        for at in range(max(1, len(own) - size + 1) if own else 0):
            pairs.add((tuple(own[at : at + size]), number[item]))
    ordered = sorted(pairs)
    windows = sorted({w for w, _ in pairs})
    place = {w: i for i, w in enumerate(windows)}
    table = np.zeros((len(windows), size), np.int64)
    for i, w in enumerate(windows):
        table[i, : len(w)] = w
    counts = np.bincount([place[w] for w, _ in ordered], minlength=len(windows)).astype(np.int64)
    return Phrases(
        vocabulary,
        likely,
        table,
        np.array([len(w) for w in windows], np.int64),
        items,
        np.array([i for _, i in ordered], np.int64),
        np.concatenate([[0], np.cumsum(counts)]),
    )


def occurrences(found: np.ndarray, of: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard, none across documents."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.windows) or not len(found):
        return nothing
    ids = phrases.ids(found)
    inside = ids > 0
    first_word = np.zeros(len(ids) + 1, bool)
    first_word[of] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first_word[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return nothing
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first_word[1:-1]
    ends = np.flatnonzero(end) + 1
    long = ends - starts >= phrases.least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return nothing
    sizes = ends - starts
    # Each run is followed by one separator.
    word_at = np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1) + np.repeat(starts, sizes + 1)
    sequence = ids[np.minimum(word_at, len(ids) - 1)]
    sequence[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    phrase, position = index.locate(*index.search(phrases.windows, phrases.lengths))
    return phrase, word_at[position]


def merged_hits(words: Words, phrase: np.ndarray, at: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Whether each word lies in an occurrence."""
    change = np.zeros(len(words.starts) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[phrase], -1)
    return np.cumsum(change[:-1]) > 0


def _spans(hit: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hit words within documents: first word, word after the last, document."""
    first_word = np.zeros(len(hit) + 1, bool)
    first_word[of] = True
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | first_word[1:-1]
    end[:-1] &= ~hit[1:] | first_word[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(of, starts, "right") - 1


SPANS = "array<struct<first_word: bigint, end_word: bigint, start: bigint, end: bigint>>"


def _scan(frame: DataFrame, phrases: Phrases, last: bool) -> DataFrame:
    """One block over the shards. Adds to ``items`` and ``spans`` what earlier blocks have found."""
    sent = send(frame.sparkSession, phrases)
    columns = "key string, n_words bigint, n_hit bigint, items array<string>, spans " + SPANS
    if not last:
        columns += ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent()
        for batch in batches:
            text = batch.column("text")
            for first, end, data, offsets in slices(text, SHARD_BYTES):
                words = split(data, offsets, LETTERS)
                found = hashes(data, words.starts, words.ends)
                phrase, at = occurrences(found, words.of, block)
                hit = merged_hits(words, phrase, at, block)
                before_items = batch.column("items").slice(first, end - first).to_pylist()
                before_spans = batch.column("spans").slice(first, end - first).to_pylist()
                for i, spans in enumerate(before_spans):
                    for span in spans:
                        hit[words.of[i] + span["first_word"] : words.of[i] + span["end_word"]] = True
                # (document, item) pairs: every phrase stands for one or more items.
                count = block.item_from[phrase + 1] - block.item_from[phrase]
                each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block.item_from[phrase], count)
                row = np.searchsorted(words.of, np.repeat(at, count), "right") - 1
                items: list[list[str]] = [list(x) for x in before_items]
                for code in np.unique(row * max(1, len(block.items)) + block.item_of[each]).tolist():
                    items[code // len(block.items)].append(block.items[code % len(block.items)])
                spans: list[list[dict]] = [[] for _ in items]
                letters: dict[int, np.ndarray] = {}
                for a, b, i in zip(*(x.tolist() for x in _spans(hit, words.of)), strict=True):
                    if i not in letters:
                        own = data[offsets[i] : offsets[i + 1]]
                        letters = {i: np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])}
                    spans[i].append(
                        {
                            "first_word": a - int(words.of[i]),
                            "end_word": b - int(words.of[i]),
                            "start": int(letters[i][words.starts[a] - offsets[i]]),
                            "end": int(letters[i][words.ends[b - 1] - offsets[i]]),
                        }
                    )
                total = np.concatenate([[0], np.cumsum(hit)])
                out = [
                    batch.column("key").slice(first, end - first),
                    pa.array(np.diff(words.of)),
                    pa.array(total[words.of[1:]] - total[words.of[:-1]]),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "start", "end")]))),
                ]
                names = ["key", "n_words", "n_hit", "items", "spans"]
                if not last:
                    out.append(text.slice(first, end - first))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(out, names)

    return frame.select("key", "text", "items", "spans").mapInArrow(run, columns)


def blocks_of(benchmark: DataFrame, text: str, key: str, size: int, most: int = BLOCK_BYTES) -> list[Phrases]:
    """The benchmark in blocks of about ``most`` bytes, by a hash of the item."""
    rows = benchmark.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text")).dropna()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / most))
    return [
        compile_phrases([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()], size)
        for b in range(blocks)
    ]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    size: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Find the ``size``-word windows of benchmark items in documents.

    Returns per row of ``docs``: key, n_words, n_hit (words inside any occurrence), items (ids of the
    items with an occurring window, as strings in order), spans (merged removal spans: word and code
    point offsets). Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    Null and empty texts have no words. Items with a null id or text are ignored; repeated items count
    once. An empty benchmark gives rows without hits. Keys may be null or repeat; each row stands for
    itself. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType
    frame = docs.select(
        F.col(f"`{key}`").cast("string").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.expr(f"cast(array() as {SPANS})").alias("spans"),
    )
    blocks = blocks_of(benchmark, item_text, item_key, size, block_bytes)
    for i, block in enumerate(blocks):
        frame = _scan(frame, block, i == len(blocks) - 1)
    return frame.select(F.col("key").cast(kind).alias(key), "n_words", "n_hit", "items", "spans")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (code points); a line break stands where one was."""
    parts, last = [], 0
    for start, end in spans:
        parts.append(text[last:start])
        last = end
    parts.append(text[last:])
    return "\n".join(parts)


def cut_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_key: str = "item_id",
    size: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with every benchmark passage cut out of ``text``; a document of which no word is left
    goes. Cutting joins what stood around a passage, so a changed text is searched again until
    nothing of any block is found. Rows without hits, and all other columns, stay as they are. Bytes of a cut text that
    are not UTF-8 become U+FFFD."""
    blocks = blocks_of(benchmark, item_text, item_key, size, block_bytes)
    if len(blocks) == 1:
        return _cut(docs, blocks[0], text)
    frame = docs
    while True:
        for block in blocks:
            frame = keep_table(_cut(frame, block, text))
        found = decontaminate(frame, benchmark, text, text, item_text, item_key, size, block_bytes)
        if found.filter("n_hit > 0").isEmpty():
            return frame


def _cut(docs: DataFrame, phrases: Phrases, text: str) -> DataFrame:
    sent = send(docs.sparkSession, phrases)
    place = docs.columns.index(text)

    def cleaned(value: str, phrases: Phrases) -> str:
        while True:
            data, offsets = buffers(pa.array([value], pa.string()))
            words = split(data, offsets, LETTERS)
            hit = merged_hits(words, *occurrences(hashes(data, words.starts, words.ends), words.of, phrases), phrases)
            if not hit.any():
                return value if len(hit) else ""
            raw = data.tobytes()
            letter = lambda b: len(raw[:b].decode())
            value = remove_spans(value, [(letter(words.starts[a]), letter(words.ends[b - 1])) for a, b, _ in zip(*_spans(hit, words.of), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent()
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(place), SHARD_BYTES):
                part = batch.slice(first, end - first)
                words = split(data, offsets, LETTERS)
                _, at = occurrences(hashes(data, words.starts, words.ends), words.of, phrases)
                rows = np.unique(np.searchsorted(words.of, at, "right") - 1).tolist()
                if rows:
                    left = {i: cleaned(data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"), phrases) for i in rows}
                    gone = np.zeros(end - first, bool)
                    gone[[i for i, value in left.items() if not value]] = True
                    part = part.set_column(place, part.schema.field(place), replaced(part.column(place), left))
                    part = part.filter(pa.array(~gone))
                yield part

    return map_batches(docs, run)
