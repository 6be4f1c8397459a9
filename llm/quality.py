"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much text rejected.

A line fails if it is boilerplate (it has a phrase of BOILERPLATE and is brief or mostly made of it), navigation (short items between separators),
mostly symbols, or short without closing punctuation. All work on a document happens in the task that reads
it; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import EXACT, NOT_SPACE, hashes, mix, shingles, slices, split

#: Phrases of lines that are about the page and not its content.
BOILERPLATE = re.compile(
    "\\b(?:lorem ipsum|licensed under|all rights reserved|terms of (?:use|services?)|privacy policy|cookie policy|"
    "uses? cookies|enable javascript|powered by|subscribe to our|sign in|log in to)\\b|\\bcopyright (?:\\(c\\)|©)",
    re.I,
)
SEPARATORS = re.compile(r"\s[|>»·•/]\s")
CLOSING = tuple(".!?…:;\"'”’»)]。！？")
SHORT = 4
#: Words of a line that a phrase of BOILERPLATE fails whatever else it says.
BRIEF = 25
MOST_SYMBOLS = 0.1
MOST_LOST = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def line_verdict(line: str) -> str | None:
    """Why a line is removed, or None; lines without words stay."""
    words = WORDS.findall(line)
    if not words:
        return None
    phrases = sum(len(w) for found in BOILERPLATE.finditer(line) for w in WORDS.findall(found[0]))
    if phrases and (len(words) <= BRIEF or 2 * phrases > sum(map(len, words))):
        return "boilerplate"
    parts = SEPARATORS.split(line.strip())
    if len(parts) >= 3 and sum(len(WORDS.findall(p)) for p in parts) <= 3 * len(parts):
        return "navigation"
    if len(SYMBOLS.findall(line)) > MOST_SYMBOLS * sum(map(len, words)):
        return "symbols"
    if len(words) < SHORT and not words[-1].endswith(CLOSING):
        return "punctuation"
    return None


def clean(text: str) -> tuple[str, float]:
    """The text of the lines that pass, and the share of its word characters that went with the others."""
    passed, lost, total = [], 0, 0
    for line in text.split("\n"):
        size = sum(map(len, WORDS.findall(line)))
        total += size
        if line_verdict(line):
            lost += size
        else:
            passed.append(line)
    return "\n".join(passed), lost / total if total else 0.0


def _row_keys(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(values ^ mix(rows.astype(np.uint64) + np.uint64(1)))


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a slice."""
    n = len(offsets) - 1
    words = split(data, offsets, NOT_SPACE)
    rows = words.rows

    def within(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    inside = NOT_SPACE[data]
    # Lines end at \n and at the end of their row; those without a word do not count.
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.unique(np.concatenate([breaks[:-1] + 1, offsets[:-1]]))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], offsets[line_row + 1])
    with_word = np.concatenate([[0], np.cumsum(inside)])
    some = with_word[ends] > with_word[starts]
    starts, ends, line_row = starts[some], ends[some], line_row[some]
    keys = _row_keys(hashes(data, starts, ends, EXACT) + (ends - starts).astype(np.uint64), line_row)
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), np.int64)
    again[first] = 0
    grams, at = shingles(hashes(data, words.starts, words.ends, EXACT), words.of, 3)
    _, which, count = np.unique(_row_keys(grams, rows[at]), return_inverse=True, return_counts=True)
    common = at[count[which] > 1] if len(at) else at
    repeat = np.zeros(len(rows) + 3, bool)
    for k in range(3):
        repeat[common + k] = True
    return {
        "n_words": np.diff(words.of),
        "word_chars": within(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": within(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row, again, n).astype(np.int64),
        "n_repeat_words": within(repeat[: len(rows)], words.of),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def clean_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", most_lost: float = MOST_LOST) -> DataFrame:
    """Per row of ``docs``: key, the measures, lost (share of word characters in failing lines), cleaned (the
    text of the other lines), base_failed (fewer than 50 words, or more than half of them repeated), kept.

    Null, empty and blank texts have no words and are not kept; cleaned is then empty. In lines, bytes that
    are not UTF-8 are U+FFFD. Keys may be null or
    repeat; each row stands for itself. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                found = measures(data, offsets)
                raw = data.tobytes()
                results = [clean(raw[a:b].decode(errors="replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        *(pa.array(found[m].astype(np.int64)) for m in MEASURES),
                        pa.array([lost for _, lost in results], pa.float64()),
                        pa.array([value for value, _ in results], pa.string()),
                    ],
                    ["key", *MEASURES, "lost", "cleaned"],
                )

    kind = docs.schema[key].dataType.simpleString()
    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    return (
        docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, f"key {kind}, {fields}, lost double, cleaned string")
        .withColumn("base_failed", F.expr(failed))
        .withColumn("kept", F.expr(f"NOT base_failed AND lost <= {most_lost}"))
        .withColumnRenamed("key", key)
    )
