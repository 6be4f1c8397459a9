"""Runs of words of a text column as rows of 128-bit fingerprints, from Arrow batches.

Words are found with a byte table and hashed with prefix sums, all lengths of runs in one pass. With a set of known runs
only these become rows: the second half of a fingerprint is computed for those that the first half finds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: White space of more than one byte, see ``K.WHITESPACE``.
LONG_SPACES = {
    0xC2: [b"\xc2\x85", b"\xc2\xa0"],
    0xE1: [b"\xe1\x9a\x80"],
    0xE2: [bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\xe2\x81\x9f"],
    0xE3: [b"\xe3\x80\x80"],
}


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of bounded size; a null text is empty."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (rows + 1 entries)."""
    table = np.ones(256, bool)
    table[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    for lead, spaces in LONG_SPACES.items():
        at = np.flatnonzero(data == lead)
        for space in spaces if len(at) else ():
            here = at[at + len(space) <= len(data)]
            for k in range(1, len(space)):
                here = here[data[here + k] == space[k]]
            for k in range(len(space)):
                inside[here + k + 1] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


class _Hasher:
    """Hashes of words and of runs of them; two independent ones make a fingerprint."""

    def __init__(self, seed: int, longest: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rng.integers(1, 2**63, longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            powers, inverses = np.full((2, len(data) + 1), np.uint64(1))
            powers[1:], inverses[1:] = np.uint64(BASE), np.uint64(INVERSE)
            self.powers, self.inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def runs(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(at), np.uint64(n))
        for k in range(n):
            total += words[at + k] * self.places[k]
        return _mix(total)


def _filter_of(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A bit table of sorted keys by their leading digits, most of them unset, and the shift to these."""
    digits = min(24, max(10, int(len(keys)).bit_length() + 5))
    table, shift = np.zeros(1 << digits, bool), np.uint64(64 - digits)
    table[keys >> shift] = True
    return table, shift


def shingle_rows(df: DataFrame, text: str, sizes: Sequence[int], known: DataFrame | None = None) -> DataFrame:
    """Every run of n words of a text, for each n of ``sizes``: the other columns of ``df`` and (``_n``, ``_a``, ``_b``), one
    row per occurrence. Words are lower-cased and split at white space; a text of fewer words than n, and a null one, has none.

    With ``known(_n, _a, _b)``, which must be small, only the runs that are in it."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)])
    schema = schema.add("_n", T.IntegerType()).add("_a", T.LongType()).add("_b", T.LongType())
    sent = None
    if known is not None:
        prints = known.select("_n", "_a", "_b").toArrow()
        of_size, a, b = (prints.column(c).to_numpy() for c in ("_n", "_a", "_b"))
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
        order = np.lexsort((b, a))
        of_size, a, b = of_size[order], a[order], b[order]
        sent = df.sparkSession.sparkContext.broadcast({n: (a[of_size == n], b[of_size == n]) for n in sizes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _Hasher(11, max(sizes)), _Hasher(12, max(sizes))
        filters = {n: _filter_of(a) for n, (a, _) in sent.value.items()} if sent else {}
        for batch in batches:
            for first, data, offsets in _pieces(batch.column(len(keep))):
                starts, ends, of = _word_spans(data, offsets)
                left = one.words(data, starts, ends)
                right = None
                room = np.repeat(of[1:], np.diff(of)) - np.arange(len(starts))
                for n in sizes:
                    at = np.flatnonzero(room >= n)
                    a = one.runs(left, at, n)
                    if sent:
                        table, shift = filters[n]
                        maybe = np.flatnonzero(table[a >> shift])
                        at, a = at[maybe], a[maybe]
                    if not len(at):
                        continue
                    right = two.words(data, starts, ends) if right is None else right
                    b = two.runs(right, at, n)
                    if sent:
                        # Runs of equal first halves lie side by side; more than one is next to impossible.
                        keys, others = sent.value[n]
                        low, high = np.searchsorted(keys, a), np.searchsorted(keys, a, "right")
                        hit = np.zeros(len(a), bool)
                        for k in range(int((high - low).max())):
                            there = np.flatnonzero(low + k < high)
                            hit[there] |= others[low[there] + k] == b[there]
                        at, a, b = at[hit], a[hit], b[hit]
                    if len(at):
                        rows = pa.array(first + np.searchsorted(of, at, "right") - 1)
                        carried = [batch.column(i).take(rows) for i in range(len(keep))]
                        new = [np.full(len(at), n, np.int32), a.view(np.int64), b.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([*carried, *map(pa.array, new)], schema.names)

    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lower(F.col(f"`{text}`")).alias("_text"))
    return plain.mapInArrow(run, schema).toDF(*keep, "_n", "_a", "_b")
