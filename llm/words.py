"""Words of text columns as numpy arrays, straight from Arrow buffers.

Operators of this package read texts in ``mapInArrow`` tasks. An Arrow string column is one byte
buffer with offsets, so words are found with a byte table and hashed with prefix sums, without one
Python object per word. Work goes through ``slices``: runs of rows of at most ``SLICE_BYTES`` bytes,
so memory stays bounded whatever the size of an Arrow batch; a longer text is a slice of its own.

Null texts are read as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _table(excluded: list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[excluded] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _table([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, read after lower-casing A-Z
LETTERS = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_random = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWERED = _VALUES.copy()
LOWERED[0x41:0x5B] = _VALUES[0x61:0x7B]
EXACT = _VALUES
ODD = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers = np.full(n, BASE)
        _inverses = np.full(n, INVERSE)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def replaced(column: pa.Array, changed: dict[int, str]) -> pa.Array:
    """A string column with other texts in some rows. Bytes of the others are not looked at: they need not be UTF-8."""
    wide = pa.types.is_large_string(column.type)
    kind = pa.large_binary() if wide else pa.binary()
    values = column.view(kind).to_pylist()
    for i, value in changed.items():
        values[i] = value.encode()
    return pa.array(values, kind).view(column.type)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of at most ``most`` bytes."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """Words of a slice: byte spans, and ``of`` with the first word of each row (rows + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of the bytes in ``table``, none across rows."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWERED) -> np.ndarray:
    """64-bit hash of each byte span; with LOWERED A-Z count as a-z."""
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(values, data, out=sums[1:], mode="clip")
    sums[1:] *= powers[:-1]
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def shingles(words: np.ndarray, of: np.ndarray, size: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a row, and the index of its first word.

    With ``whole_if_short`` a row of fewer words, but not none, is one run.
    """
    n = len(words)
    counts = np.diff(of)
    room = np.repeat(of[1:], counts) - np.arange(n)
    at = np.flatnonzero(room >= size)
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total += words[at + k] * ODD[k]
    found = mix(total)
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, row in enumerate(short):
                run = words[of[row] : of[row + 1]]
                extra[i] = np.uint64(len(run)) + (run * ODD[: len(run)]).sum(dtype=np.uint64)
            at = np.concatenate([at, of[short]])
            found = np.concatenate([found, mix(extra)])
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order]
    return found, at
