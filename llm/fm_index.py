"""FM-index over integer sequences: suffix order, wavelet ranks, sampled positions. All in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros separate runs: each is a smallest symbol of its own (in
    text order), so comparisons end at the next one. The sequence must end in a zero.

    A suffix whose place is settled is not sorted again.
    """
    n = len(sequence)
    separators = np.flatnonzero(sequence == 0)
    symbol = sequence.astype(np.int64) + len(separators)
    symbol[separators] = np.arange(len(separators))
    order = np.argsort(symbol, kind="stable")
    ordered = symbol[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    todo = order[np.repeat(sizes > 1, sizes)]
    depth = 1
    while len(todo):
        key = (rank[todo] << 32) | rank[todo + depth]
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        place = np.arange(len(todo))
        group = np.concatenate([[True], (key[1:] >> 32) != (key[:-1] >> 32)])
        part = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(group, place, 0))
        own = np.maximum.accumulate(np.where(part, place, 0))
        rank[todo] = (key >> 32) + own - first
        starts = np.flatnonzero(part)
        sizes = np.diff(np.append(starts, len(todo)))
        todo = todo[np.repeat(sizes > 1, sizes)]
        depth *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


class Wavelet:
    """Ranks and symbols of a sequence, one bit level at a time from the highest."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest = sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> shift) & 1
            ones = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(rest) - int(ones[-1])))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            before = ones[place]
            place = np.where((symbol >> shift) & 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, place) - self.base[symbol]

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(place), np.int64)
        for shift, ones, zeros in self.levels:
            before = ones[place]
            bit = ones[place + 1] - before
            symbol |= bit.astype(np.int64) << shift
            place = np.where(bit, zeros + before, place - before)
        return symbol, place - self.base[symbol]


class FMIndex:
    """Occurrences of phrases in a sequence of symbols 1 .. symbols - 1; zeros separate its runs."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 8):
        suffixes = suffix_order(sequence)
        last = sequence[suffixes - 1].astype(np.int64)
        last[suffixes == 0] = 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.ranks = Wavelet(last, symbols)
        # Every sample-th position keeps its place in the text, and so does the first of each run.
        self.sampled = (suffixes % sample == 0) | (last == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of ids, padded on the right), by backward search."""
        at = np.arange(len(phrases))
        symbol = phrases[at, lengths - 1]
        low, high = self.before[symbol], self.before[symbol + 1]
        for k in range(1, int(lengths.max(initial=0))):
            live = np.flatnonzero((low < high) & (lengths > k))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - k]
            low[live] = self.before[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every row of the ranges: step back to the next sampled position."""
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        position = np.zeros(len(row), np.int64)
        open_, steps = np.arange(len(row)), 0
        while len(open_):
            done = self.sampled[row]
            position[open_[done]] = self.positions[self.sample_no[row[done]]] + steps
            open_, row = open_[~done], row[~done]
            symbol, rank = self.ranks.symbol_and_rank(row)
            row = self.before[symbol] + rank
            steps += 1
        return phrase, position
