"""Substring dedup by compact windows: passages that repeat, nearly or exactly, across documents.

1. The tokens of a document are its word shingles. For each of HASHES hash functions the Cartesian tree of the
   token hashes gives compact windows (l, c, r): every run of tokens within [l, r] that includes c has its
   min-hash at c. Only c is looked for, as the least of a run. Windows too short to hold a passage are left out, so a document has about
   2 n / passage of them per function.
2. Windows with the same (function, min-hash) share a signature. Each is first a candidate of the first and of
   the last one of its group: stars, so a group of n gives fewer than 2 n candidates. Windows whose min-hash then
   lies in no repeated passage of their document go on: they are held against all earlier members of the group that have ``SHARED`` of the
   rarest words of the runs of words around the min-hash (by the number of words that may differ in a passage, no other member
   can share one there). No group is capped.
3. Candidates of the same two documents and the same alignment are joined. Intervals are not counted over the hash
   functions: one shared signature makes a candidate, and the texts decide.
4. Both texts are compared word by word along the alignment, and along the best path that stays within ``BAND`` words of
   it, so words may be inserted and deleted; runs of at least ``passage`` words of which ``percent`` or more are
   equal are repeated passages of the later document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import keep_table, maybe_broadcast, small
from llm.words import NOT_SPACE, buffers, hashes, mix, shingles, slices, split

HASHES = 4
TOKEN_WORDS = 5
#: Words by which a path may leave the alignment, and the equal words that each inserted or deleted word outweighs.
BAND = 16
GAP = 2
#: Pairs of documents that are compared side by side, words that are laid out at once to look ahead, and words whose bands are.
TOGETHER = 1024
LAID = 1 << 17
#: Alignments of a pair of documents up to which a path is looked for along each.
MANY = 100
#: Bytes of texts that are read at once.
SLICE = 1 << 18
ROWS = 1 << 18
#: Rare pairs of words around the min-hash that two members of a group must share to be compared, and members that are looked through at once.
SHARED = 3
MEMBERS = 1 << 12


def window_centres(values: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the centres of the compact windows of ``least`` tokens or more; ``of`` has the first token of each row.

    A centre is the leftmost least of its window, so of some run of ``least`` tokens, and the least of any such run is a centre:
    the windows' ends need not be looked for. Minima of runs are put together from those of runs of half the length."""
    centre, length = np.arange(len(values)), 1

    def lesser(step: int) -> np.ndarray:
        left, right = centre[: max(0, len(centre) - step)], centre[step:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * length <= least:
        centre, length = lesser(length), 2 * length
    if length < least:
        centre = lesser(least - length)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))[: len(centre)]
    inside = np.arange(len(centre)) + least <= of[1:][row]
    row, centre = row[inside], centre[inside]
    # Centres do not go back as runs go on.
    new = np.concatenate([[True], (centre[1:] != centre[:-1])]) if len(centre) else np.zeros(0, bool)
    return row[new], centre[new]


def windows(docs: DataFrame, passage: int, count: int) -> DataFrame:
    """(id, value, at) of the windows of each row of ``docs(id, text)``: ``at`` has the words of the text in its upper half and
    the place of the centre, counted in words, in its lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(11, 11 + count, dtype=np.uint64))
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), SLICE):
                words = split(data, offsets, NOT_SPACE)
                tokens, at = shingles(hashes(data, words.starts, words.ends), words.of, TOKEN_WORDS)
                of, size = np.searchsorted(at, words.of), np.diff(words.of) << 32
                rows, found, places = [], [], []
                for seed in seeds:
                    values = mix(tokens ^ seed)
                    row, centre = window_centres(values, of, passage - TOKEN_WORDS + 1)
                    rows.append(row)
                    found.append(values[centre])
                    places.append(centre - of[row] + size[row])
                row = np.concatenate(rows)
                if len(row):
                    own = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(row)), *own], ["id", "value", "at"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, value bigint, at bigint")


def grouped(found: DataFrame, passage: int) -> DataFrame:
    """(star, id, other, place, flag) of the windows that share their signature with another document, after ``windows``.

    Stars: alignments with the first and the last of a group, as (later document, earlier one, shift, whether the later is shorter),
    where the texts overlap by ``passage`` words.
    Others: (document, signature, place, whether the window is to go on if its stars leave it unmatched). Groups of two have been compared
    in full, but for further positions of one. Of windows in a row, all of one word, some are enough: the others' alignments are
    within the band of theirs. The stars have met the first and the last window of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        ids, value, at = (np.concatenate([batch.column(n).to_numpy() for batch in given]) for n in range(3))
        del given
        order = np.argsort(value)
        same = value[order[1:]] == value[order[:-1]]
        some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        some = some[np.lexsort((at[some], ids[some], value[some]))]
        ids, value, at = ids[some], value[some], at[some]

        def bounds(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First and last row of the group of each row."""
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), bool), value[1:] != value[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(value)]]))
            return np.repeat(first, sizes), np.repeat(first + sizes - 1, sizes)

        low, high = bounds(value)
        some = ids[low] != ids[high]
        ids, value, at = ids[some], value[some], at[some]
        if not len(ids):
            return
        low, high = bounds(value)
        c, size, rank = at & 0xFFFFFFFF, at >> 32, np.arange(len(ids)) - low
        nothing = np.zeros(1, bool)
        follows = np.concatenate([nothing, (value[1:] == value[:-1]) & (ids[1:] == ids[:-1]) & (c[1:] == c[:-1] + 1)])
        inner = follows & np.concatenate([follows[1:], nothing]) & (c % BAND != 0)
        kept = (high - low > 1) & ~inner & (rank > 0)
        asks = (ids != ids[low]) & (rank > 1) & (rank < high - low)
        yield _rows(False, ids[kept], value[kept], c[kept], asks[kept])
        own, other = np.tile(np.arange(len(ids)), 2), np.concatenate([low, high])
        later, earlier = np.where(ids[own] > ids[other], own, other), np.where(ids[own] > ids[other], other, own)
        shift = c[later] - c[earlier]
        overlap = np.minimum(size[later], size[earlier] + shift + BAND) - np.maximum(0, shift - BAND)
        some = (ids[own] != ids[other]) & (overlap >= passage)
        later, earlier = later[some], earlier[some]
        pairs = ids[later], ids[earlier], shift[some]
        new = _distinct(*pairs)
        yield _rows(True, *(x[new] for x in pairs), (size[later] < size[earlier])[new])

    kind = "star boolean, id bigint, other bigint, place bigint, flag boolean"
    return found.repartition("value").mapInArrow(run, kind)


def _rows(star: bool, ids: np.ndarray, other: np.ndarray, place: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    columns = np.full(len(ids), star), ids, other, place, flag
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["star", "id", "other", "place", "flag"])


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Of equal rows one each, in order."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in columns], axis=0)
    return order[new]


def aligned(found: DataFrame) -> DataFrame:
    """(id, source, ahead, shifts) of alignments (id, other, place, flag), as in the stars of ``grouped``: a row for each two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if given:
            ids, source, shift, ahead = (np.concatenate([batch.column(n).to_numpy(zero_copy_only=False) for batch in given]) for n in range(4))
            some = _distinct(ids, source, shift)
            ids, source, shift, ahead = ids[some], source[some], shift[some], ahead[some]
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (source[1:] != source[:-1])]))
            for at in range(0, len(first), TOGETHER):
                part, end = first[at : at + TOGETHER], first[at + TOGETHER] if at + TOGETHER < len(first) else len(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.append(part, end) - part[0], pa.int32()), pa.array(shift[part[0] : end]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(source[part]), pa.array(ahead[part]), lists], ["id", "source", "ahead", "shifts"])

    columns = found.select("id", "other", "place", "flag").repartition(F.when(F.col("flag"), F.col("id")).otherwise(F.col("other")))
    return columns.mapInArrow(run, "id bigint, source bigint, ahead boolean, shifts array<bigint>")


def runs_in(same: np.ndarray, sizes: list[int], passage: int, percent: int, gap: int = 0) -> tuple[np.ndarray, ...]:
    """(row, first, last, first equal, after last equal) of maximal unions of ``passage``-word runs with ``percent`` or more equal words.
    ``same`` has the words of rows of these ``sizes``, the last ``gap`` of which do not count; places are counted in the row."""
    sums = np.zeros(len(same) + 1, np.int32)
    np.cumsum(same, out=sums[1:])
    good = np.flatnonzero(sums[passage:] - sums[:-passage] >= -(-percent * passage // 100))
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, good, "right")
    inside = good + passage <= ends[row] - gap
    good, row = good[inside], row[inside]
    new = np.concatenate([[True], (np.diff(good) > passage) | (np.diff(row) > 0)]) if len(good) else np.zeros(0, bool)
    first, last, row = good[new], good[np.roll(new, -1)] + passage, row[new]
    there = np.flatnonzero(same)
    places = first, last, there[np.searchsorted(there, first)], there[np.searchsorted(there, last) - 1] + 1
    return row, *(x - (ends - sizes)[row] for x in places)


def _inside(first: int, last: int, spans: list[tuple[int, int]]) -> bool:
    return any(x <= first and last <= y for x, y in spans)


def _unknown(first: int, last: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of [first, last) that are in none of the spans, which are in order."""
    out = []
    for x, y in spans:
        if x > first:
            out.append((first, min(x, last)))
        first = max(first, y)
        if first >= last:
            break
    return [(x, y) for x, y in [*out, (first, last)] if x < y]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, put together where they meet."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def prints_of(words: np.ndarray) -> np.ndarray:
    """A byte of the hash of each word; 0 and 1 stand for no word in ``_laid_runs``."""
    return np.maximum(words >> np.uint64(56), np.uint64(2)).astype(np.uint8)


def repeats_of(pairs: list[tuple[np.ndarray, np.ndarray, list[int]]], passage: int, percent: int) -> list[list[tuple[int, int]]]:
    """For each (b, a, shifts) the spans of ``b`` that repeat ``a`` along an alignment or on a path around it, merged. Alignments are
    looked at by a byte per word first and go on in turns for all pairs; what is known to be repeated is not compared again, as it
    could only be found again."""
    spans: list[list[tuple[int, int]]] = [[] for _ in pairs]
    prints = [(prints_of(b).tobytes(), prints_of(a).tobytes()) for b, a, _ in pairs]

    def runs(band: int, some: slice = slice(None)) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        open_ = []
        for n, (b, a, shifts) in enumerate(pairs):
            for shift in _apart(shifts) if band else shifts[some]:
                first, last = max(0, shift - band), min(len(b), len(a) + shift + band)
                if min(len(a), len(b)) >= passage and last - first >= passage and not _inside(first, last, spans[n]):
                    open_.append((n, shift))
        for at, found in _runs_of([(*prints[n], shift) for n, shift in open_], band, passage, percent):
            yield from ((*open_[at + row], run) for row, *run in zip(*(x.tolist() for x in found), strict=True))

    def add(numbers: list[int], found: list[list[tuple[int, int]]]) -> None:
        for n, more in zip(numbers, found, strict=True):
            if more:
                spans[n] = merged(spans[n] + more)

    # The first alignment of a pair often leaves nothing for the others.
    for some in (slice(0, 1), slice(1, None)):
        for chunk in _chunks([(n, shift, *run) for n, shift, run in runs(0, some)], lambda x: x[3] - x[2]):
            chunk = [x for x in chunk if not _inside(*x[4:], spans[x[0]])]
            texts = [(*pairs[n][:2], shift, first, last, spans[n]) for n, shift, first, last, *_ in chunk]
            add([n for n, *_ in chunk], _plain(texts, passage, percent))
    # Runs that reach beyond those along an alignment lie within ``passage`` words of what these leave.
    left: dict[int, list] = {}
    for n, shift, (first, last, low, high) in runs(BAND):
        parts = merged([(max(first, x - passage), min(last, y + passage)) for x, y in _unknown(low, high, spans[n])])
        left.setdefault(n, []).extend((shift, *part) for part in parts)
    while left:
        turn = []
        for n in list(left):
            taken, most = 0, max(1, len(pairs) // len(left))
            while left[n] and taken < most:
                shift, first, last = left[n].pop()
                if not _inside(first, last, spans[n]):
                    taken += 1
                    turn.append((n, shift, first, last))
            if not left[n]:
                del left[n]
        for chunk in _chunks(turn, lambda x: x[3] - x[2], ROWS):
            add([n for n, *_ in chunk], banded([(*pairs[n][:2], *where, spans[n]) for n, *where in chunk], passage, percent))
    return spans


def _apart(shifts: list[int]) -> list[int]:
    """``shifts``, but where they are more than ``MANY``, of four or more in a row only the ends and every eighth: texts that repeat a word have
    all from some number to another, and paths along those between are within the band of these."""
    if len(shifts) <= MANY:
        return shifts
    every = set(shifts)
    return [x for x in shifts if x % (BAND // 2) == 0 or not every.issuperset((x - 1, x + 1)) or every.isdisjoint((x - 2, x + 2))]


def _chunks(rows: list, cells: Callable, most: int = 0) -> Iterator[list]:
    """``rows`` in order, one or at most ``most`` cells (``LAID``, if 0) at a time."""
    at = 0
    while at < len(rows):
        until, total = at, 0
        while until < len(rows) and (until == at or total + cells(rows[until]) <= (most or LAID)):
            total += cells(rows[until])
            until += 1
        yield rows[at:until]
        at = until


def _plain(texts: list[tuple], passage: int, percent: int) -> list[list[tuple[int, int]]]:
    """For each (b, a, shift, from, to, known) the runs of ``b`` along the alignment of b[i] with a[i - shift]."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if texts:
        same = np.concatenate([b[first:last] == a[first - shift : last - shift] for b, a, shift, first, last, _ in texts])
        row, _, _, low, high = runs_in(same, [last - first for _, _, _, first, last, _ in texts], passage, percent)
        for n, x, y in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
            out[n].append((texts[n][3] + x, texts[n][3] + y))
    return out


def banded(texts: list[tuple], passage: int, percent: int) -> list[list[tuple[int, int]]]:
    """For each (b, a, shift, from, to, known) runs of ``b`` as in ``runs_in``, a word being equal if it is so on the best
    path within ``BAND`` words of the alignment of b[i] with a[i - shift]; those within one of the ``known`` spans are left out."""
    width = 2 * BAND + 1
    later, earlier, sizes = [], [], []
    for b, a, shift, begin, end, _ in texts:
        low, high = begin - shift - BAND, end - shift + BAND
        later += [b[begin:end], np.zeros(width - 1, np.uint64)]
        earlier += [np.zeros(max(0, -low), np.uint64), a[max(0, low) : high], np.zeros(max(0, high - len(a)), np.uint64)]
        sizes.append(end - begin + width - 1)
    # No word's hash is 0.
    b, a = np.concatenate([*later, np.zeros(0, np.uint64)]), np.concatenate([*earlier, np.zeros(width - 1, np.uint64)])
    equal = np.lib.stride_tricks.sliding_window_view(a, width) == np.where(b == 0, np.uint64(1), b)[:, None]
    # No path has more equal words than there are words with an equal one within the band.
    row, _, _, low, high = runs_in(equal.any(axis=1), sizes, passage, percent, width - 1)
    start, runs = np.concatenate([[0], np.cumsum(sizes)]).tolist(), []
    for number, x, y in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
        begin, known = texts[number][3], texts[number][5]
        if not _inside(begin + x, begin + y, known):
            runs.append((number, begin + x, equal[start[number] + x : start[number] + y]))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if runs:
        same = _paths([table for _, _, table in runs])
        row, _, _, low, high = runs_in(np.concatenate(same), [len(x) for x in same], passage, percent)
        for n, x, y in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
            number, first, _ = runs[n]
            out[number].append((first + x, first + y))
    return out


def _paths(equals: list[np.ndarray]) -> list[np.ndarray]:
    """For each table which rows are equal on the best monotone path: one column up skips a word of the other text, one column
    down a row. Tables go row by row side by side, the longest first, and drop out where they end."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(equals)
    order = sorted(range(len(equals)), key=lambda i: -len(equals[i]))
    while order:
        many = max(1, int(np.searchsorted(np.cumsum([len(equals[i]) for i in order]), ROWS, "right")))
        some, order = order[:many], order[many:]
        lengths = np.array([len(equals[i]) for i in some])
        rows, width = equals[some[0]].shape
        left = np.searchsorted(-lengths, -np.arange(rows))
        # Rows i of all tables come one after the other; tables are then the last axis, so that steps across the band go over all at once.
        start = np.concatenate([[0], np.cumsum(left)])
        equal = np.zeros((start[-1], width), bool)
        for n, i in enumerate(some):
            equal[start[: lengths[n]] + n] = equals[i]
        skipped, source = np.zeros(equal.size, bool), np.zeros(equal.size, np.int8)
        of = [slice(x, y) for x, y in zip(start.tolist(), start[1:].tolist())]
        cells = [(slice(width * x.start, width * x.stop), x.stop - x.start) for x in of]
        kind = np.int16 if rows + GAP * width < 1 << 15 else np.int32
        ramp, column = (GAP * np.arange(width, dtype=kind))[:, None], np.arange(width, dtype=np.int8)[:, None]
        score = np.zeros((width, len(some)), kind)
        # No score is below 0.
        skip = np.full((width, len(some)), -1, kind)
        for here, (cell, n) in zip(of, cells):
            along = score[:, :n] + equal[here].T
            np.subtract(score[1:, :n], kind(GAP), out=skip[:-1, :n])
            np.greater(skip[:, :n], along, out=skipped[cell].reshape(width, n))
            lifted = np.maximum(along, skip[:, :n]) + ramp
            best = np.maximum.accumulate(lifted, axis=0)
            np.maximum.accumulate(np.where(lifted == best, column, np.int8(0)), axis=0, out=source[cell].reshape(width, n))
            np.subtract(best, ramp, out=score[:, :n])
        same, w, every = np.zeros(start[-1], bool), np.argmax(score, axis=0), np.arange(len(some))
        for here, (cell, n) in zip(of[::-1], cells[::-1]):
            at = source[cell].reshape(width, n)[w[:n], every[:n]].astype(np.int64)
            over = skipped[cell].reshape(width, n)[at, every[:n]]
            same[here] = ~over & equal[here][every[:n], at]
            w[:n] = at + over
        for n, i in enumerate(some):
            out[i] = same[start[: lengths[n]] + n]
    return out


def _laid_runs(rows: list[tuple[bytes, bytes, int]], band: int, passage: int, percent: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, first equal, after last equal) of the runs of (later, earlier, shift), given a byte per word as in ``prints_of``,
    a word being equal if an equal one is within ``band`` words of the alignment.

    All are laid out one after the other, the words of the earlier text ``band`` before those that they are held against, and compared
    at every step of the band at once. Runs that reach into the gaps between them do not count."""
    width, gap = 2 * band + 1, max(passage, 2 * band)
    later, earlier, sizes, begin = [], [], [], []
    for b, a, shift in rows:
        first, last = max(0, shift - band), min(len(b), len(a) + shift + band)
        low, high = first - shift - band, last - shift + band
        later += [b[first:last], b"\1" * gap]
        earlier += [b"\0" * -low, a[max(0, low) : high], b"\0" * (gap - width + 1 + max(0, high - len(a)))]
        sizes.append(last - first + gap)
        begin.append(first)
    b, a = (np.frombuffer(b"".join(x), np.uint8) for x in (later, earlier))
    near, same = np.zeros(len(b), bool), np.empty(1 << 15, bool)
    end = len(b) - width + 1
    for at in range(0, end, len(same)):
        until = min(end, at + len(same))
        for step in range(width):
            np.equal(b[at:until], a[at + step : until + step], out=same[: until - at])
            near[at:until] |= same[: until - at]
    row, *places = runs_in(near, sizes, passage, percent, gap)
    return row, *(x + np.array(begin, np.int64)[row] for x in places)


def _runs_of(rows: list[tuple[bytes, bytes, int]], band: int, passage: int, percent: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(first row, its and the next ones' ``_laid_runs``), by at most ``LAID`` words or one row."""
    at = 0
    for some in _chunks(rows, lambda row: len(row[0])):
        yield at, _laid_runs(some, band, passage, percent)
        at += len(some)


def _hopeful(*given: object) -> np.ndarray | bool:
    """Whether a passage may repeat along or around one of the alignments of (later, earlier, shifts), given as in ``_laid_runs``: the first
    alignment of each pair, then all of those that are still open. ``given`` are pairs, passage and percent; or a single pair's later, earlier
    and shifts before these, with two bytes a word, for which it is yes or no."""
    *pairs, passage, percent = given
    if len(pairs) == 3:
        texts = (np.maximum(x >> np.uint16(8), np.uint16(2)).astype(np.uint8).tobytes() for x in pairs[:2])
        return bool(_hopeful([(*texts, pairs[2])], passage, percent)[0])
    (pairs,) = pairs
    out = np.zeros(len(pairs), bool)
    able = [n for n, (b, a, _) in enumerate(pairs) if min(len(a), len(b)) >= passage]
    for some in (slice(0, 1), slice(1, None)):
        rows = [(n, shift) for n in able if not out[n] for shift in pairs[n][2][some]]
        for at, (found, *_) in _runs_of([(*pairs[n][:2], shift) for n, shift in rows], BAND, passage, percent):
            out[[rows[at + row][0] for row in found.tolist()]] = True
    return out


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, passage: int, percent: int) -> DataFrame:
    """(id, source, first_word, end_word) of the repeated passages of candidate alignments, after ``aligned``.

    Pairs of documents meet as a byte per word first; the texts of those that this leaves are then sent and compared. That of the
    shorter document is sent for each of its pairs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER)
                ahead, shifts, first, second = (rows.column(n).to_pylist() for n in range(2, 6))
                given = [(x, y, some) if before else (y, x, some) for before, some, x, y in zip(ahead, shifts, first, second, strict=True)]
                yield rows.select(range(4)).filter(pa.array(_hopeful(given, passage, percent), pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                packed = {r["first"]: (r["first_text"], r["first_size"]) for r in rows} | {r["second"]: (r["second_text"], r["second_size"]) for r in rows}
                words = dict(zip(packed, _words_of([pa.decompress(text, decompressed_size=size, codec="zstd") for text, size in packed.values()]), strict=True))
                texts = [(words[r["id"]], words[r["source"]], r["shifts"]) for r in rows]
                out = [(r["id"], r["source"], *span) for r, spans in zip(rows, repeats_of(texts, passage, percent), strict=True) for span in spans]
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["id", "source", "first_word", "end_word"])

    def both(rows: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
        for key in ("first", "second"):
            rows = rows.join(docs.select(F.col("id").alias(key), *(F.col(name).alias(f"{key}_{name}") for name in names)), key)
        return rows.select("id", "source", "ahead", "shifts", *(f"{key}_{name}" for name in names for key in ("first", "second")), "first", "second")

    def ends(rows: DataFrame) -> DataFrame:
        shorter, longer = F.when(F.col("ahead"), F.col("id")).otherwise(F.col("source")), F.when(F.col("ahead"), F.col("source")).otherwise(F.col("id"))
        return rows.withColumns({"first": shorter, "second": longer})

    left = keep_table(both(ends(pairs), prints, "print").mapInArrow(look, "id bigint, source bigint, ahead boolean, shifts array<bigint>"))
    needed = keep_table(left.select("id").union(left.select("source")).distinct())
    texts = docs.join(maybe_broadcast(needed), "id", "left_semi").select("id", "text").mapInArrow(_zipped, "id bigint, text binary, size bigint")
    return both(ends(left), texts, "text", "size").mapInArrow(run, "id bigint, source bigint, first_word bigint, end_word bigint")


def _words_of(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    out = []
    for some in _chunks(texts, len, SLICE):
        data, offsets = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
        words = split(data, offsets, NOT_SPACE)
        found = hashes(data, words.starts, words.ends)
        out += [found[x:y] for x, y in zip(words.of.tolist(), words.of[1:].tolist())]
    return out


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, size): texts compressed, and their bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        texts = [pa.compress(data[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(np.diff(offsets), pa.int64())], ["id", "text", "size"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, print): a byte of the hash of each word."""
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1), SLICE):
            words = split(data, offsets, NOT_SPACE)
            found = prints_of(hashes(data, words.starts, words.ends))
            prints = pa.array([found[a:b].tobytes() for a, b in zip(words.of, words.of[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), prints], ["id", "print"])


def _further(members: DataFrame, repeats: DataFrame, usable: DataFrame, prints: DataFrame, passage: int, percent: int) -> DataFrame:
    """``repeats`` with those of windows that the stars leave unmatched, from further members of their groups."""
    spans = repeats.select(F.col("id").alias("of"), "first_word", "end_word").distinct()
    inside = (F.col("id") == F.col("of")) & (F.col("c") >= F.col("first_word")) & (F.col("c") + TOKEN_WORDS <= F.col("end_word"))
    open_ = keep_table(members.filter("asks").drop("asks").join(spans, inside, "left_anti"))
    if open_.isEmpty():
        return repeats
    pairs = keep_table(aligned(_around(open_, members.drop("asks"), usable, passage, percent)))
    needed = keep_table(pairs.select("id").union(pairs.select("source")).distinct())
    some = prints.join(F.broadcast(needed), "id", "left_semi") if small(needed) else prints
    return repeats.unionByName(keep_table(_verified(pairs, usable, some, passage, percent)))


def _around(open_: DataFrame, members: DataFrame, usable: DataFrame, passage: int, percent: int) -> DataFrame:
    """(id, other, place, flag), as the stars of ``grouped``, of all windows in ``open_(id, value, c)`` and earlier ``members`` of their groups
    that may share a passage around the min-hash.

    The words around all members of a group are brought together, two bytes each, and looked through by ``_sharing``."""
    reach = passage - 1 + BAND
    asking = open_.select("value", "id", "c", F.lit(True).alias("open"))
    members = members.join(open_.select("value").distinct(), "value", "left_semi").join(asking, ["value", "id", "c"], "left")
    per = members.groupBy("id").agg(F.collect_list(F.struct("value", "c", F.col("open").isNotNull().alias("open"))).alias("windows"))
    per = keep_table(per)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), SLICE):
                words = split(data, offsets, NOT_SPACE)
                found = (hashes(data, words.starts, words.ends) >> np.uint64(48)).astype(np.uint16)
                packed = pa.array([found[a:b].tobytes() for a, b in zip(words.of, words.of[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), packed], ["id", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER)
                lists = rows.column(2)
                value, c, asks = (lists.flatten().field(n) for n in range(3))
                row, own = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy())), c.to_numpy()
                begin, words = np.maximum(own - reach, 0), rows.column(1).to_pylist()
                near = [words[i][2 * x : 2 * y] for i, x, y in zip(row.tolist(), begin.tolist(), (own + TOKEN_WORDS + reach).tolist(), strict=True)]
                size = pa.array(np.array([len(x) // 2 for x in words], np.int64)[row])
                columns = [value, rows.column(0).take(pa.array(row)), c, asks, pa.array(own - begin), pa.array(near, pa.binary()), size]
                yield pa.RecordBatch.from_arrays(columns, ["value", "id", "c", "open", "lead", "near", "size"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        rows = pa.Table.from_batches(given)
        del given
        rows = rows.take(pa.compute.sort_indices(rows, [(name, "ascending") for name in ("value", "id", "c")])).combine_chunks()
        value = rows.column(0).to_numpy()
        ends = np.concatenate([np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        at = 0
        while at < len(value):
            # Whole groups.
            until = int(ends[max(np.searchsorted(ends, at + MEMBERS, "right") - 1, np.searchsorted(ends, at, "right"))])
            some, at = rows.slice(at, until - at), until
            ids, c, size = (some.column(n).to_numpy() for n in (1, 2, 6))
            for later, earlier in _sharing(some, passage, percent):
                columns = ids[later], ids[earlier], c[later] - c[earlier], size[later] < size[earlier]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "other", "place", "flag"])

    texts = usable.select("id", "text")
    if small(per):
        texts = texts.join(F.broadcast(per.select("id")), "id", "left_semi")
    contexts = texts.mapInArrow(read, "id bigint, words binary").join(per, "id").mapInArrow(cut, "value bigint, id bigint, c bigint, open boolean, lead bigint, near binary, size bigint")
    return contexts.repartition("value").mapInArrow(look, "id bigint, other bigint, place bigint, flag boolean")


def _sharing(rows: pa.Table, passage: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of members (value, id, c, open, lead, near) of whole groups, in order: (later, earlier) of the open ones and the members of smaller id
    with which they may share a passage that touches the min-hash.

    Of the pairs of neighbouring words in a run of ``passage`` words a differing word takes two. Where the earlier text has one word more the pair
    stays, as there it may have a word between; of the few places where a path can skip more words (it needs more equal words than ``GAP`` for
    each of them) each takes one. So many pairs as are then left are in the words around the other member. Where words come again and again, and
    where no pairs would be left, equal words are looked for instead."""
    need = max(1, -(-percent * passage // 100))
    least = passage - 1 - 2 * (passage - need) - BAND // 2
    value, open_ = rows.column(0).to_numpy(), rows.column(3).to_numpy()
    data, of = buffers(rows.column(5))
    words, of = data.view(np.uint16), of // 2
    same = np.zeros(len(words), np.uint8)
    same[:-1] = words[1:] == words[:-1]
    # The last word of each; none is without the min-hash.
    same[of[1:] - 1] = 0
    again = (np.add.reduceat(same, of[:-1], dtype=np.int32) * 4 >= np.diff(of)) | (least < SHARED)
    for some, pairs in ((open_ & ~again, 1), (open_ & again, 0)):
        if some.any():
            groups = np.flatnonzero(np.isin(value, value[some]))
            part = rows.take(pa.array(groups)).combine_chunks() if len(groups) < len(value) else rows
            for later, earlier in _met(part, some[groups], pairs, least if pairs else need, passage, need):
                yield groups[later], groups[earlier]


def _met(rows: pa.Table, open_: np.ndarray, pairs: int, least: int, passage: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_sharing``, for the ``open_`` ones, which must have ``least`` words, or pairs of neighbouring ones, of a run in common with another member,
    a first, second, ... time each.

    Runs in which earlier members have fewer of them are left out; of the others the rarest are looked up, so many that ``SHARED`` must be
    found. What is met then is looked at word by word."""
    shared, length, region = min(SHARED, least), passage - pairs, 2 * passage + TOKEN_WORDS - 2
    value, ids, lead = (rows.column(n).to_numpy() for n in (0, 1, 4))
    group = (mix(value.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    data, of = buffers(rows.column(5))
    words, of = data.view(np.uint16), of // 2
    sizes = np.diff(of)
    # Of each member the first one of its document.
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (ids[1:] != ids[:-1])])
    own = np.flatnonzero(new)[np.cumsum(new) - 1]
    bits = np.uint32(32 - min(24, max(12, int(4 * len(words)).bit_length())))
    # A byte of each word, with the min-hash in the same place.
    around = np.zeros((len(sizes), region + 1 + 2 * BAND), np.uint8)

    def key(left: np.ndarray, right: np.ndarray, of_group: np.ndarray) -> np.ndarray:
        x = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) ^ of_group) * np.uint32(0xC2B2AE3D)
        x ^= x >> np.uint32(15)
        return x * np.uint32(0x27D4EB2F)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, member) of runs of members, the last ones first."""
        for first in reversed(range(0, len(sizes), MEMBERS)):
            last = min(len(sizes), first + MEMBERS)
            yield words[of[first] : of[last]].astype(np.uint32), np.repeat(np.arange(first, last), sizes[first:last])

    def offered() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, member) of the words or pairs, the last members first."""
        for some, row in blocks():
            for step in range(pairs, 2 * pairs + 1):
                until = len(row) - step
                inside = row[step:] == row[:until]
                if step > 1:
                    inside &= some[step:] != some[1 : until + 1]
                by = row[:until][inside]
                yield key(some[:until][inside], some[step:][inside] if step else np.uint32(0), group[by]), by

    for some, row in blocks():
        place = np.arange(len(row)) - (of[row] - of[row[:1]]) + (passage - 1 + BAND - lead)[row]
        around[row, place] = np.maximum(some >> np.uint32(8), np.uint32(2))
    # The first member with a key, or one that shares its place.
    first_with = np.full(1 << (32 - int(bits)), len(sizes), np.int32)
    for found, by in offered():
        place = found >> bits
        first_with[place[::-1]] = np.minimum(first_with[place[::-1]], by[::-1])
    asking = np.flatnonzero(open_)
    for at in range(0, len(asking), MEMBERS):
        who = asking[at : at + MEMBERS]
        begin, end = np.maximum(lead[who] - passage + 1, 0), np.minimum(sizes[who], lead[who] + TOKEN_WORDS + passage - 1)
        place = (begin + of[who])[:, None] + np.arange(region)
        inside = place < (end + of[who])[:, None]
        text = words[np.where(inside, place, 0)].astype(np.uint32)
        keys = key(text[:, : region - pairs], text[:, pairs:] if pairs else np.uint32(0), group[who][:, None])
        room = np.arange(region - passage + 1) + passage <= (end - begin)[:, None]
        held = inside[:, pairs:] & (first_with[keys >> bits] < own[who][:, None])
        sums = np.concatenate([np.zeros((len(who), 1), np.int16), np.cumsum(held, axis=1, dtype=np.int16)], axis=1)
        some = np.flatnonzero(((sums[:, length:] - sums[:, :-length] >= least) & room).any(axis=1))
        if not len(some):
            continue
        wanted = np.zeros(len(first_with), bool)
        wanted[keys[some][held[some]] >> bits] = True
        there = _counted(np.concatenate([_code(found[take], by[take]) for found, by in offered() if (take := wanted[found >> bits]).any()]))
        # Of each place in the region the key with the number of times that it has come by then.
        who, keys, held, room = who[some], keys[some], held[some], room[some]
        order = np.argsort(keys, axis=1, kind="stable")
        ordered = np.take_along_axis(keys, order, axis=1)
        begin = np.concatenate([np.ones((len(who), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
        begin = np.maximum.accumulate(np.where(begin, np.arange(keys.shape[1]), 0), axis=1)
        back = np.empty_like(order)
        np.put_along_axis(back, order, np.broadcast_to(np.arange(keys.shape[1]), order.shape), axis=1)
        begin = np.take_along_axis(begin, back, axis=1)
        code = _code(_often(keys, (back - begin).astype(np.uint32)), 0)
        low = np.searchsorted(there, code)
        many = np.where(held, np.searchsorted(there, code | own[who].astype(np.uint64)[:, None]) - low, 0)
        # The rarest come first, by how many earlier members have them.
        rarity = np.where(many > 0, np.minimum(many, 1 << 23) << 7 | np.arange(keys.shape[1]), 1 << 31).astype(np.uint32)
        taken = np.zeros(rarity.shape, bool)
        for x in range(0, len(who), 256):
            y = slice(x, x + 256)
            # A run counts from its own start.
            before = np.zeros((*keys[y].shape, keys.shape[1] + 1), np.uint8)
            np.cumsum(keys[y][:, :, None] == keys[y][:, None, :], axis=2, dtype=np.uint8, out=before[:, :, 1:])
            start = np.arange(region - passage + 1)[:, None]
            step = start + np.arange(length)
            which = np.arange(len(before))[:, None, None]
            place = order[y][which, back[y][:, step] - before[:, step, start]]
            run = rarity[y][which, place]
            found = (run < 1 << 31).sum(axis=2)
            n, b = np.nonzero((found >= least) & room[y])
            run = run[n, b]
            most = np.sort(run, axis=1)[np.arange(len(n)), found[n, b] - least + shared - 1]
            row, column = np.nonzero(run <= most[:, None])
            taken[x + n[row], place[n, b][row, column]] = True
        row, place = np.nonzero(taken)
        low, many = low[row, place], many[row, place]
        total = np.cumsum(many)
        x = 0
        while x < len(row):
            # All of a member's at once.
            y = max(int(np.searchsorted(total, total[x] - many[x] + LAID, "right")), x + 1)
            y = int(np.searchsorted(row, row[y], "left")) if y < len(row) and row[y] > row[x] else int(np.searchsorted(row, row[y - 1], "right"))
            n = many[x:y]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            met, often = np.unique(_code(np.repeat(row[x:y], n), there[np.repeat(low[x:y], n) + step] & np.uint64(0xFFFFFFFF)), return_counts=True)
            met = met[often >= shared]
            later, earlier = who[(met >> np.uint64(32)).astype(np.int64)], (met & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = value[later] == value[earlier]
            later, earlier, x = later[same], earlier[same], y
            for z in range(0, len(later), MEMBERS):
                b, a = later[z : z + MEMBERS], earlier[z : z + MEMBERS]
                good = _near(around[b], around[a], region, passage, need)
                if good.any():
                    yield b[good], a[good]


def _code(keys: np.ndarray, members: np.ndarray | int) -> np.ndarray:
    return (keys.astype(np.uint64) << np.uint64(32)) | np.asarray(members).astype(np.uint64)


def _often(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Stands for a key that comes again after so many ``times``."""
    x = keys + times * np.uint32(0x9E3779B1)
    return np.where(times > 0, (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B), keys)


def _counted(codes: np.ndarray) -> np.ndarray:
    """Sorted codes of (key, member), the second, third, ... of equal ones with another key."""
    codes = np.sort(codes)
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    times = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
    keys = _often((codes >> np.uint64(32)).astype(np.uint32), times.astype(np.uint32))
    return np.sort(_code(keys, codes & np.uint64(0xFFFFFFFF)))


def _near(later: np.ndarray, earlier: np.ndarray, region: int, passage: int, need: int) -> np.ndarray:
    """Whether in some run of the ``region`` of words in the middle of each row so many have an equal one within the band, words being bytes, 0 where
    there is none."""
    middle = later[:, BAND : BAND + region]
    middle = np.where(middle == 0, np.uint8(1), middle)
    near = np.zeros(middle.shape, bool)
    for step in range(2 * BAND + 1):
        near |= middle == earlier[:, step : step + region]
    sums = np.zeros((len(near), region + 1), np.int16)
    np.cumsum(near, axis=1, out=sums[:, 1:])
    return (sums[:, passage:] - sums[:, :-passage] >= need).any(axis=1)


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", passage: int = 50, percent: int = 80, count: int = HASHES) -> DataFrame:
    """Per key: key, n_repeated (words in repeated passages), sources (keys of documents that they repeat, in
    order), spans (merged: first word, word after the last). Of two documents that share a passage, that of the
    larger key has it as a repeat; passages that repeat within one document are not looked at.

    ``key`` must be an integer. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Null texts, and those of
    fewer words than ``passage``, repeat nothing. Rows without a key are left out; of repeated rows of one
    key the least text is taken. Other columns are ignored.
    """
    given = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL")
    again = keep_table(given.groupBy("id").count().filter("count > 1").select("id"))
    # Only texts of repeated keys need to be brought together.
    once = given
    if not again.isEmpty():
        least = given.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        once = keep_table(given.join(again, "id", "left_anti").unionByName(least))
    usable = once.filter("text IS NOT NULL")
    prints = keep_table(usable.select("id", "text").mapInArrow(_prints, "id bigint, print binary"))
    # Most windows share their signature with no other document and are not kept.
    found = keep_table(grouped(windows(usable, passage, count), passage))
    stars = keep_table(_verified(aligned(found.filter("star")), usable, prints, passage, percent))
    members = found.filter("NOT star").select("id", F.col("other").alias("value"), F.col("place").alias("c"), F.col("flag").alias("asks"))
    repeats = _further(members, stars, usable, prints, passage, percent)
    # Spans of one document are as many as its alignments at most.
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("first_word", "end_word"))),
        F.expr("cast(array() as array<struct<first_word: bigint, end_word: bigint>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end_word"] >= s["first_word"]),
            F.concat(
                F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(out, F.lit(-1))["first_word"].alias("first_word"), F.greatest(F.try_element_at(out, F.lit(-1))["end_word"], s["end_word"]).alias("end_word"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    per = repeats.groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("sources"), merged.alias("spans"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return once.select("id").join(per, "id", "left").select(
        F.col("id").alias(key),
        F.coalesce(size, F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("sources", F.expr("cast(array() as array<bigint>)")).alias("sources"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first_word: bigint, end_word: bigint>>)")).alias("spans"),
    )
