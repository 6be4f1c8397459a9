"""Secret scans: the regexes of all rules in one minimal automaton, one pass over the bytes.

The forward automaton finds where matches end, for all rules at once. Where a rule's run of accepting
states ends, an automaton over the reversed rules reads back to the leftmost start after the rule's
previous match. Both automata are built on the driver from the rules alone (a few thousand states) and
sent to the tasks; texts are read once and not shuffled.

A rule is a greedy expression whose match cannot be continued differently once it is taken, as all
below are; its matches are leftmost and do not overlap each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.automaton import Automaton, compile_rules
from llm.shared import map_batches, send
from llm.words import replaced, slices

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
OPENING = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Rule:
    """``least``: matches of fewer bytes are dropped; ``opening``: what does not count for that."""

    kind: str
    pattern: str
    least: int = 1
    opening: str = ""


#: Kinds that the counts are about, in order.
BASE = (
    Rule("assign", ASSIGN, 6, OPENING),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further kinds, by the published shapes of their tokens. Lengths are checked on the match: counted
#: repetitions after an opening that may recur inside them would multiply the states.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    forward: Automaton = field(init=False)
    backward: list[Automaton] = field(init=False)
    openings: list[Automaton | None] = field(init=False)
    scaled: list[int] = field(init=False)
    accepting: dict[int, set[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.forward = compile_rules([r.pattern for r in self.rules])
        self.backward = [compile_rules([r.pattern], search=False, back=True) for r in self.rules]
        self.openings = [compile_rules([r.opening], search=False) if r.opening else None for r in self.rules]
        # Transitions with targets already multiplied by the width.
        width = self.forward.width
        self.scaled = [t * width for t in self.forward.table]
        self.accepting = {s * width: set(a) for s, a in enumerate(self.forward.accepts) if a}

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) where a rule's accepting run ends; one step per byte for all rules together."""
        machine = self.forward
        table, accepting = self.scaled, self.accepting
        state, found, live = machine.first * machine.width, [], set()
        for at, kind in enumerate(data.translate(machine.classes)):
            state = table[state + kind]
            if live or state in accepting:
                now = accepting.get(state, _NONE)
                for rule in live - now:
                    found.append((rule, at))
                live = now
        found.extend((rule, len(data)) for rule in live)
        return found

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then by the order of the rules."""
        bound = [0] * len(self.rules)
        out = []
        for rule, end in self.ends(data):
            start = _leftmost(self.backward[rule], data, bound[rule], end)
            if start is None:
                continue
            bound[rule] = end
            skip = self.openings[rule]
            opened = _longest(skip, data, start, end) if skip else start
            if end - opened >= self.rules[rule].least:
                out.append((start, rule, end))
        return [(self.rules[rule].kind, start, end) for start, rule, end in sorted(out)]


_NONE: set[int] = set()


@cache
def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per process and set of rules."""
    return Scanner(rules)


def _leftmost(machine: Automaton, data: bytes, least: int, end: int) -> int | None:
    state, start = machine.first, None
    for at in range(end - 1, least - 1, -1):
        state = machine.table[state * machine.width + machine.classes[data[at]]]
        if machine.accepts[state]:
            start = at
        elif not _alive(machine, state):
            break
    return start


def _longest(machine: Automaton, data: bytes, start: int, end: int) -> int:
    state, last = machine.first, start
    for at in range(start, end):
        state = machine.table[state * machine.width + machine.classes[data[at]]]
        if machine.accepts[state]:
            last = at + 1
        elif not _alive(machine, state):
            break
    return last


def _alive(machine: Automaton, state: int) -> bool:
    """Whether the state has another successor than itself or accepts: the minimal automaton has one
    dead state."""
    row = machine.table[state * machine.width : (state + 1) * machine.width]
    return bool(machine.accepts[state]) or any(t != state for t in row)


def _texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The texts of a slice, one at a time."""
    raw, ends = memoryview(data), offsets.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield raw[a:b].tobytes()


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def in_letters(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte spans as code point spans."""
    if not spans or data.isascii():
        return spans
    places = sorted({p for _, a, b in spans for p in (a, b)})
    letter, last, count = {}, 0, 0
    for p in places:
        count += len(data[last:p].decode("utf-8", "replace"))
        letter[p] = count
        last = p
    return [(kind, letter[a], letter[b]) for kind, a, b in spans]


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Returns per row of ``docs``: key and secrets, an array of (kind, start, end) by start and then in
    the order of the rules; offsets in code points, end exclusive.

    Null and empty texts have none. Keys may be null or repeat; each row stands for itself. Other
    columns are ignored, whatever their names.
    """
    sent = send(docs.sparkSession, scanner_for(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent()
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                rows = []
                for own in _texts(data, offsets):
                    rows.append([{"kind": k, "start": s, "end": e} for k, s, e in in_letters(own, scanner.spans(own))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(rows, SPAN_TYPE)], ["key", "secrets"])

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, f"key {kind}, secrets {SPANS}")
        .withColumnRenamed("key", key)
    )


def as_text(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by the name of its kind; overlapping secrets are
    replaced together, under the first one's. All rows and all other columns stay as they are."""
    sent = send(docs.sparkSession, scanner_for(rules))
    place = docs.columns.index(text)

    def masked(value: bytes, spans: list[tuple[str, int, int]]) -> str:
        parts, last = [], 0
        for kind, start, end in spans:
            if start >= last:
                parts += [value[last:start], mask.format(kind=kind).encode()]
            last = max(last, end)
        return b"".join([*parts, value[last:]]).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent()
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(place)):
                part = batch.slice(first, last - first)
                changed = {i: masked(own, found) for i, own in enumerate(_texts(data, offsets)) if (found := scanner.spans(own))}
                if changed:
                    part = part.set_column(place, part.schema.field(place), replaced(part.column(place), changed))
                yield part

    return map_batches(docs, run)
