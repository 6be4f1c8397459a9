"""Regular expressions compiled together into one minimal deterministic byte automaton.

Expressions become a Thompson automaton over bytes, subset construction makes it deterministic, and
partition refinement minimises it. The result is a flat transition array over byte classes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_parser = re._parser
_op = re._constants


class _Net:
    """Thompson automaton: byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.step: list[list[tuple[int, int]]] = []  # state -> (byte set as a 256-bit mask, target)
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1


def _mask(codes) -> int:
    out = 0
    for c in codes:
        out |= 1 << c
    return out


def _in(items, fold: bool) -> int:
    codes, negated = set(), False
    for op, value in items:
        if op is _op.NEGATE:
            negated = True
        elif op is _op.LITERAL:
            codes.add(value)
        elif op is _op.RANGE:
            codes.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a byte class: {op}")
    if fold:
        codes |= {ord(chr(c).swapcase()) for c in codes if c < 128 and chr(c).isalpha()}
    return _mask(set(range(256)) - codes if negated else codes)


def _build(net: _Net, parsed, start: int, fold: bool, back: bool) -> int:
    """Add the sequence after ``start`` and return its last state; ``back`` builds it from the right."""
    at = start
    for op, value in reversed(list(parsed)) if back else parsed:
        if op is _op.LITERAL or op is _op.IN:
            end = net.state()
            net.step[at].append((_in(value if op is _op.IN else [(_op.LITERAL, value)], fold), end))
            at = end
        elif op is _op.SUBPATTERN:
            at = _build(net, value[3], at, fold or bool(value[1] & re.I), back)
        elif op is _op.BRANCH:
            end = net.state()
            for branch in value[1]:
                net.free[_build(net, branch, at, fold, back)].append(end)
            at = end
        elif op is _op.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                at = _build(net, inner, at, fold, back)
            if most is _op.MAXREPEAT:
                loop = net.state()
                net.free[at].append(loop)
                net.free[_build(net, inner, loop, fold, back)].append(loop)
                at = loop
            else:
                end = net.state()
                net.free[at].append(end)
                for _ in range(most - least):
                    at = _build(net, inner, at, fold, back)
                    net.free[at].append(end)
                at = end
        else:
            raise ValueError(f"not supported in a rule: {op}")
    return at


@dataclass
class Automaton:
    """``table[state * width + classes[byte]]`` is the next state; ``accepts[state]`` the rules it ends."""

    classes: bytes
    width: int
    table: list[int]
    accepts: list[tuple[int, ...]]
    first: int


def compile_rules(patterns: list[str], search: bool = True, back: bool = False) -> Automaton:
    """All patterns in one automaton. With ``search`` a match may start anywhere before its end; with
    ``back`` the automaton reads a match from its last byte to its first."""
    net = _Net()
    root = net.state()
    ends = {}
    for rule, pattern in enumerate(patterns):
        start = net.state()
        net.free[root].append(start)
        ends[_build(net, _parser.parse(pattern.encode()), start, False, back)] = rule
    masks = sorted({m for edges in net.step for m, _ in edges})
    kinds: dict[tuple, int] = {}
    classes = bytearray(256)
    for byte in range(256):
        classes[byte] = kinds.setdefault(tuple(m >> byte & 1 for m in masks), len(kinds))
    width = len(kinds)
    of_mask = {m: [k for signature, k in kinds.items() if signature[i]] for i, m in enumerate(masks)}

    def closed(states) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for t in net.free[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(s for s in seen if net.step[s] or s in ends)

    begin = closed([root])
    number, todo, rows = {begin: 0}, [begin], []
    for states in todo:
        targets: list[set[int]] = [set(begin) if search else set() for _ in range(width)]
        for s in states:
            for m, t in net.step[s]:
                for k in of_mask[m]:
                    targets[k].add(t)
        row = []
        for target in targets:
            after = closed(target)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in todo]
    return _minimal(bytes(classes), width, np.array(rows), accepts)


def _minimal(classes: bytes, width: int, rows: np.ndarray, accepts: list[tuple[int, ...]]) -> Automaton:
    """Merge states that no continuation tells apart: refine by (own block, blocks of all successors)."""
    kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}
    block = np.array([kinds[a] for a in accepts])
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, chosen = np.unique(block, return_index=True)
    return Automaton(
        classes, width, block[rows[chosen]].ravel().tolist(), [accepts[c] for c in chosen], int(block[0])
    )
