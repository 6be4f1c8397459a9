"""Counts of byte n-grams: one pass over the counts, the same as gram by gram."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from llm import language_id as L


def _rows(generator: random.Random, n: int) -> list[bytes]:
    parts = [b"\xc3\x80", b"\xc3\x97", b"\xc3\x9e", b"\xc3", b"\x80", b"A", b"z", b" ", b"\n", b"7", b"\xff", "日".encode(), b"the "]
    return [b"".join(generator.choices(parts, k=generator.randint(0, 12))) for _ in range(n)]


def _one_by_one(raw: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(raw), L.DIMS), np.int64)
    letters = L._letters(np.frombuffer(b"".join(raw), np.uint8)).tobytes()
    for row, start in enumerate(np.cumsum([0, *map(len, raw)])[:-1].tolist()):
        for word in letters[start : start + len(raw[row])].split(b" "):
            bounded = b" " + word + b" "
            for size, factor in zip(L.SIZES, L._FACTORS, strict=True):
                for i in range(len(bounded) - size + 1 if word else 0):
                    place = int.from_bytes(bounded[i : i + size], "big") * int(factor) % 2**32 >> 32 - L.BITS
                    counts[row, place] += 1
    return counts


def test_counts_are_those_of_every_gram():
    generator = random.Random(5)
    for n in [0, 1, 1, 2, 3, 7, 40]:
        raw = _rows(generator, n)
        offsets = np.cumsum([0, *map(len, raw)])
        found = L.gram_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert found.shape == (n, L.DIMS) and found.dtype == np.int64 and (found == _one_by_one(raw)).all()


def test_lower_case_letters():
    every = np.frombuffer(bytes(range(256)) + b"".join(bytes((0xC3, b)) for b in range(0x80, 0xC0)) + b"\xc3", np.uint8)
    low = L._letters(every).tobytes()
    assert low[:256] == bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
    want = [b + 0x20 if b <= 0x9E and b != 0x97 else b for b in range(0x80, 0xC0)]
    assert list(low[257:-1:2]) == want
    assert every[0x41] == 0x41


def test_counts_are_held_once(monkeypatch):
    """The dense counts are made once for all sizes, and whether a row has a letter is asked where it is used."""
    made, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: made.append(1) or count(*a, **k))
    monkeypatch.setattr(L, "_has_letter", None)
    texts = pa.array(["one text", None, "", "12 34", "Ünïcode"] * 100)
    runs = list(L._counted(texts))
    assert [r[:2] for r in runs] == [(0, 256), (256, 500)] and len(made) == len(runs)
    assert (np.concatenate([r[2] for r in runs])[1::5] == 0).all()
