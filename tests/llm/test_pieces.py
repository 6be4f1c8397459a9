"""Pieces of text that recur are read byte by byte once."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import token_counts

TEXTS = ["the cat and the hat " * 50, "x" * 300 + " the  cat\n\n\té中文 don't <|endoftext|> the", "", "<|endoftext|>", "a1b2c3 " * 40]


@pytest.mark.parametrize("most", [1, 3, 200_000])
def test_recurring_pieces(monkeypatch, most):
    monkeypatch.setattr(token_counts, "MOST_PIECES", most)
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine = token_counts.Transducer(*token_counts.read_vocabulary(path))
    read = []
    machine.whole.count = lambda data: read.append(data) or machine.piece(data)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    assert machine.chunk(TEXTS).tolist() == want and machine.chunk(TEXTS).tolist() == want
    assert len(machine.whole) <= most and max(map(len, machine.whole)) <= token_counts.MOST_LETTERS
    if most > len(TEXTS) ** 3:
        short = [r for r in read if len(r) <= token_counts.MOST_LETTERS]
        assert len(short) == len(set(short))


def test_words_that_end_alike_share_their_states():
    machine = token_counts.Transducer(*token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    generator = random.Random(3)
    words = ["".join(generator.choice(("an", "ther", "ion", "qu", "ssa", "él")) for _ in range(12)) for _ in range(2000)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert machine.chunk(words).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert len(machine.step) < sum(len(w.encode()) for w in words) / 10
    # A long run of new words is read in bounded states as well.
    assert machine.chunk(["".join(words)]).tolist() == [len(library.encode("".join(words), add_special_tokens=False).ids)]


def test_neighbours_are_those_that_merging_leaves_apart():
    """Odd vocabularies: tokens that no merge leads to, that merge in several ways, or whose parts come later."""
    generator = random.Random(4)
    for _ in range(60):
        ranks, tokens = {}, [b"a", b"b", b"c"]
        for _ in range(generator.randint(0, 14)):
            pair = generator.choice(tokens), generator.choice(tokens)
            ranks.setdefault(pair, len(ranks))
            tokens.append(pair[0] + pair[1])
        order = list(ranks)
        generator.shuffle(order)
        ranks = {pair: i for i, pair in enumerate(order)}
        machine = token_counts.Transducer(ranks, set(tokens), [])
        short = [t for t in dict.fromkeys(tokens) if len(t) < 12]
        for left in [b"", *short]:
            for right in short:
                assert machine.may_follow(left, right) == (_merged(left + right, ranks) == ([left, right] if left else [right]))


def test_states_are_forgotten_within_a_text(monkeypatch):
    machine = token_counts.Transducer(*token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    text = " ".join(f"w{i * i:x}" for i in range(3000))
    whole = machine.chunk([text]).tolist()
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    machine.whole.clear()
    machine.forget()
    assert machine.chunk([text]).tolist() == whole and len(machine.step) < 60
    long = "".join(random.Random(5).choices("abcdefghij", k=5000))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert machine.chunk([long]).tolist() == [len(library.encode(long, add_special_tokens=False).ids)] and len(machine.step) < 60


def _merged(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts
