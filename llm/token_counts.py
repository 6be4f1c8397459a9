"""Token counts of a byte-level BPE vocabulary by a deterministic transducer.

A state stands for what matters of a piece of text read so far: the bytes at its end that a token may still
grow from, and for each place between them the last token of the segmentation up to there and the tokens up
to there, less those up to the end. Pieces that end alike share their states. Reading a byte leads to the one
state whose last token ends here and may follow what precedes it: two tokens may be neighbours only if merging
their bytes gives just these two. Every transition is annotated with the number of tokens it adds (negative
where tokens merge). States are compiled when a text first leads to them, and forgotten when they have ``MOST_STATES`` places.

The pieces are the vocabulary's own pre-tokens. At the end of a piece every state leads back to the first
one, so the state map of a chunk of whole pieces is constant, and composing chunks is a prefix sum of
their counts: that is how texts, and pieces within texts, are put together in a batch. The maps of up to
``MOST_PIECES`` pieces are held, so bytes are read one by one only in pieces that are new.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import slices

MOST_STATES = 1_000_000
#: Pieces whose constant state map is held, and the letters that one of them may have.
MOST_PIECES, MOST_LETTERS = 200_000, 64
#: The pieces that byte-level pre-tokenisation cuts a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], set[bytes], list[str]]:
    """Merge ranks, tokens and special strings of a byte-level BPE file. Raises if it asks for more."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    model, cut = content["model"], content["pre_tokenizer"]
    if content.get("normalizer") or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or model["type"] != "BPE":
        raise ValueError("only plain byte-level BPE files are supported")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    added = [a["content"] for a in content["added_tokens"]]
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in ranks}
    return ranks, tokens, added


class Pieces(dict):
    """Annotations of whole pieces summed up, so that a piece that recurs is one transition."""

    def __init__(self, count: Callable[[bytes], int]):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        number = self.count(piece.encode())
        if len(piece) <= MOST_LETTERS:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = number
        return number


class Transducer:
    def __init__(self, ranks: dict[tuple[bytes, bytes], int], tokens: set[bytes], added: list[str]):
        self.ranks, self.tokens, self.added = ranks, tokens, added
        self.never = 1 << 60
        self.starts = {token[:i] for token in tokens for i in range(len(token))}
        self.histories: dict[bytes, list[tuple[int, bytes, bytes]]] = {b"": [(self.never, b"", b"")]}
        self.neighbours: dict[tuple[bytes, bytes], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.whole = Pieces(self.piece)
        self.forget()

    def forget(self) -> None:
        self.step: list[dict[int, int]] = []
        self.added_tokens: list[int] = []  # annotation of the transitions into each state
        self.windows: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.places = 0  # of all windows
        self.number((b"", (b"",), (0,), 0))

    def number(self, window: tuple) -> int:
        """The state that stands for a window, made if it is new."""
        known = self.numbers.get(window)
        if known is None:
            known = self.numbers[window] = len(self.step)
            self.step.append({})
            self.added_tokens.append(window[3])
            self.windows.append(window)
            self.places += len(window[1])
        return known

    def history(self, token: bytes) -> list[tuple[int, bytes, bytes]]:
        """How the bytes of a token merge when it is alone: the rank of the next merge, the first and the last part before it."""
        found = self.histories.get(token)
        if found is None:
            parts, found = [token[i : i + 1] for i in range(len(token))], []
            while True:
                pairs = zip(parts, parts[1:], strict=False)
                best, at = min(((self.ranks.get(pair, self.never), i) for i, pair in enumerate(pairs)), default=(self.never, 0))
                found.append((best, parts[0], parts[-1]))
                if best == self.never:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.histories[token] = found
        return found

    def stay_apart(self, left: bytes, right: bytes) -> bool:
        """Whether merging the bytes of both gives just these two. Until a merge across the border comes first, each side merges as if alone."""
        before, after = self.history(left), self.history(right)
        if before[-1][2] != left or after[-1][1] != right:
            return False
        i = j = 0
        while True:
            (on_left, _, last), (on_right, first, _) = before[i], after[j]
            across = self.ranks.get((last, first), self.never)
            # Of equal ranks the leftmost merges first.
            if across < on_left and across <= on_right:
                return False
            if on_left == on_right == self.never:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1

    def may_follow(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self.neighbours.get(pair)
        if known is None:
            if len(self.neighbours) > MOST_STATES:
                self.neighbours.clear()
            known = self.neighbours[pair] = self.stay_apart(left, right)
        return known

    def compile_step(self, state: int, byte: int) -> int:
        """Add the transition by ``byte``, to a state that is known or new."""
        read, last, counts, _ = self.windows[state]
        read += bytes((byte,))
        for start in range(len(read) - 1, -1, -1):
            token = read[start:]
            if token in self.tokens and self.may_follow(last[start], token):
                break
        else:
            raise ValueError("no token ends here")
        more = counts[start] + 1
        # Only bytes that a longer token may start with matter for what follows.
        cut = 0
        while read[cut:] not in self.starts:
            cut += 1
        window = (read[cut:], (*last[cut:], token), (*[n - more for n in counts[cut:]], 0), more)
        if window not in self.numbers and self.places > MOST_STATES:
            # The state before is gone as well; the window has all that matters for what follows.
            self.forget()
            return self.number(window)
        number = self.step[state][byte] = self.number(window)
        return number

    def piece(self, data: bytes) -> int:
        """Tokens of one piece: the sum of the annotations along its transitions."""
        state = count = 0
        for byte in data:
            after = self.step[state].get(byte)
            state = self.compile_step(state, byte) if after is None else after
            count += self.added_tokens[state]
        return count

    def chunk(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as differences of one prefix sum over the pieces of all."""
        counts, ends = [], [0]
        find, count = self.pieces.findall, self.whole.__getitem__
        for text in texts:
            for part in self.special.split(text) if self.special else [text]:
                if part in self.added:
                    counts.append(1)
                else:
                    counts.extend(map(count, find(part)))
            ends.append(len(counts))
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return np.diff(sums[ends])


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens of the whole text.

    ``path`` is a byte-level BPE vocabulary file, read on the driver (its size is fixed) and sent to the
    tasks. Strings of added tokens inside a text are one token each. Null and empty texts have 0 of both.
    Bytes that are not UTF-8 are counted in n_bytes as they are and as U+FFFD in tokens.
    Keys may be null or repeat; each row stands for itself. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(*sent.value)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(machine.chunk(texts))],
                    ["key", "n_bytes", "n_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
        .withColumnRenamed("key", key)
    )
