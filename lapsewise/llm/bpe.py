"""Byte-level BPE by longest matches and backtracking, and its inverse.

A text is split by the tokenizer's pattern and every match is encoded by itself. The
vocabulary's byte strings are mapped to Latin-1, one character per byte, and held in an
Aho-Corasick automaton; walking it from its root finds the longest token at a place. Encoding takes the longest token that is compatible with the one before it, goes
to the next shorter token where none is, and steps back from places that no token can
leave. Two adjacent tokens are compatible if the merges would not join across their
border before both are complete; that is worked out once per pair and kept. A sequence
whose neighbours are all compatible is the one the merges make, so ranks are reproduced
exactly, in time linear in the text.

Nulls and odd input: a null or empty text has no ids (zero bytes) and decodes to zero
bytes. Texts of any length are encoded whole. Repeated rows are encoded each for
itself. A column with the name of the output column is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from lapsewise.llm.common import append_columns

MEMO_ENTRIES = 200_000  # entries of a worker's memo before it is begun anew
FAR = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class Memo(dict):
    """A dict that computes missing values and starts again when it is full."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.reach = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.halves = Memo(self._halves)
        self.longest = Memo(self._longest)
        self.shorter = Memo(self._shorter)
        self.compatible = Memo(self._compatible, 2 * MEMO_ENTRIES)  # left << 32 | right
        self.alone = Memo(lambda t: self._merged(self.bytes_of[t]) == [self.bytes_of[t]])
        # Text between spaces; all but the first stretch of a text carry their space.
        self.match = Memo(lambda m: self._packed(self.encode_match(m.encode())))
        self.inner = Memo(self._inner)
        self.first = Memo(self._stretch)

    def _merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Plain merging, for single tokens: down to until parts, or as far as it goes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, i = min(
                (self.ranks.get(a + b, FAR), i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if rank == FAR:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return None
        left, right = self._merged(data, 2)
        return self.ranks[left], self.ranks[right]

    def _longest(self, path: str) -> int:
        """The longest token at the start of a path walked from the automaton's root."""
        while not self.automaton.exists(path):
            path = path[:-1]
        return self.automaton.get(path)

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        data = self.bytes_of[token]
        for n in range(len(data) - 1, 0, -1):
            if (rank := self.ranks.get(data[:n])) is not None:
                return rank
        return None

    def _compatible(self, pair: int) -> bool:
        """Whether merging the two tokens' bytes leaves exactly these two tokens.

        The merges on both sides are undone from the last to the first. At each step the
        parts that then touch must not merge before the merges that used them up: strictly
        before on the left side, where equal ranks are merged first, at the latest together
        on the right.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        if not (self.alone[left] and self.alone[right]):
            return False
        left_used = right_used = FAR
        text, ranks = self.bytes_of, self.ranks
        while True:
            joint = ranks.get(text[left] + text[right], FAR)
            if joint < left_used and joint <= right_used and joint != FAR:
                return False
            one, two = self.halves[left], self.halves[right]
            if one is None and two is None:
                return True
            if two is None or (one is not None and left > right):
                left, left_used = one[1], left
            else:
                right, right_used = two[0], right

    def encode_match(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        n = len(data)
        chars, reach, longest = data.decode("latin-1"), self.reach, self.longest
        walk = self.automaton.longest_prefix
        dead = bytearray(n + 1)
        out: list[int] = []
        start = chars[:reach]
        at, token = 0, longest[start[: walk(start)]]
        text, shorter, compatible, alone = self.bytes_of, self.shorter, self.compatible, self.alone
        while True:
            end = at + len(text[token])
            fits = not dead[end] and (compatible[out[-1] << 32 | token] if out else alone[token])
            if fits:
                out.append(token)
                if end == n:
                    return out
                start = chars[end : end + reach]
                at, token = end, longest[start[: walk(start)]]
                continue
            while (smaller := shorter[token]) is None:
                # Nothing fits here: give up the place and the token that led to it.
                dead[at] = 1
                token = out.pop()
                at -= len(text[token])
            token = smaller

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self.match.__getitem__, self.split(text)))

    def _inner(self, text: str) -> bytes:
        # Letters alone are one match for certain where every Unicode version agrees.
        if text.isalpha() and max(text) < "\u0250":
            return self.match[" " + text]
        return self._stretch(" " + text)

    # A space between two other characters of which at most one is white space is always
    # the border of two matches; only runs of white space need the text around them.
    RUNS = re.compile(r"\s \s|^ | $")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.RUNS.search(text):
            return self._stretch(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.inner.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per worker process; its memos last from task to task."""
    return ByteBPE(read_ranks(path), pattern)


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """df with the ids of its texts, packed as little-endian unsigned 32-bit integers."""

    def make(batch):
        run = load(path, pattern).encode
        found = [run(t) if t else b"" for t in batch.column(text).to_pylist()]
        return [pa.array(found, pa.binary())]

    return append_columns(df, [(ids, BinaryType())], make)


def decode(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """df with the bytes its ids stand for."""

    def make(batch):
        run = load(path, pattern).decode
        found = [run(i) if i else b"" for i in batch.column(ids).to_pylist()]
        return [pa.array(found, pa.binary())]

    return append_columns(df, [(decoded, BinaryType())], make)
