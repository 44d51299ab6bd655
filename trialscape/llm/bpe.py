"""Byte-level BPE by prefixes: for every prefix of a piece, the one token its encoding ends with."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialscape.llm.arrays import add_columns, blobs
from trialscape.llm.tokens import Encoder, read_ranks


class Vocabulary:
    """Tokens by bytes, and which tokens may follow each other.

    Two neighbours are compatible if merging their joint bytes gives them back. In a valid
    encoding all neighbours are compatible, and only one chain of compatible tokens covers a
    given prefix, which is why one token a prefix is enough to store."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = max(self.tokens) + 1
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The plain rule: join the neighbours of the lowest rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in ranks if r is not None), default=None)
            if least is None:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one; None for a byte, and for a token that
        merging never makes, which no encoding holds."""
        if token not in self.made:
            data = self.tokens[token]
            rank = self.ranks.pop(data)
            parts = self.merged(data)
            self.ranks[data] = rank
            self.made[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made[token]

    def _stays_apart(self, a: int, b: int) -> bool:
        """Undo the joins next to the border, the latest first: at no time may the two parts at
        the border have been joined before the join that came next."""
        tokens, ranks, before = self.tokens, self.ranks, len(self.ranks) + 1
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < before:
                return False
            left, right = self.halves(a), self.halves(b)
            if left and (a > b or not right):
                before, a = a, left[1]
            elif right:
                before, b = b + 1, right[0]  # of equal ranks, the one to the left comes first
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """May token ``b`` follow ``a``? With a = -1: may ``b`` stand first?"""
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            whole = len(self.tokens[b]) == 1 or self.halves(b) is not None
            known = self.pairs[key] = whole and (a < 0 or self._stays_apart(a, b))
        return known


class Prefixes:
    """A piece and, for each of its prefixes, the last token of the prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self) -> None:
        """Find the last token of every prefix that has none yet. The automaton gives the tokens
        that end at each byte, longest first; exactly one follows what stands before it."""
        words, last = self.vocabulary, self.last
        pairs, size, sizes = words.pairs, words.size, words.sizes
        first = max(0, len(last) - words.longest)
        for stop, token in words.automaton.iter(self.data[first:].decode("latin-1")):
            end = first + stop + 1
            if end == len(last) and end - sizes[token] >= first:
                before = last[end - sizes[token]]
                fits = pairs.get(before * size + token)
                if words.follows(before, token) if fits is None else fits:
                    last.append(token)
        if len(last) <= len(self.data):
            raise ValueError("the vocabulary does not cover all bytes")

    def append(self, more: bytes) -> None:
        """Exact: what earlier prefixes end with does not change."""
        self.data += more
        self._extend()

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace a stretch of bytes. Prefixes before it stay; behind it, they are computed until
        as many neighbours as the longest token agree with the old ones. Returns how many were."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same = old[: start + 1], 0
        whole, self.data = self.data, self.data[:start]
        while len(self.last) <= len(whole) and same < self.vocabulary.longest:
            end = len(self.last)
            self.append(whole[end - 1 : end])
            same = same + 1 if end > start + len(new) and self.last[end] == old[end - shift] else 0
        done = len(self.last) - start - 1
        self.data, self.last = whole, self.last + old[len(self.last) - shift :]
        return done

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary: unsigned 32-bit, little-endian) and ``n_tokens``.

    The pieces of ``public_tokenizers.PATTERN`` are encoded each for itself, without special
    tokens. Null or empty text has no ids (empty binary, 0); repeated rows are encoded alike; an
    empty table stays empty; input columns of these names are replaced. One pass, no shuffle:
    a hot key means nothing here, and memory follows a block of documents. ``path`` must be
    readable on every executor.
    """

    def fn(column: pa.Array) -> list[pa.Array]:
        words = vocabulary(path)
        encoder = Encoder(lambda pieces: [Prefixes(words, piece).ids() for piece in pieces])
        ids, counts = [], [np.zeros(1, np.int64)]
        for _, found, begins in encoder.column(column):
            ids.append(found)
            counts.append(np.diff(begins))
        counts = np.concatenate(counts)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return [blobs(ids, np.cumsum(counts)), pa.array(counts[1:], pa.int64())]

    return add_columns(docs, text, "ids binary, n_tokens bigint", fn)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the tokens in ``ids``. Null ids give null;
    an id that the vocabulary lacks fails the job."""

    def fn(column: pa.Array) -> list[pa.Array]:
        tokens = vocabulary(path).tokens
        cells = (c.as_buffer() for c in column)
        return [pa.array(
            [None if c is None else b"".join(map(tokens.__getitem__, np.frombuffer(c, "<u4").tolist())) for c in cells],
            pa.binary(),
        )]

    return add_columns(docs, ids, "decoded binary", fn)
