"""Pretokens and token ids of whole documents: pieces are cut with array operations, and each
distinct piece of a block is encoded once."""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from trialscape.llm.arrays import flat, runs, span_hashes

REMEMBERED = 500_000
"""Pieces whose ids a worker remembers before it starts afresh; results don't depend on it."""

LETTER, NUMBER, BLANK = 1, 2, 3
_classes: np.ndarray | None = None


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: a token in base64 and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def char_classes() -> np.ndarray:
    """Letter, number, white space or none of them, for every code point."""
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((first.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        blanks = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        _classes[blanks] = BLANK
    return _classes


def piece_starts(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pieces begin, by the rule of ``public_tokenizers.PATTERN``: a contraction's end; one
    space or none with letters, with numbers, or with other signs; white space up to the last
    blank before a sign; other white space. ``edges``: where documents begin."""
    size = len(chars)
    kind = char_classes()[chars]
    begins = np.ones(size, bool)
    begins[1:] = kind[1:] != kind[:-1]
    fresh = np.zeros(size + 3, bool)  # a document begins here; past the end counts as one
    fresh[edges[edges < size]] = True
    fresh[size:] = True
    begins |= fresh[:size]
    # a run of blanks gives its last blank away: a space joins the next piece, others stand alone
    after = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~fresh[1:size]) + 1
    begins[after - 1] = True
    begins[after[chars[after - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll at the start of a piece
    padded = np.concatenate((chars, np.zeros(3, chars.dtype)))
    for at in np.flatnonzero((chars == 39) & begins):
        a, b = (chr(c) for c in padded[at + 1 : at + 3])
        if fresh[at + 1]:
            continue
        length = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") and not fresh[at + 2] else 0
        if length:
            begins[at + 1] = False
            if at + 1 + length < size:
                begins[at + 1 + length] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of documents; ``encode`` gives the ids of pieces, each a stretch of bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode, self.known = encode, {}

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and where each document's ids begin among them."""
        text = data.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        edges = heads[offsets]
        starts = piece_starts(chars, edges)
        lengths = np.diff(np.append(starts, len(chars)))
        codes, names = pd.factorize(span_hashes(chars, starts, lengths))
        example = np.empty(len(names), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, names = self.known, names.tolist()
        firsts, sizes = starts[example].tolist(), lengths[example].tolist()
        new = [(n, a, k) for n, a, k in zip(names, firsts, sizes) if n not in known]
        for (n, _, _), found in zip(new, self.encode([text[a : a + k].encode() for _, a, k in new])):
            known[n] = array("I", found).tobytes()
        ids = [known[n] for n in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        which = np.arange(ends[-1]) + np.repeat(begins[codes] - (ends - counts), counts)
        before = np.concatenate(([0], ends))
        return pool[which], before[np.searchsorted(starts, edges, "left")]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For blocks of a column: the number of rows, their ids and where each row's begin."""
        data, offsets = flat(texts)
        for first, last in runs(offsets):
            own = offsets[first : last + 1]
            yield last - first, *self.block(data[own[0] : own[-1]], own - own[0])
