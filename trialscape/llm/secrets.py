"""Secret scan: Boolean trigram queries derived from each rule choose the documents to verify."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialscape.llm.arrays import BLOCK, _LOWER, add_columns, flat, runs

MOST = 96
"""A literal stretch with more variants than this is cut there; the query only gets weaker."""


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three base kinds. A run of [0-9a-f] is matched whole, so asking for 32 in the
# pattern drops the same matches as a check of the length afterwards.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _trigrams(word: str) -> frozenset[bytes]:
    data = bytes(_LOWER[np.frombuffer(word.encode(), np.uint8)])
    return frozenset(data[i : i + 3] for i in range(len(data) - 2))


def _of(words: set[str]) -> list:
    """One of these words stands in the text: the weakest alternatives, or nothing if one is short."""
    options = {_trigrams(w) for w in words}
    weakest = [x for x in options if not any(y < x for y in options)]
    return [] if frozenset() in options else [sorted(weakest, key=sorted)]


def _exact(items) -> set[str] | None:
    """All strings that the items match, if they are few."""
    words = {""}
    for kind, value in items:
        if kind is op.LITERAL:
            more = {chr(value)}
        elif kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
            more = set()
            for k, v in value:
                if k is op.RANGE and v[1] - v[0] >= 8:
                    return None
                more |= {chr(v)} if k is op.LITERAL else {chr(c) for c in range(v[0], v[1] + 1)}
        elif kind is op.SUBPATTERN:
            more = _exact(value[3])
        elif kind is op.BRANCH:
            parts = [_exact(x) for x in value[1]]
            more = None if None in parts else set().union(*parts)
        elif kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 4:
            inner = _exact(value[2])
            more = None
            if inner is not None and len(inner) ** value[1] <= MOST:
                more, grown = set(), {""}
                for n in range(value[1] + 1):
                    more |= grown if n >= value[0] else set()
                    grown = {a + b for a in grown for b in inner}
        else:
            more = None
        if more is None or len(words) * len(more) > MOST:
            return None
        words = {a + b for a in words for b in more}
    return words


def trigram_query(items) -> list:
    """What a text must hold: a conjunction of disjunctions, whose alternatives are sets of
    trigrams (all of them) or conjunctions again. Empty: nothing is mandatory."""
    if isinstance(items, str):
        items = parser.parse(items, re.ASCII)
    needs, words = [], {""}
    for item in items:
        kind, value = item
        one = _exact([item])
        if one is not None and len(words) * len(one) <= MOST:
            words = {a + b for a in words for b in one}
            continue
        if kind is op.MAX_REPEAT and value[0] >= 1 and (inner := _exact(value[2])) and len(words) * len(inner) <= MOST:
            words = {a + b for a in words for b in inner}  # the first repetition follows directly
        needs += _of(words)
        words = {""} if one is None else one
        if one is not None:
            continue
        if kind is op.SUBPATTERN:
            needs += trigram_query(value[3])
        elif kind is op.BRANCH:
            parts = [trigram_query(x) for x in value[1]]
            if all(parts):
                needs.append(parts)
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            needs += trigram_query(value[2])
    return needs + _of(words)


def _all_trigrams(query) -> set[bytes]:
    if isinstance(query, frozenset):
        return set(query)
    return set().union(*[_all_trigrams(x) for x in query]) if query else set()


class Index:
    """Postings of the wanted trigrams over one shard of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, rows: int):
        low = _LOWER[data].astype(np.int32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(wanted[codes])
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[owner + 1]
        found, owner = codes[at[inside]], owner[inside]
        order = np.lexsort((owner, found))
        found, owner = found[order], owner[order]
        names, first = np.unique(found, return_index=True)
        self.rows = rows
        self.postings = {int(n): np.unique(p) for n, p in zip(names, np.split(owner, first[1:]))}

    def all_of(self, trigrams: frozenset[bytes]) -> np.ndarray:
        lists = sorted((self.postings.get(int.from_bytes(t), np.zeros(0, np.int64)) for t in trigrams), key=len)
        found = lists[0]
        for other in lists[1:]:
            found = np.intersect1d(found, other, assume_unique=True)
        return found

    def search(self, query: list) -> np.ndarray:
        """The documents that satisfy the query, in order."""
        found = np.arange(self.rows)
        for options in query:
            either = [self.all_of(x) if isinstance(x, frozenset) else self.search(x) for x in options]
            found = np.intersect1d(found, np.unique(np.concatenate(either)), assume_unique=True)
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end) in code points, by start, then in rule order.

    Matches of one rule don't overlap and are taken from the left; those of different rules may
    overlap. Each block of documents is one shard of the inverted index: postings of the mandatory
    trigrams are intersected, and only the documents that remain are matched by the rule. A rule
    without mandatory trigrams reads every text.

    Null or empty text has no spans; repeated rows each get theirs; an empty table stays empty; an
    input column named ``spans`` is replaced. Nothing is shuffled, so no key can be hot; a long
    text is one shard of its own.
    """
    compiled = [(i, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for i, r in enumerate(rules)]
    needed = sorted(set().union(*[_all_trigrams(q) for *_, q in compiled]))

    def fn(column: pa.Array) -> list[pa.Array]:
        wanted = np.zeros(1 << 24, bool)
        wanted[[int.from_bytes(t) for t in needed]] = True
        data, offsets = flat(column)
        kinds, starts, ends, counts = [], [], [], [0]
        for first, last in runs(offsets, 4 * BLOCK):
            own = offsets[first : last + 1] - offsets[first]
            index = Index(data[offsets[first] : offsets[last]], own, wanted, last - first)
            texts = column.slice(first, last - first).to_pylist()
            found: list[list] = [[] for _ in texts]
            for i, rule, pattern, query in compiled:
                for k in index.search(query) if query else range(len(texts)):
                    for m in pattern.finditer(texts[k] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[k].append((m.start(), i, m.end()))
            for spans in found:
                for start, i, end in sorted(spans):
                    kinds.append(rules[i].kind)
                    starts.append(start)
                    ends.append(end)
                counts.append(len(kinds))
        spans = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"]
        )
        return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)]

    return add_columns(docs, text, "spans array<struct<kind:string,start:bigint,end:bigint>>", fn)
