"""Packing of texts into token sequences: each window is filled with lexical neighbours of its seed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.llm.arrays import blobs, flat, mix
from trialscape.llm.tokens import Encoder, read_ranks
from trialscape.session import drop_scratch, scratch_path

SHARD_IDS = 1 << 20
"""Ids of a shard, about; each shard has an inverted index of its own."""
K1, B = 1.2, 0.75
KEYS, SHARP = 3, 4.0
"""Terms drawn for a document's place, and the power of a term's rarity that weighs the draw."""
COMMON = 8
"""A term that at least one in so many documents of a shard holds is scored for all of them at once."""
TOGETHER = 2048
"""Shards of at most so many documents have the scores of common terms in one product, a table of 32 MB at most;
in others each seed has a product of its own; its sums may round otherwise."""

ADDED = {"<|endoftext|>": 50256}
"""The added token of the vocabulary ``byte_bpe_50k``."""


@lru_cache(maxsize=1)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class Shard:
    """A BM25 index over documents given as token ids; ``frequency`` and ``mean`` describe the whole corpus."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, frequency: np.ndarray, documents: int, mean: float):
        # as many tasks as cores hold one each: worked in place, the narrow columns are 32 bits wide
        codes = np.repeat(np.arange(len(at) - 1) << 32, np.diff(at))
        codes |= ids
        codes.sort()
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        first = np.flatnonzero(first)
        counts = np.diff(first, append=len(codes))
        codes = codes[first]
        owner, term = (codes >> 32).astype(np.int32), codes.astype(np.int32)
        del first, codes
        below = np.diff(at)[owner] / max(mean, 1e-9)
        below *= B
        below += 1 - B
        below *= K1
        below += counts
        weight = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))[term]
        weight *= counts
        weight *= K1 + 1
        weight /= below
        del below, counts
        self.documents = len(at) - 1
        self.terms, self.weights = term, weight
        self.of = np.searchsorted(owner, np.arange(self.documents + 1))
        order = np.argsort(term, kind="stable")
        self.posting_docs, self.posting_weights = owner[order], weight[order]
        self.posting_at = np.searchsorted(term[order], np.arange(len(frequency) + 1))
        del order
        common = np.flatnonzero(np.diff(self.posting_at) * COMMON >= max(self.documents, 1))
        self.row = np.full(len(frequency), -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.documents))
        shared = self.row[term] >= 0
        self.common[self.row[term[shared]], owner[shared]] = weight[shared]
        del shared, owner
        self.table = (self.common > 0).T.astype(float) @ self.common if self.documents <= TOGETHER else None

    def neighbours(self, seed: int) -> np.ndarray:
        """The other documents that share a term with the seed, the best first; scores are compared
        to nine places, ties go to the smaller place."""
        own = self.terms[self.of[seed] : self.of[seed + 1]]
        row = self.row[own]
        if self.table is None:
            held = np.zeros(len(self.common))
            held[row[row >= 0]] = 1
            score = held @ self.common
        else:
            score = self.table[seed]
        first = self.posting_at[own[row < 0]]
        counts = self.posting_at[own[row < 0] + 1] - first
        ends = np.cumsum(counts)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)
        score = score + np.bincount(self.posting_docs[where], self.posting_weights[where], self.documents)
        score[seed] = 0
        best = np.flatnonzero(score)
        return best[np.argsort(-np.round(score[best], 9), kind="stable")]


def term_ranks(frequency: np.ndarray, documents: int) -> np.ndarray:
    """For each draw, the place of every term: a document draws its first term. Terms come by exponential clocks
    whose speed is a power of their rarity, so two documents draw alike the more often, the more rare terms they
    share. A term of a single document comes last: it has no neighbours."""
    rare = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
    speed = np.where(frequency >= 2, rare, 0) ** SHARP
    ranks = np.empty((KEYS, len(frequency)), np.int32)
    for draw in range(KEYS):
        salted = np.arange(len(frequency), dtype=np.uint64) + np.uint64((draw + 1) << 32)
        chance = ((mix(salted) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        with np.errstate(divide="ignore"):
            ranks[draw, np.argsort(-np.log(chance) / speed, kind="stable")] = np.arange(len(frequency))
    return ranks


def draws(ranks: np.ndarray, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The drawn terms of documents, each of at least one id, as places."""
    return [np.minimum.reduceat(r[ids], at[:-1]) if len(at) > 1 else r[:0] for r in ranks]


def shards_of(batches: Iterator[pa.RecordBatch], counts: int) -> Iterator[pa.Table]:
    """Whole documents of about ``SHARD_IDS`` ids at a time; column ``counts`` holds a document's number."""
    held, ids = [], 0
    for batch in batches:
        ends, first = np.cumsum(batch.column(counts).to_numpy()), 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            last = min(int(np.searchsorted(ends, before + SHARD_IDS - ids)) + 1, len(ends))
            held.append(batch.slice(first, last - first))
            ids, first = ids + int(ends[last - 1]) - before, last
            if ids >= SHARD_IDS:
                yield pa.Table.from_batches(held)
                held, ids = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(encoder: Encoder, texts: pa.Array, special: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``encoder.column``, but the ``special`` strings have ids of their own and cut their text."""
    if not special:
        yield from encoder.column(texts)
        return
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    holds = np.zeros(len(texts), bool)
    for s in special:
        holds |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
    first = 0
    for at in [*np.flatnonzero(holds).tolist(), len(texts)]:
        if at > first:
            yield from encoder.column(texts.slice(first, at - first))
        if at < len(texts):
            parts = cut.split(texts[at].as_py())
            found = []
            for _, ids, begins in encoder.column(pa.array(parts[::2], pa.large_string())):
                found += [ids[a:b] for a, b in zip(begins, begins[1:])]
            marks = [np.array([special[s]], np.uint32) for s in parts[1::2]]
            whole = np.concatenate([x for pair in zip(found, [*marks, np.zeros(0, np.uint32)]) for x in pair])
            yield 1, whole.astype(np.uint32), np.array([0, len(whole)])
        first = at + 1


def fill(shard: Shard, lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. A window's seed is the document
    at its beginning; the best unused neighbour follows, or the next unused document if none is
    left. What doesn't fit goes on in the next window, whose seed it is."""
    used = np.zeros(len(lengths), bool)
    pieces, place, sequence, seed, following, fresh = [], 0, 0, None, None, 0
    for _ in range(len(lengths)):
        doc = None
        if place and seed is not None:
            if following is None:
                following = iter(shard.neighbours(seed).tolist())
            doc = next((d for d in following if not used[d]), None)
        if doc is None:
            while used[fresh]:
                fresh += 1
            doc = fresh
        used[doc] = True
        start, left = 0, int(lengths[doc])
        if place == 0:
            seed, following = doc, None
        while left:
            take = min(left, window - place)
            pieces.append((doc, start, take, sequence, place))
            start, left, place = start + take, left - take, place + take
            if place == window:
                sequence, place = sequence + 1, 0
                seed, following = (doc, None) if left else (None, None)
    return pieces


def pack_documents(
    docs: DataFrame, path: str, pattern: str, window: int = 1024, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
    special: dict[str, int] | None = None,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ``ids`` are
    its ids as unsigned 32-bit, little-endian.

    A text's ids are followed by ``end_id``. Strings of ``special`` inside a text have the ids named there.
    Sequences have at most ``window`` ids; only the last one of a shard can be shorter. Every id is in exactly one piece.

    Null or empty text is ``end_id`` alone. Each row is a document of its own, also if it repeats
    another; a null doc_id is carried along. An empty table gives no rows; other columns are
    ignored. Equal scores go to the document that comes first in the shard. ``path`` must be readable on every executor.

    Ids are written once, with a row number. Document frequencies of the ids (a table no longer
    than the vocabulary) and the mean length come from all documents. Each document then draws a few of its terms,
    rare ones likelier, and documents are ordered by the drawn terms and the row number: lexical neighbours
    come to stand together. Ranges of that order are the tasks, and a task is cut into shards of about
    ``SHARD_IDS`` ids as it streams by, so no term, source, id or group of copies fills one.
    """
    spark = docs.sparkSession
    special = special or {}
    folder = scratch_path(spark, "packing")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(encoding(path, pattern).max_token_value, end_id, *special.values(), 0) + 1
    held = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def tokenise(batches):
        words = encoding(path, pattern)._core_bpe
        encoder = Encoder(lambda pieces: [words.encode_single_piece(p) for p in pieces])
        for batch in batches:
            first = 0
            for rows, ids, begins in encoded(encoder, batch.column(1), special):
                counts = np.diff(begins)
                at = np.concatenate(([0], np.cumsum(counts + 1)))
                whole = np.full(int(at[-1]), end_id, held)
                ends = np.zeros(len(whole), bool)
                ends[at[1:] - 1] = True
                whole[~ends] = ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(counts + 1), blobs(whole, at)], names=["doc_id", "n", "ids"]
                )
                first += rows

    def unpacked(column):
        data, at = flat(column)
        return data.view(held), at // held.itemsize

    kind = docs.schema[doc_id].dataType.simpleString()
    coded = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        tokenise, f"doc_id {kind}, n bigint, ids binary"
    )
    coded.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/ids")
    coded = spark.read.parquet(f"{folder}/ids")
    documents, total = coded.agg(F.count(F.lit(1)), F.sum("n")).first()

    def in_documents(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            ids, at = unpacked(batch.column(0))
            for a in range(0, len(batch), 64):
                b = min(a + 64, len(batch))
                met = np.zeros((b - a, size), bool)
                met[np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), ids[at[a] : at[b]]] = True
                sums += met.sum(axis=0)
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[ids])], names=["id", "docs"])

    # at most one row for each id of the vocabulary
    found = coded.select("ids").mapInArrow(in_documents, "id bigint, docs bigint").groupBy("id").agg(F.sum("docs").alias("docs")).collect()
    frequency = np.zeros(size)
    frequency[[r["id"] for r in found]] = [r["docs"] for r in found]
    corpus = spark.sparkContext.broadcast((frequency, documents, (total or 0) / max(documents, 1)))
    keys = [f"key{k}" for k in range(KEYS)]

    def draw(batches):
        ranks = term_ranks(*corpus.value[:2])
        for batch in batches:
            drawn = [pa.array(d, pa.int32()) for d in draws(ranks, *unpacked(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *drawn], names=["doc_id", "row", "n", "ids", *keys])

    # written, so that the ranges are found from the keys alone
    coded.select("doc_id", "row", "n", "ids").mapInArrow(
        draw, f"doc_id {kind}, row bigint, n bigint, ids binary, " + ", ".join(f"{k} int" for k in keys)
    ).write.parquet(f"{folder}/dealt")
    drop_scratch(spark, f"{folder}/ids")
    dealt = spark.read.parquet(f"{folder}/dealt")
    shards = max(1, (total or 0) // SHARD_IDS)
    tasks = min(shards, max(parts, shards // 16))
    places = [*keys, "row"]

    def pack(batches):
        sequences = TaskContext.get().partitionId() << 32
        for group in shards_of(batches, 1):
            ids, at = unpacked(group.column(2))
            lengths = np.diff(at)
            doc, start, length, sequence, offset = np.array(fill(Shard(ids, at, *corpus.value), lengths, window), np.int64).T
            cells = np.concatenate(([0], np.cumsum(length)))
            which = np.repeat(at[doc] + start - cells[:-1], length)
            which += np.arange(cells[-1])
            yield from pa.table({
                "doc_id": group.column(0).take(pa.array(doc)), "start": start, "length": length,
                "ids": blobs(ids[which].astype("<u4"), cells), "doc_tokens": lengths[doc],
                "sequence_id": sequences + sequence, "offset": offset,
            }).combine_chunks().to_batches()
            sequences += int(sequence[-1]) + 1

    return dealt.repartitionByRange(tasks, *places).sortWithinPartitions(*places).select("doc_id", "n", "ids").mapInArrow(
        pack, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
