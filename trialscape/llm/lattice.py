"""Likelihood of texts over all segmentations of their words into the pieces of a vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.llm.arrays import flat
from trialscape.session import scratch_path

CHUNK_BYTES = 16 << 20
"""Text that shares one table of its distinct words."""
MARK = "▁"
ROWS_OUT = 50_000


@lru_cache(maxsize=1)
def pieces_of(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Natural logarithms of piece probabilities, and the marginal of a word."""

    def __init__(self, pieces: dict[str, float], byte: list[float], end: float):
        self.pieces, self.byte, self.end = pieces, byte, end
        self.longest = max(map(len, pieces), default=1)

    def word(self, word: str) -> float:
        """Forward recursion: the total weight of all ways to reach each position from the word's
        beginning, in logarithms. A character may always be spelled by its bytes."""
        text = MARK + word
        get, byte, longest = self.pieces.get, self.byte, self.longest
        ahead = [0.0]
        for stop in range(1, len(text) + 1):
            char = text[stop - 1]
            ways = [ahead[-1] + (byte[ord(char)] if char < "\x80" else sum(byte[b] for b in char.encode()))]
            for start in range(max(0, stop - longest), stop):
                weight = get(text[start:stop])
                if weight is not None:
                    ways.append(ahead[start] + weight)
            top = max(ways)
            ahead.append(top if len(ways) == 1 else top + math.log(sum([math.exp(x - top) for x in ways])))
        return ahead[-1]


def estimate(counts: dict[int, int], texts: int, path: str) -> Lattice:
    """Piece probabilities from counts in the training texts, one added to each: of all ordinary
    pieces, of the 256 bytes, and of the end of a text."""
    vocabulary = pieces_of(path)
    ordinary, byte = {}, {}
    for i in range(vocabulary.get_piece_size()):
        if vocabulary.is_byte(i):
            byte[int(vocabulary.id_to_piece(i)[3:-1], 16)] = i
        elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i)):
            ordinary[vocabulary.id_to_piece(i)] = i
    if not byte:
        byte = {b: -1 - b for b in range(256)}
    total = math.log(sum(counts.values()) + texts + len(ordinary) + len(byte) + 1)
    weight = lambda i: math.log(counts.get(i, 0) + 1) - total
    # a piece that crosses words can't stand in one
    inside = {p: weight(i) for p, i in ordinary.items() if MARK not in p[1:]}
    return Lattice(inside, [weight(byte[b]) for b in range(256)], math.log(texts + 1) - total)


def score_documents(docs: DataFrame, training: str, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, trains, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Tokens are runs of anything but ASCII white space, A-Z in lower case, and one end a text.
    ``training`` is a condition (SQL) on the rows to learn from; null counts as false. From them come
    the counts of all words (for ``n_known`` and ``base_score``, the sum of log10((c + 1) / (N + V + 1)))
    and the probabilities of the vocabulary's pieces: each distinct word is cut by the vocabulary's
    existing scores and its pieces count as often as the word. ``score`` is the log10 probability of
    the text: the product over its words of the sum over all segmentations, and the end.

    Null or empty text is its end alone. Without training rows N and V are 0. Repeated rows are
    scored alike; an empty table gives no rows; other columns are ignored. ``path`` must be readable
    on every executor.

    Texts are dealt into chunks by hash. Only the distinct words of a chunk are counted, joined to
    the corpus counts, and sent back to it; no table of words goes to the driver or to all tasks.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "lattice")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.expr(training), F.lit(False)).alias("trains"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = own.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("trains"), 1))).first()
    chunks, texts = max(1, (size[0] or 0) // CHUNK_BYTES), size[1]
    own = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def texts_of(column: pa.Array):
        data, at = flat(column)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield data[a:b].tobytes().lower().split()

    def count(batches):
        now, train, other = None, Counter(), set()

        def result():
            found = [*train.items(), *((w, 0) for w in other.difference(train))]
            for a in range(0, len(found), ROWS_OUT):
                part = found[a : a + ROWS_OUT]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), now, np.int64)), pa.array([w for w, _ in part], pa.binary()),
                        pa.array([n for _, n in part], pa.int64()),
                    ],
                    names=["chunk", "word", "n"],
                )

        for batch in batches:
            for chunk, trains, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                if chunk != now:
                    yield from result()
                    now, train, other = chunk, Counter(), set()
                if trains:
                    train.update(words)
                else:
                    other.update(words)
        yield from result()

    dealt = own.select("chunk", "trains", "text").repartition(parts, "chunk").sortWithinPartitions("chunk")
    dealt.mapInArrow(count, "chunk bigint, word binary, n bigint").write.parquet(f"{folder}/uses")
    uses = spark.read.parquet(f"{folder}/uses")
    uses.groupBy("word").agg(F.sum("n").alias("c")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    known = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = (known[0] or 0) + texts, known[1] + (texts > 0)

    def cut(batches):
        vocabulary, sums = pieces_of(path), None
        for batch in batches:
            listed = [w.decode() for w in batch.column(0).to_pylist()]
            found = vocabulary.encode(listed, num_threads=1)
            weight = np.repeat(batch.column(1).to_numpy(), list(map(len, found)))
            flat_ids = np.fromiter((i for ids in found for i in ids), np.int64, len(weight))
            more = np.bincount(flat_ids, weight, vocabulary.get_piece_size())
            sums = more if sums is None else sums + more
        if sums is not None:
            ids = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[ids].astype(np.int64))], names=["piece", "n"])

    counted = words.where("c > 0").select("word", "c").mapInArrow(cut, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    # at most one row for each piece of the vocabulary
    lattice = spark.sparkContext.broadcast(estimate({r["piece"]: r["n"] for r in counted.collect()}, texts, path))

    def weigh(batches):
        for batch in batches:
            marginal = lattice.value.word
            scores = [marginal(w.decode()) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["word2", "c", "lp"])

    weighed = words.select("word", "c").mapInArrow(weigh, "word2 binary, c bigint, lp double")
    looked = uses.select("chunk", "word").join(weighed, F.col("word") == F.col("word2"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tagged = looked.select(
        "chunk", F.lit(0).alias("role"), "word", "c", "lp", none(own.schema["doc_id"].dataType, "doc_id"), none("boolean", "trains"), none("string", "text")
    ).unionByName(own.select(
        "chunk", F.lit(1).alias("role"), none("binary", "word"), none("bigint", "c"), none("double", "lp"), "doc_id", "trains", "text"
    ))
    tagged = tagged.repartition(parts, "chunk").sortWithinPartitions("chunk", "role")
    rest = math.log10(total + kinds + 1)
    end_known, end_base, end_score = int(texts > 0), math.log10(texts + 1) - rest, lattice.value.end / math.log(10)

    def score(batches):
        now, place, base, lp, seen = None, {}, [], [], []
        joined = None
        for batch in batches:
            chunk, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, place, base, lp, seen, joined = chunk[a], {}, [], [], [], None
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    place.update(zip(part.column(2).to_pylist(), range(len(place), len(place) + len(part))))
                    c = part.column(3).to_numpy()
                    base.append(np.log10(c + 1) - rest)
                    seen.append(c > 0)
                    lp.append(part.column(4).to_numpy())
                    continue
                if joined is None:
                    joined = [np.concatenate(x) if x else np.zeros(0) for x in (base, lp, seen)]
                out = [[], [], [], []]
                for listed in texts_of(part.column(7)):
                    at = np.fromiter(map(place.__getitem__, listed), np.int64, len(listed))
                    out[0].append(len(listed) + 1)
                    out[1].append(int(joined[2][at].sum()) + end_known)
                    out[2].append(float(joined[0][at].sum()) + end_base)
                    out[3].append(float(joined[1][at].sum()) + end_score)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(5), part.column(6), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                        pa.array(np.full(len(part), total, np.int64)), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()),
                    ],
                    names=["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = own.schema["doc_id"].dataType.simpleString()
    return tagged.mapInArrow(
        score,
        f"doc_id {kind}, trains boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
