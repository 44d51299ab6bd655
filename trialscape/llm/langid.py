"""Languages of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape.llm.arrays import _LOWER, add_columns, flat, mix, runs, span_hashes, word_spans

SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
"""Different labelled texts per language that the model is fitted on, and the code points taken of each."""
SLICES = 64
"""Parts, by hash, in which a language's texts are ranked before the whole."""
BUCKETS = 1 << 17
STRETCH, STRETCHES, SEQUENCES = 10, 4, 6000
"""Training sequences: so many stretches of so many words, each stretch in one language."""
SEGMENT = 64
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_WORDY = np.zeros(256, bool)
_WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start and length of each word that holds a letter's byte; and the
    offsets of documents among these words. Words end at ASCII white space."""
    data = _LOWER[data]
    starts, lengths = word_spans(data, offsets)
    inside = np.concatenate(([0], np.cumsum(_WORDY[data])))
    holds = inside[starts + lengths] > inside[starts]
    starts, lengths = starts[holds], lengths[holds]
    return data, starts, lengths, np.searchsorted(starts, offsets, "left")


class Features:
    """Rows of a weight table for words: n-grams with the word's borders (so affixes too), the
    word itself, and the lexicons that hold it."""

    def __init__(self, lexicons: list[np.ndarray]):
        self.lexicons, self.rows = lexicons, BUCKETS + len(lexicons)

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (word, row), each sorted by word."""
        size = lengths + 2
        begins = np.cumsum(size) - size
        text = np.full(int(size.sum()) + 4, 2, np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(owner)) - begins[owner]
        body = (within > 0) & (within <= lengths[owner])
        text[: len(owner)][within == 0] = 1
        text[: len(owner)][body] = data[(within - 1 + starts[owner])[body]]
        left = size[owner] - within
        found = []
        code = text[: len(owner)]
        for n in (2, 3, 4):
            code = code * np.uint64(257) + text[n - 1 : n - 1 + len(owner)]
            use = left >= n if n < 4 else (left >= n) & ((within == 0) | (left == n))
            found.append((owner[use], self._row(code[use], n)))
        names = span_hashes(data, starts, lengths)
        found.append((np.arange(len(names)), self._row(names, 9)))
        for k, lexicon in enumerate(self.lexicons):
            at = np.minimum(np.searchsorted(lexicon, names), max(len(lexicon) - 1, 0))
            held = np.flatnonzero(lexicon[at] == names) if len(lexicon) else np.zeros(0, np.int64)
            found.append((held, np.full(len(held), BUCKETS + k)))
        return found

    @staticmethod
    def _row(code: np.ndarray, salt: int) -> np.ndarray:
        return (mix(code + np.uint64(salt << 56)) % np.uint64(BUCKETS)).astype(np.int64)

    def scores(self, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), weights.shape[1]))
        for owner, row in self.of(data, starts, lengths):
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(owner, weights[row, k], len(starts))
        return out


def marginals(emission: np.ndarray, at: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The chance of each label at each word, by forward-backward over each document's chain.

    Chains are cut into segments. The transfer matrices of all segments are multiplied side by
    side, which gives the state at every cut exactly; then all segments run side by side."""
    words, labels = emission.shape
    if not words:
        return emission
    counts = np.diff(at)
    pieces = -(-counts // SEGMENT)
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - first[owner]
    begin = at[:-1][owner] + number * SEGMENT
    size = np.minimum(SEGMENT, at[1:][owner] - begin)
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(change)
    grid = np.minimum(begin[:, None] + np.arange(SEGMENT), words - 1)
    real = np.arange(SEGMENT)[None, :] < size[:, None]
    seen = e[grid]
    span = int(size.max())
    whole = np.broadcast_to(np.eye(labels), (len(owner), labels, labels)).copy()
    for k in range(span):
        step = (whole @ t) * seen[:, k, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        whole = np.where(real[:, k, None, None], step, whole)
    ahead = np.full((len(owner), labels), 1 / labels)
    behind = np.ones((len(owner), labels))
    for r in range(1, int(pieces.max(initial=0))):
        now = first[pieces > r] + r
        value = np.einsum("ni,nij->nj", ahead[now - 1], whole[now - 1])
        ahead[now] = value / value.sum(axis=1, keepdims=True)
    for r in range(int(pieces.max(initial=0)) - 2, -1, -1):
        now = first[pieces > r + 1] + r
        value = np.einsum("nij,nj->ni", whole[now + 1], behind[now + 1])
        behind[now] = value / value.sum(axis=1, keepdims=True)
    forward, backward = np.ones(seen.shape), np.ones(seen.shape)
    for k in range(span):
        value = (ahead @ t) * seen[:, k]
        ahead = np.where(real[:, k, None], value / value.sum(axis=1, keepdims=True), ahead)
        forward[:, k] = ahead
    for k in range(span - 1, -1, -1):
        backward[:, k] = behind
        value = (behind * seen[:, k]) @ t.T
        behind = np.where(real[:, k, None], value / value.sum(axis=1, keepdims=True), behind)
    both = (forward * backward)[real]
    return both / both.sum(axis=1, keepdims=True)


class Model:
    """``labels`` in order; a text's language is the label with the greatest mean chance over its words."""

    def __init__(self, labels: list[str], features: Features, weights: np.ndarray, change: np.ndarray):
        self.labels, self.features, self.weights, self.change = labels, features, weights, change

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean chances of every document, and its number of words."""
        data, starts, lengths, at = words_of(data, offsets)
        codes, names = pd.factorize(span_hashes(data, starts, lengths))
        example = np.zeros(len(names), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        emission = self.features.scores(self.weights, data, starts[example], lengths[example])[codes]
        chance = np.concatenate((marginals(emission, at, self.change).cumsum(axis=0), np.zeros((1, len(self.labels)))))
        upto = np.where(at[:, None] > 0, chance[at - 1], 0)
        counts = np.diff(at)
        return np.diff(upto, axis=0) / np.maximum(counts, 1)[:, None], counts

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        data, offsets = flat(column)
        names, scores = [], []
        for first, last in runs(offsets):
            own = offsets[first : last + 1]
            mean, counts = self.block(data[own[0] : own[-1]], own - own[0])
            best = mean.argmax(axis=1)
            texts = column.slice(first, last - first).to_pylist()
            for text, k, row, n in zip(texts, best.tolist(), mean, counts.tolist()):
                known = n > 0 and LETTER.search(text) is not None
                names.append(self.labels[k] if known else UNKNOWN)
                scores.append(min(1.0, float(row[k])) if known else 0.0)
        return names, scores


def train(texts: list[str], langs: list[str], rounds: int = 3, seed: int = 7) -> Model:
    """Fit weights and transitions on code-switched sequences made of stretches of the texts, by
    adaptive gradient steps on the conditional likelihood."""
    labels = sorted(set(langs))
    kind = np.array([labels.index(x) for x in langs])
    data, starts, lengths, at = words_of(*flat(pa.array(texts, pa.string())))
    names = span_hashes(data, starts, lengths)
    lexicons = []
    for k in range(len(labels)):
        own = [np.unique(names[at[i] : at[i + 1]]) for i in np.flatnonzero(kind == k)]
        found, docs = np.unique(np.concatenate(own), return_counts=True)
        lexicons.append(found[docs >= 3])
    features = Features(lexicons)
    rng = np.random.default_rng(seed)
    weights, change = np.zeros((features.rows, len(labels))), np.zeros((len(labels), len(labels)))
    past, past_change = np.full(weights.shape, 1e-4), np.full(change.shape, 1e-4)
    ready = [np.flatnonzero((kind == k) & (np.diff(at) > 0)) for k in range(len(labels))]
    usable = [k for k in range(len(labels)) if len(ready[k])]
    if not usable:
        return Model(labels, features, weights, change)
    batch = 100
    for _ in range(rounds * SEQUENCES // batch):
        rows, gold, ends = [], [], [0]
        for _ in range(batch):
            for k in rng.choice(usable, STRETCHES):
                doc = rng.choice(ready[k])
                begin = rng.integers(at[doc], at[doc + 1])
                part = np.arange(begin, min(begin + STRETCH, at[doc + 1]))
                rows.append(part)
                gold.append(np.full(len(part), k))
            ends.append(sum(map(len, rows[-STRETCHES:])) + ends[-1])
        rows, gold, ends = np.concatenate(rows), np.concatenate(gold), np.array(ends)
        pairs = features.of(data, starts[rows], lengths[rows])
        emission = np.zeros((len(rows), len(labels)))
        for owner, row in pairs:
            for k in range(len(labels)):
                emission[:, k] += np.bincount(owner, weights[row, k], len(rows))
        chance = marginals(emission, ends, change)
        error = np.eye(len(labels))[gold] - chance
        slope = np.zeros(weights.shape)
        for owner, row in pairs:
            for k in range(len(labels)):
                slope[:, k] += np.bincount(row, error[owner, k], features.rows)
        # transitions: those seen minus those expected from neighbouring chances
        inner = np.ones(len(rows), bool)
        inner[ends[:-1]] = False
        now = np.flatnonzero(inner)
        seen = np.zeros(change.shape)
        np.add.at(seen, (gold[now - 1], gold[now]), 1)
        e = np.exp(emission[now] - emission[now].max(axis=1, keepdims=True))
        joint = chance[now - 1][:, :, None] * np.exp(change)[None] * e[:, None, :]
        joint *= (chance[now] / np.maximum(joint.sum(axis=1), 1e-300))[:, None, :]
        turn = seen - joint.sum(axis=0) / max(joint.sum() / max(len(now), 1), 1e-300)
        slope, turn = slope / batch - 1e-5 * weights, turn / batch - 1e-4 * change
        past += slope * slope
        past_change += turn * turn
        weights += 0.2 * slope / np.sqrt(past)
        change += 0.05 * turn / np.sqrt(past_change)
    return Model(labels, features, weights.astype(np.float32), change)


def sampled(texts: DataFrame) -> DataFrame | None:
    """Rows (lang, print, text): per language the ``SAMPLE_ROWS`` different texts of least hash among those with a label
    other than ``und`` and a letter; of a longer text a stretch of ``SAMPLE_CHARS`` code points, whose place
    its hash draws.

    Equal texts count once. Only hashes are ranked, in slices first, so that a task of the second ranking sees at most
    ``SLICES * SAMPLE_ROWS`` of them; then the texts of the winners are fetched. There are ``SAMPLE_ROWS``
    texts a label: a table with 1,000 labels gives at most 400,000 stretches. Without a labelled text there is none.
    """
    marked = texts.where(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}")
    ).withColumn("print", F.xxhash64("text"))
    order = F.col("print")
    in_slice = F.row_number().over(W.partitionBy("lang", F.pmod("print", F.lit(SLICES))).orderBy(order))
    in_all = F.row_number().over(W.partitionBy("lang").orderBy(order))
    least = (
        marked.select("lang", "print").distinct()
        .withColumn("rank", in_slice).where(F.col("rank") <= SAMPLE_ROWS)
        .withColumn("rank", in_all).where(F.col("rank") <= SAMPLE_ROWS)
        .select("lang", "print").toArrow()
    )
    if not least.num_rows:
        return None
    beyond = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0))
    begin = F.pmod(F.xxhash64(F.col("print")), beyond + 1).cast("int") + 1
    fetched = marked.join(F.broadcast(texts.sparkSession.createDataFrame(least)), ["lang", "print"], "left_semi")
    stretch = F.substring("text", begin, SAMPLE_CHARS).alias("text")
    return fetched.select("lang", "print", stretch).distinct()


def labelled_sample(texts: DataFrame) -> list[Row]:
    """The rows of :func:`sampled`, in order."""
    sample = sampled(texts)
    return [] if sample is None else sample.orderBy("lang", "print", "text").collect()


def fitted(sample: DataFrame) -> Model:
    """The model of a labelled sample, fitted in a task: the driver sees weights, no texts."""

    def work(batches):
        langs, texts = [], []
        for batch in batches:
            langs += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts:
            model = train(texts, langs)
            parts = pickle.dumps((model.labels, model.features.lexicons, model.weights, model.change))
            yield pa.RecordBatch.from_arrays([pa.array([parts], pa.binary())], names=["parts"])

    in_order = sample.repartition(1).sortWithinPartitions("lang", "print", "text").select("lang", "text")
    labels, lexicons, weights, change = pickle.loads(in_order.mapInArrow(work, "parts binary").first()["parts"])
    return Model(labels, Features(lexicons), weights, change)


def identify_languages(
    docs: DataFrame, learn_from: DataFrame | None = None, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    The model is fitted on a bounded sample of ``learn_from`` (by default ``docs``), see :func:`sampled`.
    Each word's label gets its chance in the chain of all words of
    the whole text; the text's language has the greatest mean chance, which is the score (ties:
    the first in alphabetical order). Nothing but ``text`` enters a prediction.

    Null text, text without a letter, and every text if there is no labelled one, are ``und`` with
    score 0. Repeated rows are predicted alike; an empty table stays empty; input columns named
    ``lang_pred`` or ``score`` are replaced. One pass without a shuffle, besides the sample.
    """
    spark = docs.sparkSession
    learn_from = docs if learn_from is None else learn_from
    sample = sampled(learn_from.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")))
    model = spark.sparkContext.broadcast(None if sample is None else fitted(sample))

    def fn(column: pa.Array) -> list[pa.Array]:
        if model.value is None:
            names, scores = [UNKNOWN] * len(column), [0.0] * len(column)
        else:
            names, scores = model.value.predict(column)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, text, "lang_pred string, score double", fn)
