"""Collocations from streams of phrase counts: counted by rising length, kept in order, joined by merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trialscape.llm.arrays import flat, mix, span_hashes
from trialscape.session import scratch_path

BLOCK = 1 << 23
"""Bytes of text counted at once; a longer piece is taken whole."""
MOST_WORDS = 1 << 22
"""Bound of the filter of frequent phrases: 32 MB. More phrases fill it more densely, so that more rows are counted."""
SLICES = 32
"""A language is ranked in so many slices first, so that one task sees their best only."""
BITS = 16
"""Bits of the filter per phrase."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in blocks of about BLOCK bytes, cut between texts or at the end of a piece: (bytes, edges of texts)."""
    first = 0
    while first < len(data):
        last = min(first + BLOCK, len(data))
        edge = int(offsets[np.searchsorted(offsets, last)])
        while last < edge and _KIND[data[last]] != 2:
            ahead = np.flatnonzero(_KIND[data[last : min(last + BLOCK, edge)]] == 2)
            last = last + int(ahead[0]) if len(ahead) else min(last + BLOCK, edge)
        inner = offsets[np.searchsorted(offsets, first, "right") : np.searchsorted(offsets, last)]
        yield _LOWER[data[first:last]], inner - first
        first = last


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, the distinct words, piece of each word)."""
    kind = _KIND[data]
    inside = np.append(kind == 0, False)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    letters = np.flatnonzero(inside[:-1])
    offsets = np.append(np.searchsorted(letters, starts), len(letters))
    breaks = kind == 2
    piece = np.cumsum(breaks)[starts] + np.searchsorted(edges, starts, "right") if len(starts) else np.zeros(0, np.int64)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[letters]))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = flat(words)
    return span_hashes(data, offsets[:-1], np.diff(offsets)) if len(words) else np.zeros(0, np.uint64)


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words; the last runs are incomplete and left out."""
    out = hashes
    for k in range(1, words):
        out = mix(out[: max(0, len(hashes) - k)] * np.uint64(3) + hashes[k:])
    return out


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a hash belongs to (``size`` is a power of two) and its four bits."""
    mask = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return (hashes >> np.uint64(30)) & np.uint64(size - 1), mask


def _lang_hash(lang: str) -> np.uint64:
    return word_hashes(pa.array([f"\t{lang}"]))[0]


def _filter(frequent: DataFrame, rows: int, words: int) -> np.ndarray:
    """A Bloom filter of phrases of ``words`` words with 64-bit blocks. It only spares counting: nothing is
    decided by it."""
    size = 1 << max(10, min(MOST_WORDS.bit_length() - 1, (rows * BITS // 64).bit_length()))

    def place(batches):
        for batch in batches:
            texts = batch.column(1)
            data, offsets = flat(texts)
            spaces = np.flatnonzero(data == 32)
            starts, ends = np.sort(np.append(offsets[:-1], spaces + 1)), np.sort(np.append(offsets[1:], spaces))
            own = rolled(span_hashes(data, starts, ends - starts), words)[::words]
            langs = batch.column(0).dictionary_encode()
            salt = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
            at, mask = _bits(mix(own + salt[langs.indices.to_numpy()]), size)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(mask.view(np.int64))], names=["at", "mask"])

    set_bits = frequent.select("lang", "phrase").mapInArrow(place, "at LONG, mask LONG")
    found = set_bits.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size, np.uint64)
    out[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _counted(docs: DataFrame, words: int, known: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``words`` words whose two parts of one word less pass the
    filter. With one word also one row of a null phrase per language, the number of its words."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, texts = langs.indices.to_numpy(), batch.column(1)
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                salt = _lang_hash(lang)
                for data, edges in blocks(*flat(texts.filter(pa.array(codes == number)))):
                    phrases, counts = count_block(data, edges, salt)
                    if words == 1:
                        phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.string())])
                        counts = np.append(counts, counts.sum())
                    names = pa.DictionaryArray.from_arrays(np.zeros(len(phrases), np.int32), [lang]).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([names, phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    def count_block(data, edges, salt):
        code, distinct, piece = words_of(data, edges)
        if words == 1:
            return distinct, np.bincount(code, minlength=len(distinct))
        runs = max(0, len(code) - words + 1)
        whole = piece[:runs] == piece[words - 1 :][:runs]
        parts = mix(rolled(word_hashes(distinct)[code], words - 1) + salt)
        at, mask = _bits(parts, len(held.value))
        passes = held.value[at] & mask == mask
        first = np.flatnonzero(whole & passes[:runs] & passes[1:][:runs])
        same, counts = code[first], None
        for k in range(1, words):
            _, lead, same, counts = np.unique(
                same * len(distinct) + code[first + k], return_index=True, return_inverse=True, return_counts=True
            )
        lead = first[lead]
        return pc.binary_join_element_wise(*[distinct.take(pa.array(code[lead + k])) for k in range(words)], " "), counts

    return docs.mapInArrow(work, "lang STRING, phrase STRING, f LONG").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, min_count: int = 100, most_words: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to ``most_words`` words that occur ``min_count`` times or more
    in a language, and a row of zero words and null phrase with all its word occurrences.

    Both parts of a frequent phrase of n words that have one word less are frequent. So each length is one pass that
    counts only the runs whose two parts pass a filter of the frequent phrases before; its false hits are
    counted as well and fall to ``min_count``. Tasks add up whole blocks of text before the shuffle."""
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "phrases")
    named = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    known = None
    for words in range(1, most_words + 1):
        path = f"{folder}/words={words}"
        counted = _counted(named, words, known)
        counted.where((F.col("f") >= min_count) | F.col("phrase").isNull()).write.parquet(path)
        frequent = spark.read.schema("lang STRING, phrase STRING, f LONG").parquet(path).where("phrase IS NOT NULL")
        rows = frequent.count()
        if not rows:
            break
        if words < most_words:
            known = _filter(frequent, rows, words)
    found = spark.read.schema("lang STRING, phrase STRING, f LONG, words INT").option("basePath", folder).parquet(f"{folder}/words=*")
    return found.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(F.col("words")).alias("words"), "f")


def collocations(
    docs: DataFrame, min_count: int = 100, most_words: int = 5, percent: int = 100, top: int = 2000,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into words.
    A candidate has 2 to ``most_words`` words and a = f(phrase) >= ``min_count``. Cut after k words, its parts
    occur l and r times, its score is floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, the smallest k of
    equal ones. Candidates inside a longer candidate with 100 * f(longer) >= ``percent`` * a are dropped; it is enough to look at those
    one word longer, which are as frequent as any that hold them.

    The stream of cuts is brought into the order of their left parts, then of their right parts, and the
    stream of extensions into that of the phrases; each is merged with the stream of counts, sorted alike.
    A part that very many phrases share is one row of the counts; its join is left to the skew split.

    Null text is empty, a null language is ``und``. Repeated rows count each. Equal scores go by greater a, then by
    phrase in byte order. Empty tables or texts give no rows. Other columns are not read.
    """
    counts = phrase_counts(docs, min_count, most_words, text, lang)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    stream = counts.where("words > 0")
    candidates = stream.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    part = lambda first, size: F.array_join(F.slice(F.split("phrase", " "), first, size), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    by_left = stream.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")).hint("merge")
    by_right = stream.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")).hint("merge")
    known = cuts.join(by_left, ["lang", "left"]).join(by_right, ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    known = known.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), "under": wide("l") * wide("r")})
    scored = known.select("lang", "phrase", "a", "n", F.struct(F.expr("over div under").alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))

    inner = candidates.where("words > 2").select(
        "lang", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"), "a"
    )
    extended = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer")).hint("merge")
    swallowed = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= wide("a") * percent, F.lit(False))
    kept = lowest.join(extended, ["lang", "phrase"], "left").where(~swallowed)
    best_first = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*best_first)).cast("long")
        kept = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    ranked = kept
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
