"""Line deduplication: lines that several documents share stay in the first document only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, letters A-Z in lower case (other letters as they are)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def key_hash(line: Column) -> Column:
    """128 bits of the key: two 64-bit hashes with different starting values."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, min_docs: int = 2, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``text`` reduced, and ``n_lines`` (before dropping) and ``n_dropped``.

    Texts are split at newlines. A line whose key has at least ``min_chars`` code points and
    occurs in at least ``min_docs`` documents stays in the smallest ``doc_id`` that has it (all
    its occurrences there) and goes elsewhere; the rest is joined in the old order.

    Null or empty text is one empty line and comes back empty. Rows that repeat a ``doc_id`` are
    one document for counting and each is reduced. Rows without ``doc_id`` come back whole and
    count for nothing. An empty table gives an empty result. Other columns are kept; input
    columns named ``n_lines`` or ``n_dropped`` are replaced.

    Only hashes, ids and positions meet in shuffles keyed by line. A line that a third of all
    rows share is counted before the shuffle, and its join is left to the skew split of adaptive
    execution. Positions are gathered per document, so they are bounded by its own text.
    """
    kept = docs.drop("n_lines", "n_dropped")
    ref = lambda name: F.col(f"`{name}`")
    body = F.coalesce(ref(text), F.lit(""))
    lines = kept.where(ref(doc_id).isNotNull()).select(
        ref(doc_id).alias("doc"), F.xxhash64(body).alias("print"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line")
    )
    keys = lines.where(F.char_length(line_key(F.col("line"))) >= min_chars).select(
        "doc", "print", "pos", key_hash(F.col("line")).alias("h")
    )
    keys = keys.select("doc", "print", "pos", "h.a", "h.b")
    if min_docs == 2:  # two documents: the smallest id is not the greatest
        holders = keys.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        shared = holders.where(F.col("first") != F.col("last"))
    else:
        holders = keys.select("doc", "a", "b").distinct().groupBy("a", "b")
        shared = holders.agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    shared = shared.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "first")
    goes = (
        keys.join(shared, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("doc") != F.col("first")))
        .groupBy("doc", "print")
        .agg(F.collect_set("pos").alias("__goes"))
        .select(F.col("doc").alias("__doc"), F.col("print").alias("__print"), "__goes")
    )
    joined = kept.join(goes, (ref(doc_id) == F.col("__doc")) & (F.xxhash64(body) == F.col("__print")), "left")
    split = joined.withColumn("__lines", F.split(body, "\n", -1)).withColumn("n_lines", F.size("__lines").cast("long"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__goes"))
    rest = F.array_join(F.transform(stays, lambda at: F.get(F.col("__lines"), at)), "\n")
    return split.select(
        *[
            F.when(F.col("__goes").isNull(), body).otherwise(rest).alias(c) if c == text else ref(c)
            for c in kept.columns
        ],
        "n_lines",
        F.coalesce(F.size("__goes"), F.lit(0)).cast("long").alias("n_dropped"),
    )
