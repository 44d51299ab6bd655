"""From raw documents to packed sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape.llm import langid, lines, packing, pii, setsketch
from trialscape.session import scratch_path


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """``used`` columns and the others in one, so that no operator's column replaces them."""
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in used]).alias("others"))


def _restored(docs: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The ``columns`` of documents: those named in ``own`` from there, the others from aside."""
    return docs.select(*[own[c].alias(c) if c in own else F.col(f"others.`{c}`").alias(c) for c in columns])


LEAST_SCORE = 0.3
"""A document in which no language has this mean chance a word is rejected: it is spread over all of them."""


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those without text or letter (``und``), and those whose best
    language scores below ``LEAST_SCORE``. A missing label is filled in; a given one stays, and does not save a rejected
    document. Null and empty texts go; long ones are read whole; ties go to the first language of the alphabet; rows that
    repeat each other are judged alike; without any label, or any row, nothing is left. Other columns, also those named
    like a prediction, are untouched."""
    judged = langid.identify_languages(_aside(docs, "text"), docs.select("text", "lang"))
    known = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _restored(known, docs.columns, text=F.col("text"), lang=F.coalesce("others.lang", "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; documents stay, even if nothing is left of them. A null
    text becomes empty, long texts are split whole, rows that repeat an id are one document, an empty table stays empty. Other columns, also
    those named like a count of lines, are untouched."""
    found = lines.dedup_lines(_aside(docs, "doc_id", "text"))
    return _measured(_restored(found, docs.columns, doc_id=F.col("doc_id"), text=F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays, with all rows
    that repeat this id: they are one document. Null and empty texts are like nothing and stay; texts of fewer than five words are
    one shingle; an empty table stays empty."""
    found = setsketch.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null and empty texts and all rows stay as they are."""
    return _measured(pii.redact_personal_data(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids; a null or empty text is one end token, an empty table has no piece."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, special=packing.ADDED)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", pack),
]
#: Language ID, estimates of similarity and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    folder = scratch_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
