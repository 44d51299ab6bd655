"""Readers of the append logs (SRC-1..4, SRC-13..14)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape import schemas
from trialscape.functions.scalar import is_json_object

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class RunLogs:
    """The logs of one or more experiments; ``experimentDir`` tells the rows apart."""

    manifests: DataFrame | None
    trials: DataFrame
    responses: DataFrame
    evals: DataFrame
    votes: DataFrame


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise
    return True


def _raw(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    ddl = f"{schemas.ARTIFACTS[kind]}, {schemas.LEGACY}, {CORRUPT} STRING"
    return (
        spark.read.schema(ddl)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
        .withColumn("experimentDir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", ""))
        .withColumn(
            "seq",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ),
        )
    )


def _broken() -> Column:
    """A line that is no JSON object has no field at all; naming one keeps a plain count legal."""
    return F.col(CORRUPT).isNotNull() & F.col("trialId").isNull() & ~is_json_object(CORRUPT)


def read_artifact(
    spark: SparkSession, dirs: str | list[str], kind: str, strict: bool = True, optional: bool = False
) -> DataFrame:
    """SRC-1..3: one log of one or more directories.

    ``seq`` keeps the line order of a file and can be compared. A line that is no JSON object
    fails the job that meets it when ``strict``; :func:`corrupt_lines` gives such lines with their numbers and
    :func:`require_objects` fails with them before anything is computed. A wrongly typed field reads as null. Missing files of an
    ``optional`` log give an empty table.
    """
    names = [dirs] if isinstance(dirs, str) else list(dirs)
    paths = [f"{d.rstrip('/')}/{kind}.jsonl" for d in names]
    if optional:
        paths = [p for p in paths if path_exists(spark, p)]
        if not paths:
            empty = f"{schemas.ARTIFACTS[kind]}, {schemas.LEGACY}, experimentDir STRING, " \
                "seq STRUCT<file: STRING, block: BIGINT, line: BIGINT>"
            return spark.createDataFrame([], empty)
    rows = _raw(spark, paths, kind)
    broken = _broken()
    if strict:
        message = F.concat(F.lit("not a JSON object in "), F.col("seq.file"), F.lit(": "), F.col(CORRUPT))
        rows = rows.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))
    else:
        rows = rows.where(~broken)
    return rows.drop(CORRUPT)


def corrupt_lines(spark: SparkSession, dirs: str | list[str], kind: str) -> DataFrame:
    """SRC-2: the lines that are no JSON objects: ``file``, ``line_number`` (from 1, blank lines count)
    and ``line``. Blank lines are not broken.

    A file is read in blocks by different tasks. One pass counts the lines of each block and keeps its broken ones
    with their place in the block, so no more than a block's text meets; the number of a line is its place plus the
    lines of the file's earlier blocks."""
    names = [dirs] if isinstance(dirs, str) else list(dirs)
    lines = spark.read.text([f"{d.rstrip('/')}/{kind}.jsonl" for d in names]).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    broken = (F.length(F.trim("line")) > 0) & ~is_json_object("line")
    blocks = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), F.collect_list(F.when(broken, F.struct("at", "line"))).alias("broken")
    )
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("lines").over(earlier), F.lit(0))
    shifted = blocks.select("file", (before - F.col("first") + 1).alias("shift"), "broken")
    found = shifted.select("file", "shift", F.explode("broken").alias("b"))
    return found.select("file", (F.col("b.at") + F.col("shift")).alias("line_number"), "b.line")


def require_objects(spark: SparkSession, dirs: str | list[str], kinds: list[str] | None = None, shown: int = 5) -> None:
    """SRC-2: raises ``ValueError`` with the file and line of the first broken lines of the logs that exist."""
    names = [dirs] if isinstance(dirs, str) else list(dirs)
    for kind in kinds or list(schemas.ARTIFACTS):
        there = [d for d in names if path_exists(spark, f"{d.rstrip('/')}/{kind}.jsonl")]
        found = corrupt_lines(spark, there, kind).orderBy("file", "line_number").limit(shown).collect() if there else []
        if found:
            raise ValueError("; ".join(f"{r.file}:{r.line_number}: not a JSON object: {r.line[:80]}" for r in found))


def load_runs(spark: SparkSession, dirs: list[str], check_lines: bool = False) -> RunLogs:
    """SRC-4: all logs of several experiments. One directory without trials is an error;
    among several it is skipped with a warning. ``check_lines`` reads the logs once before, to name the
    file and line of what is no JSON object."""
    from trialscape.sources.manifest import read_manifest

    found = []
    for d in dirs:
        if path_exists(spark, f"{d.rstrip('/')}/trials.jsonl"):
            found.append(d)
        elif len(dirs) == 1:
            raise ValueError(f"no trials.jsonl in {d}")
        else:
            warnings.warn(f"skipped, no trials.jsonl in {d}", stacklevel=2)
    if not found:
        raise ValueError("no directory with a trials.jsonl remains")
    if check_lines:
        require_objects(spark, found)
    return RunLogs(
        manifests=read_manifest(spark, found),
        trials=read_artifact(spark, found, "trials"),
        responses=read_artifact(spark, found, "responses", optional=True),
        evals=read_artifact(spark, found, "evals", optional=True),
        votes=read_artifact(spark, found, "judge_votes", optional=True),
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: one trial id per line; trimmed, blank lines dropped."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("trialId"))
        .where(F.length("trialId") > 0)
    )
