"""Trace documents: one JSON file per trial, kept as VARIANT (SRC-6, SRC-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_traces(spark: SparkSession, dirs: str | list[str], kind: str) -> DataFrame:
    """``kind`` is ``executions`` or ``evals``. A file that is no JSON gives a null body."""
    names = [dirs] if isinstance(dirs, str) else list(dirs)
    return spark.read.text(
        [f"{d.rstrip('/')}/traces/{kind}/*.json" for d in names], wholetext=True
    ).select(
        F.regexp_replace(F.col("_metadata.file_path"), "/traces/[^/]+/[^/]+$", "").alias("experimentDir"),
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("trialId"),
        F.lit(kind).alias("kind"),
        F.try_parse_json("value").alias("body"),
    )


def payload(body: Column, nested: bool = True) -> Column:
    """The trace proper: below ``trace`` when the file nests it, else the document itself.
    ``nested=False`` always takes the document itself."""
    if not nested:
        return body
    return F.coalesce(F.try_variant_get(body, "$.trace", "variant"), body)


def resolve_traces(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """SRC-7: the trace a row points to, absolute or below its directory; without such a file
    the trace named after the trial. Adds ``trace``."""
    ref = F.trim("traceRef")
    target = F.when(F.length(ref) == 0, F.lit(None)).when(
        F.rlike(ref, F.lit(r"^([a-z0-9]+:)?/")), ref
    ).otherwise(F.concat(F.col("experimentDir"), F.lit("/"), ref))
    known = traces.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), "experimentDir", "trialId")
    by_path = known.select("__path", F.col("__path").alias("__hit"))
    by_id = known.select(
        F.col("experimentDir").alias("__dir"), F.col("trialId").alias("__id"), F.col("__path").alias("__named")
    )
    # paths only, so that each body is shuffled once
    chosen = (
        rows.withColumn("__target", F.regexp_replace(target, "^file:/+", "/"))
        .join(by_path, F.col("__target") == F.col("__path"), "left").drop("__path")
        .join(by_id, (F.col("experimentDir") == F.col("__dir")) & (F.col("trialId") == F.col("__id")), "left")
        .withColumn("__chosen", F.coalesce("__hit", "__named"))
    )
    bodies = traces.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), F.col("body").alias("trace"))
    return chosen.join(bodies, F.col("__chosen") == F.col("__path"), "left").drop(
        "__target", "__path", "__hit", "__dir", "__id", "__named", "__chosen"
    )
