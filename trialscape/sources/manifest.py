"""Manifest of an experiment as dimension tables (SRC-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape import schemas
from trialscape.functions.scalar import first_string


def read_manifest(spark: SparkSession, dirs: str | list[str]) -> DataFrame:
    names = [dirs] if isinstance(dirs, str) else list(dirs)
    return (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", "true")
        .json([f"{d.rstrip('/')}/manifest.json" for d in names])
        .withColumn("experimentDir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", ""))
    )


def configurations(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "experimentDir", "experimentId", F.explode("configurations").alias("configurationId", "d")
    ).select("experimentDir", "experimentId", "configurationId", "d.*")


def surfaces(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "experimentDir", "experimentId", F.explode("surfaces").alias("surface", "d")
    ).select("experimentDir", "experimentId", "surface", "d.*")


def judges(manifest: DataFrame) -> DataFrame:
    """Configured judges in order. A judge is named by its parameters, else ``provider:model``."""
    named = [F.try_element_at(F.col("j.params"), F.lit(k)) for k in ("id", "judgeId", "judge_id", "name")]
    return manifest.select(
        "experimentDir", "experimentId", F.posexplode("evaluation.judges").alias("ord", "j")
    ).select(
        "experimentDir",
        "experimentId",
        "ord",
        F.coalesce(first_string(*named), F.concat_ws(":", "j.provider", "j.model")).alias("judgeId"),
        "j.provider",
        "j.model",
    )
