"""Task and instance catalogs, context files, blocks, pages, corpora (SRC-8..12, SRC-15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape import fixed, schemas
from trialscape.functions.scalar import literal_map, variant_kind
from trialscape.sources.artifacts import path_exists

OPEN_COST = 64 << 10


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """SRC-8: tasks in catalog order; an unknown validation type or an old ``question`` field fails."""
    raw = spark.read.schema(schemas.TASK_CATALOG).option("multiLine", "true").json(f"{root}/tasks.json")
    rows = raw.select("datasetId", "version", F.posexplode("tasks").alias("ord", "t")).select(
        "datasetId",
        "version",
        "ord",
        F.trim("t.id").alias("taskId"),
        F.coalesce("t.statement", F.lit("")).alias("statement"),
        F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"),
        F.col("t.validation.type").alias("validationType"),
        F.col("t.validation").alias("validation"),
        F.coalesce("t.contextBlocks", "t.contextBlock", F.array().cast("array<string>")).alias("contextBlocks"),
        F.col("t.question").alias("question"),
    )
    wrong = ~F.coalesce(F.col("validationType").isin(*fixed.METHODS), F.lit(False)) | F.col("question").isNotNull()
    message = F.concat(F.lit("task not accepted: "), F.coalesce("taskId", F.lit("?")))
    return rows.where(F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(True)).drop("question")


def read_instances(spark: SparkSession, root: str) -> DataFrame:
    """SRC-9: one row per instance and task with its parameters; an absent file gives no rows."""
    path = f"{root}/tasks.instance.json"
    if not path_exists(spark, path):
        return spark.createDataFrame(
            [], "datasetId STRING, version STRING, instanceId STRING, contextBlocks STRING, "
            "taskId STRING, parameters MAP<STRING, STRING>"
        )
    raw = spark.read.schema(schemas.INSTANCE_CATALOG).option("multiLine", "true").json(path)
    return (
        raw.select("datasetId", "version", F.explode_outer("instances").alias("i"))
        .select("datasetId", "version", "i.instanceId", "i.contextBlocks", F.explode_outer("i.tasks").alias("t"))
        .select(
            "datasetId", "version", "instanceId", "contextBlocks",
            F.col("t.id").alias("taskId"),
            F.coalesce("t.parameters", F.create_map().cast("map<string,string>")).alias("parameters"),
        )
    )


def context_file(representation: Column, code: bool = False) -> Column:
    """File name of a representation; a name outside the aliases stands for itself."""
    aliases = fixed.CODE_CONTEXT_FILES if code else fixed.CONTEXT_FILES
    return F.coalesce(F.try_element_at(literal_map(aliases), representation), representation)


def read_contexts(spark: SparkSession, root: str, representation: str, code: bool = False) -> DataFrame:
    """SRC-10: the context of every instance in one representation."""
    aliases = fixed.CODE_CONTEXT_FILES if code else fixed.CONTEXT_FILES
    name = aliases.get(representation, representation)
    return spark.read.text(f"{root}/context/*/{name}", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "/context/([^/]+)/", 1).alias("instanceId"),
        F.lit(representation).alias("representation"),
        F.col("value").alias("content"),
    )


def missing_contexts(instances: DataFrame, contexts: DataFrame) -> DataFrame:
    """SRC-10: instances that lack the representation."""
    return instances.select("instanceId").distinct().join(contexts, "instanceId", "left_anti")


def explode_blocks(documents: DataFrame, body: str = "body") -> DataFrame:
    """SRC-11: one row per block of ``{"blocks": {...}}`` or of the flat form. Adds blockId, title,
    content: an object gives its title (else the id) and content, anything else its own text."""
    whole = F.col(body)
    inner = F.when(variant_kind(whole, "$.blocks") == "OBJECT", F.try_variant_get(whole, "$.blocks", "variant"))
    blocks = F.coalesce(inner, whole).try_cast("map<string,variant>")
    rows = documents.withColumn("__m", blocks).drop(body)
    keep = [c for c in rows.columns if c != "__m"]
    value = F.col("__v")
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return (
        rows.select(*keep, F.explode("__m").alias("blockId", "__v"))
        .where(value.isNotNull() & ~F.is_variant_null(value))
        .select(
            *keep,
            "blockId",
            F.when(is_object, F.coalesce(F.try_variant_get(value, "$.title", "string"), F.col("blockId")))
            .alias("title"),
            F.when(is_object, F.coalesce(F.try_variant_get(value, "$.content", "string"), F.lit("")))
            .otherwise(F.try_variant_get(value, "$", "string")).alias("content"),
        )
    )


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    files = read_contexts(spark, root, "blocks")
    return explode_blocks(files.select("instanceId", F.try_parse_json("content").alias("body")))


def explode_corpus(raw: DataFrame, column: str = "value") -> DataFrame:
    """SRC-12: one row per repository of a corpus document keyed by language, in order."""
    parsed = raw.select(F.from_json(column, schemas.CORPUS).alias("c"))
    return (
        parsed.select(F.explode("c").alias("language", "r"))
        .select("language", F.posexplode("r").alias("repo_ord", "r"))
        .select("language", "repo_ord", "r.*")
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: JSON, plain or gzip."""
    return explode_corpus(spark.read.text(path, wholetext=True))


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12 at scale: one repository per line with its ``language`` and ``repo_ord``, which Spark reads in splits
    (a compressed file is one)."""
    return spark.read.schema(schemas.CORPUS_LINE).json(path)


def corpus_files(repos: DataFrame) -> DataFrame:
    return repos.select("language", "repo_ord", "repo", F.explode("content").alias("path", "source"))


def corpus_needles(repos: DataFrame) -> DataFrame:
    return repos.select(
        "language", "repo_ord", "repo", F.size("needles").alias("needle_count"),
        F.posexplode("needles").alias("needle_ord", "n"),
    ).select("language", "repo_ord", "repo", "needle_count", "needle_ord", "n.*")


def decode_page(content: Column) -> Column:
    """SRC-15: UTF-8 when the bytes are valid, else Latin-1."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), content.cast("string")
    ).otherwise(F.decode(content, "ISO-8859-1"))


def small_files(spark: SparkSession) -> None:
    """Pages are files of a few kilobytes, which by default count as 4 MB each, so that a task would read a handful of
    them. A session that counts still less for a file keeps it."""
    name = "spark.sql.files.openCostInBytes"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > OPEN_COST:
        spark.conf.set(name, str(OPEN_COST))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    small_files(spark)
    return spark.read.format("binaryFile").load(path).select("path", decode_page(F.col("content")).alias("html"))


# SRC registration: the extension point is a name and a function that yields named tables.
_REGISTRY: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def register_source(name: str, loader: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
    if name in _REGISTRY:
        raise ValueError(f"source registered twice: {name}")
    _REGISTRY[name] = loader


def load_source(spark: SparkSession, name: str, root: str) -> dict[str, DataFrame]:
    if name not in _REGISTRY:
        raise KeyError(f"unknown source: {name}")
    return _REGISTRY[name](spark, root)
