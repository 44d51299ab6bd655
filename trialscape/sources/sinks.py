"""Writers (SNK-*). Every writer is a distributed Spark write; a table becomes a folder of parts."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from functools import partial, reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscape import fixed
from trialscape.functions.scalar import col, file_slug, first_usable, sorted_by


@F.pandas_udf(T.StringType())
def _exact(numbers: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) else str(int(x)) if x.is_integer() else f"{x:.6g}" for x in numbers], dtype=object
    )


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction, others with six significant digits and no padding zeros.

    The JVM rounds the printed decimal, the contract rounds the binary value. They differ only where
    the seventh digit is a lone 5, and only those numbers, and those beyond 2^53, go to Python."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "E.*$", ""), "[-.]", ""), "^0+", "")
    tie = F.rlike(digits, F.lit("^[0-9]{6}5$"))
    short = F.format_string("%.6g", c)
    fixed = F.regexp_replace(F.regexp_replace(short, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(short, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    huge = F.abs(c) >= float(2**53)
    fraction = F.when(F.contains(short, F.lit("e")), science).otherwise(fixed)
    plain = F.when(~huge & (c == F.floor(c)), c.try_cast("bigint").cast("string")).otherwise(fraction)
    return F.when(c.isNotNull(), F.coalesce(_exact(F.when(huge | (tie & (c != F.floor(c))), c)), plain))


def csv_value(c: Column | str, data_type: T.DataType) -> Column:
    """SNK-1: canonical text of a cell; null stays null and is written as an empty cell."""
    value = col(c)
    if isinstance(data_type, T.BooleanType):
        return F.when(value, F.lit("true")).when(~value, F.lit("false"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return number_text(value.cast("double"))
    return value.cast("string")


def csv_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[csv_value(n, types[n]).alias(n) for n in names])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    (
        csv_table(df, columns)
        .write.mode(mode)
        .option("header", "true")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("lineSep", "\n")
        .csv(path)
    )


def sorted_fields(c: Column, data_type: T.DataType) -> Column:
    """The value with the fields of every struct in name order."""
    if isinstance(data_type, T.StructType):
        ordered = sorted(data_type.fields, key=lambda f: f.name)
        parts = [sorted_fields(c[f.name], f.dataType).alias(f.name) for f in ordered]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, data_type.elementType))
    return c


def write_jsonl(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """SNK-3: one object per line, keys sorted at every level, nulls kept. Logs repeat their keys in every line;
    ``compression="gzip"`` is read back like plain parts, each part by one task."""
    ordered = sorted(df.schema.fields, key=lambda f: f.name)
    rows = df.select(*[sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in ordered])
    rows.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).json(path)


def write_summary(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-4: the one-row summary as a JSON document."""
    names = sorted(df.columns)
    df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def metrics_manifest(
    trials: DataFrame, responses: DataFrame, evals: DataFrame, votes: DataFrame, manifests: DataFrame | None = None
) -> DataFrame:
    """SNK-5: rows per log and input directory, with the identity of the experiment."""
    tagged = [
        df.select("experimentDir", F.lit(name).alias("log"))
        for name, df in (
            ("trials", trials), ("responses", responses), ("evaluations", evals), ("judgeVotes", votes),
        )
    ]
    counts = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("experimentDir")
        .agg(
            *[
                F.count_if(F.col("log") == n).alias(n)
                for n in ("trials", "responses", "evaluations", "judgeVotes")
            ]
        )
    )
    identity = trials.groupBy("experimentDir").agg(
        F.min("experimentId").alias("experimentId"),
        F.min("dataset.id").alias("datasetId"),
        F.min("dataset.version").alias("datasetVersion"),
    )
    table = counts.join(identity, "experimentDir", "left")
    if manifests is not None:
        content = manifests.select("experimentDir", F.col("dataset.contentHash").alias("datasetContentHash"),
                                   F.col("dataset.resolvedRevision").alias("datasetResolvedRevision"))
        table = table.join(content, "experimentDir", "left")
    return table


def run_manifest(
    inputs: DataFrame, group_by: list[str], selectors: dict[str, list[str]] | None = None, command: str = "metrics",
    configurations: DataFrame | None = None,
) -> DataFrame:
    """SNK-5: one row, the manifest of a metrics run: framework, selectors, grouping, the inputs of
    :func:`metrics_manifest` with the configurations of their manifest, and the files written. Bounded by the number of
    directories and their configurations."""
    rows = inputs
    if configurations is not None:
        definition = F.struct("strategy", "representation", "surface")
        entry = F.array_sort(F.collect_list(F.struct("configurationId", definition.alias("d"))))
        own = configurations.groupBy("experimentDir").agg(F.map_from_entries(entry).alias("configurations"))
        rows = rows.join(own, "experimentDir", "left")
    chosen = F.from_json(F.lit(json.dumps(selectors or {})), "map<string,array<string>>")
    listed = rows.agg(sorted_by(F.collect_list(F.struct(*rows.columns)), "experimentDir").alias("inputs"))
    return listed.select(
        F.lit("2.0").alias("schemaVersion"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generatedAt"),
        F.lit(command).alias("command"),
        F.struct(F.lit("HELM").alias("inspiredBy"), F.array(*map(F.lit, fixed.CORE_DIMENSIONS)).alias("coreDimensions")).alias("metricFramework"),
        chosen.alias("selectors"), F.array(*map(F.lit, group_by)).cast("array<string>").alias("groupBy"),
        "inputs", F.array(*map(F.lit, fixed.METRIC_OUTPUTS)).alias("outputs"),
    )


def write_split(df: DataFrame, path: str, model: str = "modelId", configuration: str = "configurationId",
                mode: str = "error") -> None:
    """SNK-6: one folder per model and configuration. Big groups are split into several files
    of balanced size, small ones are gathered."""
    labelled = df.withColumn("modelSlug", file_slug(F.coalesce(model, F.lit("model"))))
    (
        labelled.hint("rebalance", "modelSlug", configuration)
        .write.mode(mode)
        .partitionBy("modelSlug", configuration)
        .json(path)
    )


def split_with_reason(
    df: DataFrame, rules: list[tuple[Column, str]]
) -> tuple[DataFrame, DataFrame]:
    """SNK-7: rows that pass, and rows that do not with the first reason that applies."""
    reason = reduce(
        lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[1])).otherwise(rest),
        reversed(rules),
        F.lit(None).cast("string"),
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def scorer_candidates(
    responses: DataFrame,
    native: DataFrame,
    success_only: bool = True,
    representations: list[str] | None = None,
    configurations: list[str] | None = None,
    strategies: list[str] | None = None,
) -> DataFrame:
    """JON-10: responses with their native task and, where one is missing, the reason."""
    from trialscape.operators.select import successful

    marked = responses.withColumn("__ok", successful(responses)).withColumn(
        "__text", first_usable("response")
    )
    tasks = native.withColumn("__native", F.struct(*native.columns)).select("instanceId", "__native")
    joined = marked.join(tasks, "instanceId", "left")
    rules: list[tuple[Column, str]] = []
    if success_only:
        rules.append((~F.col("__ok"), "response_not_successful"))
    for values, column, name in (
        (representations, "representation", "representation_filtered"),
        (configurations, "configurationId", "configuration_filtered"),
        (strategies, "strategy", "strategy_filtered"),
    ):
        if values:
            rules.append((~F.coalesce(F.col(column).isin(*values), F.lit(False)), name))
    rules += [
        (F.coalesce(F.length(F.trim("instanceId")), F.lit(0)) == 0, "missing_instance_id"),
        (F.col("__native").isNull(), "missing_native_task"),
        (F.col("__text").isNull(), "missing_response_text"),
    ]
    ok, skipped = split_with_reason(joined, rules)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped).drop("__ok")


def to_scorer_rows(responses: DataFrame, native: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """SNK-11: native task columns, ``output`` with the response and the identity of the run;
    and the rows left out with their reason."""
    rows = scorer_candidates(responses, native, **options)
    identity = [
        c for c in (
            "trialId", "experimentId", "instanceId", "taskId", "modelId", "modelName", "provider",
            "configurationId", "strategy", "representation", "repeatIndex", "usage", "metricsSummary",
        ) if c in responses.columns
    ]
    exported = rows.where("reason IS NULL").select(
        "__native.*", F.array("__text").alias("output"), F.struct(*identity).alias("run")
    )
    left_out = [c for c in ("trialId", "instanceId", "taskId", "modelId", "configurationId") if c in rows.columns]
    return exported, rows.where("reason IS NOT NULL").select(*left_out, "reason")


def write_tables(tables: dict[str, DataFrame], folder: str, force: bool = False, fmt: str = "csv") -> list[str]:
    """SNK-9, SNK-10: one folder per named table. A target that exists is refused unless forced."""
    mode = "overwrite" if force else "error"
    for name, df in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, target, mode=mode)
        else:
            df.write.mode(mode).format(fmt).save(target)
    return list(tables)


def _write_files(root: str, rows) -> None:
    """The rows of a task as files of a folder that appears when all are written; the first attempt's stays."""
    own, n = f"{root}/.{uuid.uuid4().hex}", 0
    for row in rows:
        if n == 0:
            os.makedirs(own)
        with open(f"{own}/{n:09d}.txt", "wb") as f:
            f.write((row.value or b"") + b"\n")
        n += 1
    if n:
        try:
            os.rename(own, f"{root}/part={TaskContext.get().partitionId()}")
        except OSError:
            if not os.path.isdir(f"{root}/part={TaskContext.get().partitionId()}"):
                raise
            shutil.rmtree(own)


def local_folder(spark, path: str) -> str | None:
    """The folder as the operating system names it, if it lies in a (shared) file system and not in a store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return target.toUri().getPath() if scheme == "file" else None


def write_each(values: DataFrame, path: str) -> None:
    """Every ``value`` as a file of its own in a new folder, ended by a line break; a null is an empty line. Each task has
    its own folder, so files are neither renamed nor listed one by one in the driver. In a file system tasks write them
    by themselves, as Hadoop starts a process or two a file to set its mode."""
    folder = local_folder(values.sparkSession, path)
    if folder is None:
        values.select("value", F.spark_partition_id().alias("part")).write.partitionBy("part").option("maxRecordsPerFile", "1").text(path)
        return
    os.makedirs(folder)
    values.select(F.col("value").cast("binary")).rdd.foreachPartition(partial(_write_files, folder))
