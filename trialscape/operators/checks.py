"""Data-quality checks (VAL-*). A check returns the offending keys; nothing is raised by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import sha256_normal
from trialscape.operators.facts import method_consistent  # noqa: F401  VAL-10
from trialscape.operators.metrics import pooled  # noqa: F401  VAL-16

TREATMENT = ["configurationId", "strategy", "representation", "surface"]


def _rows(df: DataFrame, rule: str, key: Column | str, detail: Column | str) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"),
        (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"),
    )


def dup_within(trials: DataFrame, source: str = "experimentDir") -> DataFrame:
    """VAL-1: ids that occur twice in one log."""
    return trials.where(F.length("trialId") > 0).groupBy(source, "trialId").agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1")


def dup_across(trials: DataFrame, source: str = "experimentDir") -> DataFrame:
    """VAL-2: ids that occur in several inputs."""
    pairs = trials.where(F.length("trialId") > 0).select("trialId", source).distinct()
    return pairs.groupBy("trialId").agg(
        F.count(F.lit(1)).alias("inputs"), F.min(source).alias("first"), F.max(source).alias("last")
    ).where("inputs > 1")


def with_config(rows: DataFrame, configurations: DataFrame, name: str = "definition") -> DataFrame:
    """JON-20: rows with the definition (strategy, representation, surface) that the manifest gives their configuration
    as a struct ``name``; null where the manifest has none. Rows of several experiments meet the manifest of their own if both
    sides have ``experimentId``."""
    keys = [k for k in ("experimentId", "configurationId") if k in rows.columns and k in configurations.columns]
    d = configurations.select(*keys, F.struct(*TREATMENT[1:]).alias(name)).distinct()
    return rows.join(d, keys, "left").select(*rows.columns, name)


def bad_treatments(rows: DataFrame, configurations: DataFrame) -> DataFrame:
    """VAL-3: rows whose configuration, strategy, representation or surface differs from the
    manifest, at the top level or in ``metadata``."""
    joined = with_config(rows, configurations, "__d").where(F.col("__d").isNotNull())
    wrong = ~F.col("metadata.configurationId").eqNullSafe(F.col("configurationId"))
    for c in TREATMENT[1:]:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__d.{c}")) | ~F.col(f"metadata.{c}").eqNullSafe(F.col(f"__d.{c}"))
    return joined.where(wrong).select("trialId", "configurationId")


def treatment_conflicts(rows: DataFrame) -> DataFrame:
    """VAL-4: trials with more than one treatment over all their rows."""
    return rows.select("trialId", F.struct(*TREATMENT).alias("t")).groupBy("trialId").agg(
        F.min("t").alias("a"), F.max("t").alias("b")
    ).where("a != b").select("trialId")


def config_conflicts(configurations: DataFrame) -> DataFrame:
    """VAL-5: configuration ids with several definitions."""
    return configurations.select("configurationId", F.struct(*TREATMENT[1:]).alias("d")).groupBy("configurationId").agg(
        F.count_distinct("d").alias("definitions")
    ).where("definitions > 1")


def unknown_config(rows: DataFrame, configurations: DataFrame) -> DataFrame:
    """VAL-6: rows with a configuration outside the manifest, or with the old ``format`` field."""
    known = configurations.select("configurationId", F.lit(True).alias("__known")).distinct()
    legacy = F.col("format").isNotNull() if "format" in rows.columns else F.lit(False)
    return rows.join(known, "configurationId", "left").where(F.col("__known").isNull() | legacy).select(
        "trialId", "configurationId"
    )


def legacy_rows(rows: DataFrame) -> DataFrame:
    """SRC-1: rows that carry a column of the old log format."""
    present = [c for c in fixed.LEGACY_COLUMNS if c in rows.columns]
    hit = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in present], F.lit(False))
    return rows.where(hit).select("trialId")


def not_responses(rows: DataFrame) -> DataFrame:
    """SRC-1: rows of a response log without status and timing."""
    return rows.where(F.col("status").isNull() & F.col("timing").isNull()).select("trialId")


def bad_versions(manifests: DataFrame) -> DataFrame:
    """Manifests whose contract version is not the integer 2."""
    v = F.col("provisioningArtifactVersion")
    whole = F.schema_of_variant(v) == "BIGINT"
    good = F.coalesce(whole & (F.try_variant_get(v, "$", "bigint") == fixed.CONTRACT_VERSION), F.lit(False))
    return manifests.where(~good).select("experimentDir")


def bad_tags(trials: DataFrame) -> DataFrame:
    """VAL-8."""
    return trials.where(F.exists("taskTags", lambda t: F.contains(t, F.lit("|")))).select("trialId", "taskTags")


def unknown_values(facts: DataFrame | None = None, votes_long: DataFrame | None = None) -> DataFrame:
    """VAL-9: each rating, evaluation status and method outside the contract, once."""
    parts = []
    if facts is not None:
        for column, known in (("evaluation_status", fixed.EVALUATION_STATUSES), ("evaluation_method", fixed.METHODS)):
            value = F.col(column)
            parts.append(facts.where(value.isNotNull() & ~value.isin(*known)).select(
                F.lit(column).alias("kind"), value.alias("value")))
    if votes_long is not None:
        value = F.col("rating")
        parts.append(votes_long.where(value.isNotNull() & ~value.isin(*fixed.RATINGS)).select(
            F.lit("rating").alias("kind"), value.alias("value")))
    return reduce(DataFrame.unionByName, parts).distinct()


def materialization_conflicts(records: DataFrame) -> DataFrame:
    """VAL-12: a dataset version with several contents."""
    content = F.struct(F.coalesce("contentHash", F.lit("")), F.coalesce("verifiedSha256", F.lit("")))
    return records.groupBy("datasetId", "version").agg(F.count_distinct(content).alias("contents")).where("contents > 1")


def missing_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """VAL-13: per trial the asked blocks its instance does not have, in the order asked."""
    asked = rows.select("trialId", "instanceId", F.posexplode("contextBlocks").alias("pos", "blockId"))
    absent = asked.join(blocks.select("instanceId", "blockId").distinct(), ["instanceId", "blockId"], "left_anti")
    return absent.groupBy("trialId").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "blockId"))), lambda x: x["blockId"]), ", ")
        .alias("missing")
    )


def hash_mismatch(files: DataFrame, content: str = "content", expected: str = "expected") -> DataFrame:
    """VAL-15: rows whose content hash is not the expected one; an unreadable expectation is reported too."""
    actual = F.sha2(F.col(content), 256)
    return files.withColumn("actual", actual).where(~F.col("actual").eqNullSafe(sha256_normal(expected)))


#: Rules on single rows, as bits of a group's set.
_METADATA, _TAG, _LEGACY, _NO_RESPONSE = 1, 2, 4, 8


def _marked(df: DataFrame, log: str) -> DataFrame:
    """Narrow rows of a log: id, directory, treatment, a tag list with a pipe, and the bits of the broken rules."""
    differs = reduce(lambda a, b: a | b, [~F.col(f"metadata.{c}").eqNullSafe(F.col(c)) for c in TREATMENT])
    tagged, legacy, empty = F.lit(False), F.lit(False), F.lit(False)
    if log == "trials":
        tagged = F.coalesce(F.exists("taskTags", lambda t: F.contains(t, F.lit("|"))), F.lit(False))
    if log != "evals":
        legacy = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fixed.LEGACY_COLUMNS if c in df.columns], legacy)
    if log == "responses":
        empty = F.col("status").isNull() & F.col("timing").isNull()
    bits = ((differs, _METADATA), (tagged, _TAG), (legacy, _LEGACY), (empty, _NO_RESPONSE))
    return df.select(
        "trialId", "experimentDir", *TREATMENT,
        F.when(tagged, F.array_join("taskTags", ",") if log == "trials" else F.lit("")).alias("tags"),
        F.lit(int(log == "trials")).alias("planned"),
        reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, bit).otherwise(0) for c, bit in bits]).alias("bits"),
    )


def contract_violations(trials: DataFrame, responses: DataFrame, evals: DataFrame, manifests: DataFrame) -> DataFrame:
    """VAL-1..8 over loaded logs as one table (rule, key, detail): a row for each trial, directory and treatment that
    breaks a rule on rows, one for each trial that breaks a rule on trials.

    Each log is read once. Rows become the set of their broken rules, merged by ``bit_or`` with the treatments and directories of a trial; what is
    left, a row for each different treatment in a directory, meets the manifests' definitions, and the
    rules on several rows of a trial are windows over it."""
    from trialscape.sources.manifest import configurations

    definitions = configurations(manifests)
    one = definitions.groupBy("configurationId").agg(*[F.min(c).alias(f"__{c}") for c in TREATMENT[1:]], F.lit(True).alias("__known"))
    rows = reduce(DataFrame.unionByName, [_marked(df, log) for df, log in ((trials, "trials"), (responses, "responses"), (evals, "evals"))])
    groups = rows.groupBy("trialId", "experimentDir", *TREATMENT, "tags").agg(
        F.bit_or("bits").alias("bits"), F.sum("planned").alias("planned"))
    trial, place = W.partitionBy("trialId"), W.partitionBy("trialId", "experimentDir")
    treatment, planned_in = F.struct(*TREATMENT), F.when(F.col("planned") > 0, F.col("experimentDir"))
    seen = (
        groups.join(one, "configurationId", "left")
        .withColumn("several", F.min(treatment).over(trial) != F.max(treatment).over(trial))
        .withColumn("first", F.min(planned_in).over(trial))
        .withColumn("last", F.max(planned_in).over(trial))
        .withColumn("copies", F.sum("planned").over(place))
        .withColumn("in_place", F.row_number().over(place.orderBy(*TREATMENT, "tags")) == 1)
        .withColumn("in_trial", F.row_number().over(trial.orderBy("experimentDir", *TREATMENT, "tags")) == 1)
    )
    known = F.col("__known").isNotNull()
    strange = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in TREATMENT[1:]])
    named = F.length("trialId") > 0

    def has(bit: int) -> Column:
        return F.col("bits").bitwiseAND(bit) > 0

    rules = [
        ("duplicate_in_log", named & F.col("in_place") & (F.col("copies") > 1), F.col("experimentDir")),
        ("duplicate_across_inputs", named & F.col("in_trial") & (F.col("first") != F.col("last")), F.concat_ws(" and ", "first", "last")),
        ("unknown_configuration", ~known, F.col("configurationId")),
        ("treatment_differs", known & (strange | has(_METADATA)), F.col("configurationId")),
        ("treatment_conflict", F.col("in_trial") & F.col("several"), F.lit("several treatments")),
        ("pipe_in_tag", has(_TAG), F.col("tags")),
        ("legacy_column", has(_LEGACY), F.lit("old log")),
        ("not_a_response", has(_NO_RESPONSE), F.lit("no status and no timing")),
    ]
    found = F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, broken, detail in rules])
    of_trials = seen.select(F.col("trialId").alias("key"), F.explode(F.array_compact(found)).alias("x")).select("x.rule", "key", "x.detail")
    return reduce(DataFrame.unionByName, [
        _rows(bad_versions(manifests), "contract_version", "experimentDir", F.lit("not 2")),
        _rows(config_conflicts(definitions), "configuration_conflict", "configurationId", "definitions"),
        of_trials,
    ])


def refuse(violations: DataFrame, shown: int = 20) -> None:
    """Raise when there is a violation; the message names a few."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in found))
