"""Metric families over fact rows (AGG-1..8).

Missing numbers leave an aggregate, they never count as zero. Each family is one hash
aggregation; percentiles come from the distributed counting of ``functions.stats``.
Seconds are milliseconds divided last, so sums of whole milliseconds stay exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape.functions.scalar import safe_div, share
from trialscape.functions.stats import null_safe_join, with_quantiles
from trialscape.operators.facts import eval_tokens, total_calls

EFFECTIVENESS = [
    "n_trials", "n_evaluated", "primary_metric_name", "primary_success_count",
    "primary_success_rate", "primary_score_mean", "primary_score_median", "primary_score_stddev",
]
EFFICIENCY = [
    "n_trials", "n_responses", "primary_success_count", "total_tokens_mean", "total_tokens_median",
    "total_tokens_p95", "total_tokens_sum", "tokens_per_primary_success", "duration_sec_mean",
    "duration_sec_median", "duration_sec_p95", "duration_sec_sum", "duration_sec_per_primary_success",
    "model_calls_mean", "tool_calls_mean", "function_calls_mean", "mcp_tool_calls_mean",
    "steps_mean", "total_calls_sum", "calls_per_primary_success",
]
ROBUSTNESS = [
    "robustness_axis", "n_groups", "primary_success_rate_mean", "primary_success_rate_min",
    "primary_success_rate_max", "primary_success_rate_range", "primary_score_mean",
    "primary_score_stddev", "duration_sec_stddev", "total_tokens_stddev",
]
RELIABILITY = [
    "evaluation_method", "n_trials", "n_evaluated", "evaluation_coverage_rate",
    "evaluation_success_rate", "evaluation_error_rate", "evaluation_skipped_rate",
    "n_evaluation_status_other", "judge_count_mean", "judge_error_rate", "judge_agreement_mean",
    "judge_unanimity_rate", "evaluation_tokens_mean", "evaluation_duration_sec_median",
]
OBSERVABILITY = [
    "n_trials", "trace_coverage_rate", "execution_trace_coverage_rate", "eval_trace_coverage_rate",
    "raw_response_coverage_rate", "tool_call_observability_rate", "native_mcp_observability_rate",
    "server_mcp_observability_rate", "usage_observability_rate", "error_observability_rate",
]
AXES = {
    "task": ("taskId",),
    "instance": ("instanceId",),
    "repeat": ("taskId", "instanceId", "repeatIndex"),
    "model": ("modelId",),
    "representation": ("representation",),
    "surface": ("surface",),
}
AGGREGATE = [
    "n_trials", "n_responses", "n_evaluated", "primary_metric_name", "primary_success_rate",
    "primary_score_mean", "primary_score_stddev", "total_tokens_mean", "total_tokens_median",
    "total_tokens_p95", "tokens_per_primary_success", "duration_sec_median", "duration_sec_p95",
    "duration_sec_per_primary_success", "model_calls_mean", "tool_calls_mean", "function_calls_mean",
    "mcp_tool_calls_mean", "calls_per_primary_success",
    *[f"primary_success_rate_range_by_{axis}" for axis in AXES],
    "evaluation_coverage_rate", "evaluation_success_rate", "evaluation_error_rate",
    "judge_agreement_mean", "judge_unanimity_rate", "trace_coverage_rate",
    "tool_call_observability_rate", "usage_observability_rate",
]
GROUP_FIELDS = {
    "experimentId", "dataset_id", "dataset_version", "provider", "modelId", "modelName", "strategy",
    "representation", "surface", "configurationId", "instanceId", "taskId", "taskTags", "repeatIndex",
    "evaluation_method", "primary_metric_name",
}


def check_group(fields: list[str]) -> list[str]:
    unknown = [f for f in fields if f not in GROUP_FIELDS]
    if unknown:
        raise ValueError(f"cannot group by {unknown}")
    return fields


def _single(name: str) -> Column:
    """The only value of a column in the group, or ``mixed``."""
    return F.when(F.min(name) != F.max(name), F.lit("mixed")).otherwise(F.min(name))


def _definitions() -> dict[str, Column]:
    f = F.col
    n = F.count(F.lit(1))
    success = F.count_if(f("primary_success"))
    known = F.count("primary_success")
    mixed = F.coalesce(F.min("primary_metric_name") != F.max("primary_metric_name"), F.lit(False))
    status = f("evaluation_status")
    present = f("evaluation_present")
    calls = total_calls()
    rate = lambda cond: safe_div(F.count_if(cond), n)
    other = present & ~F.coalesce(status.isin("evaluated", "partial", "error", "skipped"), F.lit(False))
    return {
        "n_trials": n,
        "n_evaluated": F.count_if(present),
        "n_responses": F.count_if("response_present"),
        "primary_metric_name": _single("primary_metric_name"),
        "primary_success_count": success,
        "primary_success_rate": safe_div(success, known),
        "primary_score_mean": F.when(~mixed, F.avg("primary_score")),
        "primary_score_stddev": F.when(~mixed, F.stddev_samp("primary_score")),
        "total_tokens_mean": F.avg("total_tokens"),
        "total_tokens_sum": F.sum("total_tokens"),
        "tokens_per_primary_success": safe_div(F.sum("total_tokens"), success),
        "duration_sec_mean": F.avg("duration_ms") / 1000.0,
        "duration_sec_sum": F.sum("duration_ms") / 1000.0,
        "duration_sec_per_primary_success": safe_div(F.sum("duration_ms") / 1000.0, success),
        **{f"{c}_mean": F.avg(c) for c in ("model_calls", "tool_calls", "function_calls", "mcp_tool_calls", "steps")},
        "total_calls_sum": F.sum(calls),
        "calls_per_primary_success": safe_div(F.sum(calls), success),
        "evaluation_method": _single("evaluation_method"),
        "evaluation_coverage_rate": rate(present),
        "evaluation_success_rate": rate(present & status.isin("evaluated", "partial")),
        "evaluation_error_rate": rate(present & (status == "error")),
        "evaluation_skipped_rate": rate(present & (status == "skipped")),
        "n_evaluation_status_other": F.count_if(other),
        "judge_count_mean": F.avg("judge_count"),
        "judge_error_rate": safe_div(F.sum("judge_error_count"), F.sum("judge_count")),
        "judge_agreement_mean": F.avg("judge_agreement_mean"),
        "judge_unanimity_rate": share("judge_unanimous"),
        "evaluation_tokens_mean": F.avg(eval_tokens()),
        "trace_coverage_rate": share("trace_available"),
        "execution_trace_coverage_rate": share("execution_trace_available"),
        "eval_trace_coverage_rate": share("eval_trace_available"),
        "raw_response_coverage_rate": share("raw_response_available"),
        "tool_call_observability_rate": share("tool_calls_observable"),
        "native_mcp_observability_rate": share("native_mcp_observable"),
        "server_mcp_observability_rate": share("server_mcp_observable"),
        "usage_observability_rate": share("usage_observable"),
        "error_observability_rate": share("error_observable"),
    }


# Percentiles: column, percent, smallest number of values, divisor.
_PERCENTILES = {
    "primary_score_median": ("primary_score", 50, 1, 1.0),
    "total_tokens_median": ("total_tokens", 50, 1, 1.0),
    "total_tokens_p95": ("total_tokens", 95, 2, 1.0),
    "duration_sec_median": ("duration_ms", 50, 1, 1000.0),
    "duration_sec_p95": ("duration_ms", 95, 2, 1000.0),
    "evaluation_duration_sec_median": ("evaluation_duration_ms", 50, 1, 1000.0),
}


def _family(facts: DataFrame, gb: list[str], names: list[str], accuracy: int | None = None) -> DataFrame:
    check_group(gb)
    definitions = _definitions()
    percentiles = [n for n in names if n in _PERCENTILES]
    helpers = {f"__n_{c}": F.count(c) for c in {_PERCENTILES[n][0] for n in percentiles}}
    mixed = F.coalesce(F.min("primary_metric_name") != F.max("primary_metric_name"), F.lit(False))
    aggs = {n: definitions[n] for n in names if n in definitions} | helpers
    if "primary_score_median" in percentiles:
        aggs["__mixed"] = mixed
    clash = {n for n in aggs if n in gb}
    table = facts.groupBy(*gb).agg(*[c.alias(n) for n, c in aggs.items() if n not in clash])
    if percentiles:
        wanted = {n: _PERCENTILES[n][:2] for n in percentiles}
        table = with_quantiles(table, facts, gb, wanted, 1, accuracy)
        for n in percentiles:
            column, _, least, divisor = _PERCENTILES[n]
            table = table.withColumn(n, F.when(F.col(f"__n_{column}") >= least, F.col(n) / F.lit(divisor)))
        if "primary_score_median" in percentiles:
            table = table.withColumn("primary_score_median", F.when(~F.col("__mixed"), F.col("primary_score_median")))
    return table.select(*gb, *[n for n in names if n not in gb])


def effectiveness(facts: DataFrame, gb: list[str], accuracy: int | None = None) -> DataFrame:
    """AGG-1."""
    return _family(facts, gb, EFFECTIVENESS, accuracy)


def efficiency(facts: DataFrame, gb: list[str], accuracy: int | None = None) -> DataFrame:
    """AGG-2."""
    return _family(facts, gb, EFFICIENCY, accuracy)


def eval_reliability(facts: DataFrame, gb: list[str], accuracy: int | None = None) -> DataFrame:
    """AGG-4: the rates divide by all planned trials."""
    return _family(facts, gb, RELIABILITY, accuracy)


def observability(facts: DataFrame, gb: list[str]) -> DataFrame:
    """AGG-5."""
    return _family(facts, gb, OBSERVABILITY)


def robustness(facts: DataFrame, gb: list[str], axes: list[str] | None = None) -> DataFrame:
    """AGG-3: spread of the success rate over the subgroups of each axis.

    One pass: every row counts once per axis and once for its whole group, subgroups are
    reduced map-side, and the second aggregation sees one row per subgroup. The standard
    deviations are over rows and come from the whole group."""
    check_group(gb)
    names = axes or list(AXES)
    width = max(len(AXES[a]) for a in names)

    def entry(axis: str, columns: tuple[str, ...]) -> Column:
        keys = [F.col(c).cast("string") for c in columns] + [F.lit(None).cast("string")] * (width - len(columns))
        return F.struct(F.lit(axis).alias("axis"), F.array(*keys).alias("key"))

    entries = F.array(entry("", ()), *[entry(a, AXES[a]) for a in names])
    spread = facts.select(
        *[F.col(k).alias(f"__{k}") for k in gb],
        "primary_success", "primary_score", "duration_ms", "total_tokens",
        F.explode(entries).alias("__x"),
    )
    keys = [f"__{k}" for k in gb]
    whole = F.col("__x.axis") == ""

    def of_whole(c: str) -> Column:
        return F.when(whole, F.col(c))

    subgroups = spread.groupBy(*keys, F.col("__x.axis").alias("robustness_axis"), F.col("__x.key").alias("__key")).agg(
        safe_div(F.count_if("primary_success"), F.count("primary_success")).alias("__rate"),
        F.avg(of_whole("primary_score")).alias("__mean"),
        F.stddev_samp(of_whole("primary_score")).alias("__score"),
        F.stddev_samp(of_whole("duration_ms")).alias("__duration"),
        F.stddev_samp(of_whole("total_tokens")).alias("__tokens"),
    )
    per_axis = subgroups.groupBy(*keys, "robustness_axis").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.avg("__rate").alias("__rate_mean"),
        F.min("__rate").alias("__rate_min"),
        F.max("__rate").alias("__rate_max"),
        *[F.max(c).alias(c) for c in ("__mean", "__score", "__duration", "__tokens")],
    )
    group = W.partitionBy(*keys)  # one row per axis
    enough = F.col("n_groups") >= 2
    whole_row = per_axis.withColumns({c: F.max(c).over(group) for c in ("__mean", "__score", "__duration", "__tokens")})
    return whole_row.where("robustness_axis != ''").select(
        *[F.col(f"__{k}").alias(k) for k in gb],
        "robustness_axis",
        "n_groups",
        F.when(enough, F.col("__rate_mean")).alias("primary_success_rate_mean"),
        F.when(enough, F.col("__rate_min")).alias("primary_success_rate_min"),
        F.when(enough, F.col("__rate_max")).alias("primary_success_rate_max"),
        F.when(enough, F.col("__rate_max") - F.col("__rate_min")).alias("primary_success_rate_range"),
        F.when(enough, F.col("__mean")).alias("primary_score_mean"),
        F.when(enough, F.col("__score")).alias("primary_score_stddev"),
        F.when(enough, F.col("__duration") / 1000.0).alias("duration_sec_stddev"),
        F.when(enough, F.col("__tokens")).alias("total_tokens_stddev"),
    )


def robustness_ranges(table: DataFrame, gb: list[str], axes: list[str] | None = None) -> DataFrame:
    """One row per group with the success-rate range of each axis."""
    return table.groupBy(*gb).agg(
        *[
            F.max(F.when(F.col("robustness_axis") == a, F.col("primary_success_rate_range")))
            .alias(f"primary_success_rate_range_by_{a}")
            for a in axes or AXES
        ]
    )


def aggregate_metrics(facts: DataFrame, gb: list[str], accuracy: int | None = None) -> DataFrame:
    """AGG-6."""
    ranges = robustness_ranges(robustness(facts, gb), gb)
    names = [n for n in AGGREGATE if not n.startswith("primary_success_rate_range_by_")]
    table = null_safe_join(_family(facts, gb, names, accuracy), ranges, gb)
    return table.select(*gb, *[n for n in AGGREGATE if n not in gb])


def dimension_summary(facts: DataFrame, gb: list[str]) -> DataFrame:
    """AGG-7: long table of five metrics and six ranges per group."""
    parts = {
        "primary_success_rate": "effectiveness",
        "tokens_per_primary_success": "efficiency",
        "evaluation_coverage_rate": "evaluation_reliability",
        "judge_unanimity_rate": "evaluation_reliability",
        "trace_coverage_rate": "observability",
    }
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in gb])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                for m, d in parts.items()
            ]
        )
    )
    plain = _family(facts, gb, list(parts)).select(*gb, rows.alias("__x")).select(*gb, "__x.*")
    ranges = robustness(facts, gb).select(
        *gb,
        F.lit("robustness").alias("dimension"),
        F.concat(F.lit("primary_success_rate_range_by_"), F.col("robustness_axis")).alias("metric"),
        F.col("primary_success_rate_range").alias("value"),
    )
    both = plain.unionByName(ranges)
    return both.select("dimension", key.alias("group_key"), *gb, "metric", "value")


def summary(facts: DataFrame, accuracy: int | None = None, gb: list[str] | None = None) -> DataFrame:
    """AGG-8: one row; with ``gb`` also the groups that pool several configurations, in order."""
    names = [
        "n_trials", "n_responses", "n_evaluated", "primary_metric_name", "primary_success_rate",
        "total_tokens_sum", "duration_sec_median", "evaluation_success_rate", "trace_coverage_rate",
    ]
    totals = _family(facts, [], names, accuracy)
    kinds = facts.agg(
        F.count_distinct("experimentId").alias("experiments"),
        F.array_sort(F.collect_set("dataset_id")).alias("datasets"),
    )
    extra = []
    if gb is not None:
        listed = F.struct(F.struct(*gb).alias("group"), "configurationIds")
        extra = [pooled(facts, gb).agg(F.array_sort(F.collect_list(listed)).alias("p")).select("p").scalar().alias("pooledConfigurations")]
    return totals.select(
        *extra,
        F.lit("2.0").alias("schemaVersion"),
        kinds.select("experiments").scalar().alias("experiments"),
        kinds.select("datasets").scalar().alias("datasets"),
        "*",
    )


def pooled(df: DataFrame, gb: list[str]) -> DataFrame:
    """VAL-16: groups that pool several configurations, with the sorted list."""
    distinct = df.select(*gb, "configurationId").distinct()
    return (
        distinct.groupBy(*gb)
        .agg(F.array_sort(F.collect_list("configurationId")).alias("configurationIds"))
        .where(F.size("configurationIds") > 1)
    )


def canonical_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """SRT-1, SRT-2: by the text of the columns, null as ''."""
    return df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
