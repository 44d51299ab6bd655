"""The wide fact row per planned trial (JON-1, COL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import (
    join_tags, lookup, seconds, sum_non_null, truncate, variant_array, variant_bool01, variant_object,
)
from trialscape.operators.latest import last_rows
from trialscape.operators.votes import has_error
from trialscape.sources.traces import payload

FACT_COLUMNS = [
    "experimentId", "dataset_id", "dataset_version", "trialId", "instanceId", "taskId", "taskTags",
    "provider", "modelId", "modelName", "strategy", "representation", "surface", "configurationId",
    "repeatIndex", "response_present", "execution_status", "evaluation_present", "evaluation_status",
    "evaluation_method", "evaluation_method_consistent", "input_tokens", "output_tokens",
    "total_tokens", "cached_input_tokens", "cached_read_tokens", "reserved_tokens",
    "reasoning_tokens", "duration_ms", "duration_sec", "model_duration_ms", "tool_duration_ms",
    "model_calls", "tool_calls", "function_calls", "mcp_tool_calls", "steps",
    "primary_metric_name", "primary_success", "primary_score", "evaluation_input_tokens",
    "evaluation_output_tokens", "evaluation_duration_ms", "judge_count", "judge_error_count",
    "judge_agreement_mean", "judge_unanimous", "trace_available", "execution_trace_available",
    "eval_trace_available", "raw_response_available", "tool_calls_observable",
    "native_mcp_observable", "server_mcp_observable", "usage_observable", "error_observable",
    "error_message", "response_excerpt",
]


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) > 0


def primary_name(method: Column) -> Column:
    return F.when(method == fixed.JUDGE_METHOD, F.lit("judge_meets")).when(
        method == fixed.SCORER_METHOD, F.lit("pass")
    )


def primary_success(method: Column, correctness: Column, completeness: Column, passed: Column) -> Column:
    """COL-6, COL-7: both ratings meet; or the scorer passed."""
    both = correctness.isNotNull() & completeness.isNotNull()
    judged = F.when(both, (correctness == "meets") & (completeness == "meets"))
    return F.when(method == fixed.JUDGE_METHOD, judged).when(method == fixed.SCORER_METHOD, passed)


def primary_score(method: Column, correctness: Column, completeness: Column, similarity: Column) -> Column:
    points = [lookup(fixed.RATING_SCORES, c) for c in (correctness, completeness)]
    return F.when(method == fixed.JUDGE_METHOD, (points[0] + points[1]) / 2.0).when(
        method == fixed.SCORER_METHOD, similarity.cast("double")
    )


def method_consistent(planned: Column, actual: Column) -> Column:
    """VAL-10: null when both are missing, false when both are there and differ."""
    return F.when(planned.isNull() & actual.isNull(), F.lit(None)).otherwise(
        F.coalesce(planned == actual, F.lit(True))
    )


def vote_spread(votes: DataFrame) -> DataFrame:
    """Per trial over all its votes: how many, how many valid, and whether the valid ones agree."""
    valid = ~F.col("status").eqNullSafe("error") & ~has_error()
    pair = F.struct(
        F.col("criterias.correctness.rating").alias("c"), F.col("criterias.completeness.rating").alias("k")
    )
    return votes.groupBy("trialId").agg(
        F.count(F.lit(1)).alias("__votes"),
        F.count_if(valid).alias("__valid"),
        F.min(F.when(valid, pair)).eqNullSafe(F.max(F.when(valid, pair))).alias("__one"),
    )


def trace_flags(traces: DataFrame, nested: bool = True) -> DataFrame:
    """COL-13..16, the part that reads trace documents. One row per trace that is an object."""
    body, t = F.col("body"), F.col("__t")
    calls = ("mcp.tool_call", "mcp.tool_result")
    events = F.coalesce(variant_array(t, "$.aiTrace.events"), F.array().cast("array<variant>"))
    called = F.exists(
        events,
        lambda e: F.coalesce(F.try_variant_get(e, "$.type", "string").isin(*calls), F.lit(False))
        | F.coalesce(F.try_variant_get(e, "$.name", "string").isin(*calls), F.lit(False)),
    )
    some = lambda path: F.coalesce(F.size(variant_array(t, path)) > 0, F.lit(False))
    error = F.to_json(F.try_variant_get(t, "$.error", "variant"))
    objects = traces.where(variant_object(body).isNotNull())
    return objects.select("trialId", payload(body, nested).alias("__t")).select(
        "trialId",
        F.lit(True).alias("__trace"),
        (some("$.toolCalls") | called).alias("__tool"),
        F.coalesce(F.size(variant_object(t, "$.nativeMcp")) > 0, F.lit(False)).alias("__native"),
        some("$.serverMcp").alias("__server"),
        F.coalesce(~error.isin('""', "0", "0.0", "false", "{}", "[]", "null"), F.lit(False)).alias("__error"),
    )


def _no_traces(trials: DataFrame) -> DataFrame:
    return trials.sparkSession.createDataFrame(
        [], "trialId STRING, __trace BOOLEAN, __tool BOOLEAN, __native BOOLEAN, __server BOOLEAN, __error BOOLEAN"
    )


def build_trial_facts(
    trials: DataFrame,
    responses: DataFrame,
    evals: DataFrame,
    votes: DataFrame,
    execution_traces: DataFrame | None = None,
    eval_traces: DataFrame | None = None,
    nested_traces: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """JON-1: planned trials with their latest response, latest evaluation and vote spread.

    All sides are cut to what the facts show and reduced to one row per trial before they meet, so
    the joins share the partitioning on ``trialId``, no key repeats, and no response text travels."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        """Plain columns, so that those that nobody shows don't travel."""
        own = [F.col(c).alias(f"__{name}_{c}") for c in rows.columns if c not in ("trialId", seq)]
        return rows.select("trialId", F.lit(True).alias(f"__{name}"), *own)

    r = side(last_rows(responses.select("trialId", seq, *_response_columns()), ["trialId"], seq), "r")
    e = side(last_rows(evals.select("trialId", seq, *_eval_columns()), ["trialId"], seq), "e")
    joined = trials.join(r, "trialId", "left").join(e, "trialId", "left").join(
        vote_spread(votes), "trialId", "left"
    )
    x = _no_traces(trials) if execution_traces is None else trace_flags(execution_traces, nested_traces)
    joined = joined.join(x, "trialId", "left")
    if eval_traces is None:
        joined = joined.withColumn("__eval_trace", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(
            eval_traces.where(variant_object(F.col("body")).isNotNull()).select(
                "trialId", F.lit(True).alias("__eval_trace")
            ), "trialId", "left",
        )
    return joined.select(*_fact_columns())


_COUNTERS = [
    "inputTokens", "outputTokens", "totalTokens", "cachedInputTokens", "cacheReadInputTokens", "reservedTokens",
    "totalDurationMs", "modelDurationMs", "toolDurationMs", "modelCalls", "toolCalls", "functionCalls",
    "mcpToolCalls", "steps",
]


def _response_columns() -> list[Column]:
    """What the facts show of a response: an excerpt and whether there is a text, not the text."""
    f = F.col
    return [
        f("status"), f("errorMessage"), filled(f("response")).alias("filled"), truncate("response", 280).alias("excerpt"),
        filled(f("traceRef")).alias("traced"), f("usage.reasoningTokens").cast("double").alias("reasoningTokens"),
        *[f(f"metricsSummary.{c}").cast("double").alias(c) for c in _COUNTERS],
    ]


def _eval_columns() -> list[Column]:
    f = F.col
    return [
        f("status"), f("evaluationMethod"), filled(f("traceRef")).alias("traced"),
        *[f(f"outcome.{c}.rating").alias(c) for c in ("correctness", "completeness")],
        *[variant_bool01(f(f"outcome.{c}.agreement")).alias(f"{c}Agreed") for c in ("correctness", "completeness")],
        f("details.outcome.passed").alias("passed"), f("details.repoqa.bestSimilarScore").alias("bestSimilarScore"),
        *[f(c).cast("double").alias(c) for c in (
            "judgeCount", "judgeErrorCount", "evaluationInputTokens", "evaluationOutputTokens", "evaluationDurationMs")],
    ]


def _fact_columns() -> list[Column]:
    f = F.col
    m = lambda name: f(f"__r_{name}")
    method = f("__e_evaluationMethod")
    ratings = f("__e_correctness"), f("__e_completeness")
    agreed = [f("__e_correctnessAgreed"), f("__e_completenessAgreed")]
    judged = method == fixed.JUDGE_METHOD
    false = lambda c: F.coalesce(c, F.lit(False))
    exec_trace = false(f("__trace")) | false(f("__r_traced"))
    eval_trace = false(f("__eval_trace")) | false(f("__e_traced"))
    unanimous = (
        F.when(f("__valid") >= 2, f("__one"))
        .when(F.coalesce(f("__votes"), F.lit(0)) > 0, F.lit(None))
        .otherwise(F.when(agreed[0].isNotNull() & agreed[1].isNotNull(), agreed[0] & agreed[1]))
    )
    native = false(f("strategy").isin("local_mcp", "remote_mcp") & (m("mcpToolCalls") > 0)) | false(f("__native"))
    return [
        f("experimentId"), f("dataset.id").alias("dataset_id"), f("dataset.version").alias("dataset_version"),
        f("trialId"), f("instanceId"), f("taskId"), join_tags("taskTags").alias("taskTags"), f("provider"),
        f("modelId"), F.coalesce(F.nullif(f("modelName"), F.lit("")), f("model")).alias("modelName"),
        f("strategy"), f("representation"), f("surface"), f("configurationId"), f("repeatIndex"),
        f("__r").isNotNull().alias("response_present"), f("__r_status").alias("execution_status"),
        f("__e").isNotNull().alias("evaluation_present"), f("__e_status").alias("evaluation_status"),
        method.alias("evaluation_method"),
        method_consistent(f("validationType"), method).alias("evaluation_method_consistent"),
        m("inputTokens").alias("input_tokens"), m("outputTokens").alias("output_tokens"),
        m("totalTokens").alias("total_tokens"), m("cachedInputTokens").alias("cached_input_tokens"),
        m("cacheReadInputTokens").alias("cached_read_tokens"), m("reservedTokens").alias("reserved_tokens"),
        m("reasoningTokens").alias("reasoning_tokens"),
        m("totalDurationMs").alias("duration_ms"), seconds(m("totalDurationMs")).alias("duration_sec"),
        m("modelDurationMs").alias("model_duration_ms"), m("toolDurationMs").alias("tool_duration_ms"),
        m("modelCalls").alias("model_calls"), m("toolCalls").alias("tool_calls"),
        m("functionCalls").alias("function_calls"), m("mcpToolCalls").alias("mcp_tool_calls"),
        m("steps").alias("steps"),
        primary_name(method).alias("primary_metric_name"),
        primary_success(method, *ratings, f("__e_passed")).alias("primary_success"),
        primary_score(method, *ratings, f("__e_bestSimilarScore")).alias("primary_score"),
        f("__e_evaluationInputTokens").alias("evaluation_input_tokens"),
        f("__e_evaluationOutputTokens").alias("evaluation_output_tokens"),
        f("__e_evaluationDurationMs").alias("evaluation_duration_ms"),
        F.when(judged, f("__e_judgeCount")).alias("judge_count"),
        F.when(judged, f("__e_judgeErrorCount")).alias("judge_error_count"),
        F.when(judged, (agreed[0].cast("int").cast("double") + agreed[1].cast("int").cast("double")) / 2.0)
        .alias("judge_agreement_mean"),
        F.when(judged, unanimous).alias("judge_unanimous"),
        (exec_trace | eval_trace).alias("trace_available"),
        exec_trace.alias("execution_trace_available"), eval_trace.alias("eval_trace_available"),
        false(f("__r_filled")).alias("raw_response_available"),
        (F.coalesce(m("toolCalls"), m("functionCalls"), m("mcpToolCalls")).isNotNull() | false(f("__tool")))
        .alias("tool_calls_observable"),
        native.alias("native_mcp_observable"),
        f("__server").alias("server_mcp_observable"),
        F.coalesce(m("inputTokens"), m("outputTokens"), m("totalTokens")).isNotNull().alias("usage_observable"),
        (filled(f("__r_errorMessage")) | false(f("__error"))).alias("error_observable"),
        f("__r_errorMessage").alias("error_message"),
        f("__r_excerpt").alias("response_excerpt"),
    ]


def total_calls() -> Column:
    """COL-18 on fact rows."""
    return sum_non_null("model_calls", "tool_calls", "function_calls", "mcp_tool_calls")


def eval_tokens(inputs: str = "evaluation_input_tokens", outputs: str = "evaluation_output_tokens") -> Column:
    """COL-19."""
    return sum_non_null(inputs, outputs)


def eval_status(skipped: Column, method: Column, judge_count: Column, judge_errors: Column) -> Column:
    """COL-20."""
    return (
        F.when(skipped, F.lit("skipped"))
        .when(method == fixed.SCORER_METHOD, F.lit("evaluated"))
        .when(F.coalesce(judge_count, F.lit(0)) == 0, F.lit("error"))
        .when(F.coalesce(judge_errors, F.lit(0)) > 0, F.lit("partial"))
        .otherwise(F.lit("evaluated"))
    )


def exec_status(answer: Column, error: Column) -> Column:
    """COL-21: an error or a blank answer is an error."""
    blank = F.coalesce(F.length(F.trim(answer)), F.lit(0)) == 0
    return F.when(error.isNotNull() | blank, F.lit("error")).otherwise(F.lit("success"))
