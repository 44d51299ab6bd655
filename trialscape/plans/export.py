"""Flat export: one row per response with its evaluation and one vote (JON-2, SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import variant_bool01
from trialscape.operators.latest import first_vote, latest_of
from trialscape.operators.select import Selector, by_filters, select_rows
from trialscape.sources.sinks import write_csv

EXPORT_COLUMNS = [
    "experimentId", "trialId", "dataset_id", "dataset_version", "instanceId", "configurationId", "representation",
    "surface", "taskId", "modelId", "modelName", "tags", "index", "strategy", "temperature",
    "inputTokens", "outputTokens", "totalTokens", "cachedInputTokens", "cachedReadTokens",
    "status", "modelCalls", "toolCalls", "mcpToolCalls",
    "response", "errorMessage", "modelDuration", "reservedTokens", "toolDurationMs", "totalDurationMs",
    "completeness", "completeness_agreement", "correctness", "correctness_agreement",
    "completeness_justification", "correctness_justification",
    "judge", "judgeId", "judgeModel",
    "evaluationDurationMs", "evaluationInputTokens", "evaluationOutputTokens",
    "evaluationMethod", "judgeCount", "evaluationStatus", "contextBlocks",
]

EVAL_COLUMNS = [
    "outcome", "evaluationDurationMs", "evaluationInputTokens", "evaluationOutputTokens", "evaluationMethod", "judgeCount",
    "status", "contextBlocks",
]


def export_rows(responses: DataFrame, evals: DataFrame, votes: DataFrame, seq: str = "seq") -> DataFrame:
    """JON-2: planned trials without a response do not appear. Evaluations and votes are reduced to one
    row per trial first, so a trial with many responses is the only repeating side of the joins."""
    e = latest_of(evals, ["trialId"], EVAL_COLUMNS, seq).select("trialId", F.struct(*EVAL_COLUMNS).alias("e"))
    v = first_vote(votes.select("trialId", seq, "judgeId", "provider", "model", "error", "criterias"), seq).select(
        "trialId", F.struct("judgeId", "provider", "model", "criterias").alias("v")
    )
    f = F.col
    judge = F.concat_ws("/", F.coalesce("v.provider", F.lit("None")), F.coalesce("v.model", F.lit("None")))
    named = f("v.provider").isNotNull() | f("v.model").isNotNull()
    table = responses.join(e, "trialId", "left").join(v, "trialId", "left")
    return table.select(
        "experimentId", "trialId", f("dataset.id").alias("dataset_id"), f("dataset.version").alias("dataset_version"),
        "instanceId", "configurationId", "representation", "surface", "taskId", "modelId",
        F.coalesce(F.nullif(f("model"), F.lit("")), f("modelName")).alias("modelName"),
        F.array_join(F.coalesce("taskTags", F.array().cast("array<string>")), ",").alias("tags"),
        f("repeatIndex").alias("index"), "strategy", F.try_element_at("parameters", F.lit("temperature")).alias("temperature"),
        f("usage.inputTokens"), f("usage.outputTokens"), f("usage.totalTokens"), f("usage.cachedInputTokens"),
        f("usage.cacheReadInputTokens").alias("cachedReadTokens"), "status", f("metricsSummary.modelCalls"),
        f("metricsSummary.toolCalls"), f("metricsSummary.mcpToolCalls"), "response", "errorMessage",
        f("metricsSummary.modelDurationMs").alias("modelDuration"), f("metricsSummary.reservedTokens"),
        f("metricsSummary.toolDurationMs"), f("metricsSummary.totalDurationMs"),
        f("e.outcome.completeness.rating").alias("completeness"),
        variant_bool01(f("e.outcome.completeness.agreement")).alias("completeness_agreement"),
        f("e.outcome.correctness.rating").alias("correctness"),
        variant_bool01(f("e.outcome.correctness.agreement")).alias("correctness_agreement"),
        f("v.criterias.completeness.justification").alias("completeness_justification"),
        f("v.criterias.correctness.justification").alias("correctness_justification"),
        F.when(named, judge).alias("judge"), f("v.judgeId"), f("v.model").alias("judgeModel"),
        f("e.evaluationDurationMs"), f("e.evaluationInputTokens"), f("e.evaluationOutputTokens"), f("e.evaluationMethod"),
        f("e.judgeCount"), f("e.status").alias("evaluationStatus"), F.array_join("e.contextBlocks", ",").alias("contextBlocks"),
    )


def export_results(responses: DataFrame, evals: DataFrame, votes: DataFrame, path: str, selector: Selector | None = None,
                   filters: list[str] | None = None, mode: str = "error") -> None:
    """SNK-2: selection runs on the responses, before the joins."""
    rows = select_rows(responses, selector or Selector())
    rows = by_filters(rows, filters or [])
    write_csv(export_rows(rows, evals, votes), path, EXPORT_COLUMNS, mode)
