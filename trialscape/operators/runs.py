"""Wide run table of the study (RSH-1..4, JON-3, JON-5, JON-19). Here missing costs count as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import variant_bool01, word_count
from trialscape.operators.votes import collapsed, consensus_flags, vote_cost, vote_wide

_EMPTY = "array<string>"


def _strings(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_EMPTY)).alias(c)


RESPONSE_COLUMNS = [
    "experimentId", "taskId", "instanceId", "modelId", "model", "provider", "configurationId", "strategy", "representation",
    "repeatIndex", "status", "errorMessage", "taskStatement", "taskTemplate", "response", "answerChars", "answerWords", "taskTags",
    "contextBlocks", "validationType", "traceRef", "usage", "metricsSummary", "timing",
]


def measure_answers(responses: DataFrame) -> DataFrame:
    """The length of each answer instead of its text, for tables that show no texts; a row is a fraction as wide."""
    answer = F.coalesce("response", F.lit(""))
    measures = {"answerChars": F.length(answer).cast("long"), "answerWords": word_count(answer)}
    return responses.withColumns(measures).drop("response")


def flatten_responses(responses: DataFrame) -> DataFrame:
    """RSH-2: tokens come from ``usage`` first, durations from the summary first. Responses of
    :func:`measure_answers` have no text."""
    def first(usage: str) -> Column:
        return F.coalesce(F.col(f"usage.{usage}"), F.col(f"metricsSummary.{usage}")).alias(f"{usage}_answer")

    texts = "response" in responses.columns
    kept = responses.withColumns({"__text": F.coalesce("response", F.lit(""))} if texts else {})
    rows = measure_answers(kept).withColumnRenamed("__text", "response") if texts else kept
    counters = [
        "strategyDurationMs", "modelDurationMs", "toolDurationMs", "rateLimitWaitMs", "retryCount", "toolCalls",
        "functionCalls", "mcpToolCalls", "modelCalls", "contextChars", "contextBytes", "promptChars",
    ]
    return rows.select(
        "trialId", "experimentId", "taskId", "instanceId", "modelId", "model", "provider", "configurationId",
        "strategy", "representation", "repeatIndex",
        F.col("status").alias("status_answer"), "errorMessage", "taskStatement", "taskTemplate",
        *(["response"] if texts else []), _strings("taskTags"), _strings("contextBlocks"), "validationType",
        F.col("traceRef").alias("traceRef_answer"),
        first("inputTokens"), first("outputTokens"), first("totalTokens"), first("cachedInputTokens"),
        F.coalesce("metricsSummary.totalDurationMs", "timing.durationMs").alias("totalDurationMs_answer"),
        *[F.col(f"metricsSummary.{c}") for c in counters],
        "answerChars", "answerWords",
    )


def flatten_evals(evals: DataFrame) -> DataFrame:
    """RSH-3."""
    return evals.select(
        "trialId", "experimentId", "taskId", "instanceId", "repeatIndex",
        F.col("configurationId").alias("configuration_eval"), F.col("status").alias("status_eval"),
        "evaluationMethod",
        F.col("evaluationDurationMs").alias("evaluationDurationMs_reported"),
        F.col("evaluationInputTokens").alias("evaluationInputTokens_reported"),
        F.col("evaluationOutputTokens").alias("evaluationOutputTokens_reported"),
        F.col("evaluationTotalTokens").alias("evaluationTotalTokens_reported"),
        F.col("judgeCount").alias("judgeCount_reported"),
        F.col("judgeErrorCount").alias("judgeErrorCount_reported"),
        F.col("outcome.correctness.rating").alias("correctness_outcome_rating"),
        variant_bool01(F.col("outcome.correctness.agreement")).alias("correctness_outcome_agreement"),
        F.col("outcome.completeness.rating").alias("completeness_outcome_rating"),
        variant_bool01(F.col("outcome.completeness.agreement")).alias("completeness_outcome_agreement"),
        F.col("traceRef").alias("traceRef_eval"),
        F.coalesce("contextBlocks", F.array().cast(_EMPTY)).alias("contextBlocks_eval"),
    )


def cost_columns(runs: DataFrame) -> DataFrame:
    """RSH-4."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    first = {
        "answer_tokens_cost": zero("totalTokens_answer"),
        "evaluation_tokens_reported": zero("evaluationTotalTokens_reported"),
        "evaluation_tokens_corrected": zero("evaluationTotalTokens_votes"),
        "answer_duration_ms": zero("totalDurationMs_answer"),
        "evaluation_duration_reported_ms": zero("evaluationDurationMs_reported"),
        "evaluation_duration_votes_sum_ms": zero("evaluationDurationMs_votes_sum"),
    }
    rows = runs.withColumns(first)
    rows = rows.withColumns(
        {
            "total_cost_tokens_corrected": F.col("answer_tokens_cost") + F.col("evaluation_tokens_corrected"),
            "total_cost_tokens_reported": F.col("answer_tokens_cost") + F.col("evaluation_tokens_reported"),
            "total_duration_reported_ms": F.col("answer_duration_ms") + F.col("evaluation_duration_reported_ms"),
        }
    )
    return rows.withColumns(
        {
            "wasted_tokens_no_full_meet":
                F.when(F.col("full_unanimous_meet"), F.lit(0.0)).otherwise(F.col("total_cost_tokens_corrected")),
            "is_wasted_no_full_meet": ~F.col("full_unanimous_meet"),
        }
    )


def categories() -> Column:
    """RSH-1: the tags of the response if there are any, else those of the catalog."""
    own = F.when(F.size("taskTags") > 0, F.col("taskTags"))
    return F.coalesce(own, F.col("question_tags_catalog"), F.array().cast(_EMPTY))


def explode_tags(runs: DataFrame) -> DataFrame:
    """RSH-1: one row per run and tag; runs without a tag are ``uncategorized``."""
    return runs.select(
        *[c for c in runs.columns if c != "categories"], F.explode_outer("categories").alias("__tag")
    ).withColumn("category", F.coalesce("__tag", F.lit("uncategorized"))).drop("__tag")


def build_runs(responses: DataFrame, evals: DataFrame, votes: DataFrame, consensus: DataFrame,
               catalog: DataFrame) -> DataFrame:
    """JON-3: one row per answered trial. ``responses`` and ``evals`` hold one row per trial, ``votes``
    is the whole log (every vote was paid for). Adds flags, collapsed accuracy, costs and tags."""
    keys = ["trialId", "experimentId", "taskId", "instanceId"]
    joined = (
        flatten_responses(responses)
        .join(flatten_evals(evals).drop("repeatIndex"), keys, "left")
        .join(vote_wide(consensus), "trialId", "left")
        .join(vote_cost(votes), "trialId", "left")
        .join(catalog.select("taskId", "question_tags_catalog", "contextBlocks_catalog"), "taskId", "left")
    )
    flagged = consensus_flags(
        joined.withColumns(
            {
                "has_eval": F.col("status_eval").isNotNull(),
                "answer_success": F.coalesce(F.col("status_answer") == "success", F.lit(False)),
            }
        )
    )
    costed = cost_columns(flagged.withColumn("collapsed_majority_accuracy", collapsed()))
    return costed.withColumn("categories", categories())


def vote_base(runs: DataFrame, votes_long: DataFrame, configuration: str | None = None,
              models: list[str] | None = None) -> DataFrame:
    """JON-5: votes of evaluated runs with the run's model, configuration and tokens."""
    kept = runs.where(F.col("has_eval") & F.col("totalTokens_answer").isNotNull())
    if configuration is not None:
        kept = kept.where(F.col("configurationId") == configuration)
    if models is not None:
        kept = kept.where(F.col("modelId").isin(*models))
    columns = [c for c in ("categories",) if c in runs.columns]
    kept = kept.select("trialId", "taskId", "modelId", "configurationId", "totalTokens_answer", *columns)
    votes = votes_long.where("criterion IS NOT NULL AND rating IS NOT NULL").select(
        "trialId", "judgeId", "criterion", "rating"
    )
    return votes.join(kept.where("taskId IS NOT NULL"), "trialId", "inner")


def group_label(*columns: str) -> Column:
    """RSH-7."""
    return F.concat_ws(" | ", *columns)


def success_group(flag: str = "full_unanimous_meet", yes: str = "Unanimous success", no: str = "Other outcomes") -> Column:
    return F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no))
