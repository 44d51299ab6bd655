"""The study: every table of the analysis by name (SNK-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.operators import behavior, study
from trialscape.operators import traces as trace_ops
from trialscape.operators import votes as vote_ops
from trialscape.operators.latest import latest, task_meta
from trialscape.operators.runs import build_runs, explode_tags, flatten_evals, flatten_responses
from trialscape.session import scratch_path
from trialscape.sources.sinks import write_tables

ARTICLE_COLUMNS = {
    "configuration": [
        "configurationId", "evaluated", "answer_tokens_avg", "evaluation_tokens_corrected_avg", "total_cost_tokens_corrected_avg",
        "answer_duration_ms_avg", "strict_majority_meet_rate_pct", "full_consensus_rate_pct", "full_unanimous_meet_rate_pct",
        "tokens_per_strict_majority_meet", "tokens_per_full_unanimous_meet", "strict_majority_meets_per_100k_tokens",
        "full_unanimous_meets_per_100k_tokens", "wasted_tokens_no_full_meet_pct", "eval_share_of_total_cost_pct", "no_majority_any_criterion_pct",
    ],
    "model_configuration": [
        "modelId", "configurationId", "evaluated", "total_cost_tokens_corrected_avg", "strict_majority_meet_rate_pct",
        "full_unanimous_meet_rate_pct", "full_unanimous_meets_per_100k_tokens", "tokens_per_full_unanimous_meet", "wasted_tokens_no_full_meet_pct",
    ],
    "category_configuration": [
        "category", "configurationId", "evaluated", "total_cost_tokens_corrected_avg", "strict_majority_meet_rate_pct", "full_consensus_rate_pct",
        "full_unanimous_meet_rate_pct", "full_unanimous_meets_per_100k_tokens", "wasted_tokens_no_full_meet_pct",
    ],
}
PIVOT_NAMES = {
    "majority_success": "majority_success", "unanimous_success": "unanimous_success", "efficiency": "efficiency",
    "wasted_tokens": "wasted_tokens", "cost": "cost",
}


def write_analysis(
    trials: DataFrame, responses: DataFrame, evals: DataFrame, votes: DataFrame, configurations: list[str], out: str,
    force: bool = False, fmt: str = "csv", **more,
) -> list[str]:
    """SNK-10: all tables of the study below ``out``, one folder each. What most of them read is written once before. Nested columns of a CSV table are written as JSON text."""
    spark, folder = trials.sparkSession, scratch_path(trials.sparkSession, "study")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tables = analysis_tables(trials, responses, evals, votes, configurations, keep=written, **more)

    def flat(df: DataFrame) -> DataFrame:
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map", "variant")]
        return df.withColumns({c: F.to_json(c) for c in nested}) if fmt == "csv" else df

    return write_tables({name: flat(df) for name, df in tables.items()}, out, force, fmt)


def analysis_tables(
    trials: DataFrame, responses: DataFrame, evals: DataFrame, votes: DataFrame, configurations: list[str],
    configured_judges: DataFrame | None = None, execution_traces: DataFrame | None = None, eval_traces: DataFrame | None = None,
    seq: str = "seq", keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """43 named tables. ``configurations`` is the column order of the pivots. Without traces the trace
    tables carry nulls. ``keep`` may write the tables that others read and give them back read again."""
    keep = keep or (lambda df, name: df)
    last_responses = keep(latest(responses, ["trialId"], seq).drop(seq), "responses")
    last_evals = keep(latest(evals, ["trialId"], seq).drop(seq), "evals")
    long = vote_ops.votes_long(votes, trials)
    consensus = keep(vote_ops.vote_consensus(long, vote_ops.expected_judges(configured_judges, votes), seq=seq), "consensus")
    runs = keep(build_runs(last_responses, last_evals, votes, consensus, task_meta(trials, seq)), "runs")
    tagged = explode_tags(runs)
    flagged = behavior.behavior_flags(runs)
    flagged_tags = explode_tags(flagged)
    checked = vote_ops.agreement_check(vote_ops.evals_long(flatten_evals(last_evals)), consensus)
    sums = keep(study.summaries(runs, tagged), "summaries")
    one = lambda name: study.grouping(sums, name)
    category = one("category_configuration")
    answers, flat_evals = flatten_responses(last_responses), flatten_evals(last_evals)
    reported = answers.select("trialId", "configurationId", "modelId", "taskId", "instanceId", "toolCalls", "mcpToolCalls", "functionCalls")
    features = None if execution_traces is None else trace_ops.trace_features(execution_traces)
    judged = last_evals.select("trialId", "taskId", "instanceId", "configurationId", "judgeErrorCount")
    eval_features = trace_ops.eval_trace_features(
        eval_traces if eval_traces is not None else trials.select("trialId").limit(0).selectExpr("trialId", "parse_json(null) AS body")
    )
    behaviour = lambda df, *gb: behavior.summarize_behavior(df, list(gb))
    return {
        "responses_flat": answers, "evals_flat": flat_evals, "votes_flat": long, "vote_agg_by_run_criterion": consensus,
        "runs_flat_corrected": runs, "runs_tags_flat_corrected": tagged, "runs_behavior": flagged, "runs_behavior_tags": flagged_tags,
        "summary_overall": one("overall"), "summary_by_strategy": one("strategy"), "summary_by_configuration": one("configuration"),
        "summary_by_model": one("model"), "summary_by_model_configuration": one("model_configuration"), "summary_by_question": one("task"),
        "summary_by_question_configuration": one("task_configuration"), "summary_by_category": one("category"),
        "summary_by_category_configuration": category, "summary_by_model_category": one("model_category"),
        "summary_by_representation_configuration": one("representation_configuration"),
        "judge_cost": study.judge_cost(votes), "reported_vs_corrected_eval_cost": study.cost_reconciliation(runs),
        "judge_distribution": study.judge_distribution(long), "vote_pattern_counts": study.vote_patterns(consensus),
        "agreement_check": checked, "agreement_summary": study.agreement_summary(checked),
        "behavior_by_strategy": behaviour(flagged, "strategy"), "behavior_by_configuration": behaviour(flagged, "configurationId"),
        "behavior_by_model": behaviour(flagged, "modelId"), "behavior_by_question": behaviour(flagged, "taskId"),
        "behavior_by_category": behaviour(flagged_tags, "category"),
        "behavior_by_category_configuration": behaviour(flagged_tags, "category", "configurationId"),
        "answers_trace_features": reported if features is None else reported.join(features, "trialId", "left"),
        "instrumentation_gap": trace_ops.instrumentation_gap(reported, features),
        "evals_trace_features": judged.join(eval_features, "trialId", "left"),
        "eval_trace_summary": trace_ops.eval_trace_summary(last_evals, eval_features),
        **{f"article_{k}_table": one(k).select(*v) for k, v in ARTICLE_COLUMNS.items()},
        **{f"pivot_{n}_category_configuration": study.category_pivot(category, k, configurations) for k, n in PIVOT_NAMES.items()},
    }
