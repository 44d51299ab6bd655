"""Queries: latest-wins, votes, facts and the metric families."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialscape.functions.scalar import truncate
from trialscape.mart import tables as m
from trialscape.mart.registry import register, rounded
from trialscape.operators import facts as facts_ops
from trialscape.operators import latest as latest_ops
from trialscape.operators import metrics as metric_ops
from trialscape.operators import select as select_ops
from trialscape.operators import votes as vote_ops


@register("latest_response", """
SELECT trialId, status, errorMessage, totalTokens, totalDurationMs FROM x_last""")
def latest_response(spark, sf):
    rows = latest_ops.latest(m.response_log(spark, sf), ["trialId"])
    return rows.select("trialId", "status", "errorMessage", "metricsSummary.totalTokens", "metricsSummary.totalDurationMs")


@register("latest_vote", """
SELECT trialId, judgeId, correctness, completeness, error FROM x_lastvotes""")
def latest_vote(spark, sf):
    return m.latest_votes(spark, sf).select(
        "trialId", "judgeId", F.col("criterias.correctness.rating").alias("correctness"),
        F.col("criterias.completeness.rating").alias("completeness"), "error",
    )


@register("log_compaction", "SELECT trialId, judgeId, status, inputTokens, durationMs FROM x_lastvotes")
def log_compaction(spark, sf):
    from trialscape.session import scratch_path

    path = scratch_path(spark, "compact")
    latest_ops.compact(m.votes(spark, sf), ["trialId", "judgeId"], path, fmt="parquet")
    return spark.read.parquet(path).select("trialId", "judgeId", "status", "inputTokens", "durationMs")


@register("votes_in_order", """
SELECT CAST(l_orderkey AS VARCHAR) AS trialId, 'judge' || (l_suppkey % 3) AS judgeId, l_shipdate, l_linenumber FROM lineitem""")
def votes_in_order(spark, sf):
    return latest_ops.votes_in_order(m.votes(spark, sf)).select("trialId", "judgeId", "seq.l_shipdate", "seq.l_linenumber")


@register("first_valid_vote", """
SELECT trialId, judgeId, provider, model, correctness, error FROM x_votes WHERE firstValid = 1""")
def first_valid_vote(spark, sf):
    return latest_ops.first_vote(m.votes(spark, sf)).select(
        "trialId", "judgeId", "provider", "model", F.col("criterias.correctness.rating").alias("correctness"), "error"
    )


@register("votes_long", """
SELECT trialId, configurationId, judgeId, criterion, rating, justification, totalTokens AS totalTokens_vote
FROM x_long JOIN x_trials USING (trialId)""")
def votes_long(spark, sf):
    return vote_ops.votes_long(m.votes(spark, sf), m.trials(spark, sf)).select(
        "trialId", "configurationId", "judgeId", "criterion", "rating", "justification", "totalTokens_vote"
    )


_RAW = "CASE l_linenumber WHEN 1 THEN ' Meets' WHEN 2 THEN 'Partially meets ' WHEN 3 THEN 'DOES NOT MEET' WHEN 4 THEN 'odd' WHEN 5 THEN NULL ELSE 'misses' END"


@register("rating_normalised", """
SELECT CASE l_linenumber WHEN 1 THEN 'meets' WHEN 2 THEN 'partial' WHEN 4 THEN 'odd' ELSE 'misses' END AS rating,
  l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL""")
def rating_normalised(spark, sf):
    li = m.table(spark, sf, "lineitem").withColumn("raw", F.expr(_RAW))
    return li.groupBy(vote_ops.norm_rating("raw").alias("rating"), F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register("plurality_outcome", """
SELECT trialId, correctness AS correctness_rating, c_agree AS correctness_agreement,
  completeness AS completeness_rating, k_agree AS completeness_agreement FROM x_outcome""")
def plurality_outcome(spark, sf):
    return vote_ops.outcome(m.latest_votes(spark, sf))


CONSENSUS_SQL = """
SELECT trialId, criterion, count(*) AS n_votes, count(*) = 3 AS has_all_expected_votes,
  string_agg(rating, '|' ORDER BY judgeId) AS ratings_tuple, count(DISTINCT rating) AS unique_rating_count,
  greatest(count(*) FILTER (rating = 'meets'), count(*) FILTER (rating = 'partial'), count(*) FILTER (rating = 'misses')) AS majority_count
FROM x_long WHERE back = 1 GROUP BY trialId, criterion"""
from trialscape.mart.registry import cte  # noqa: E402

cte("x_tops", CONSENSUS_SQL)
cte("x_cons", """
SELECT x_tops.*, majority_count * 2 > 3 AS has_majority,
  CASE WHEN majority_count * 2 > 3 THEN m.rating END AS majority_rating,
  has_all_expected_votes AND unique_rating_count = 1 AS unanimous,
  CASE WHEN has_all_expected_votes AND unique_rating_count = 1 THEN m.rating END AS unanimous_rating,
  has_all_expected_votes AND unique_rating_count = 1 AND m.rating = 'meets' AS unanimous_meet,
  has_all_expected_votes AND unique_rating_count = 1 AND m.rating = 'partial' AS unanimous_partial,
  has_all_expected_votes AND unique_rating_count = 1 AND m.rating = 'misses' AS unanimous_misses,
  NOT (majority_count * 2 > 3) AS no_majority
FROM x_tops JOIN (
  SELECT trialId, criterion, arg_max(rating, n) AS rating
  FROM (SELECT trialId, criterion, rating, count(*) AS n FROM x_long WHERE back = 1 GROUP BY ALL) GROUP BY ALL) m
USING (trialId, criterion)""")


def consensus(spark, sf, li=None):
    votes = m.votes(spark, sf, li=li)
    return vote_ops.vote_consensus(vote_ops.votes_long(votes), vote_ops.expected_judges(None, votes))


register("vote_consensus", "SELECT * FROM x_cons")(consensus)


@register("judge_columns", """
SELECT trialId, criterion, max(rating) FILTER (judgeId = 'judge0') AS judge0_rating,
  max(rating) FILTER (judgeId = 'judge1') AS judge1_rating, max(rating) FILTER (judgeId = 'judge2') AS judge2_rating
FROM x_long WHERE back = 1 GROUP BY trialId, criterion""")
def judge_columns(spark, sf):
    judges = ["judge0", "judge1", "judge2"]
    table = vote_ops.vote_consensus(vote_ops.votes_long(m.votes(spark, sf)), 3, judges)
    return table.select("trialId", "criterion", *[f"{j}_rating" for j in judges])


@register("consensus_wide", """
SELECT trialId, max(ratings_tuple) FILTER (criterion = 'correctness') AS correctness_ratings_tuple,
  max(majority_rating) FILTER (criterion = 'correctness') AS correctness_majority_rating,
  bool_or(unanimous) FILTER (criterion = 'correctness') AS correctness_unanimous,
  max(n_votes) FILTER (criterion = 'completeness') AS completeness_n_votes,
  max(majority_rating) FILTER (criterion = 'completeness') AS completeness_majority_rating,
  bool_or(has_majority) FILTER (criterion = 'completeness') AS completeness_has_majority
FROM x_cons GROUP BY trialId""")
def consensus_wide(spark, sf):
    return vote_ops.vote_wide(consensus(spark, sf)).select(
        "trialId", "correctness_ratings_tuple", "correctness_majority_rating", "correctness_unanimous",
        "completeness_n_votes", "completeness_majority_rating", "completeness_has_majority",
    )


cte("x_wide", """
SELECT trialId, max(majority_rating) FILTER (criterion = 'correctness') AS c_major,
  max(majority_rating) FILTER (criterion = 'completeness') AS k_major,
  bool_or(unanimous_meet) FILTER (criterion = 'correctness') AS c_umeet,
  bool_or(unanimous_meet) FILTER (criterion = 'completeness') AS k_umeet,
  bool_or(unanimous) FILTER (criterion = 'correctness') AS c_una,
  bool_or(unanimous) FILTER (criterion = 'completeness') AS k_una,
  bool_or(has_majority) FILTER (criterion = 'correctness') AS c_has,
  bool_or(has_majority) FILTER (criterion = 'completeness') AS k_has
FROM x_cons GROUP BY trialId""")
COLLAPSED = """CASE WHEN coalesce(c_major = 'misses', false) OR coalesce(k_major = 'misses', false) THEN 'misses'
  WHEN coalesce(c_major = 'partial', false) OR coalesce(k_major = 'partial', false) THEN 'partial'
  WHEN c_major = 'meets' AND k_major = 'meets' THEN 'meets' ELSE 'no_majority' END"""


@register("collapsed_accuracy", f"SELECT trialId, {COLLAPSED} AS collapsed FROM x_wide")
def collapsed_accuracy(spark, sf):
    return vote_ops.vote_wide(consensus(spark, sf)).select("trialId", vote_ops.collapsed().alias("collapsed"))


@register("expected_judges", "SELECT DISTINCT judgeId FROM x_votes")
def expected_judges(spark, sf):
    return vote_ops.expected_judges(None, m.votes(spark, sf))


@register("vote_cost", """
SELECT trialId, coalesce(sum(inputTokens), 0) AS evaluationInputTokens_votes, coalesce(sum(outputTokens), 0) AS evaluationOutputTokens_votes,
  coalesce(sum(totalTokens), 0) AS evaluationTotalTokens_votes, coalesce(sum(durationMs), 0) AS evaluationDurationMs_votes_sum,
  count(*) AS judge_vote_rows, count(error) AS judge_vote_errors FROM x_votes GROUP BY trialId""")
def vote_cost(spark, sf):
    return vote_ops.vote_cost(m.votes(spark, sf))


@register("judge_info", """
SELECT trialId, CASE WHEN count(DISTINCT provider) = 1 THEN min(provider) END AS provider,
  CASE WHEN count(DISTINCT model) = 1 THEN min(model) END AS model, sum(inputTokens) AS inputTokens,
  sum(outputTokens) AS outputTokens, sum(durationMs) AS durationMs FROM x_lastvotes GROUP BY trialId""")
def judge_info(spark, sf):
    return vote_ops.judge_info(m.latest_votes(spark, sf))


@register("vote_tokens_status", """
SELECT trialId, judgeId, CASE WHEN error IS NOT NULL THEN 'error' ELSE 'evaluated' END AS judge_status,
  coalesce(inputTokens, 0) + coalesce(outputTokens, 0) AS tokens FROM x_lastvotes""")
def vote_tokens_status(spark, sf):
    return m.latest_votes(spark, sf).select(
        "trialId", "judgeId", vote_ops.judge_status().alias("judge_status"), vote_ops.vote_tokens().alias("tokens")
    )


@register("merge_votes", """
SELECT trialId, judgeId, correctness, error IS NOT NULL AS failed, CASE WHEN judgeId = 'judge0' THEN 'new' ELSE 'old' END AS origin
FROM x_lastvotes WHERE trialId IN (SELECT trialId FROM x_lastvotes WHERE judgeId = 'judge0')""")
def merge_votes(spark, sf):
    last = m.latest_votes(spark, sf).select(
        "trialId", "judgeId", F.col("criterias.correctness.rating").alias("correctness"), F.col("error").isNotNull().alias("failed")
    )
    new = last.where("judgeId = 'judge0'").withColumn("origin", F.lit("new"))
    return latest_ops.merge_votes(new, last.withColumn("origin", F.lit("old")))


@register("task_meta", """
SELECT taskId, arg_max(taskStatement, k) AS question_text_catalog, array_to_string(arg_max(tags, k), '|') AS tags,
  arg_max(validationType, k) AS validation_type_catalog FROM x_trials GROUP BY taskId""")
def task_meta(spark, sf):
    return latest_ops.task_meta(m.trials(spark, sf)).select(
        "taskId", "question_text_catalog", F.array_join("question_tags_catalog", "|").alias("tags"), "validation_type_catalog"
    )


@register("upsert_rows", """
SELECT trialId, CASE WHEN k % 10 = 0 THEN 'rerun' ELSE taskId END AS taskId FROM x_trials""")
def upsert_rows(spark, sf):
    t = m.trials(spark, sf).select("trialId", "taskId")
    again = t.where("CAST(trialId AS BIGINT) % 10 = 0").withColumn("taskId", F.lit("rerun"))
    return latest_ops.upsert(t, again)


@register("trial_facts", "SELECT * FROM x_facts")
def trial_facts(spark, sf):
    return m.facts(spark, sf)


@register("primary_metric", """
SELECT primary_metric_name, primary_success, primary_score, count(*) AS n FROM x_facts WHERE evaluation_present GROUP BY ALL""")
def primary_metric(spark, sf):
    facts = m.facts(spark, sf, with_traces=False).where("evaluation_present")
    return facts.groupBy("primary_metric_name", "primary_success", "primary_score").agg(F.count(F.lit(1)).alias("n"))


@register("total_calls", """
SELECT trialId, CASE WHEN coalesce(model_calls, tool_calls, function_calls, mcp_tool_calls) IS NOT NULL THEN
  coalesce(model_calls, 0) + coalesce(tool_calls, 0) + coalesce(function_calls, 0) + coalesce(mcp_tool_calls, 0) END AS calls,
  CASE WHEN coalesce(evaluation_input_tokens, evaluation_output_tokens) IS NOT NULL THEN
  coalesce(evaluation_input_tokens, 0) + coalesce(evaluation_output_tokens, 0) END AS eval_tokens FROM x_facts""")
def total_calls(spark, sf):
    facts = m.facts(spark, sf, with_traces=False)
    return facts.select("trialId", facts_ops.total_calls().alias("calls"), facts_ops.eval_tokens().alias("eval_tokens"))


@register("excerpt", """
SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS excerpt FROM documents""")
def excerpt(spark, sf):
    return m.table(spark, sf, "documents").select("doc_id", truncate("text", 280).alias("excerpt"))


@register("trace_flags", """
SELECT CAST(o_orderkey AS VARCHAR) AS trialId, (o_orderkey % 2 = 0 OR o_orderkey % 4 = 1) AS tool, o_orderkey % 3 = 0 AS native,
  o_orderkey % 7 < 3 AS server, o_orderkey % 11 = 0 AS error FROM orders WHERE o_orderkey % 5 <> 0""")
def trace_flags(spark, sf):
    return facts_ops.trace_flags(m.traces(spark, sf)).select(
        "trialId", F.col("__tool").alias("tool"), F.col("__native").alias("native"),
        F.col("__server").alias("server"), F.col("__error").alias("error"),
    )


@register("trace_flags_top_level", """
SELECT count(*) AS traces, count(*) FILTER (o_orderkey % 3 = 1 AND (o_orderkey % 2 = 0 OR o_orderkey % 4 = 1)) AS tool,
  count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 7 < 3) AS server,
  count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 11 = 0) AS error FROM orders WHERE o_orderkey % 5 <> 0""")
def trace_flags_top_level(spark, sf):
    flags = facts_ops.trace_flags(m.traces(spark, sf), nested=False)
    return flags.agg(
        F.count(F.lit(1)).alias("traces"), F.count_if("__tool").alias("tool"),
        F.count_if("__server").alias("server"), F.count_if("__error").alias("error"),
    )


# --- metric families ---------------------------------------------------------

def family_sql(kind: str, gb: str) -> str:
    """Statements of the families; every ratio is a DOUBLE division of the same two numbers."""
    rate = lambda cond: f"count(*) FILTER ({cond}) / CAST(count(*) AS DOUBLE)"
    share = lambda c: f"count(*) FILTER ({c}) / CAST(nullif(count({c}), 0) AS DOUBLE)"
    success = "count(*) FILTER (primary_success)"
    mixed = "count(DISTINCT primary_metric_name) > 1"
    calls = ("CASE WHEN coalesce(model_calls, tool_calls, function_calls, mcp_tool_calls) IS NOT NULL THEN coalesce(model_calls, 0)"
             " + coalesce(tool_calls, 0) + coalesce(function_calls, 0) + coalesce(mcp_tool_calls, 0) END")
    p95 = lambda c: f"CASE WHEN count({c}) >= 2 THEN quantile_cont({c}, 0.95) END"
    columns = {
        "n_trials": "count(*)",
        "n_evaluated": "count(*) FILTER (evaluation_present)",
        "n_responses": "count(*) FILTER (response_present)",
        "primary_metric_name": f"CASE WHEN {mixed} THEN 'mixed' ELSE min(primary_metric_name) END",
        "primary_success_count": success,
        "primary_success_rate": share("primary_success"),
        "primary_score_mean": f"CASE WHEN NOT ({mixed}) THEN avg(primary_score) END",
        "primary_score_median": f"CASE WHEN NOT ({mixed}) THEN round(quantile_cont(primary_score, 0.5), 6) END",
        "primary_score_stddev": f"CASE WHEN NOT ({mixed}) THEN round(stddev_samp(primary_score), 6) END",
        "total_tokens_mean": "avg(total_tokens)",
        "total_tokens_median": "round(quantile_cont(total_tokens, 0.5), 6)",
        "total_tokens_p95": f"round({p95('total_tokens')}, 6)",
        "total_tokens_sum": "sum(total_tokens)",
        "tokens_per_primary_success": f"sum(total_tokens) / nullif({success}, 0)",
        "duration_sec_mean": "avg(duration_ms) / 1000.0",
        "duration_sec_median": "round(quantile_cont(duration_ms, 0.5) / 1000.0, 6)",
        "duration_sec_p95": f"round({p95('duration_ms')} / 1000.0, 6)",
        "duration_sec_sum": "sum(duration_ms) / 1000.0",
        "duration_sec_per_primary_success": f"sum(duration_ms) / 1000.0 / nullif({success}, 0)",
        "model_calls_mean": "avg(model_calls)",
        "tool_calls_mean": "avg(tool_calls)",
        "function_calls_mean": "avg(function_calls)",
        "mcp_tool_calls_mean": "avg(mcp_tool_calls)",
        "steps_mean": "avg(steps)",
        "total_calls_sum": f"sum({calls})",
        "calls_per_primary_success": f"sum({calls}) / nullif({success}, 0)",
        "evaluation_method": "CASE WHEN count(DISTINCT evaluation_method) > 1 THEN 'mixed' ELSE min(evaluation_method) END",
        "evaluation_coverage_rate": rate("evaluation_present"),
        "evaluation_success_rate": rate("evaluation_status IN ('evaluated', 'partial')"),
        "evaluation_error_rate": rate("evaluation_status = 'error'"),
        "evaluation_skipped_rate": rate("evaluation_status = 'skipped'"),
        "n_evaluation_status_other": "count(*) FILTER (evaluation_present AND evaluation_status NOT IN ('evaluated','partial','error','skipped'))",
        "judge_count_mean": "avg(judge_count)",
        "judge_error_rate": "sum(judge_error_count) / nullif(sum(judge_count), 0)",
        "judge_agreement_mean": "avg(judge_agreement_mean)",
        "judge_unanimity_rate": share("judge_unanimous"),
        "evaluation_tokens_mean": "avg(CASE WHEN coalesce(evaluation_input_tokens, evaluation_output_tokens) IS NOT NULL THEN "
                                  "coalesce(evaluation_input_tokens, 0) + coalesce(evaluation_output_tokens, 0) END)",
        "evaluation_duration_sec_median": "round(quantile_cont(evaluation_duration_ms, 0.5) / 1000.0, 6)",
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
    names = {
        "effectiveness": metric_ops.EFFECTIVENESS, "efficiency": metric_ops.EFFICIENCY,
        "reliability": metric_ops.RELIABILITY, "observability": metric_ops.OBSERVABILITY,
        "aggregate": [n for n in metric_ops.AGGREGATE if "_range_by_" not in n],
    }[kind]
    listed = ", ".join(f"{columns[n]} AS {n}" for n in names)
    return f"SELECT {gb}, {listed} FROM x_facts GROUP BY {gb}"


ROUNDED = [
    "primary_score_median", "primary_score_stddev", "total_tokens_median", "total_tokens_p95",
    "duration_sec_median", "duration_sec_p95", "evaluation_duration_sec_median",
]


def tidy(df):
    return rounded(df, *[c for c in ROUNDED if c in df.columns])


def _family(name, kind, fn, gb):
    @register(name, family_sql(kind, ", ".join(gb)))
    def run(spark, sf):
        return tidy(fn(m.facts(spark, sf), gb))
    return run


_family("effectiveness", "effectiveness", metric_ops.effectiveness, ["dataset_id", "configurationId"])
_family("effectiveness_by_task", "effectiveness", metric_ops.effectiveness, ["taskId", "modelId"])
_family("efficiency", "efficiency", metric_ops.efficiency, ["dataset_id", "configurationId"])
_family("efficiency_by_instance", "efficiency", metric_ops.efficiency, ["instanceId"])
_family("eval_reliability", "reliability", metric_ops.eval_reliability, ["dataset_id", "configurationId"])
_family("eval_reliability_by_task", "reliability", metric_ops.eval_reliability, ["taskId"])
_family("observability", "observability", metric_ops.observability, ["dataset_id", "configurationId"])


def robust_sql(gb: str, axes: dict[str, str]) -> str:
    parts = []
    for axis, keys in axes.items():
        parts.append(f"""
SELECT s.*, CASE WHEN n_groups >= 2 THEN mean END AS primary_score_mean,
  CASE WHEN n_groups >= 2 THEN round(sd, 6) END AS primary_score_stddev,
  CASE WHEN n_groups >= 2 THEN round(dsd / 1000.0, 6) END AS duration_sec_stddev,
  CASE WHEN n_groups >= 2 THEN round(tsd, 6) END AS total_tokens_stddev
FROM (SELECT {gb}, '{axis}' AS robustness_axis, count(*) AS n_groups,
    CASE WHEN count(*) >= 2 THEN round(avg(rate), 9) END AS primary_success_rate_mean,
    CASE WHEN count(*) >= 2 THEN min(rate) END AS primary_success_rate_min,
    CASE WHEN count(*) >= 2 THEN max(rate) END AS primary_success_rate_max,
    CASE WHEN count(*) >= 2 THEN max(rate) - min(rate) END AS primary_success_rate_range
  FROM (SELECT {gb}, {keys}, count(*) FILTER (primary_success) / CAST(nullif(count(primary_success), 0) AS DOUBLE) AS rate
        FROM x_facts GROUP BY {gb}, {keys}) GROUP BY {gb}) s
JOIN (SELECT {gb}, avg(primary_score) AS mean, stddev_samp(primary_score) AS sd, stddev_samp(duration_ms) AS dsd,
        stddev_samp(total_tokens) AS tsd FROM x_facts GROUP BY {gb}) w USING ({gb})""")
    return "\nUNION ALL\n".join(parts)


AXIS_SQL = {a: ", ".join(keys) for a, keys in metric_ops.AXES.items()}


def robust(facts, gb, axes=None):
    table = metric_ops.robustness(facts, gb, axes)
    table = rounded(table, "primary_score_stddev", "duration_sec_stddev", "total_tokens_stddev")
    return rounded(table, "primary_success_rate_mean", digits=9)


def _robust(name, gb, axes):
    @register(name, robust_sql(", ".join(gb), {a: AXIS_SQL[a] for a in axes}))
    def run(spark, sf):
        return robust(m.facts(spark, sf, with_traces=False), gb, axes)
    return run


for _axis in ("task", "instance", "repeat", "model"):
    _robust(f"robustness_{_axis}", ["configurationId"], [_axis])
_robust("robustness_all_axes", ["dataset_id", "configurationId"], list(metric_ops.AXES))

_RANGES = "\nUNION ALL\n".join(
    f"SELECT dataset_id, configurationId, '{a}' AS axis, CASE WHEN count(*) >= 2 THEN max(rate) - min(rate) END AS spread FROM ("
    f"SELECT dataset_id, configurationId, {keys}, count(*) FILTER (primary_success) / CAST(nullif(count(primary_success), 0) AS DOUBLE) AS rate "
    f"FROM x_facts GROUP BY dataset_id, configurationId, {keys}) GROUP BY dataset_id, configurationId"
    for a, keys in AXIS_SQL.items()
)
cte("x_ranges", _RANGES)


@register("aggregate_metrics", f"""
SELECT a.*, {", ".join(f"r.{x} AS primary_success_rate_range_by_{x}" for x in AXIS_SQL)}
FROM ({family_sql("aggregate", "dataset_id, configurationId")}) a
JOIN (SELECT dataset_id, configurationId, {", ".join(f"max(spread) FILTER (axis = '{x}') AS {x}" for x in AXIS_SQL)}
  FROM x_ranges GROUP BY ALL) r USING (dataset_id, configurationId)""")
def aggregate_metrics(spark, sf):
    return tidy(metric_ops.aggregate_metrics(m.facts(spark, sf), ["dataset_id", "configurationId"]))


_DIM = {
    "effectiveness": {"primary_success_rate": "count(*) FILTER (primary_success) / CAST(nullif(count(primary_success), 0) AS DOUBLE)"},
    "efficiency": {"tokens_per_primary_success": "sum(total_tokens) / nullif(count(*) FILTER (primary_success), 0)"},
    "evaluation_reliability": {
        "evaluation_coverage_rate": "count(*) FILTER (evaluation_present) / CAST(count(*) AS DOUBLE)",
        "judge_unanimity_rate": "count(*) FILTER (judge_unanimous) / CAST(nullif(count(judge_unanimous), 0) AS DOUBLE)",
    },
    "observability": {"trace_coverage_rate": "count(*) FILTER (trace_available) / CAST(nullif(count(trace_available), 0) AS DOUBLE)"},
}


@register("dimension_summary", "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dimension, dataset_id || '|' || configurationId AS group_key, dataset_id, configurationId, '{k}' AS metric, {v} AS value "
    "FROM x_facts GROUP BY dataset_id, configurationId"
    for d, metrics in _DIM.items() for k, v in metrics.items()
) + """
UNION ALL SELECT 'robustness', dataset_id || '|' || configurationId, dataset_id, configurationId,
  'primary_success_rate_range_by_' || axis, spread FROM x_ranges""")
def dimension_summary(spark, sf):
    return metric_ops.dimension_summary(m.facts(spark, sf), ["dataset_id", "configurationId"])


@register("summary", """
SELECT '2.0' AS schemaVersion, count(DISTINCT experimentId) AS experiments,
  array_to_string(list_sort(list(DISTINCT dataset_id)), ',') AS datasets, count(*) AS n_trials,
  count(*) FILTER (response_present) AS n_responses, count(*) FILTER (evaluation_present) AS n_evaluated,
  'mixed' AS primary_metric_name, count(*) FILTER (primary_success) / CAST(count(primary_success) AS DOUBLE) AS primary_success_rate,
  sum(total_tokens) AS total_tokens_sum, round(quantile_cont(duration_ms, 0.5) / 1000.0, 6) AS duration_sec_median,
  count(*) FILTER (evaluation_status IN ('evaluated', 'partial')) / CAST(count(*) AS DOUBLE) AS evaluation_success_rate,
  count(*) FILTER (trace_available) / CAST(count(*) AS DOUBLE) AS trace_coverage_rate FROM x_facts""")
def summary(spark, sf):
    return tidy(metric_ops.summary(m.facts(spark, sf))).withColumn("datasets", F.array_join("datasets", ","))


@register("failure_cases", f"""
SELECT {", ".join(select_ops.FAILURE_COLUMNS)} FROM x_facts
WHERE (response_present AND coalesce(execution_status, '') <> 'success') OR evaluation_status IN ('error', 'skipped')
  OR primary_success IS FALSE OR (primary_success IS NULL AND evaluation_present)""")
def failure_cases(spark, sf):
    return select_ops.failure_cases(m.facts(spark, sf, with_traces=False))


@register("pooled_configurations", """
SELECT representation, string_agg(configurationId, ',' ORDER BY configurationId) AS configurations
FROM (SELECT DISTINCT representation, configurationId FROM x_trials) GROUP BY representation HAVING count(*) > 1""")
def pooled_configurations(spark, sf):
    return metric_ops.pooled(m.trials(spark, sf), ["representation"]).select(
        "representation", F.array_join("configurationIds", ",").alias("configurations")
    )


def flagship(spark, sf):
    """Effectiveness next to efficiency, per configuration: success rate, token and time cost of a success."""
    facts = m.facts(spark, sf)
    left = metric_ops.effectiveness(facts, ["configurationId"])
    right = metric_ops.efficiency(facts, ["configurationId"]).drop("n_trials", "primary_success_count")
    return tidy(left.join(right, "configurationId", "inner"))


register("flagship", f"""
SELECT a.*, b.* EXCLUDE (configurationId, n_trials, primary_success_count)
FROM ({family_sql("effectiveness", "configurationId")}) a JOIN ({family_sql("efficiency", "configurationId")}) b USING (configurationId)""")(flagship)
