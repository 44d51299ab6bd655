"""Queries: runs, study tables, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialscape.mart import tables as m
from trialscape.mart.q_facts import COLLAPSED, consensus
from trialscape.mart.registry import cte, register, rounded
from trialscape.operators import latest as latest_ops
from trialscape.operators import ranking, runs as runs_ops, select as select_ops, study
from trialscape.operators import votes as vote_ops


def runs(spark, sf, text=False):
    """The run table; only listings that show answers ask for their texts."""
    li = m.lines_by_trial(spark, sf)
    return runs_ops.build_runs(
        m.latest_responses(spark, sf, text, li),
        m.evals(spark, sf, li).drop("seq"),
        m.votes(spark, sf, li=li),
        consensus(spark, sf, li),
        latest_ops.task_meta(m.trials(spark, sf)),
    )


cte("x_cost", """
SELECT trialId, coalesce(sum(totalTokens), 0) AS v_total, coalesce(sum(durationMs), 0) AS v_ms, count(*) AS v_rows, count(error) AS v_errors
FROM x_votes GROUP BY trialId""")
cte("x_runs0", f"""
SELECT t.trialId, t.experimentId, t.taskId, t.instanceId, t.modelId, t.configurationId, t.strategy, t.representation, t.tags,
  l.status AS status_answer, coalesce(l.response, '') AS response, coalesce(l.u_total, l.totalTokens) AS tokens,
  coalesce(l.totalDurationMs, l.price + l.line) AS ms, l.toolCalls, l.mcpToolCalls, l.functionCalls, l.modelCalls,
  e.ev_status AS status_eval, e.trialId IS NOT NULL AS has_eval, e.evaluationTotalTokens AS ev_tokens, e.evaluationDurationMs AS ev_ms,
  e.correctness AS ev_correctness, e.c_agree AS ev_c, e.completeness AS ev_completeness, e.k_agree AS ev_k,
  w.*, {COLLAPSED} AS collapsed,
  coalesce(c_major = 'meets', false) AND coalesce(k_major = 'meets', false) AS strict, c_umeet AND k_umeet AS fullm,
  c_una AND k_una AS fullc, NOT (c_has AND k_has) AS nomaj, c.v_total, c.v_ms, c.v_rows, c.v_errors
FROM x_trials t JOIN x_last l USING (trialId) LEFT JOIN x_evals e USING (trialId)
LEFT JOIN (SELECT trialId AS wid, * EXCLUDE (trialId) FROM x_wide) w ON t.trialId = w.wid LEFT JOIN x_cost c USING (trialId)""")
cte("x_runs", """
SELECT *, coalesce(tokens, 0) AS ans, v_total AS ev_cost, coalesce(tokens, 0) + v_total AS cost, coalesce(ev_tokens, 0) AS ev_rep,
  coalesce(tokens, 0) + coalesce(ev_tokens, 0) AS cost_rep, coalesce(ms, 0) AS ans_ms, coalesce(ev_ms, 0) AS ev_rep_ms,
  coalesce(ms, 0) + coalesce(ev_ms, 0) AS total_ms, CASE WHEN fullm THEN 0 ELSE coalesce(tokens, 0) + v_total END AS wasted
FROM x_runs0""")
cte("x_tagged", """
SELECT x_runs.*, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['uncategorized'] END) AS category FROM x_runs""")


@register("runs", """
SELECT trialId, taskId, modelId, configurationId, status_answer, response, has_eval, tokens AS totalTokens_answer,
  ms AS totalDurationMs_answer, strict AS strict_majority_meet, fullm AS full_unanimous_meet, fullc AS full_consensus,
  nomaj AS no_majority_any_criterion, collapsed AS collapsed_majority_accuracy, ans AS answer_tokens_cost,
  ev_cost AS evaluation_tokens_corrected, cost AS total_cost_tokens_corrected, cost_rep AS total_cost_tokens_reported,
  total_ms AS total_duration_reported_ms, v_ms AS evaluation_duration_votes_sum_ms,
  CAST(wasted AS DOUBLE) AS wasted_tokens_no_full_meet, NOT fullm AS is_wasted_no_full_meet, array_to_string(tags, '|') AS tags,
  length(response) AS answerChars FROM x_runs""")
def runs_query(spark, sf):
    return runs(spark, sf, text=True).select(
        "trialId", "taskId", "modelId", "configurationId", "status_answer", "response", "has_eval", "totalTokens_answer",
        "totalDurationMs_answer", "strict_majority_meet", "full_unanimous_meet", "full_consensus",
        "no_majority_any_criterion", "collapsed_majority_accuracy", "answer_tokens_cost", "evaluation_tokens_corrected",
        "total_cost_tokens_corrected", "total_cost_tokens_reported", "total_duration_reported_ms",
        "evaluation_duration_votes_sum_ms", "wasted_tokens_no_full_meet", "is_wasted_no_full_meet",
        F.array_join("categories", "|").alias("tags"), "answerChars",
    )


@register("flatten_responses", """
SELECT trialId, status AS status_answer, u_input AS inputTokens_answer, outputTokens AS outputTokens_answer, coalesce(u_total, totalTokens) AS totalTokens_answer,
  cachedInputTokens AS cachedInputTokens_answer, coalesce(totalDurationMs, price + line) AS totalDurationMs_answer, modelDurationMs,
  toolCalls, length(coalesce(response, '')) AS answerChars, len(regexp_extract_all(coalesce(response, ''), '[\\p{L}\\p{N}_]+')) AS answerWords
FROM x_log""")
def flatten_responses(spark, sf):
    return runs_ops.flatten_responses(m.responses(spark, sf)).select(
        "trialId", "status_answer", "inputTokens_answer", "outputTokens_answer", "totalTokens_answer", "cachedInputTokens_answer",
        "totalDurationMs_answer", "modelDurationMs", "toolCalls", "answerChars", "answerWords",
    )


@register("flatten_evals", """
SELECT trialId, configurationId AS configuration_eval, ev_status AS status_eval, validationType AS evaluationMethod,
  evaluationTotalTokens AS evaluationTotalTokens_reported, judgeCount AS judgeCount_reported, correctness AS correctness_outcome_rating,
  c_agree AS correctness_outcome_agreement, completeness AS completeness_outcome_rating, k_agree AS completeness_outcome_agreement,
  ev_trace AS traceRef_eval FROM x_evals""")
def flatten_evals(spark, sf):
    return runs_ops.flatten_evals(m.evals(spark, sf)).select(
        "trialId", "configuration_eval", "status_eval", "evaluationMethod", "evaluationTotalTokens_reported", "judgeCount_reported",
        "correctness_outcome_rating", "correctness_outcome_agreement", "completeness_outcome_rating",
        "completeness_outcome_agreement", "traceRef_eval",
    )


@register("runs_by_category", "SELECT trialId, category, cost AS total_cost_tokens_corrected FROM x_tagged")
def runs_by_category(spark, sf):
    return runs_ops.explode_tags(runs(spark, sf)).select("trialId", "category", "total_cost_tokens_corrected")


def run_summary_sql(source: str, keys: list[str], extra: str = "") -> str:
    gb = ", ".join(keys)
    head = f"{extra}{gb + ', ' if keys else ''}"
    f = lambda agg, c: f"{agg}({c}) FILTER (has_eval)"
    n = "count(*) FILTER (has_eval)"
    cnt = lambda c: f"count(*) FILTER (has_eval AND {c})"
    pct = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0) * 100.0"
    tot = lambda c: f"coalesce({f('sum', c)}, 0)"
    q = lambda c, p: f"round({f('quantile_cont', f'{c}, {p}')}, 6)".replace(f"quantile_cont({c}, {p}) FILTER", f"quantile_cont({c}, {p}) FILTER")
    cols = {
        "runs": "count(*)", "evaluated": n, "answer_errors": "count(*) FILTER (coalesce(status_answer, '') <> 'success')",
        "answer_tokens_sum": tot("ans"), "evaluation_tokens_corrected_sum": tot("ev_cost"), "total_cost_tokens_corrected_sum": tot("cost"),
        "answer_tokens_avg": f("avg", "ans"), "evaluation_tokens_corrected_avg": f("avg", "ev_cost"),
        "total_cost_tokens_corrected_avg": f("avg", "cost"), "eval_share_of_total_cost_pct": pct(tot("ev_cost"), tot("cost")),
        "answer_duration_ms_avg": f("avg", "ans_ms"), "evaluation_duration_reported_ms_avg": f("avg", "ev_rep_ms"),
        "total_duration_reported_ms_avg": f("avg", "total_ms"), "strict_majority_meet_count": cnt("strict"),
        "strict_majority_meet_rate_pct": pct(cnt("strict"), n),
        **{f"collapsed_majority_{v}_pct": pct(cnt(f"collapsed = '{v}'"), n) for v in ("meets", "partial", "misses", "no_majority")},
        "full_consensus_count": cnt("fullc"), "full_consensus_rate_pct": pct(cnt("fullc"), n),
        "full_unanimous_meet_count": cnt("fullm"), "full_unanimous_meet_rate_pct": pct(cnt("fullm"), n),
        "correctness_consensus_rate_pct": pct(cnt("c_una"), n), "completeness_consensus_rate_pct": pct(cnt("k_una"), n),
        "correctness_unanimous_meet_rate_pct": pct(cnt("c_umeet"), n), "completeness_unanimous_meet_rate_pct": pct(cnt("k_umeet"), n),
        "no_majority_any_criterion_count": cnt("nomaj"), "no_majority_any_criterion_pct": pct(cnt("nomaj"), n),
        "tokens_per_strict_majority_meet": f"{tot('cost')} / nullif({cnt('strict')}, 0)",
        "tokens_per_full_unanimous_meet": f"{tot('cost')} / nullif({cnt('fullm')}, 0)",
        "strict_majority_meets_per_100k_tokens": f"{cnt('strict')} / nullif({tot('cost')}, 0) * 100000.0",
        "full_unanimous_meets_per_100k_tokens": f"{cnt('fullm')} / nullif({tot('cost')}, 0) * 100000.0",
        "wasted_tokens_no_full_meet": tot("wasted"), "wasted_tokens_no_full_meet_pct": pct(tot("wasted"), tot("cost")),
        "toolCalls_avg_reported": f("avg", "toolCalls"), "mcpToolCalls_avg_reported": f("avg", "mcpToolCalls"),
        "functionCalls_avg_reported": f("avg", "functionCalls"), "modelCalls_avg": f("avg", "modelCalls"),
        "answer_tokens_median": q("ans", 0.5), "total_cost_tokens_corrected_median": q("cost", 0.5), "answer_tokens_p95": q("ans", 0.95),
        "total_cost_tokens_corrected_p95": q("cost", 0.95), "answer_duration_ms_median": q("ans_ms", 0.5), "answer_duration_ms_p95": q("ans_ms", 0.95),
    }
    listed = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"SELECT {head}{listed} FROM {source}" + (f" GROUP BY {gb}" if keys else "")


MEDIANS = [
    "answer_tokens_median", "total_cost_tokens_corrected_median", "answer_tokens_p95", "total_cost_tokens_corrected_p95",
    "answer_duration_ms_median", "answer_duration_ms_p95",
]


@register("summary_by_configuration", run_summary_sql("x_runs", ["configurationId"]))
def summary_by_configuration(spark, sf):
    return rounded(study.summarize_runs(runs(spark, sf), ["configurationId"]), *MEDIANS)


def _keys(present: list[str]) -> str:
    every = ["strategy", "configurationId", "modelId", "taskId", "representation", "category"]
    return ", ".join(k if k in present else f"NULL::VARCHAR AS {k}" for k in every)


_ALL = []
for _source, _sets in (("x_runs", study.RUN_GROUPINGS), ("x_tagged", study.TAG_GROUPINGS)):
    for _name, _cols in _sets.items():
        _inner = run_summary_sql(_source, _cols)
        _ALL.append(f"SELECT '{_name}' AS grouping, {_keys(_cols)}, * EXCLUDE ({', '.join(_cols)}) FROM ({_inner})"
                    if _cols else f"SELECT '{_name}' AS grouping, {_keys(_cols)}, * FROM ({_inner})")


@register("summary_grouping_sets", "\nUNION ALL BY NAME\n".join(_ALL))
def summary_grouping_sets(spark, sf):
    table = runs(spark, sf)
    return rounded(study.summaries(table, runs_ops.explode_tags(table)), *MEDIANS)


@register("judge_cost", """
SELECT judgeId, provider, model, count(*) AS vote_rows, count(DISTINCT trialId) AS run_count, sum(inputTokens) AS input_tokens_sum,
  sum(outputTokens) AS output_tokens_sum, sum(totalTokens) AS total_tokens_sum, avg(totalTokens) AS avg_total_tokens_per_vote,
  avg(durationMs) AS avg_duration_ms_per_vote, count(error) AS error_rows FROM x_votes GROUP BY judgeId, provider, model""")
def judge_cost(spark, sf):
    return study.judge_cost(m.votes(spark, sf))


@register("cost_reconciliation", """
SELECT sum(ev_rep) AS evals_reported_total_tokens_sum, sum(ev_cost) AS judge_votes_corrected_total_tokens_sum,
  sum(ev_cost) - sum(ev_rep) AS missing_tokens_if_using_evals_jsonl, sum(ev_rep) / sum(ev_cost) * 100.0 AS reported_over_corrected_pct,
  sum(ans) AS answers_total_tokens_sum, sum(cost) AS corrected_total_experiment_tokens FROM x_runs""")
def cost_reconciliation(spark, sf):
    return study.cost_reconciliation(runs(spark, sf))


_DIST = ", ".join(f"count(*) FILTER (rating = '{r}') AS {r}, count(*) FILTER (rating = '{r}') / CAST(count(*) AS DOUBLE) * 100.0 AS {r}_pct"
                  for r in ("meets", "partial", "misses"))


@register("judge_distribution", f"SELECT judgeId, criterion, {_DIST}, count(*) AS total FROM x_long GROUP BY judgeId, criterion")
def judge_distribution(spark, sf):
    return study.judge_distribution(vote_ops.votes_long(m.votes(spark, sf)))


@register("vote_patterns", "SELECT criterion, ratings_tuple, count(*) AS count FROM x_cons GROUP BY criterion, ratings_tuple")
def vote_patterns(spark, sf):
    return study.vote_patterns(consensus(spark, sf))


cte("x_check", """
SELECT e.*, ratings_tuple, coalesce(has_majority, false) AS has_majority, majority_rating, coalesce(unanimous, false) AS unanimous,
  coalesce(outcome_agreement = has_majority, false) AS m1, coalesce(outcome_agreement = unanimous, false) AS m2,
  coalesce(outcome_rating = majority_rating, false) AS m3
FROM (SELECT trialId, taskId, 'correctness' AS criterion, correctness AS outcome_rating, c_agree AS outcome_agreement FROM x_evals
  UNION ALL SELECT trialId, taskId, 'completeness', completeness, k_agree FROM x_evals) e LEFT JOIN x_cons USING (trialId, criterion)""")


def checked(spark, sf):
    return vote_ops.agreement_check(vote_ops.evals_long(runs_ops.flatten_evals(m.evals(spark, sf))), consensus(spark, sf))


@register("evals_long", """
SELECT trialId, criterion, outcome_rating, outcome_agreement FROM x_check""")
def evals_long(spark, sf):
    return vote_ops.evals_long(runs_ops.flatten_evals(m.evals(spark, sf))).select("trialId", "criterion", "outcome_rating", "outcome_agreement")


@register("agreement_check", """
SELECT trialId, criterion, m1 AS outcome_agreement_matches_majority, m2 AS outcome_agreement_matches_unanimity, m3 AS outcome_rating_matches_majority,
  coalesce(outcome_agreement, false) AND NOT unanimous AS agreement_true_but_not_unanimous,
  NOT has_majority AND outcome_rating IS NOT NULL AS no_majority_but_outcome_rating_present FROM x_check""")
def agreement_check(spark, sf):
    return checked(spark, sf).select(
        "trialId", "criterion", "outcome_agreement_matches_majority", "outcome_agreement_matches_unanimity",
        "outcome_rating_matches_majority", "agreement_true_but_not_unanimous", "no_majority_but_outcome_rating_present",
    )


@register("agreement_summary", """
SELECT count(*) AS criterion_rows, count(*) FILTER (outcome_agreement) AS outcome_agreement_true, count(*) FILTER (unanimous) AS real_unanimous_rows,
  count(*) FILTER (outcome_agreement AND NOT unanimous) AS agreement_true_but_not_unanimous, count(*) FILTER (NOT has_majority) AS no_majority_rows,
  count(*) FILTER (NOT has_majority AND outcome_rating IS NOT NULL) AS no_majority_but_outcome_rating_present,
  count(*) FILTER (m1) / CAST(count(*) AS DOUBLE) * 100.0 AS agreement_matches_majority_pct,
  count(*) FILTER (m2) / CAST(count(*) AS DOUBLE) * 100.0 AS agreement_matches_unanimity_pct,
  count(*) FILTER (has_majority AND m3) / CAST(count(*) FILTER (has_majority) AS DOUBLE) * 100.0 AS rating_matches_majority_when_majority_pct
FROM x_check""")
def agreement_summary(spark, sf):
    return study.agreement_summary(checked(spark, sf))


@register("discrepancies", """
SELECT trialId, taskId, criterion, ratings_tuple, has_majority, majority_rating, unanimous, outcome_rating, outcome_agreement
FROM x_check WHERE NOT unanimous OR NOT has_majority""")
def discrepancies(spark, sf):
    return select_ops.list_discrepancies(checked(spark, sf), limit=None).withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("has_majority", "unanimous")}
    )


@register("discrepancies_first", """
SELECT trialId, taskId, criterion, ratings_tuple, has_majority, majority_rating, unanimous, outcome_rating, outcome_agreement
FROM x_check WHERE (NOT unanimous OR NOT has_majority) AND criterion = 'completeness' ORDER BY trialId, criterion LIMIT 25""")
def discrepancies_first(spark, sf):
    """The first 25 of one criterion; the limit is the listing's own."""
    return select_ops.list_discrepancies(checked(spark, sf), criterion="completeness", limit=25).withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("has_majority", "unanimous")}
    )


def query_sql(source: str, keys: list[str]) -> str:
    gb = ", ".join(keys)
    f = lambda agg, c: f"{agg}({c}) FILTER (has_eval)"
    n, full, strict = "count(*) FILTER (has_eval)", "count(*) FILTER (has_eval AND fullm)", "count(*) FILTER (has_eval AND strict)"
    total, waste = f("sum", "tokens"), "sum(tokens) FILTER (has_eval AND NOT fullm)"
    return f"""SELECT {gb}, count(*) AS runs, {n} AS evaluated, {total} AS query_tokens_sum, {f('avg', 'tokens')} AS query_tokens_mean,
  round({f('quantile_cont', 'tokens, 0.5')}, 6) AS query_tokens_median, round({f('quantile_cont', 'tokens, 0.95')}, 6) AS query_tokens_p95,
  {f('avg', 'ms')} AS query_duration_ms_mean, round({f('quantile_cont', 'ms, 0.5')}, 6) AS query_duration_ms_median,
  {strict} AS strict_majority_success_count, CAST({strict} AS DOUBLE) / nullif({n}, 0) * 100.0 AS strict_majority_success_rate_pct,
  {full} AS full_unanimous_meet_count, CAST({full} AS DOUBLE) / nullif({n}, 0) * 100.0 AS full_unanimous_meet_rate_pct,
  {total} / nullif({full}, 0) AS query_tokens_per_full_unanimous_meet, {full} / nullif({total}, 0) * 100000.0 AS full_unanimous_meets_per_100k_query_tokens,
  {waste} AS wasted_query_tokens_no_full_meet, {waste} / nullif({total}, 0) * 100.0 AS wasted_query_tokens_no_full_meet_pct
FROM {source} GROUP BY {gb}"""


QUERY_MEDIANS = ["query_tokens_median", "query_tokens_p95", "query_duration_ms_median"]


def by_model(spark, sf, percentiles=False):
    return study.query_effectiveness(runs(spark, sf), ["modelId", "configurationId"], percentiles=percentiles)


def by_category(spark, sf, percentiles=False):
    tagged = runs_ops.explode_tags(runs(spark, sf))
    return study.query_effectiveness(tagged, ["category", "configurationId"], percentiles=percentiles)


cte("x_qmodel", query_sql("x_runs", ["modelId", "configurationId"]))
cte("x_qcat", query_sql("x_tagged", ["category", "configurationId"]))
register("query_effectiveness", "SELECT * FROM x_qmodel")(
    lambda spark, sf: rounded(by_model(spark, sf, True), *QUERY_MEDIANS))
register("query_effectiveness_category", "SELECT * FROM x_qcat")(
    lambda spark, sf: rounded(by_category(spark, sf, True), *QUERY_MEDIANS))


@register("outcome_distribution", "SELECT configurationId, " + ", ".join(
    f"count(*) FILTER (collapsed = '{v}') / CAST(count(*) AS DOUBLE) * 100.0 AS {v}" for v in ("meets", "partial", "misses", "no_majority")
) + " FROM x_runs GROUP BY configurationId")
def outcome_distribution(spark, sf):
    return study.outcome_distribution(runs(spark, sf))


cte("x_base", """
SELECT v.trialId, v.judgeId, v.criterion, v.rating, r.taskId, r.modelId, r.configurationId, r.tokens, r.tags
FROM x_long v JOIN x_runs r ON v.trialId = r.trialId WHERE r.has_eval AND r.tokens IS NOT NULL""")


def vote_base(spark, sf):
    return runs_ops.vote_base(runs(spark, sf), vote_ops.votes_long(m.votes(spark, sf)))


@register("vote_distribution_task", f"""
SELECT criterion, taskId, {_DIST}, count(*) AS total_votes, avg(tokens) AS avg_query_tokens FROM x_base GROUP BY criterion, taskId""")
def vote_distribution_task(spark, sf):
    return study.vote_distribution(vote_base(spark, sf), "taskId")


@register("vote_distribution_tag", f"""
SELECT criterion, category AS tag, {_DIST}, count(*) AS total_votes, avg(tokens) AS avg_query_tokens
FROM (SELECT *, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['uncategorized'] END) AS category FROM x_base) GROUP BY criterion, category""")
def vote_distribution_tag(spark, sf):
    tagged = runs_ops.explode_tags(vote_base(spark, sf))
    return study.vote_distribution(tagged, "category").withColumnRenamed("category", "tag")


@register("entity_order", """
SELECT taskId, round(avg(p), 6) AS mean_meets_pct FROM (
  SELECT criterion, taskId, count(*) FILTER (rating = 'meets') / CAST(count(*) AS DOUBLE) * 100.0 AS p FROM x_base GROUP BY criterion, taskId)
GROUP BY taskId""")
def entity_order(spark, sf):
    return rounded(study.entity_order(study.vote_distribution(vote_base(spark, sf), "taskId"), "taskId"), "mean_meets_pct")


@register("success_matrix", """
SELECT taskId, modelId, count(DISTINCT trialId) AS runs, count(*) FILTER (fullm) / CAST(count(*) AS DOUBLE) * 100.0 AS success_rate_pct,
  avg(ms) AS avg_time_ms FROM x_runs WHERE has_eval GROUP BY taskId, modelId""")
def success_matrix(spark, sf):
    return study.success_matrix(runs(spark, sf), "taskId", "modelId")


CONFIGS = ["cfg-F", "cfg-O", "cfg-P"]


@register("category_pivot", "SELECT category, " + ", ".join(
    f"max(CASE WHEN configurationId = '{c}' THEN p END) AS \"{c}\"" for c in CONFIGS
) + """ FROM (SELECT category, configurationId, CAST(count(*) FILTER (has_eval AND strict) AS DOUBLE) / nullif(count(*) FILTER (has_eval), 0) * 100.0 AS p
  FROM x_tagged GROUP BY category, configurationId) GROUP BY category""")
def category_pivot(spark, sf):
    tagged = runs_ops.explode_tags(runs(spark, sf))
    table = study.summarize_runs(tagged, ["category", "configurationId"], percentiles=False)
    return study.category_pivot(table, "majority_success", CONFIGS)


def box_sql(keys: str, value: str, source: str) -> str:
    return f"""
SELECT {keys}, n, min, max, mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, whisker_low, whisker_high, outliers FROM (
  SELECT {keys}, any_value(b.n) AS n, any_value(b.lo) AS min, any_value(b.hi) AS max, any_value(b.mean) AS mean, any_value(q1) AS q1,
    any_value(median) AS median, any_value(q3) AS q3, min({value}) FILTER ({value} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
    max({value}) FILTER ({value} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
    count(*) FILTER (NOT ({value} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)) AS outliers
  FROM ({source}) s JOIN (SELECT {keys}, count(*) AS n, min({value}) AS lo, max({value}) AS hi, avg({value}) AS mean, quantile_cont({value}, 0.25) AS q1,
    quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM ({source}) GROUP BY {keys}) b USING ({keys}) GROUP BY {keys})"""


@register("box_stats", box_sql("configurationId", "cost", "SELECT * FROM x_runs WHERE has_eval"))
def box_stats(spark, sf):
    table = study.box_stats(runs(spark, sf).where("has_eval"), ["configurationId"], "total_cost_tokens_corrected")
    return rounded(table, "q1", "median", "q3")


_LABELLED = """SELECT *, configurationId || ' | ' || CASE WHEN fullm THEN 'Unanimous success' ELSE 'Other outcomes' END AS label
FROM x_runs WHERE has_eval AND tokens IS NOT NULL"""


@register("box_stats_by_success", box_sql("label", "tokens", _LABELLED))
def box_stats_by_success(spark, sf):
    rows = runs(spark, sf).where("has_eval").withColumn("group", runs_ops.success_group())
    rows = rows.withColumn("label", runs_ops.group_label("configurationId", "group"))
    return rounded(study.box_stats(rows, ["label"], "totalTokens_answer"), "q1", "median", "q3")


# --- rankings ----------------------------------------------------------------

@register("pareto", """
SELECT modelId, configurationId, query_tokens_mean, full_unanimous_meet_rate_pct FROM (
  SELECT *, max(full_unanimous_meet_rate_pct) OVER (ORDER BY query_tokens_mean, full_unanimous_meet_rate_pct DESC, modelId || configurationId
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM x_qmodel)
WHERE best IS NULL OR full_unanimous_meet_rate_pct > best""")
def pareto(spark, sf):
    table = by_model(spark, sf).withColumn("key", F.concat("modelId", "configurationId"))
    return ranking.pareto(table, "query_tokens_mean", "full_unanimous_meet_rate_pct", "key").select(
        "modelId", "configurationId", "query_tokens_mean", "full_unanimous_meet_rate_pct"
    )


@register("pareto_orders", """
SELECT o_orderkey, o_totalprice, price FROM (SELECT *, max(price) OVER (ORDER BY o_totalprice, price DESC, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM (SELECT o_orderkey, any_value(o_totalprice) AS o_totalprice, max(l_extendedprice) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey))
WHERE best IS NULL OR price > best""")
def pareto_orders(spark, sf):
    li = m.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"))
    rows = m.table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "inner")
    return ranking.pareto(rows.select("o_orderkey", "o_totalprice", "price"), "o_totalprice", "price", "o_orderkey")


@register("minmax", """
SELECT modelId, configurationId, CASE WHEN max(p) OVER () = min(p) OVER () THEN 0.5 ELSE (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) END AS quality_norm,
  CASE WHEN max(q) OVER (PARTITION BY modelId) = min(q) OVER (PARTITION BY modelId) THEN 0.5
    ELSE (q - min(q) OVER (PARTITION BY modelId)) / (max(q) OVER (PARTITION BY modelId) - min(q) OVER (PARTITION BY modelId)) END AS cost_norm
FROM (SELECT modelId, configurationId, full_unanimous_meet_rate_pct AS p, query_tokens_mean AS q FROM x_qmodel)""")
def minmax(spark, sf):
    table = ranking.minmax(by_model(spark, sf), "full_unanimous_meet_rate_pct", "quality_norm")
    return ranking.minmax(table, "query_tokens_mean", "cost_norm", ["modelId"]).select(
        "modelId", "configurationId", "quality_norm", "cost_norm"
    )


@register("group_share", """
SELECT configurationId, collapsed, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY configurationId) AS DOUBLE) * 100.0 AS pct
FROM x_runs GROUP BY configurationId, collapsed""")
def group_share(spark, sf):
    counts = runs(spark, sf).groupBy("configurationId", F.col("collapsed_majority_accuracy").alias("collapsed")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.group_share(counts, "n", ["configurationId"])


@register("best_by_category", """
SELECT * FROM (SELECT category, configurationId AS best_quality_configuration, full_unanimous_meet_rate_pct AS best_unanimous_success_pct,
    strict_majority_success_rate_pct AS majority_success_of_best_quality_pct FROM x_qcat
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY full_unanimous_meet_rate_pct DESC NULLS LAST, strict_majority_success_rate_pct DESC NULLS LAST, configurationId) = 1)
FULL JOIN (SELECT category, configurationId AS best_efficiency_configuration, full_unanimous_meets_per_100k_query_tokens AS best_unanimous_successes_per_100k_query_tokens
  FROM x_qcat QUALIFY row_number() OVER (PARTITION BY category ORDER BY full_unanimous_meets_per_100k_query_tokens DESC NULLS LAST, configurationId) = 1) USING (category)
FULL JOIN (SELECT category, configurationId AS lowest_cost_configuration, query_tokens_mean AS lowest_avg_query_tokens
  FROM x_qcat QUALIFY row_number() OVER (PARTITION BY category ORDER BY query_tokens_mean ASC NULLS LAST, configurationId) = 1) USING (category)""")
def best_by_category(spark, sf):
    return study.best_by_category(by_category(spark, sf))


@register("rank_in_entity", """
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank_in_entity FROM orders""")
def rank_in_entity(spark, sf):
    rows = m.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranking.rank_in(rows, ["o_orderstatus"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "rank_in_entity")


@register("rank_few_values", """
SELECT l_orderkey, l_linenumber, l_discount, row_number() OVER (PARTITION BY l_returnflag = 'R' ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
FROM lineitem""")
def rank_few_values(spark, sf):
    """Eleven distinct values rank all lines: rows of one value are dealt over tasks by their ties."""
    rows = m.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").alias("returned")
    )
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ranking.rank_in(rows, ["returned"], "l_discount", ties, "rank").select("l_orderkey", "l_linenumber", "l_discount", "rank")


@register("seq_cap", """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS sequence FROM documents""")
def seq_cap(spark, sf):
    rows = m.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return ranking.seq_cap(rows, ["lang"], ["source", "doc_id"]).select("doc_id", "lang", "sequence")


@register("seq_cap_20", """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS sequence FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) <= 20""")
def seq_cap_20(spark, sf):
    rows = m.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return ranking.seq_cap(rows, ["lang"], ["source", "doc_id"], cap=20).select("doc_id", "lang", "sequence")


@register("position_ratio", """
SELECT conv_id, turn, (turn + 0.5::DOUBLE) / greatest(1, count(*) OVER (PARTITION BY conv_id)) AS ratio FROM conversations""")
def position_ratio(spark, sf):
    c = m.table(spark, sf, "conversations").select("conv_id", "turn")
    sizes = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.join(sizes, "conv_id", "inner").select("conv_id", "turn", ranking.position_ratio("turn", "n").alias("ratio"))


@register("worst_tasks", """
SELECT taskId, evaluated, wasted_tokens_no_full_meet_pct FROM (SELECT taskId, count(*) FILTER (has_eval) AS evaluated,
  CAST(coalesce(sum(wasted) FILTER (has_eval), 0) AS DOUBLE) / nullif(coalesce(sum(cost) FILTER (has_eval), 0), 0) * 100.0 AS wasted_tokens_no_full_meet_pct
  FROM x_runs GROUP BY taskId) ORDER BY wasted_tokens_no_full_meet_pct DESC, taskId LIMIT 3""")
def worst_tasks(spark, sf):
    table = study.summarize_runs(runs(spark, sf), ["taskId"], percentiles=False)
    return ranking.ranked(table, [F.desc("wasted_tokens_no_full_meet_pct"), "taskId"], 3).select(
        "taskId", "evaluated", "wasted_tokens_no_full_meet_pct"
    )


@register("answers_of_interest", """
SELECT trialId, instanceId, modelId, configurationId, taskId, response, strict AS strict_majority_meet, tokens AS totalTokens_answer
FROM x_runs WHERE taskId IN ('1-URGENT', '3-MEDIUM') AND strategy = 'inline'""")
def answers_of_interest(spark, sf):
    definitions = m.trials(spark, sf).select("configurationId", "strategy").distinct()
    return select_ops.answers_of_interest(runs(spark, sf, text=True), definitions, ["1-URGENT", "3-MEDIUM"]).select(
        "trialId", "instanceId", "modelId", "configurationId", "taskId", "response", "strict_majority_meet", "totalTokens_answer"
    )
