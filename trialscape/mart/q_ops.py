"""Queries: selection, status, pending work, checks, planning, set operations, traces, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialscape.functions import scalar
from trialscape.functions.stats import running_position
from trialscape.mart import tables as m
from trialscape.mart.registry import cte, register
from trialscape.operators import checks, metrics, pending, planning, ranking, select as select_ops, sets
from trialscape.operators import status as status_ops
from trialscape.operators import traces as trace_ops
from trialscape.operators import votes as vote_ops
from trialscape.operators.latest import first_vote, latest
from trialscape.plans.export import EXPORT_COLUMNS, export_rows

KEYS = ["trialId", "configurationId", "modelId", "taskId", "execution_status"]
_KEY_SQL = "SELECT trialId, configurationId, modelId, taskId, execution_status FROM x_facts"


def facts(spark, sf):
    return m.facts(spark, sf, with_traces=False)


# --- selection ---------------------------------------------------------------

@register("select_include", f"""{_KEY_SQL} WHERE configurationId IN ('cfg-F', 'cfg-O') AND taskId = '2-HIGH' AND repeatIndex IN (1, 3)""")
def select_include(spark, sf):
    chosen = select_ops.Selector(configuration=("cfg-F", "cfg-O"), task=("2-HIGH",), repetition=(1, 3))
    return select_ops.select_rows(facts(spark, sf), chosen, "execution_status").select(*KEYS)


@register("select_exclude", f"""{_KEY_SQL} WHERE coalesce(execution_status, '') <> 'error' AND strategy <> 'inline' AND instanceId NOT IN ('i1', 'i2')""")
def select_exclude(spark, sf):
    dropped = select_ops.Selector(without={"status": ("error",), "strategy": ("inline",), "instance": ("i1", "i2")})
    return select_ops.select_rows(facts(spark, sf), dropped, "execution_status").select(*KEYS)


@register("select_model", f"""{_KEY_SQL} WHERE modelId IN ('BUILDING') OR modelName = 'machinery-v1'""")
def select_model(spark, sf):
    chosen = select_ops.Selector(model=("BUILDING", "machinery-v1"))
    return select_ops.select_rows(facts(spark, sf), chosen, "execution_status").select(*KEYS)


@register("select_status", f"""{_KEY_SQL} WHERE execution_status = 'success' AND coalesce(evaluation_status, '') NOT IN ('partial', 'skipped')""")
def select_status(spark, sf):
    rows = select_ops.select_rows(facts(spark, sf), select_ops.Selector(status=("success",)), "execution_status")
    return select_ops.select_eval(rows, exclude=("partial", "skipped")).select(*KEYS)


@register("by_filters", f"""{_KEY_SQL} WHERE configurationId IN ('cfg-F', 'cfg-P') AND (modelId = 'FURNITURE' OR modelName = 'household-v1') AND surface = 'ops'""")
def by_filters(spark, sf):
    tokens = ["configuration=cfg-F", "configuration = cfg-P", "model=FURNITURE", "model=household-v1", "surface=ops"]
    return select_ops.by_filters(facts(spark, sf), tokens).select(*KEYS)


@register("id_semi", f"""{_KEY_SQL} WHERE trialId IN (SELECT CAST(user_id AS VARCHAR) FROM events)""")
def id_semi(spark, sf):
    ids = m.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("trialId"))
    return select_ops.semi(facts(spark, sf), ids).select(*KEYS)


@register("successful_text", """
SELECT trialId, status, length(response) AS chars FROM x_log WHERE errorMessage IS NULL AND status = 'success'""")
def successful_text(spark, sf):
    log = m.response_log(spark, sf)
    text = select_ops.response_text("response")
    return log.where(select_ops.successful(log)).select("trialId", "status", F.length(text).cast("long").alias("chars"))


@register("trial_detail", """
SELECT trialId, 'response' AS kind, status, CAST(NULL AS VARCHAR) AS judgeId FROM (SELECT *, row_number() OVER (PARTITION BY trialId ORDER BY back DESC) AS f FROM x_log) WHERE f = 1
UNION ALL SELECT trialId, 'evaluation', ev_status, NULL FROM x_evals UNION ALL SELECT trialId, 'vote', status, judgeId FROM x_votes""")
def trial_detail(spark, sf):
    li = m.lines_by_trial(spark, sf)
    ranges = max(m.buckets(spark, sf), spark.sparkContext.defaultParallelism)
    rows = select_ops.trial_detail(m.response_log(spark, sf, li=li), m.evals(spark, sf, li), m.votes(spark, sf, li=li), ranges=ranges)
    return rows.select("trialId", "kind", F.get_json_object("body", "$.status").alias("status"), F.get_json_object("body", "$.judgeId").alias("judgeId"))


@register("list_votes", """
SELECT trialId, criterion, judgeId, rating, justification, totalTokens AS totalTokens_vote, durationMs AS durationMs_vote FROM x_long""")
def list_votes(spark, sf):
    return select_ops.list_votes(vote_ops.votes_long(m.votes(spark, sf)))


# --- export ------------------------------------------------------------------

@register("export_rows", f"""
SELECT t.experimentId, t.trialId, t.dataset_id, t.dataset_version, t.instanceId, t.configurationId, t.representation, t.surface, t.taskId,
  t.modelId, t.modelName, array_to_string(t.tags, ',') AS tags, t.repeatIndex AS index, t.strategy, CAST(NULL AS VARCHAR) AS temperature,
  r.u_input AS inputTokens, r.outputTokens, r.u_total AS totalTokens, r.cachedInputTokens, CAST(NULL AS DOUBLE) AS cachedReadTokens,
  r.status, r.modelCalls, r.toolCalls, r.mcpToolCalls, r.response, r.errorMessage, r.modelDurationMs AS modelDuration, r.reservedTokens,
  r.toolDurationMs, r.totalDurationMs, e.completeness, e.k_agree AS completeness_agreement, e.correctness, e.c_agree AS correctness_agreement,
  v.justification AS completeness_justification, v.justification AS correctness_justification, v.provider || '/' || v.model AS judge,
  v.judgeId, v.model AS judgeModel, e.evaluationDurationMs, e.evaluationInputTokens, e.evaluationOutputTokens,
  e.validationType AS evaluationMethod, e.judgeCount, e.ev_status AS evaluationStatus, array_to_string(e.contextBlocks, ',') AS contextBlocks
FROM x_log r JOIN x_trials t USING (trialId) LEFT JOIN x_evals e USING (trialId) LEFT JOIN (SELECT * FROM x_votes WHERE firstValid = 1) v USING (trialId)""")
def export_query(spark, sf):
    li = m.lines_by_trial(spark, sf)
    return export_rows(m.responses(spark, sf, li), m.evals(spark, sf, li), m.votes(spark, sf, li=li)).select(*EXPORT_COLUMNS)


# --- status ------------------------------------------------------------------

@register("status_phase", """
SELECT 'execute' AS phase, (SELECT count(*) FROM orders) AS total, count(*) FILTER (status = 'success') AS success,
  count(*) FILTER (status = 'error') AS failed, greatest(0, (SELECT count(*) FROM orders) - count(*)) AS pending FROM x_last
UNION ALL SELECT 'eval', (SELECT count(*) FROM x_last WHERE status = 'success'), count(*) FILTER (ev_status = 'evaluated'),
  count(*) FILTER (ev_status = 'error'), greatest(0, (SELECT count(*) FROM x_last WHERE status = 'success') - count(*)) FROM x_evals""")
def status_phase(spark, sf):
    return status_ops.status(m.trials(spark, sf), m.response_log(spark, sf), m.evals(spark, sf))


def _by(column: str, extra: str = "") -> str:
    return f"""SELECT {column} AS label, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS failed,
  count(*) FILTER (status IS NULL) AS pending{extra} FROM x_trials LEFT JOIN x_last USING (trialId) GROUP BY {column}"""


@register("status_by_model", _by("modelId"))
def status_by_model(spark, sf):
    return status_ops.status_by(m.trials(spark, sf), m.response_log(spark, sf), "model")


@register("status_by_instance", _by("instanceId"))
def status_by_instance(spark, sf):
    return status_ops.status_by(m.trials(spark, sf), m.response_log(spark, sf), "instance")


@register("status_by_strategy", _by("strategy", ", CAST(NULL AS VARCHAR) AS pooled"))
def status_by_strategy(spark, sf):
    return status_ops.status_by(m.trials(spark, sf), m.response_log(spark, sf), "strategy")


@register("status_by_judge", """
SELECT judgeId, (SELECT count(*) FROM x_last WHERE status = 'success') AS total, count(*) FILTER (error IS NULL) AS success,
  count(error) AS failed, greatest(0, (SELECT count(*) FROM x_last WHERE status = 'success') - count(*)) AS pending FROM x_lastvotes GROUP BY judgeId""")
def status_by_judge(spark, sf):
    configured = m.votes(spark, sf).select("judgeId").distinct().where("judgeId = 'judge1'").withColumn("ord", F.lit(0))
    return status_ops.status_by_judge(m.response_log(spark, sf), m.votes(spark, sf), configured)


@register("status_tally", "SELECT status, count(*) AS n FROM x_last GROUP BY status")
def status_tally(spark, sf):
    return status_ops.tally(m.response_log(spark, sf))


@register("eval_summary", """
SELECT trialId, ev_status AS status, validationType AS evaluationMethod, judgeCount, judgeErrorCount, correctness AS correctness_rating,
  c_agree AS correctness_agreement, completeness AS completeness_rating, k_agree AS completeness_agreement FROM x_evals""")
def eval_summary(spark, sf):
    return status_ops.eval_summary(m.evals(spark, sf)).drop("taskId", "instanceId")


@register("exec_status", """
SELECT role, CASE WHEN trim(text) = '' THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM conversations GROUP BY ALL""")
def exec_status(spark, sf):
    from trialscape.operators.facts import exec_status as rule

    c = m.table(spark, sf, "conversations")
    return c.groupBy("role", rule(F.col("text"), F.lit(None).cast("string")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- pending work ------------------------------------------------------------

def judges(spark, sf):
    return vote_ops.expected_judges(None, m.votes(spark, sf))


def answered(spark, sf):
    t = m.trials(spark, sf).select("trialId", "instanceId", "taskId", "provider", "modelName", "contextBlocks", "validationType")
    last = latest(m.response_log(spark, sf).select("trialId", "seq", "status", "response"), ["trialId"])
    return last.join(t, "trialId", "inner")


@register("pending_trials", "SELECT trialId, configurationId FROM x_trials WHERE trialId NOT IN (SELECT trialId FROM x_last WHERE status = 'success')")
def pending_trials(spark, sf):
    return pending.pending_trials(m.trials(spark, sf), m.response_log(spark, sf)).select("trialId", "configurationId")


cte("x_pairs", """
SELECT trialId, judgeId FROM x_last JOIN x_trials USING (trialId) CROSS JOIN (SELECT DISTINCT judgeId FROM x_votes)
WHERE validationType = 'judge' AND trialId NOT IN (SELECT trialId FROM x_evals WHERE ev_status = 'skipped')
  AND (trialId, judgeId) NOT IN (SELECT (trialId, judgeId) FROM x_votes WHERE coalesce(status, '') <> 'error')""")


def open_pairs(spark, sf):
    return pending.pending_votes(answered(spark, sf), judges(spark, sf), m.votes(spark, sf), m.evals(spark, sf))


@register("pending_votes", "SELECT trialId, judgeId FROM x_pairs")
def pending_votes(spark, sf):
    return open_pairs(spark, sf).select("trialId", "judgeId")


@register("pending_groups", """
SELECT missing_judges, count(*) AS trials FROM (SELECT trialId, string_agg(judgeId, ',' ORDER BY judgeId) AS missing_judges FROM x_pairs GROUP BY trialId) GROUP BY ALL""")
def pending_groups(spark, sf):
    return pending.pending_groups(open_pairs(spark, sf))


@register("pending_scores", """
SELECT trialId FROM x_last JOIN x_trials USING (trialId) WHERE validationType = 'repoqa-scorer' AND trialId NOT IN (SELECT trialId FROM x_evals WHERE NOT judged)""")
def pending_scores(spark, sf):
    return pending.pending_scores(answered(spark, sf), m.evals(spark, sf)).select("trialId")


cte("x_jobs", """
SELECT trialId, instanceId, taskId, judgeId, substr(trialId || '-' || judgeId, 1, 64) AS custom_id FROM x_last JOIN x_trials USING (trialId)
CROSS JOIN (SELECT DISTINCT judgeId FROM x_votes) WHERE status = 'success' AND validationType = 'judge'""")


@register("judge_jobs", "SELECT trialId, judgeId, custom_id FROM x_jobs")
def judge_jobs(spark, sf):
    return pending.judge_jobs(answered(spark, sf), judges(spark, sf)).select("trialId", "judgeId", "custom_id")


@register("job_order", "SELECT trialId, judgeId, instanceId FROM x_jobs")
def job_order(spark, sf):
    return pending.job_order(pending.judge_jobs(answered(spark, sf), judges(spark, sf))).select("trialId", "judgeId", "instanceId")


def places(ordered):
    """Rows with the number of their place in the order that the operator left them in."""
    return running_position(ordered.withColumn("place", F.monotonically_increasing_id()), [], [F.col("place")], "position")


@register("job_places", """
SELECT DISTINCT trialId, rank() OVER (ORDER BY array_to_string(list_sort(t.contextBlocks), ','), coalesce(t.instanceId, ''), coalesce(t.taskId, ''),
  coalesce(t.provider, ''), coalesce(t.modelName, ''), trialId) AS position FROM x_jobs j JOIN x_trials t USING (trialId)""")
def job_places(spark, sf):
    """The order itself: the first place of each trial's jobs."""
    ordered = pending.job_order(pending.judge_jobs(answered(spark, sf), judges(spark, sf)))
    return places(ordered.select("trialId")).groupBy("trialId").agg(F.min("position").alias("position"))


@register("batch_match", """
SELECT j.trialId, j.judgeId, v.correctness AS rating, v.totalTokens FROM x_jobs j JOIN x_lastvotes v ON j.custom_id = v.trialId || '-' || v.judgeId""")
def batch_match(spark, sf):
    place = F.col("judgeId")
    own = F.concat_ws("-", "trialId", "judgeId")
    items = m.latest_votes(spark, sf).select(
        F.when(place == "judge0", own).alias("custom_id"), F.when(place == "judge1", own).alias("customId"),
        F.when(place == "judge2", F.create_map(F.lit("custom_id"), own)).alias("metadata"),
        F.col("criterias.correctness.rating").alias("rating"), "totalTokens",
    )
    jobs = pending.judge_jobs(answered(spark, sf), judges(spark, sf))
    return pending.match_batch(items, jobs).select("trialId", "judgeId", "item.rating", "item.totalTokens")


def blocks(spark, sf):
    """Two context blocks per nation instance; a few instances lack the second one."""
    n = m.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    instance = F.concat(F.lit("i"), key.cast("string"))
    body = F.when(
        key % 6 != 0, F.to_json(F.struct(F.struct(
            F.struct(F.lit("Name").alias("title"), F.col("n_name").alias("content")).alias("b1"),
            F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("b2"),
        ).alias("blocks")))
    ).otherwise(F.to_json(F.struct(F.struct(F.lit("Name").alias("title"), F.col("n_name").alias("content")).alias("b1"))))
    from trialscape.sources.catalog import explode_blocks

    return explode_blocks(n.select(instance.alias("instanceId"), F.try_parse_json(body).alias("body")))


@register("context_blocks", """
SELECT 'i' || n_nationkey AS instanceId, 'b1' AS blockId, 'Name' AS title, n_name AS content FROM nation
UNION ALL SELECT 'i' || n_nationkey, 'b2', NULL, 'region ' || n_regionkey FROM nation WHERE n_nationkey % 6 <> 0""")
def context_blocks(spark, sf):
    return blocks(spark, sf)


@register("build_evidence", """
SELECT trialId, CASE WHEN len(contextBlocks) = 1 THEN '## Name' || chr(10) || n_name ELSE '## Name' || chr(10) || n_name || chr(10) || chr(10) || 'region ' || n_regionkey END AS evidence
FROM x_last JOIN x_trials USING (trialId) JOIN nation ON instanceId = 'i' || n_nationkey WHERE len(contextBlocks) = 1 OR n_nationkey % 6 <> 0""")
def build_evidence(spark, sf):
    rows = answered(spark, sf)
    tasks = m.trials(spark, sf).select("taskId", "contextBlocks").distinct()
    return pending.build_evidence(rows, tasks, blocks(spark, sf)).select("trialId", "evidence")


@register("missing_blocks", """
SELECT trialId, 'b2' AS missing FROM x_trials JOIN nation ON instanceId = 'i' || n_nationkey WHERE len(contextBlocks) = 2 AND n_nationkey % 6 = 0""")
def missing_blocks(spark, sf):
    return checks.missing_blocks(m.trials(spark, sf), blocks(spark, sf))


@register("completed_ids", """
SELECT DISTINCT trialId FROM (SELECT trialId FROM x_log UNION ALL SELECT trialId FROM x_evals UNION ALL SELECT CAST(user_id AS VARCHAR) FROM events)""")
def completed_ids(spark, sf):
    seen = m.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("trialId"))
    return pending.completed_ids(m.response_log(spark, sf), m.evals(spark, sf), seen)


@register("fill_from_trials", """
SELECT trialId, l.status, configurationId, taskId, 'State of order ' || trialId || '?' AS taskStatement FROM x_log l JOIN x_trials USING (trialId)""")
def fill_from_trials(spark, sf):
    log = m.response_log(spark, sf).withColumn("taskStatement", F.lit(None).cast("string"))
    return pending.fill_from_trials(log, m.trials(spark, sf).drop("seq")).select(
        "trialId", "status", "configurationId", "taskId", "taskStatement"
    )


# --- checks ------------------------------------------------------------------

def _inputs(spark, sf):
    """The planned trials as if they came from two directories; some ids are in both or twice in one."""
    t = m.trials(spark, sf).select("trialId", F.concat(F.lit("dir"), (F.col("seq") % 2).cast("string")).alias("experimentDir"), "seq")
    again = t.where("seq % 100 = 0")
    return t.unionByName(again.where("seq % 200 = 0")).unionByName(
        again.where("seq % 300 = 0").withColumn("experimentDir", F.lit("dir9"))
    )


@register("duplicate_ids", "SELECT 'dir0' AS experimentDir, CAST(o_orderkey AS VARCHAR) AS trialId, 2 AS n FROM orders WHERE o_orderkey % 200 = 0")
def duplicate_ids(spark, sf):
    return checks.dup_within(_inputs(spark, sf))


@register("duplicate_across", "SELECT CAST(o_orderkey AS VARCHAR) AS trialId, 2 AS inputs, 'dir0' AS first, 'dir9' AS last FROM orders WHERE o_orderkey % 300 = 0")
def duplicate_across(spark, sf):
    return checks.dup_across(_inputs(spark, sf))


def definitions(spark, sf):
    return m.trials(spark, sf).select(*checks.TREATMENT).distinct()


def _bent(spark, sf):
    t = m.trials(spark, sf)
    bent = F.when(F.col("seq") % 40 == 0, F.lit("other")).otherwise(F.col("representation"))
    return t.withColumn("representation", bent)


@register("bad_treatments", "SELECT trialId, configurationId FROM x_trials WHERE k % 40 = 0")
def bad_treatments(spark, sf):
    return checks.bad_treatments(_bent(spark, sf), definitions(spark, sf))


@register("treatment_conflicts", "SELECT trialId FROM x_trials WHERE k % 40 = 0")
def treatment_conflicts(spark, sf):
    columns = ["trialId", *checks.TREATMENT]
    return checks.treatment_conflicts(m.trials(spark, sf).select(*columns).unionByName(_bent(spark, sf).select(*columns)))


@register("config_conflicts", "SELECT 'cfg-' || o_orderstatus AS configurationId, 2 AS definitions FROM orders WHERE o_orderkey % 40 = 0 GROUP BY o_orderstatus")
def config_conflicts(spark, sf):
    return checks.config_conflicts(_bent(spark, sf).select(*checks.TREATMENT).distinct())


@register("unknown_config", "SELECT trialId, configurationId FROM x_trials WHERE configurationId = 'cfg-P'")
def unknown_config(spark, sf):
    return checks.unknown_config(m.trials(spark, sf), definitions(spark, sf).where("configurationId != 'cfg-P'"))


@register("bad_tags", "SELECT CAST(doc_id AS VARCHAR) AS trialId FROM documents WHERE text LIKE '%|%'")
def bad_tags(spark, sf):
    docs = m.table(spark, sf, "documents")
    return checks.bad_tags(docs.select(F.col("doc_id").cast("string").alias("trialId"), F.array("lang", "text").alias("taskTags"))).select("trialId")


@register("unknown_values", """
SELECT DISTINCT 'evaluation_status' AS kind, event_type AS value FROM events WHERE event_type NOT IN ('evaluated','partial','error','skipped')
UNION ALL SELECT DISTINCT 'evaluation_method', props FROM events UNION ALL SELECT DISTINCT 'rating', role FROM conversations""")
def unknown_values(spark, sf):
    e = m.table(spark, sf, "events").select(F.col("event_type").alias("evaluation_status"), F.col("props").alias("evaluation_method"))
    return checks.unknown_values(e, m.table(spark, sf, "conversations").select(F.col("role").alias("rating")))


@register("method_consistent", """
SELECT taskId, CASE WHEN k % 10 = 0 AND k % 7 = 0 THEN NULL WHEN k % 10 = 0 OR k % 7 = 0 THEN true ELSE validationType = 'judge' END AS consistent, count(*) AS n
FROM x_trials GROUP BY ALL""")
def method_consistent(spark, sf):
    t = m.trials(spark, sf)
    planned = F.when(F.col("seq") % 10 != 0, F.col("validationType"))
    actual = F.when(F.col("seq") % 7 != 0, F.lit("judge"))
    return t.groupBy("taskId", checks.method_consistent(planned, actual).alias("consistent")).agg(F.count(F.lit(1)).alias("n"))


@register("materialization_conflicts", """
SELECT lang AS datasetId, source AS version, count(DISTINCT text) AS contents FROM documents GROUP BY lang, source HAVING count(DISTINCT text) > 1""")
def materialization_conflicts(spark, sf):
    docs = m.table(spark, sf, "documents")
    records = docs.select(
        F.col("lang").alias("datasetId"), F.col("source").alias("version"), F.sha2("text", 256).alias("contentHash"),
        F.lit(None).cast("string").alias("verifiedSha256"),
    )
    return checks.materialization_conflicts(records)


@register("hash_mismatch", "SELECT doc_id, sha256(text) AS actual FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def hash_mismatch(spark, sf):
    docs = m.table(spark, sf, "documents")
    right = F.concat(F.lit(" SHA256:"), F.upper(F.sha2("text", 256)))
    expected = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("x"), 256)).when(F.col("doc_id") % 5 == 0, F.lit("not a hash")).otherwise(right)
    files = docs.select("doc_id", F.col("text").alias("content"), expected.alias("expected"))
    return checks.hash_mismatch(files).select("doc_id", "actual")


# --- planning ----------------------------------------------------------------

@register("expand_trials", """
SELECT 'i' || c_custkey AS instanceId, o_orderpriority AS taskId, c_mktsegment AS modelId, configurationId, repeatIndex
FROM (SELECT c_custkey FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)
CROSS JOIN (SELECT DISTINCT 'cfg-' || o_orderstatus AS configurationId FROM orders) CROSS JOIN (VALUES (1), (2)) r(repeatIndex)""")
def expand_trials(spark, sf):
    c = m.table(spark, sf, "customer")
    instances = c.select(F.lit("d").alias("datasetId"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("instanceId"))
    t = m.trials(spark, sf)
    tasks = t.select(F.lit("d").alias("datasetId"), "taskId").distinct()
    models = c.select(F.lit("p").alias("provider"), F.lit(None).cast("string").alias("modelId"), F.col("c_mktsegment").alias("modelName")).distinct()
    grown = planning.expand_trials(instances, tasks, models, t.select("configurationId", "strategy").distinct(), 2)
    return grown.select("instanceId", "taskId", "modelId", "configurationId", "repeatIndex")


@register("scope_filter", "SELECT trialId FROM x_trials WHERE taskId IN ('1-URGENT', '5-LOW') AND instanceId IN (SELECT 'i' || s_nationkey FROM supplier)")
def scope_filter(spark, sf):
    ids = m.table(spark, sf, "supplier").select(F.concat(F.lit("i"), F.col("s_nationkey").cast("string")).alias("instanceId"))
    rows = planning.scope(m.trials(spark, sf), "taskId", ["1-URGENT", "5-LOW"])
    return planning.scope(planning.scope(rows, "instanceId", ids), "modelId", []).select("trialId")


@register("cell_parameters", """
SELECT trialId, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS nation FROM x_trials JOIN nation ON instanceId = 'i' || n_nationkey""")
def cell_parameters(spark, sf):
    n = m.table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    tasks = m.trials(spark, sf).select("taskId").distinct()
    given = n.select(
        F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("instanceId"),
        F.create_map(F.lit("nation"), F.col("n_name")).alias("parameters"), F.lit(1).alias("one"),
    ).join(tasks.withColumn("one", F.lit(1)), "one", "inner")
    cells = planning.with_parameters(m.trials(spark, sf).drop("parameters"), given)
    return cells.select("trialId", F.coalesce(F.try_element_at("parameters", F.lit("nation")), F.lit("")).alias("nation"))


@register("merge_params", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'shared' END AS a, 'common' AS b, c_mktsegment AS model_name FROM customer""")
def merge_params(spark, sf):
    c = m.table(spark, sf, "customer")
    common = F.create_map(F.lit("a"), F.lit("shared"), F.lit("b"), F.lit("common"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("own")))
    merged = c.select("c_custkey", planning.merge_params(common, own, "c_mktsegment").alias("p"))
    return merged.select("c_custkey", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("a", "b", "model_name")])


@register("render_template", "SELECT trialId, 'State of order ' || trialId || ' of ' || modelId || ' in ?' AS statement FROM x_trials")
def render_template(spark, sf):
    return m.trials(spark, sf).select("trialId", planning.render("taskTemplate", "parameters").alias("statement"))


@register("render_turns", """
SELECT conv_id, turn, replace(replace('[{role}] {text}', '{role}', role), '{text}', text) AS line FROM conversations""")
def render_turns(spark, sf):
    c = m.table(spark, sf, "conversations")
    params = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))
    return c.select("conv_id", "turn", planning.render(F.lit("[{role}] {text}"), params).alias("line"))


@register("template_gaps", """
SELECT trialId, 'missing' AS problem, 'year' AS parameter FROM x_trials
UNION ALL SELECT trialId, 'unused', 'colour' FROM x_trials WHERE k % 3 = 0""")
def template_gaps(spark, sf):
    extra = F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("colour"), F.lit("red")))
    cells = m.trials(spark, sf).withColumn("parameters", scalar.merge_maps("parameters", extra))
    return planning.template_gaps(cells, keys=("trialId",))


_IDENTITY = """'{"configuration":{"representation":"' || representation || '","strategy":"' || strategy || '","surface":"' || surface ||
  '"},"configurationId":"' || configurationId || '","experimentId":"' || experimentId || '","identityVersion":2,"instanceId":"' || instanceId ||
  '","modelName":"' || modelName || '","provider":"' || provider || '","repeatIndex":' || k || ',"taskId":"' || taskId || '"}'"""


def _identified(spark, sf):
    rows = m.trials(spark, sf).withColumn("order", F.col("trialId")).withColumn("repeatIndex", F.col("seq"))
    return rows.withColumn("identity", planning.canonical_id())


@register("canonical_id", f"SELECT trialId, {_IDENTITY} AS identity FROM x_trials")
def canonical_id(spark, sf):
    return _identified(spark, sf).select("trialId", "identity")


cte("x_hashes", f"SELECT trialId, sha256({_IDENTITY}) AS h FROM x_trials")


@register("short_ids", """
SELECT trialId, substr(h, 1, (SELECT min(n) FROM (SELECT n, count(DISTINCT substr(h, 1, n)) AS d FROM x_hashes CROSS JOIN (SELECT unnest(range(10, 65)) AS n)
  GROUP BY n) WHERE d = (SELECT count(*) FROM x_hashes))) AS shortId FROM x_hashes""")
def short_ids(spark, sf):
    return planning.short_ids(_identified(spark, sf).select("order", "identity"), "identity", "shortId").select(
        F.col("order").alias("trialId"), "shortId"
    )


@register("resolve_surface", """
SELECT DISTINCT experimentId, configurationId, surface, CASE surface WHEN 'page' THEN 'full_context' ELSE 'operations' END AS type,
  CASE surface WHEN 'ops' THEN 'find,get' END AS operations FROM x_trials""")
def resolve_surface(spark, sf):
    t = m.trials(spark, sf)
    cfg = t.select("experimentId", *checks.TREATMENT).distinct()
    kinds = t.select("experimentId", "surface").distinct().select(
        "experimentId", "surface",
        F.when(F.col("surface") == "page", F.lit("full_context")).otherwise(F.lit("operations")).alias("type"),
        F.when(F.col("surface") == "ops", F.array(F.lit("find"), F.lit("get"))).alias("operations"),
    )
    joined = planning.resolve_surface(cfg, kinds)
    return joined.select("experimentId", "configurationId", "surface", "type", F.array_join("operations", ",").alias("operations"))


@register("cache_keys", """
SELECT page_id, substr(sha256(html), 1, 16) AS fingerprint, 'inl:html:' || substr(sha256('m|' || url || '|html|' || substr(sha256(html), 1, 16)), 1, 32) AS inline_key,
  'jud:ctx:' || substr(sha256('m|' || url || '|' || substr(sha256(html), 1, 16)), 1, 32) AS judge_key FROM pages""")
def cache_keys(spark, sf):
    p = m.table(spark, sf, "pages").withColumns({"model": F.lit("m"), "rep": F.lit("html")})
    return p.select(
        "page_id", planning.fingerprint("html").alias("fingerprint"),
        planning.inline_cache_key("model", "url", "rep", "html").alias("inline_key"),
        planning.judge_cache_key("model", "url", "html").alias("judge_key"),
    )


@register("slugs", """
SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'item') AS slug FROM pages""")
def slugs(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", scalar.slug("url").alias("slug"))


# --- sets --------------------------------------------------------------------

@register("union_runs", "SELECT experimentId, count(*) AS n FROM x_trials GROUP BY experimentId")
def union_runs(spark, sf):
    t = m.trials(spark, sf).select("experimentId", "trialId")
    parts = [t.where(F.col("experimentId") == f"exp-{i}") for i in range(4)]
    return sets.union_runs(parts).groupBy("experimentId").agg(F.count(F.lit(1)).alias("n"))


@register("ordered_union", """
SELECT name, row_number() OVER (ORDER BY side, ord, name) AS pos FROM (SELECT name, min(side) AS side, arg_min(ord, side) AS ord FROM (
  SELECT n_name AS name, 0 AS side, n_nationkey AS ord FROM nation WHERE n_nationkey > 10 UNION ALL SELECT DISTINCT n_name, 1, 0 FROM nation) GROUP BY name)""")
def ordered_union(spark, sf):
    n = m.table(spark, sf, "nation")
    first = n.where("n_nationkey > 10").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    both = sets.ordered_union(first, n.select(F.col("n_name").alias("name")), "name")
    return ranking.seq_cap(both.select("name", F.col("ord.__side").alias("s"), F.col("ord.__ord").alias("o")), [], ["s", "o", "name"], name="pos").select(
        "name", F.col("pos").cast("long").alias("pos"))


@register("set_difference", "SELECT trialId FROM x_trials WHERE trialId NOT IN (SELECT trialId FROM x_log)")
def set_difference(spark, sf):
    return sets.difference(m.trials(spark, sf).select("trialId"), m.response_log(spark, sf), ["trialId"])


@register("set_intersection", "SELECT DISTINCT taskId, CASE WHEN list_contains(tags, 'service') THEN 'service' ELSE '' END AS common FROM x_trials")
def set_intersection(spark, sf):
    common = sets.intersect_keys(F.col("taskTags"), F.array(F.lit("service"), F.lit("other")))
    return m.trials(spark, sf).select("taskId", F.array_join(common, ",").alias("common")).distinct()


# --- traces ------------------------------------------------------------------

cte("x_calls", """
SELECT CAST(o_orderkey AS VARCHAR) AS trialId, o_orderkey AS k, o_orderstatus AS s, lower(substr(o_orderpriority, 3, 20)) AS nm,
  '{"page":' || (o_orderkey % 10) || ',"state":"' || o_orderstatus || '"}' AS args FROM orders WHERE o_orderkey % 5 <> 0""")
cte("x_events", """
SELECT trialId, k, 1 AS ord, nm AS tool_name, 'trace.toolCalls' AS tool_source, args AS arguments FROM x_calls WHERE k % 2 = 0
UNION ALL SELECT trialId, k, 2, nm, 'trace.nativeMcp.visibleToolCalls', args FROM x_calls WHERE k % 3 = 0
UNION ALL SELECT trialId, k, 3, 'lookup', 'trace.serverMcp', '{"id":' || (k % 4) || '}' FROM x_calls WHERE k % 7 < 3
UNION ALL SELECT trialId, k, 4, 'fetch', 'aiTrace.events:mcp.tool_call', '{"n":' || (k % 3) || '}' FROM x_calls WHERE k % 4 = 1""")


@register("tool_events", """
SELECT trialId, row_number() OVER (PARTITION BY trialId ORDER BY ord) AS call_index, tool_name, tool_source, arguments FROM x_events""")
def tool_events(spark, sf):
    return trace_ops.tool_events(m.traces(spark, sf))


@register("distinct_calls", "SELECT DISTINCT trialId, tool_name, tool_source, arguments FROM x_events")
def distinct_calls(spark, sf):
    return sets.distinct_calls(trace_ops.tool_events(m.traces(spark, sf))).drop("call_index")


_CELL = "{e}, modelId, configurationId"


def activation_sql(entity: str, source: str) -> str:
    return f"""
SELECT u.{entity}, u.modelId, u.configurationId, u.tool_name, runs_with_tool, tool_calls, total_runs,
  runs_with_tool / CAST(total_runs AS DOUBLE) * 100.0 AS activation_rate_pct, u.configurationId || ' / ' || u.tool_name AS tool_label
FROM (SELECT {entity}, modelId, configurationId, tool_name, count(DISTINCT trialId) AS runs_with_tool, count(*) AS tool_calls
  FROM x_events JOIN ({source}) USING (trialId) GROUP BY ALL) u
JOIN (SELECT {entity}, modelId, configurationId, count(DISTINCT trialId) AS total_runs FROM ({source}) GROUP BY ALL) r USING ({entity}, modelId, configurationId)"""


_BY_TASK = "SELECT trialId, taskId, modelId, configurationId FROM x_trials WHERE strategy <> 'inline'"
_BY_TAG = "SELECT trialId, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['uncategorized'] END) AS category, modelId, configurationId FROM x_trials WHERE strategy <> 'inline'"
cte("x_activation", activation_sql("taskId", _BY_TASK))


def by_task(spark, sf):
    entities = trace_ops.without_inline(m.trials(spark, sf)).select("trialId", "taskId", "modelId", "configurationId")
    return trace_ops.tool_activation(trace_ops.tool_names(m.traces(spark, sf)), entities, "taskId")


register("tool_activation", "SELECT * FROM x_activation")(by_task)


@register("tool_activation_tag", activation_sql("category", _BY_TAG))
def tool_activation_tag(spark, sf):
    t = trace_ops.without_inline(m.trials(spark, sf))
    tagged = t.select("trialId", "modelId", "configurationId", F.explode_outer(F.when(F.size("taskTags") > 0, F.col("taskTags"))).alias("category"))
    entities = tagged.withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    return trace_ops.tool_activation(trace_ops.tool_names(m.traces(spark, sf)), entities, "category")


@register("top_k_tools", """
SELECT taskId, modelId, configurationId, tool_name, activation_rate_pct FROM x_activation WHERE activation_rate_pct >= 20
QUALIFY row_number() OVER (PARTITION BY modelId, taskId, configurationId ORDER BY activation_rate_pct DESC, tool_name) <= 2""")
def top_k_tools(spark, sf):
    rows = ranking.top_k(by_task(spark, sf), ["modelId", "taskId", "configurationId"], [F.desc("activation_rate_pct"), "tool_name"], 2, ("activation_rate_pct", 20.0))
    return rows.select("taskId", "modelId", "configurationId", "tool_name", "activation_rate_pct")


@register("top_k_cell", """
SELECT taskId, modelId, tool_label, activation_rate_pct FROM x_activation
QUALIFY row_number() OVER (PARTITION BY taskId, modelId ORDER BY activation_rate_pct DESC, tool_label) <= 3""")
def top_k_cell(spark, sf):
    return ranking.top_k(by_task(spark, sf), ["taskId", "modelId"], [F.desc("activation_rate_pct"), "tool_label"], 3).select(
        "taskId", "modelId", "tool_label", "activation_rate_pct"
    )


cte("x_features", """
SELECT CAST(k AS VARCHAR) AS trialId, k, b AS trace_query_exists, b AND k % 3 <> 1 AND k % 11 = 0 AS trace_query_error_present,
  CASE WHEN NOT b OR k % 3 = 1 THEN 0 WHEN k % 6 = 0 THEN 4 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS trace_native_mcp_visible_count,
  b AND k % 3 = 0 AS trace_native_mcp_has_visible_calls, CASE WHEN b AND k % 3 <> 1 AND k % 7 < 3 THEN 1 ELSE 0 END AS trace_server_mcp_count,
  CASE WHEN b AND k % 3 <> 1 AND k % 2 = 0 THEN 2 ELSE 0 END AS trace_tool_call_count FROM (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS b FROM orders)""")


@register("trace_features", "SELECT * EXCLUDE (k) FROM x_features")
def trace_features(spark, sf):
    return trace_ops.trace_features(m.traces(spark, sf))


@register("instrumentation_gap", """
SELECT configurationId, count(*) AS runs, coalesce(sum(toolCalls), 0) AS reported_toolCalls_sum, coalesce(sum(mcpToolCalls), 0) AS reported_mcpToolCalls_sum,
  CAST(coalesce(sum(trace_native_mcp_visible_count), 0) AS BIGINT) AS trace_native_mcp_visible_sum,
  count(*) FILTER (trace_native_mcp_has_visible_calls) AS trace_native_mcp_visible_runs, CAST(coalesce(sum(trace_tool_call_count), 0) AS BIGINT) AS trace_tool_call_sum,
  count(*) FILTER (trace_query_error_present) AS query_trace_error_runs,
  count(*) FILTER (trace_native_mcp_has_visible_calls) / CAST(count(*) AS DOUBLE) * 100.0 AS native_mcp_visible_runs_pct, true AS trace_scan_enabled
FROM x_last JOIN x_trials USING (trialId) LEFT JOIN x_features USING (trialId) GROUP BY configurationId""")
def instrumentation_gap(spark, sf):
    rows = latest(m.response_log(spark, sf).select("trialId", "seq", "metricsSummary"), ["trialId"]).select(
        "trialId", "metricsSummary.toolCalls", "metricsSummary.mcpToolCalls"
    ).join(m.trials(spark, sf).select("trialId", "configurationId"), "trialId", "inner")
    return trace_ops.instrumentation_gap(rows, trace_ops.trace_features(m.traces(spark, sf)))


@register("instrumentation_gap_off", """
SELECT configurationId, count(*) AS runs, coalesce(sum(toolCalls), 0) AS reported_toolCalls_sum, coalesce(sum(mcpToolCalls), 0) AS reported_mcpToolCalls_sum,
  CAST(NULL AS BIGINT) AS trace_native_mcp_visible_sum, CAST(NULL AS BIGINT) AS trace_native_mcp_visible_runs, CAST(NULL AS BIGINT) AS trace_tool_call_sum,
  CAST(NULL AS BIGINT) AS query_trace_error_runs, CAST(NULL AS DOUBLE) AS native_mcp_visible_runs_pct, false AS trace_scan_enabled
FROM x_log JOIN x_trials USING (trialId) GROUP BY configurationId""")
def instrumentation_gap_off(spark, sf):
    rows = m.responses(spark, sf).select("trialId", "configurationId", "metricsSummary.toolCalls", "metricsSummary.mcpToolCalls")
    return trace_ops.instrumentation_gap(rows)


def eval_traces(spark, sf):
    """An evaluation trace per order: raw judge responses with errors and failed statuses."""
    k = F.col("o_orderkey")
    text = F.lit(None).cast("string")
    raw = F.array(
        F.struct(F.when(k % 3 == 0, F.lit("bad")).otherwise(text).alias("error"), F.lit("ok").alias("status")),
        F.struct(text.alias("error"), F.when(k % 4 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status")),
    )
    ai = F.struct(F.array(F.struct(F.when(k % 5 == 0, F.lit("x")).otherwise(text).alias("error"), F.lit("j").alias("id"))).alias("judges"))
    body = F.struct(F.struct(raw.alias("rawResponse"), ai.alias("aiTrace"), F.when(k % 7 == 0, F.lit("top")).otherwise(text).alias("error")).alias("trace"))
    return m.table(spark, sf, "orders").select(k.cast("string").alias("trialId"), F.try_parse_json(F.to_json(body)).alias("body"))


@register("eval_trace_summary", """
SELECT true AS trace_scan_enabled, count(*) AS eval_rows_scanned, count(*) FILTER (coalesce(judgeErrorCount, 0) > 0) AS reported_judge_error_rows,
  count(*) FILTER (k % 7 = 0) AS trace_top_error_rows, count(*) FILTER (k % 3 = 0) AS trace_raw_error_rows, count(*) FILTER (k % 4 = 0) AS trace_status_error_rows,
  count(*) FILTER (k % 5 = 0) AS trace_judge_error_rows FROM x_evals""")
def eval_trace_summary(spark, sf):
    return trace_ops.eval_trace_summary(m.evals(spark, sf), trace_ops.eval_trace_features(eval_traces(spark, sf)))


KINDS = {"click": "model.generate", "view": "mcp.tool_call", "purchase": "mcp.tool_result", "error": "retry.attempt", "signup": "rate_limit.wait"}


@register("metrics_from_events", """
SELECT CAST(user_id AS VARCHAR) AS trialId, sum(floor(value)) FILTER (event_type = 'click') AS modelDurationMs,
  sum(floor(value)) FILTER (event_type = 'purchase') AS toolDurationMs, count(*) FILTER (event_type = 'click') AS modelCalls,
  count(*) FILTER (event_type = 'view') AS toolCalls, count(*) FILTER (event_type = 'error') AS retryCount,
  CAST(greatest(0, max(CAST(json_extract(props, '$.k') AS BIGINT) % 9)) AS DOUBLE) AS steps,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (event_type = 'click') AS DOUBLE) AS inputTokens,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT) + 1) FILTER (event_type = 'click' AND event_id % 3 = 0) AS DOUBLE) AS totalTokens,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT) + 1) FILTER (event_type = 'click' AND event_id % 3 <> 0) AS DOUBLE) AS totalTokensEstimated,
  sum(floor(value)) FILTER (event_type = 'signup') AS rateLimitWaitMs FROM events GROUP BY user_id""")
def metrics_from_events(spark, sf):
    e = m.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    kind = scalar.lookup(KINDS, "event_type")
    rows = e.select(
        F.col("user_id").cast("string").alias("trialId"), F.col("event_id").alias("pos"), kind.alias("type"), kind.alias("name"),
        F.floor("value").cast("double").alias("duration_ms"), k.alias("input_tokens"), F.lit(1.0).alias("output_tokens"),
        F.when(F.col("event_id") % 3 == 0, k + 1).alias("total_tokens"), (k % 9).alias("steps"),
        *[F.lit(None).cast("double").alias(c) for c in trace_ops.EVENT_NUMBERS if c not in ("input_tokens", "output_tokens", "total_tokens", "steps")],
    )
    return trace_ops.metrics_from_events(rows).select(
        "trialId", "modelDurationMs", "toolDurationMs", "modelCalls", "toolCalls", "retryCount", "steps", "inputTokens",
        "totalTokens", "totalTokensEstimated", "rateLimitWaitMs",
    )


@register("events_of_traces", """
SELECT type, count(*) AS n FROM (SELECT 'model.generate' AS type FROM x_calls UNION ALL SELECT 'mcp.tool_call' FROM x_calls WHERE k % 4 = 1) GROUP BY type""")
def events_of_traces(spark, sf):
    return trace_ops.explode_events(m.traces(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("canonical_order", "SELECT dataset_id, experimentId, trialId FROM x_facts")
def canonical_order(spark, sf):
    return metrics.canonical_order(facts(spark, sf), ["dataset_id", "experimentId", "trialId"]).select("dataset_id", "experimentId", "trialId")


@register("canonical_places", """
SELECT trialId, row_number() OVER (ORDER BY coalesce(dataset_id, ''), experimentId, trialId) AS position FROM x_facts""")
def canonical_places(spark, sf):
    """The order itself: each row's place."""
    return places(metrics.canonical_order(facts(spark, sf), ["dataset_id", "experimentId", "trialId"]).select("trialId")).select("trialId", "position")


@register("first_vote_judge", "SELECT judgeId, count(*) AS n FROM x_votes WHERE firstValid = 1 GROUP BY judgeId")
def first_vote_judge(spark, sf):
    return first_vote(m.votes(spark, sf)).groupBy("judgeId").agg(F.count(F.lit(1)).alias("n"))
