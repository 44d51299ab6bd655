"""Queries: sources written from the given tables in their own form and read back; parts of whole documents."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from trialscape.functions import scalar
from trialscape.mart import tables as m
from trialscape.mart.registry import register
from trialscape.operators import checks, corpus, curriculum
from trialscape.operators import latest as latest_ops
from trialscape.operators import metrics as metric_ops
from trialscape.operators import select as select_ops
from trialscape.operators import votes as vote_ops
from trialscape.session import drop_scratch, scratch_path
from trialscape.sources import artifacts, catalog, manifest, sinks

EXPERIMENTS = [f"exp-{i}" for i in range(4)]


def manifest_folder(spark, sf):
    """A manifest per experiment: the configurations of its trials, the judges of its share of the suppliers."""
    folder = scratch_path(spark, "manifests")
    own = m.trials(spark, sf).select("experimentId", "configurationId", F.struct("strategy", "representation", "surface").alias("d")).distinct()
    defined = own.groupBy("experimentId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("configurationId", "d")))).alias("configurations"))
    key = F.col("s_suppkey").cast("string")
    judge = F.struct(F.concat(F.lit("p"), key).alias("provider"), F.concat(F.lit("m"), key).alias("model"),
                     F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("judgeId"), F.concat(F.lit("judge "), key))).alias("params"))
    judges = m.table(spark, sf, "supplier").groupBy(F.concat(F.lit("exp-"), (F.col("s_suppkey") % 4).cast("string")).alias("experimentId")).agg(
        F.transform(scalar.sorted_by(F.collect_list(F.struct("s_suppkey", judge.alias("j"))), "s_suppkey"), lambda x: x["j"]).alias("judges"))
    surfaces = F.create_map(F.lit("ops"), F.struct(F.lit("operations").alias("type"), F.array(F.lit("find"), F.lit("read")).alias("operations")),
                            F.lit("page"), F.struct(F.lit("document").alias("type"), F.array().cast("array<string>").alias("operations")))
    docs = defined.join(judges, "experimentId", "left").select(
        "experimentId", F.to_json(F.struct("experimentId", "configurations", surfaces.alias("surfaces"), F.struct(F.lit(True).alias("enabled"), "judges").alias("evaluation"))).alias("value"))
    for name in EXPERIMENTS:
        docs.where(F.col("experimentId") == name).select("value").write.text(f"{folder}/{name}/manifest.json")
    return folder, [f"{folder}/{name}" for name in EXPERIMENTS]


def read_manifests(spark, sf):
    """Each manifest is a folder of one part here, so the directory is one level up."""
    _, dirs = manifest_folder(spark, sf)
    return manifest.read_manifest(spark, dirs)


@register("manifest_configurations", """
SELECT DISTINCT experimentId, configurationId, strategy, representation, surface FROM x_trials""")
def manifest_configurations(spark, sf):
    return manifest.configurations(read_manifests(spark, sf)).drop("experimentDir")


@register("manifest_surfaces", """
SELECT experimentId, s.surface, s.type, s.operations FROM (SELECT DISTINCT experimentId FROM x_trials) CROSS JOIN (VALUES ('ops', 'operations', 'find,read'), ('page', 'document', '')) s(surface, type, operations)""")
def manifest_surfaces(spark, sf):
    return manifest.surfaces(read_manifests(spark, sf)).select("experimentId", "surface", "type", F.array_join("operations", ",").alias("operations"))


@register("manifest_judges", """
SELECT 'exp-' || (s_suppkey % 4) AS experimentId, CAST(row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1 AS INTEGER) AS ord,
  CASE WHEN s_suppkey % 2 = 0 THEN 'judge ' || s_suppkey ELSE 'p' || s_suppkey || ':m' || s_suppkey END AS judgeId, 'p' || s_suppkey AS provider, 'm' || s_suppkey AS model
FROM supplier WHERE 'exp-' || (s_suppkey % 4) IN (SELECT experimentId FROM x_trials)""")
def manifest_judges(spark, sf):
    return manifest.judges(read_manifests(spark, sf)).select("experimentId", "ord", "judgeId", "provider", "model")


def logs_of_experiments(spark, sf):
    """Four experiments; the last has no evaluations, all but the first no votes."""
    folder, dirs = manifest_folder(spark, sf)
    evals = scratch_path(spark, "evals")
    m.evals(spark, sf).drop("seq").write.parquet(evals)
    kinds = {"trials": (m.trials(spark, sf).drop("seq"), EXPERIMENTS), "responses": (m.response_log(spark, sf, experiments=True).drop("seq"), EXPERIMENTS),
             "evals": (spark.read.parquet(evals), EXPERIMENTS[:3]), "judge_votes": (m.votes(spark, sf, experiments=True).drop("seq"), EXPERIMENTS[:1])}
    for kind, (rows, names) in kinds.items():
        for name in names:
            sinks.write_jsonl(rows.where(F.col("experimentId") == name), f"{folder}/{name}/{kind}.jsonl", compression="gzip")
    drop_scratch(spark, evals)
    return folder, dirs


@register("load_runs", """
SELECT experimentId AS experiment, 'trials' AS log, count(*) AS n, count(DISTINCT trialId) AS ids FROM x_trials GROUP BY experimentId
UNION ALL SELECT experimentId, 'responses', count(*), count(DISTINCT trialId) FROM x_log JOIN x_trials USING (trialId) GROUP BY experimentId
UNION ALL SELECT experimentId, 'evals', count(*), count(DISTINCT trialId) FROM x_evals WHERE experimentId <> 'exp-3' GROUP BY experimentId
UNION ALL SELECT experimentId, 'judge_votes', count(*), count(DISTINCT trialId) FROM x_votes JOIN x_trials USING (trialId) WHERE experimentId = 'exp-0' GROUP BY experimentId""")
def load_runs(spark, sf):
    """Logs of several directories, one of them without trials; optional logs may be missing."""
    folder, dirs = logs_of_experiments(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        logs = artifacts.load_runs(spark, [*dirs, f"{folder}/nothing"])
    parts = {"trials": logs.trials, "responses": logs.responses, "evals": logs.evals, "judge_votes": logs.votes}
    experiment = F.regexp_extract("experimentDir", "(exp-[0-9])", 1).alias("experiment")
    rows = [df.select(experiment, F.lit(kind).alias("log"), "trialId") for kind, df in parts.items()]
    return metric_ops.union_all(rows).groupBy("experiment", "log").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trialId").alias("ids"))


@register("run_manifest", """
SELECT experimentId, count(*) AS trials, min(dataset_id) AS datasetId, count(DISTINCT configurationId) AS configurations, 'task' AS selected, 5 AS dimensions, 'configurationId' AS groupBy
FROM x_trials GROUP BY experimentId""")
def run_manifest(spark, sf):
    """The manifest of a metrics run as one document, its inputs taken apart again."""
    t = m.trials(spark, sf).withColumn("experimentDir", F.col("experimentId"))
    own = t.select("trialId", "experimentDir")
    inputs = sinks.metrics_manifest(t, m.response_log(spark, sf).join(own, "trialId"), m.evals(spark, sf).withColumn("experimentDir", F.col("experimentId")), m.votes(spark, sf).join(own, "trialId"))
    defined = t.select("experimentDir", "configurationId", "strategy", "representation", "surface").distinct()
    path = scratch_path(spark, "manifest")
    sinks.write_summary(sinks.run_manifest(inputs, ["configurationId"], {"task": ["1-URGENT"]}, configurations=defined), path)
    body = "inputs ARRAY<STRUCT<experimentId: STRING, trials: BIGINT, datasetId: STRING, configurations: MAP<STRING, STRUCT<strategy: STRING>>>>, selectors MAP<STRING, ARRAY<STRING>>, " \
        "groupBy ARRAY<STRING>, metricFramework STRUCT<coreDimensions: ARRAY<STRING>>"
    doc = spark.read.schema(body).json(path)
    return doc.select(F.explode("inputs").alias("i"), "selectors", "groupBy", "metricFramework").select(
        "i.experimentId", "i.trials", "i.datasetId", F.size("i.configurations").cast("long").alias("configurations"),
        F.element_at(F.map_keys("selectors"), 1).alias("selected"), F.size("metricFramework.coreDimensions").alias("dimensions"), F.array_join("groupBy", ",").alias("groupBy"))


@register("summary_pooled", """
SELECT dataset_id, provider, array_to_string(list_sort(list(DISTINCT configurationId)), ',') AS configurations FROM x_trials GROUP BY ALL HAVING count(DISTINCT configurationId) > 1""")
def summary_pooled(spark, sf):
    """Groups of the summary document that pool several configurations, written and read back."""
    path = scratch_path(spark, "summary")
    sinks.write_summary(metric_ops.summary(m.facts(spark, sf, with_traces=False), gb=["dataset_id", "provider"]), path)
    doc = spark.read.schema("pooledConfigurations ARRAY<STRUCT<group: STRUCT<dataset_id: STRING, provider: STRING>, configurationIds: ARRAY<STRING>>>").json(path)
    return doc.select(F.explode("pooledConfigurations").alias("p")).select("p.group.dataset_id", "p.group.provider", F.array_join("p.configurationIds", ",").alias("configurations"))


@register("with_config", """
SELECT trialId, CASE WHEN strategy <> 'remote_mcp' THEN strategy END AS strategy, CASE WHEN strategy <> 'remote_mcp' THEN surface END AS surface FROM x_log JOIN x_trials USING (trialId)""")
def with_config(spark, sf):
    """Responses with the definition of their configuration; one configuration is not in the manifest."""
    defined = m.trials(spark, sf).where("strategy != 'remote_mcp'").select("configurationId", "strategy", "representation", "surface").distinct()
    return checks.with_config(m.responses(spark, sf), defined).select("trialId", "definition.strategy", "definition.surface")


@register("merge_outcomes", """
SELECT n.trialId, CASE WHEN o.trialId IS NOT NULL AND n.judges > 1 THEN o.correctness ELSE own.correctness END AS correctness,
  CASE WHEN o.trialId IS NOT NULL AND n.judges > 1 THEN o.k_agree WHEN own.trialId IS NOT NULL THEN true END AS completeness_agreed
FROM (SELECT trialId, count(*) AS judges FROM x_lastvotes GROUP BY trialId HAVING bool_or(judgeId = 'judge0')) n
LEFT JOIN x_outcome o ON o.trialId = n.trialId LEFT JOIN (SELECT * FROM x_lastvotes WHERE judgeId = 'judge0' AND error IS NULL) own ON own.trialId = n.trialId""")
def merge_outcomes(spark, sf):
    """One judge evaluated again; the votes of the others come from the log and change the outcome."""
    last = m.latest_votes(spark, sf)
    new = last.where("judgeId = 'judge0'")
    one = lambda c: F.struct(F.col(f"{c}_rating").alias("rating"), F.col(f"{c}_agreement").cast("variant").alias("agreement"))
    found = vote_ops.outcome(new).select("trialId", F.struct(one("correctness").alias("correctness"), one("completeness").alias("completeness")).alias("outcome"))
    evals = new.select("trialId").join(found, "trialId", "left")
    return latest_ops.merge_outcomes(evals, new, last).select("trialId", "outcome.correctness.rating", F.col("outcome.completeness.agreement").cast("boolean").alias("completeness_agreed")).withColumnRenamed("rating", "correctness")


@register("trial_object", """
SELECT trialId, f.status, f.modelId AS model, array_to_string(f.tags, ',') AS tags, f.totalTokens AS tokens, e.ev_status AS evaluation, v.judges, v.n AS votes
FROM (SELECT l.*, t.modelId, t.tags FROM (SELECT *, row_number() OVER (PARTITION BY trialId ORDER BY back DESC) AS f FROM x_log) l JOIN x_trials t USING (trialId) WHERE l.f = 1) f
LEFT JOIN (SELECT trialId, ev_status FROM x_evals) e USING (trialId) LEFT JOIN (SELECT trialId, count(*) AS n, string_agg(judgeId, ',' ORDER BY back DESC) AS judges FROM (
  SELECT trialId, judgeId, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS back
  FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS trialId, 'judge' || (l_suppkey % 3) AS judgeId FROM lineitem)) GROUP BY trialId) v USING (trialId)""")
def trial_object(spark, sf):
    """Every trial as one JSON object, some of its parts read again."""
    li = m.lines_by_trial(spark, sf)
    rows = select_ops.trial_object(m.response_log(spark, sf, li=li), m.evals(spark, sf, li), m.votes(spark, sf, li=li), trials=m.trials(spark, sf).drop("seq"))
    body = "status STRING, model STRUCT<id: STRING>, tags ARRAY<STRING>, metrics STRUCT<totalTokens: DOUBLE>, evaluation STRUCT<status: STRING>, judgeVotes ARRAY<STRUCT<judgeId: STRING>>"
    return rows.withColumn("d", F.from_json("detail", body)).select(
        "trialId", "d.status", F.col("d.model.id").alias("model"), F.array_join("d.tags", ",").alias("tags"), F.col("d.metrics.totalTokens").alias("tokens"),
        F.col("d.evaluation.status").alias("evaluation"), F.array_join("d.judgeVotes.judgeId", ",").alias("judges"), F.size("d.judgeVotes").cast("long").alias("votes"))


# --- catalogs, id lists, pages, corpora --------------------------------------

@register("read_tasks", """
SELECT 'set-' || (item_id // 20) AS datasetId, CAST(row_number() OVER (PARTITION BY item_id // 20 ORDER BY item_id) - 1 AS INTEGER) AS ord, 'q' || item_id AS taskId, text AS statement,
  CASE WHEN item_id % 3 = 0 THEN '' ELSE 'a,b' END AS tags, CASE WHEN item_id % 4 = 0 THEN 'repoqa-scorer' ELSE 'judge' END AS validationType FROM benchmark""")
def read_tasks(spark, sf):
    """Task catalogs of twenty benchmark items, one document a file."""
    b = m.table(spark, sf, "benchmark")
    k = F.col("item_id")
    method = F.when(k % 4 == 0, F.lit("repoqa-scorer")).otherwise(F.lit("judge"))
    task = F.struct(F.concat(F.lit(" q"), k.cast("string"), F.lit(" ")).alias("id"), F.col("text").alias("statement"),
                    F.when(k % 3 != 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.struct(method.alias("type")).alias("validation"))
    dataset = F.concat(F.lit("set-"), F.floor(k / 20).cast("string")).alias("datasetId")
    docs = b.groupBy(dataset).agg(F.transform(scalar.sorted_by(F.collect_list(F.struct("item_id", task.alias("t"))), "item_id"), lambda x: x["t"]).alias("tasks"))
    root = scratch_path(spark, "catalog")
    docs.select(F.to_json(F.struct("datasetId", F.lit("v1").alias("version"), "tasks")).alias("value")).write.option("maxRecordsPerFile", "1").text(f"{root}/tasks.json")
    rows = catalog.read_tasks(spark, root)
    return rows.select("datasetId", "ord", "taskId", "statement", F.array_join("tags", ",").alias("tags"), "validationType")


@register("read_instances", """
SELECT 'i' || (c_custkey // 50) AS instanceId, 'c' || c_custkey AS taskId, c_mktsegment AS segment, CASE WHEN c_custkey % 7 <> 0 THEN 1 ELSE 0 END AS parameters FROM customer""")
def read_instances(spark, sf):
    """Instance catalogs of fifty customers, one document a file; a seventh of the entries has no parameters."""
    c = m.table(spark, sf, "customer")
    own = F.when(F.col("c_custkey") % 7 != 0, F.create_map(F.lit("segment"), F.col("c_mktsegment")))
    instance = F.concat(F.lit("i"), F.floor(F.col("c_custkey") / 50).cast("string")).alias("instanceId")
    entry = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), own.alias("parameters"))
    docs = c.groupBy(instance).agg(F.collect_list(entry).alias("tasks"))
    root = scratch_path(spark, "catalog")
    body = F.struct(F.lit("d").alias("datasetId"), F.array(F.struct("instanceId", "tasks")).alias("instances"))
    docs.select(F.to_json(body).alias("value")).write.option("maxRecordsPerFile", "1").text(f"{root}/tasks.instance.json")
    rows = catalog.read_instances(spark, root)
    segments = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("taskId"), "c_mktsegment")
    return rows.join(segments, "taskId").select("instanceId", "taskId", F.coalesce(F.col("parameters")["segment"], "c_mktsegment").alias("segment"), F.size("parameters").alias("parameters"))


@register("read_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS trialId FROM orders WHERE o_orderkey % 6 <> 0")
def read_ids(spark, sf):
    """An id list with blanks around ids and blank lines."""
    path, key = scratch_path(spark, "ids"), F.col("o_orderkey")
    line = F.when(key % 6 == 0, F.repeat(F.lit(" "), (key % 3).cast("int"))).otherwise(F.concat(F.lit("  "), key.cast("string"), F.lit(" ")))
    m.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return artifacts.read_ids(spark, path)


@register("read_pages", "SELECT html || chr(10) AS html, count(*) AS n FROM pages GROUP BY ALL")
def read_pages(spark, sf):
    """Every page as a file of its own, read as bytes and decoded."""
    path = scratch_path(spark, "pages")
    sinks.write_each(m.table(spark, sf, "pages").select(F.col("html").alias("value")), path)
    return catalog.read_pages(spark, path).groupBy("html").agg(F.count(F.lit(1)).alias("n"))


@register("read_corpus_lines", """
SELECT lang AS language, source || '-' || (doc_id // 50) AS repo, CAST(doc_id // 50 AS INTEGER) AS repo_ord, 'd' || doc_id AS path, text AS source FROM documents""")
def read_corpus_lines(spark, sf):
    """A corpus of one repository a line, read in splits and taken apart into files."""
    d = m.table(spark, sf, "documents")
    part = F.floor(F.col("doc_id") / 50)
    repos = d.groupBy(F.col("lang").alias("language"), F.concat_ws("-", "source", part.cast("string")).alias("repo"), part.cast("int").alias("repo_ord")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))).alias("content"))
    path = scratch_path(spark, "corpus")
    repos.write.json(path)
    return catalog.corpus_files(catalog.read_corpus_lines(spark, path)).select("language", "repo", "repo_ord", "path", "source")


# --- helpers of whole documents ----------------------------------------------

@register("duration_ms", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(0, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) - epoch_ms(CAST(o_orderdate AS TIMESTAMP))) END AS ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def duration_ms(spark, sf):
    """ISO time stamps as a log writes them; a broken one has no difference."""
    both = m.table(spark, sf, "lineitem").join(m.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    iso = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    ended = F.when(F.col("l_linenumber") == 7, F.lit("soon")).otherwise(iso("l_shipdate"))
    return both.select("l_orderkey", "l_linenumber", scalar.duration_ms(iso("o_orderdate"), ended).alias("ms"))


@register("render_prompt", """
SELECT conv_id, turn, text || role || coalesce(text, '') AS prompt FROM conversations""")
def render_prompt(spark, sf):
    """The columns that a template names, in its order; an unknown one gives nothing."""
    c = m.table(spark, sf, "conversations").withColumn("template", F.lit("text\nrole\nnobody\ntext"))
    return c.select("conv_id", "turn", corpus.render_prompt("template", ["role", "text"]).alias("prompt"))


@register("research_interests", "SELECT id, CASE WHEN id % 5 <> 0 THEN seg END AS area FROM x_people")
def research_interests(spark, sf):
    from trialscape.mart.q_text import curricula

    rows = curriculum.research_interests(curricula(spark, sf))
    return rows.select("id", F.try_variant_get("expertise", "$.area", "string").alias("area"))


# --- the contract of a metrics run ------------------------------------------------

@register("contract_violations", """
SELECT DISTINCT 'contract_version' AS rule, experimentId AS key, 'not 2' AS detail FROM x_trials
UNION ALL SELECT DISTINCT 'configuration_conflict', 'cfg-F', '2' FROM x_trials WHERE experimentId = 'exp-3' AND configurationId = 'cfg-F'
UNION ALL SELECT 'duplicate_in_log', trialId, experimentId FROM x_trials WHERE k % 200 = 0
UNION ALL SELECT 'duplicate_across_inputs', trialId, 'dir9 and ' || experimentId FROM x_trials WHERE k % 300 = 0
UNION ALL SELECT 'unknown_configuration', trialId, 'cfg-P' FROM x_trials WHERE configurationId = 'cfg-P'
UNION ALL SELECT 'treatment_differs', trialId, configurationId FROM x_trials WHERE k % 40 = 0 AND configurationId <> 'cfg-P'
UNION ALL SELECT 'treatment_conflict', trialId, 'several treatments' FROM x_trials
  WHERE k % 40 = 0 AND (trialId IN (SELECT trialId FROM x_log) OR trialId IN (SELECT trialId FROM x_evals))
UNION ALL SELECT 'pipe_in_tag', trialId, 'a|b,c' FROM x_trials WHERE k % 90 = 0
UNION ALL SELECT 'legacy_column', trialId, 'old log' FROM x_trials WHERE k % 70 = 0
UNION ALL SELECT DISTINCT 'not_a_response', CAST(l_orderkey AS VARCHAR), 'no status and no timing' FROM lineitem WHERE l_linenumber = 7""")
def contract_violations(spark, sf):
    """Logs bent in every way the contract forbids, and manifests that miss a configuration and disagree on another."""
    own = ["trialId", "experimentDir", *checks.TREATMENT, "metadata"]
    t = m.trials(spark, sf).withColumn("experimentDir", F.col("experimentId"))
    bent = t.select(
        "trialId", "experimentDir", "configurationId", "strategy", "surface", "metadata", "seq",
        F.when(F.col("seq") % 40 == 0, F.lit("other")).otherwise(F.col("representation")).alias("representation"),
        F.when(F.col("seq") % 90 == 0, F.array(F.lit("a|b"), F.lit("c"))).otherwise(F.col("taskTags")).alias("taskTags"),
        F.when(F.col("seq") % 70 == 0, F.lit("old")).alias("question"),
    )
    trials = bent.unionByName(bent.where("seq % 200 = 0")).unionByName(bent.where("seq % 300 = 0").withColumn("experimentDir", F.lit("dir9")))
    last = F.col("seq.l_linenumber") == 7
    responses = m.response_log(spark, sf).select(
        "trialId", *[F.when(~last, F.col(c)).alias(c) for c in ("status", "timing")]).join(t.select(*own), "trialId")
    evals = m.evals(spark, sf).withColumn("experimentDir", F.col("experimentId")).select(*own)
    defined = F.map_filter("configurations", lambda k, v: k != "cfg-P")
    differs = lambda k, v: (F.col("experimentId") == "exp-3") & (k == "cfg-F")
    manifests = read_manifests(spark, sf).withColumn("experimentDir", F.col("experimentId")).withColumn(
        "configurations", F.transform_values(defined, lambda k, v: F.when(differs(k, v), v.withField("strategy", F.lit("zzz"))).otherwise(v)))
    return checks.contract_violations(trials, responses, evals, manifests).distinct()
