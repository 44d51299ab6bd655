"""Queries: logs replayed as streams, and round trips through the readers and writers."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trialscape.functions.scalar import coerce_numeric
from trialscape.mart import tables as m
from trialscape.mart.registry import register
from trialscape.operators import pending
from trialscape.session import scratch_path
from trialscape.sources import artifacts, sinks
from trialscape.streaming import logs
from trialscape.streaming.levels import Levels


def stream_table(spark, sf, name):
    """A given table as a stream."""
    schema = m.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def event_stream(spark, sf):
    """The events as a log of six files, two of them in each micro-batch."""
    path, events = scratch_path(spark, "events"), m.table(spark, sf, "events")
    events.repartition(6, "event_id").write.option("maxRecordsPerFile", "0").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "2").parquet(path)


def _finish(spark, updates, mode="update"):
    path, checkpoint = scratch_path(spark, "deltas"), scratch_path(spark, "stream")
    logs.run_to_end(logs.write_deltas(updates, path, checkpoint, mode))
    return path


@register("stream_latest", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def stream_latest(spark, sf):
    events = stream_table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    path = _finish(spark, logs.stream_latest(events, ["user_id"], "ts"))
    return logs.read_latest(spark, path, ["user_id"]).select("user_id", "event_id", "event_type")


@register("stream_compact", """
SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def stream_compact(spark, sf):
    path, checkpoint = scratch_path(spark, "levels"), scratch_path(spark, "stream")
    keys = ["user_id", "event_type"]
    events = event_stream(spark, sf).select(*keys, "event_id", F.col("event_id").alias("seq"))
    logs.run_to_end(logs.stream_compact(events, keys, "seq", path, checkpoint, fan=2))
    return Levels(path, keys, "seq", 2).read(spark).select(*keys, "event_id")


@register("stream_latest_expiring", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def stream_latest_expiring(spark, sf):
    """Three micro-batches; a user is forgotten after a day without events, and read back from the levels."""
    path, checkpoint = scratch_path(spark, "levels"), scratch_path(spark, "stream")
    events = event_stream(logs.state_session(spark), sf).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    updates = logs.stream_latest_expiring(events, ["user_id"], "ts", "ts", "3650 days", 86400)
    logs.run_to_end(logs.write_levels(updates, Levels(path, ["user_id"], "ts", 2), checkpoint))
    return Levels(path, ["user_id"], "ts", 2).read(spark).select("user_id", "event_id", "event_type")


class _Stopped(Exception):
    pass


@register("stream_once_restart", """
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS delivered FROM events GROUP BY event_type""")
def stream_once_restart(spark, sf):
    """Each user and kind once, by a query that is stopped after the second batch's output and resumed."""
    path, checkpoint = scratch_path(spark, "once"), scratch_path(spark, "stream")
    events = event_stream(spark, sf).select("user_id", "event_type", "event_id")

    def stop(number):
        if number == 1:
            raise _Stopped

    try:
        logs.run_to_end(logs.write_once(events, ["user_id", "event_type"], "event_id", path, checkpoint, before_commit=stop))
    except StreamingQueryException:
        logs.run_to_end(logs.write_once(events, ["user_id", "event_type"], "event_id", path, checkpoint))
    return logs.read_once(spark, path).groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("delivered")
    )


@register("stream_status", """
SELECT date_trunc('day', ts)::DATE AS label, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def stream_status(spark, sf):
    events = stream_table(spark, sf, "events")
    path = _finish(spark, logs.stream_status(events, F.to_date("ts"), "event_type"))
    return logs.read_latest(spark, path, ["label", "status"])


@register("stream_once", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def stream_once(spark, sf):
    events = stream_table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    unique = logs.once_per_key(events, ["user_id", "event_type"], "ts", "3650 days")
    path = _finish(spark, unique, "append")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_match", """
SELECT o_orderkey AS trial, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def stream_match(spark, sf):
    jobs = m.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("t-"), F.col("o_orderkey").cast("string")).alias("custom_id"), F.col("o_orderkey").alias("trial")
    )
    key = F.concat(F.lit("t-"), F.col("l_orderkey").cast("string"))
    items = stream_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, key).alias("custom_id"), F.when(F.col("l_linenumber") % 2 == 1, key).alias("customId"), "l_linenumber"
    )
    path = _finish(spark, logs.stream_match(items, jobs), "append")
    return spark.read.parquet(path).select("trial", F.col("item.l_linenumber").alias("line"))


# --- round trips -------------------------------------------------------------

@register("artifact_roundtrip", """
SELECT trialId, status, totalTokens, response FROM x_last""")
def artifact_roundtrip(spark, sf):
    """The response log written as JSON lines and read back with its line order."""
    folder = scratch_path(spark, "run")
    log = m.response_log(spark, sf)
    rows = log.repartitionByRange("trialId", "seq").sortWithinPartitions("trialId", "seq").drop("seq")
    sinks.write_jsonl(rows, f"{folder}/responses.jsonl", compression="gzip")
    back = artifacts.read_artifact(spark, folder, "responses")
    from trialscape.operators.latest import latest

    return latest(back.select("trialId", "seq", "status", "metricsSummary.totalTokens", "response"), ["trialId"]).drop("seq")


def in_small_splits(spark, size="32k"):
    """A session that cuts files into many splits, so that a small log is read as a large one is."""
    session = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(key, size)
    return session


@register("corrupt_lines", """
SELECT o_orderkey % 7 AS part, line_number, CASE o_orderkey % 3 WHEN 0 THEN '{"trialId": "' || o_orderkey || '", ' WHEN 1 THEN '["' || o_orderkey || '"]' ELSE 'Traceback of ' || o_orderkey END AS line
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) AS line_number FROM orders) WHERE o_orderkey % 11 = 0""")
def corrupt_lines(spark, sf):
    """Seven log files with broken and blank lines among good ones, each read in several splits."""
    folder, found = scratch_path(spark, "run"), scratch_path(spark, "broken")
    key = F.col("o_orderkey").cast("string")
    good = F.to_json(F.struct(key.alias("trialId"), F.lit("success").alias("status"), F.repeat("o_orderpriority", F.lit(5)).alias("response")))
    bad = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"trialId": "'), key, F.lit('", '))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit('["'), key, F.lit('"]'))).otherwise(F.concat(F.lit("Traceback of "), key))
    text = F.when(F.col("o_orderkey") % 11 == 0, bad).when(F.col("o_orderkey") % 13 == 0, F.lit("  ")).otherwise(good)
    rows = m.table(spark, sf, "orders").select((F.col("o_orderkey") % 7).alias("part"), "o_orderkey", text.alias("value"))
    sorted_rows = rows.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey")
    sorted_rows.write.partitionBy("part").text(f"{folder}/responses.jsonl")
    artifacts.corrupt_lines(in_small_splits(spark), folder, "responses").write.parquet(found)
    return spark.read.parquet(found).select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "line_number", "line")


@register("csv_values", """
SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE format('{:.6g}', l_extendedprice) END AS price,
  CASE WHEN l_discount = 0 THEN '0' ELSE format('{:.6g}', l_discount / 7) END AS share, CASE WHEN l_linenumber > 3 THEN 'true' ELSE 'false' END AS late FROM lineitem""")
def csv_values(spark, sf):
    li = m.table(spark, sf, "lineitem")
    return sinks.csv_table(li.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") / 7).alias("share"), (F.col("l_linenumber") > 3).alias("late")))


@register("csv_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(m.table(spark, sf, "documents"), path, ["doc_id", "text", "lang"])
    return spark.read.csv(path, header=True, schema="doc_id STRING, text STRING, lang STRING", multiLine=True, escape='"', lineSep="\n")


@register("split_output", """
SELECT modelId AS modelSlug, configurationId, count(*) AS n FROM x_trials GROUP BY ALL""")
def split_output(spark, sf):
    path = scratch_path(spark, "split")
    sinks.write_split(m.trials(spark, sf).select("trialId", "modelId", "configurationId", "taskId"), path)
    return spark.read.json(path, schema="trialId STRING, taskId STRING, modelSlug STRING, configurationId STRING").groupBy("modelSlug", "configurationId").agg(F.count(F.lit(1)).alias("n"))


@register("scorer_rows", """
SELECT trialId, coalesce(reason, 'exported') AS result FROM (SELECT l.trialId, CASE WHEN status <> 'success' THEN 'response_not_successful' WHEN configurationId = 'cfg-P' THEN 'configuration_filtered'
  WHEN instanceId IN ('i0', 'i1') THEN 'missing_native_task' END AS reason FROM x_log l JOIN x_trials USING (trialId))""")
def scorer_rows(spark, sf):
    n = m.table(spark, sf, "nation").where("n_nationkey > 1")
    native = n.select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("instanceId"), F.col("n_name").alias("name"))
    done, left = sinks.to_scorer_rows(m.responses(spark, sf), native, configurations=["cfg-F", "cfg-O"])
    exported = done.select("run.trialId", F.lit("exported").alias("result"))
    return exported.unionByName(left.select("trialId", F.col("reason").alias("result")))


@register("input_manifest", """
SELECT experimentId AS experimentDir, count(*) AS trials, sum(r) AS responses, sum(e) AS evaluations, sum(v) AS judgeVotes, min(dataset_id) AS datasetId FROM x_trials
LEFT JOIN (SELECT trialId, count(*) AS r FROM x_log GROUP BY 1) USING (trialId) LEFT JOIN (SELECT trialId, 1 AS e FROM x_evals) USING (trialId)
LEFT JOIN (SELECT trialId, count(*) AS v FROM x_votes GROUP BY 1) USING (trialId) GROUP BY experimentId""")
def input_manifest(spark, sf):
    t = m.trials(spark, sf).withColumn("experimentDir", F.col("experimentId"))
    own = t.select("trialId", "experimentDir")
    e = m.evals(spark, sf).withColumn("experimentDir", F.col("experimentId"))
    table = sinks.metrics_manifest(t, m.response_log(spark, sf).join(own, "trialId"), e, m.votes(spark, sf).join(own, "trialId"))
    return table.select("experimentDir", "trials", "responses", "evaluations", "judgeVotes", "datasetId")


@register("coerce_numeric", "SELECT event_id, try_cast(event_type AS DOUBLE) AS a, CAST(value AS DOUBLE) AS b FROM events")
def coerce_numeric_query(spark, sf):
    e = m.table(spark, sf, "events").select("event_id", F.col("event_type").alias("a"), F.col("value").cast("string").alias("b"))
    return coerce_numeric(e, ["a", "b"])


@register("job_ids", "SELECT c_custkey, substr(c_custkey || '-' || c_mktsegment || '-x', 1, 64) AS custom_id FROM customer")
def job_ids(spark, sf):
    c = m.table(spark, sf, "customer")
    named = c.withColumn("judge", F.concat(F.lit("--"), F.col("c_mktsegment"), F.lit(" / x_")))
    return named.select("c_custkey", pending.custom_id("c_custkey", "judge").alias("custom_id"))
