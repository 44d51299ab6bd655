"""The run logs, derived by Spark from the given tables.

orders x customer are the planned trials, lineitem is the response log and the vote log,
evaluations are computed from the votes, every order yields a trace document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape import fixed, schemas
from trialscape.operators import facts as facts_ops
from trialscape.operators import votes as vote_ops
from trialscape.operators.latest import last_rows, latest, latest_of
from trialscape.operators.pending import fill_from_trials
from trialscape.operators.runs import RESPONSE_COLUMNS, measure_answers
from trialscape.session import scratch_path


SPLIT = 16 << 20
BUCKET = 4 << 20


def small_splits(spark: SparkSession) -> None:
    """Derived log rows are many times as wide as the compressed columns they come from, so what one task reads
    must be small for its rows to be sorted in memory. A session with still smaller splits keeps them."""
    name = "spark.sql.files.maxPartitionBytes"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > SPLIT:
        spark.conf.set(name, str(SPLIT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_splits(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a table's files, wherever they lie."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _by_status(f: str, o: str, p: str) -> Column:
    s = F.col("o_orderstatus")
    return F.when(s == "F", F.lit(f)).when(s == "O", F.lit(o)).otherwise(F.lit(p))


def _tags() -> Column:
    p = F.col("o_orderpriority")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return (
        F.when(p.isin("1-URGENT", "2-HIGH"), words("urgent", "service"))
        .when(p == "3-MEDIUM", words("standard"))
        .when(p == "5-LOW", words("backlog", "service"))
        .otherwise(F.array().cast("array<string>"))
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    key = F.col("o_orderkey")
    rows = (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
        .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    )
    empty = F.lit(None).cast("string")
    dataset = F.struct(
        F.lower("r_name").alias("id"), F.lit("v1").alias("version"), empty.alias("origin"),
        empty.alias("resolvedRevision"), empty.alias("contentHash"), empty.alias("materializedPath"),
    )
    rows = rows.select(
        key.cast("string").alias("trialId"),
        _text("exp-", key % 4).alias("experimentId"),
        dataset.alias("dataset"),
        _text("i", F.col("c_nationkey")).alias("instanceId"),
        F.col("o_orderpriority").alias("taskId"),
        _text("State of order ", key, "?").alias("taskStatement"),
        F.lit("State of order {order} of {segment} in {year}?").alias("taskTemplate"),
        _tags().alias("taskTags"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("b1")))
        .otherwise(F.array(F.lit("b1"), F.lit("b2"))).alias("contextBlocks"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lit("north")).otherwise(F.lit("south"))
        .alias("provider"),
        F.col("c_mktsegment").alias("modelId"),
        _text(F.lower("c_mktsegment"), "-v1").alias("modelName"),
        empty.alias("model"),
        _by_status("inline", "local_function", "remote_mcp").alias("strategy"),
        _by_status("html", "json", "json").alias("representation"),
        _by_status("page", "ops", "ops").alias("surface"),
        _text("cfg-", F.col("o_orderstatus")).alias("configurationId"),
        (key % 3 + 1).cast("int").alias("repeatIndex"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(fixed.SCORER_METHOD))
        .otherwise(F.lit(fixed.JUDGE_METHOD)).alias("validationType"),
        F.create_map().cast("map<string,string>").alias("validationConfig"),
        F.create_map(
            F.lit("order"), key.cast("string"), F.lit("segment"), F.col("c_mktsegment"),
        ).alias("parameters"),
        key.alias("seq"),
    )
    metadata = F.struct(
        F.concat_ws("/", "experimentId", "taskId", "instanceId").alias("canonicalId"),
        "configurationId", "strategy", "representation", "surface",
    )
    return rows.withColumn("metadata", metadata)


def log_order() -> Column:
    """Line order inside an order; total, see the survey."""
    return F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def lines(spark: SparkSession, sf_dir: str, experiments: bool = False) -> DataFrame:
    """The log lines as they are in the table, with the experiment of their trial where it is asked for: they meet
    their trials before texts are made of them."""
    li = table(spark, sf_dir, "lineitem").withColumn("trialId", F.col("l_orderkey").cast("string"))
    if not experiments:
        return li
    own = trials(spark, sf_dir).select(F.col("seq").alias("l_orderkey"), "experimentId")
    return li.join(own, "l_orderkey")


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return max(1, -(-stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // BUCKET))


def lines_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log lines, written once in buckets of their trial. Jobs that read the logs several times pass them to each
    reader: the narrow lines are shuffled once, and what is reduced or joined by trial stays in its bucket. A bucket
    holds about ``BUCKET`` bytes of the table, so none outgrows the memory of a task as the table grows."""
    li = lines(spark, sf_dir).drop("l_orderkey")
    n = buckets(spark, sf_dir)
    path = scratch_path(spark, "lines")
    name = f"lines_{path.rsplit('-', 1)[1]}"
    li.repartition(n, "trialId").write.bucketBy(n, "trialId").sortBy("trialId").saveAsTable(name, format="parquet", path=path)
    return spark.table(name)


def response_log(spark: SparkSession, sf_dir: str, experiments: bool = False, li: DataFrame | None = None) -> DataFrame:
    """Every line as a response; ``li`` are lines read before."""
    li = lines(spark, sf_dir, experiments) if li is None else li
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    price = F.floor("l_extendedprice").cast("double")
    failed = F.col("l_returnflag") == "R"
    asked = F.floor(qty * 3 / 4).cast("double")
    phrase = _text("part ", F.col("l_partkey"), " from supplier ", F.col("l_suppkey"), " costs ",
                   F.floor("l_extendedprice").cast("long"), ". ")
    values = {
        "totalDurationMs": F.when(line != 7, price),
        "modelDurationMs": F.floor(price / 2),
        "toolDurationMs": F.when(line > 2, line * 10),
        "modelCalls": line,
        "toolCalls": F.when(line > 1, line - 1),
        "functionCalls": F.when(line % 2 == 0, line),
        "mcpToolCalls": F.when(line % 3 == 0, F.lit(1)).when(line % 3 == 1, F.lit(0)),
        "steps": line + 1,
        "inputTokens": F.when(line != 6, asked),
        "outputTokens": qty - asked,
        "totalTokens": F.when(line != 6, qty),
        "cachedInputTokens": F.floor(qty / 4),
        "reservedTokens": qty + 10,
    }
    counters = F.struct(*[values.get(c, F.lit(None)).cast("double").alias(c) for c in schemas.COUNTERS])
    usage = F.struct(
        asked.alias("inputTokens"), (qty - asked).alias("outputTokens"),
        F.when(line != 5, qty).alias("totalTokens"), F.floor(qty / 4).cast("double").alias("cachedInputTokens"),
        F.lit(None).cast("double").alias("cacheReadInputTokens"),
        (F.col("l_partkey") % 7).cast("double").alias("reasoningTokens"),
    )
    key = F.col("trialId")
    return li.select(
        key,
        log_order().alias("seq"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(~failed, F.repeat(phrase, line * 2)).alias("response"),
        F.when(failed, F.lit("returned")).alias("errorMessage"),
        F.when(F.col("l_linestatus") == "F", _text("traces/executions/", key, ".json")).alias("traceRef"),
        F.struct(
            F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startedAt"),
            F.lit(None).cast("string").alias("finishedAt"),
            (price + line).alias("durationMs"),
        ).alias("timing"),
        usage.alias("usage"),
        counters.alias("metricsSummary"),
        *(["experimentId"] if experiments else []),
    )


def responses(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """The response log with the dimensions of its trial; ``li`` are lines read before."""
    return fill_from_trials(response_log(spark, sf_dir, li=li), trials(spark, sf_dir).drop("seq"))


def latest_responses(spark: SparkSession, sf_dir: str, text: bool = True, li: DataFrame | None = None) -> DataFrame:
    """The latest response of each trial with what a run shows of its dimensions. Lines are reduced before they meet
    their trials, and again after it, as a trial may be planned twice."""
    log = response_log(spark, sf_dir, li=li)
    last = latest(log if text else measure_answers(log), ["trialId"])
    filled = fill_from_trials(last, trials(spark, sf_dir).drop("seq"))
    return latest_of(filled, ["trialId"], [c for c in RESPONSE_COLUMNS if c in filled.columns])


def votes(spark: SparkSession, sf_dir: str, experiments: bool = False, li: DataFrame | None = None) -> DataFrame:
    """Every line as a vote; ``li`` are lines read before."""
    li = lines(spark, sf_dir, experiments) if li is None else li
    line = F.col("l_linenumber")

    def graded(c: str, good: float, fair: float) -> Column:
        return F.when(F.col(c) < good, F.lit("meets")).when(F.col(c) < fair, F.lit("partial")).otherwise(F.lit("misses"))

    def criterion(rating: Column) -> Column:
        return F.struct(rating.alias("rating"), _text("line ", line).alias("justification"))

    told = (F.col("l_partkey") % 100).cast("double")
    said = F.when(line != 5, (F.col("l_suppkey") % 10).cast("double"))
    return li.select(
        "trialId",
        log_order().alias("seq"),
        _text("judge", F.col("l_suppkey") % 3).alias("judgeId"),
        _text("jp", F.col("l_suppkey") % 2).alias("provider"),
        _text("jm", F.col("l_suppkey") % 3).alias("model"),
        F.when(line == 6, F.lit("error")).alias("status"),
        F.when(line == 6, F.lit("timeout")).alias("error"),
        F.struct(
            criterion(graded("l_discount", 0.035, 0.065)).alias("correctness"),
            criterion(graded("l_tax", 0.025, 0.055)).alias("completeness"),
        ).alias("criterias"),
        told.alias("inputTokens"),
        said.alias("outputTokens"),
        (told + said).alias("totalTokens"),
        (F.floor("l_extendedprice") % 1000).cast("double").alias("durationMs"),
        F.lit(None).cast("string").alias("traceRef"),
        *(["experimentId"] if experiments else []),
    )


def latest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(votes(spark, sf_dir), ["trialId", "judgeId"])


def evals(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """One evaluation per trial whose latest response succeeded; ``li`` are lines read before."""
    answered = last_rows(
        response_log(spark, sf_dir, li=li).select("trialId", "seq", "status", "metricsSummary.reservedTokens"), ["trialId"]
    ).where("status = 'success'").select("trialId", (F.col("reservedTokens") - 10).alias("qty"))
    ratings = F.struct(*[
        F.when(F.col(f"criterias.{c}").isNotNull(), F.struct(F.col(f"criterias.{c}.rating").alias("rating"))).alias(c)
        for c in vote_ops.CRITERIA
    ])
    last = latest_of(
        votes(spark, sf_dir, li=li).withColumn("criterias", ratings), ["trialId", "judgeId"],
        ["error", "criterias", "inputTokens", "outputTokens", "durationMs"],
    )
    t = trials(spark, sf_dir).drop("seq")
    rows = (
        t.join(answered, "trialId", "inner")
        .join(vote_ops.outcome(last), "trialId", "left")
        .join(vote_ops.judge_counts(last), "trialId", "left")
    )
    method = F.col("validationType")
    judged = method == fixed.JUDGE_METHOD
    key = F.col("trialId").cast("long")

    def criterion(c: str) -> Column:
        return F.struct(F.col(f"{c}_rating").alias("rating"), F.col(f"{c}_agreement").cast("variant").alias("agreement"))

    scored = F.col("qty") / 64.0
    return rows.select(
        "trialId", "experimentId", "dataset", "instanceId", "taskId", "repeatIndex", "strategy", "representation",
        "surface", "configurationId", "metadata",
        facts_ops.eval_status(key % 50 == 0, method, F.col("judge_count"), F.col("judge_error_count")).alias("status"),
        method.alias("evaluationMethod"),
        F.when(judged, F.coalesce("judge_count", F.lit(0))).cast("double").alias("judgeCount"),
        F.when(judged, F.coalesce("judge_error_count", F.lit(0))).cast("double").alias("judgeErrorCount"),
        F.when(
            judged & F.col("correctness_rating").isNotNull(),
            F.struct(criterion("correctness").alias("correctness"), criterion("completeness").alias("completeness")),
        ).alias("outcome"),
        F.when(judged, F.col("evaluation_input_tokens")).alias("evaluationInputTokens"),
        F.when(judged, F.col("evaluation_output_tokens")).alias("evaluationOutputTokens"),
        F.when(judged, facts_ops.eval_tokens()).alias("evaluationTotalTokens"),
        F.when(judged, F.col("evaluation_duration_ms")).alias("evaluationDurationMs"),
        "contextBlocks",
        F.when(key % 4 == 0, _text("traces/evals/", F.col("trialId"), ".json")).alias("traceRef"),
        F.when(
            ~judged,
            F.struct(
                F.struct((F.col("qty") >= 25).alias("passed"), F.lit(None).cast("string").alias("reason")).alias("outcome"),
                F.struct(
                    F.lit(0.8).alias("threshold"), F.lit(None).cast("string").alias("bestTarget"),
                    scored.alias("bestSimilarScore"), (F.col("qty") >= 25).alias("passed"),
                ).alias("repoqa"),
            ),
        ).alias("details"),
        F.lit(0).alias("seq"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace document per order, null for every fifth; every third is not nested below ``trace``."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = lambda c: F.lower(F.substring(c, 3, 20))
    call = lambda label, tool, args: F.struct(tool.alias(label), args.alias("arguments"))
    args = F.struct((k % 10).alias("page"), F.col("o_orderstatus").alias("state"))
    prefixed = F.concat(F.lit(fixed.TOOL_NAME_PREFIX), name("o_orderpriority"))
    tool_calls = F.when(k % 2 == 0, F.array(call("name", prefixed, args), call("name", prefixed, args)))
    visible = F.when(k % 3 == 0, F.array(call("toolName", name("o_orderpriority"), args)))
    native = F.when(
        visible.isNotNull(),
        F.struct(visible.alias("visibleToolCalls"), F.when(k % 6 == 0, F.lit(4)).alias("visibleToolCallCount")),
    )
    server = F.when(k % 7 < 3, F.array(call("toolName", F.lit("lookup"), F.struct((k % 4).alias("id")))))
    event = F.struct(
        F.lit("mcp.tool_call").alias("type"), F.lit("mcp.tool_call").alias("name"),
        F.struct(F.lit("fetch").alias("toolName"), F.struct((k % 3).alias("n")).alias("arguments")).alias("metadata"),
    )
    other = F.struct(
        F.lit("model.generate").alias("type"), F.lit("model.generate").alias("name"),
        F.struct(F.lit(None).cast("string").alias("toolName"), F.struct((k % 3).alias("n")).alias("arguments"))
        .alias("metadata"),
    )
    ai = F.struct(F.when(k % 4 == 1, F.array(other, event)).otherwise(F.array(other)).alias("events"))
    body = F.struct(
        tool_calls.alias("toolCalls"), native.alias("nativeMcp"), server.alias("serverMcp"), ai.alias("aiTrace"),
        F.when(k % 11 == 0, F.lit("boom")).alias("error"),
    )
    text = F.when(k % 3 == 1, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("trace"))))
    return o.select(k.cast("string").alias("trialId"), F.lit("executions").alias("kind"), F.when(k % 5 != 0, F.try_parse_json(text)).alias("body"))


def facts(spark: SparkSession, sf_dir: str, with_traces: bool = True) -> DataFrame:
    li = lines_by_trial(spark, sf_dir)
    return facts_ops.build_trial_facts(
        trials(spark, sf_dir).drop("seq"),
        response_log(spark, sf_dir, li=li),
        evals(spark, sf_dir, li),
        votes(spark, sf_dir, li=li),
        execution_traces=traces(spark, sf_dir) if with_traces else None,
    )
