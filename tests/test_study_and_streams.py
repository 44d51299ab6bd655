"""The study over a small factorial run, the plan that makes it, and streams that must equal batch."""

from pyspark.sql import functions as F

from trialscape import schemas
from trialscape.operators.latest import latest
from trialscape.plans.analysis import analysis_tables
from trialscape.plans.planning import plan_trials
from trialscape.sources.sinks import write_jsonl
from trialscape.streaming import logs
from trialscape.streaming.levels import Levels


def study_logs(spark):
    """4 models x 4 configurations x 2 tasks, 10 response tokens, 3 judges with 3 tokens each; the votes
    of the second task are split."""
    grid = [(f"m{m}-c{c}-q{q}", f"m{m}", f"c{c}", f"q{q}") for m in range(4) for c in range(4) for q in range(2)]
    base = spark.createDataFrame(grid, "trialId STRING, modelId STRING, configurationId STRING, taskId STRING")
    dims = base.select("*", F.lit("exp").alias("experimentId"), F.lit("i1").alias("instanceId"), F.lit("s").alias("strategy"), F.lit("json").alias("representation"))

    def shaped(df, kind):
        wanted = spark.createDataFrame([], schemas.ARTIFACTS[kind]).schema
        own = {f.name for f in df.schema.fields}
        return df.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], F.lit(0).alias("seq"))

    usage = F.from_json(F.lit('{"totalTokens": 10}'), schemas.USAGE)
    trials = shaped(dims.withColumn("taskTags", F.array(F.lit("a"), F.lit("b"))), "trials")
    responses = shaped(dims.withColumns({"status": F.lit("success"), "response": F.lit("one two three four five 6"), "usage": usage}), "responses")
    evals = shaped(dims.withColumn("status", F.lit("evaluated")), "evals")
    voted = base.withColumn("judgeId", F.explode(F.array(*[F.lit(f"j{i}") for i in range(3)])))
    rating = F.when((F.col("taskId") == "q1") & (F.col("judgeId") == "j0"), F.lit("misses")).otherwise(F.lit("meets"))
    one = F.struct(rating.alias("rating"), F.lit(None).cast("string").alias("justification"))
    votes = shaped(voted.withColumns({"criterias": F.struct(one.alias("correctness"), one.alias("completeness")), "totalTokens": F.lit(3.0)}), "judge_votes")
    return trials, responses, evals, votes


def test_study(spark):
    tables = analysis_tables(*study_logs(spark), [f"c{i}" for i in range(4)])
    assert len(tables) == 43
    row = tables["summary_overall"].collect()[0]
    assert (row.runs, row.evaluated, row.full_unanimous_meet_count, row.strict_majority_meet_count) == (32, 32, 16, 32)
    assert (row.total_cost_tokens_corrected_sum, row.wasted_tokens_no_full_meet_pct) == (608.0, 50.0)
    assert tables["pivot_unanimous_success_category_configuration"].collect()[0].c0 == 50.0
    assert tables["runs_tags_flat_corrected"].count() == 64


def test_plan(spark):
    tasks = spark.createDataFrame([("d", f"q{i}", "Who is {who}?", ["t"]) for i in range(2)], "datasetId STRING, taskId STRING, statement STRING, tags ARRAY<STRING>")
    instances = spark.createDataFrame([("d", "i1"), ("d", "i2"), ("d", "i3")], "datasetId STRING, instanceId STRING")
    given = spark.createDataFrame([("i1", "q0", {"who": "Ann"})], "instanceId STRING, taskId STRING, parameters MAP<STRING, STRING>")
    models = spark.createDataFrame([("p", None, "m1"), ("p", "x", "m2")], "provider STRING, modelId STRING, modelName STRING")
    cfg = spark.createDataFrame([("c1", "inline", "html", "page"), ("c2", "inline", "json", "page")], "configurationId STRING, strategy STRING, representation STRING, surface STRING")
    planned = plan_trials("e", tasks, instances, given, models, cfg, repeats=2, instance_scope=["i1", "i2"]).collect()
    assert len(planned) == 2 * 2 * 2 * 2 * 2 and len({r.trialId for r in planned}) == len(planned)
    assert {r.taskStatement for r in planned} == {"Who is Ann?", "Who is ?"} and {r.modelId for r in planned} == {"m1", "x"}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(
        (F.col("id") % 17).cast("string").alias("trialId"), F.when(F.col("id") % 4 == 0, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        (F.col("id") * 7 % 300).cast("int").alias("repeatIndex"),
    )
    write_jsonl(rows.repartition(3), str(tmp_path / "log"))
    stream = logs.stream_artifact(spark, str(tmp_path / "log"), "responses", files_per_batch=1).select("trialId", "status", "repeatIndex")
    logs.run_to_end(logs.stream_compact(stream, ["trialId"], "repeatIndex", str(tmp_path / "out"), str(tmp_path / "cp")))
    got = Levels(str(tmp_path / "out"), ["trialId"], "repeatIndex").read(spark)
    want = latest(rows, ["trialId"], "repeatIndex")
    assert sorted(map(tuple, got.select("trialId", "status", "repeatIndex").collect())) == sorted(map(tuple, want.select("trialId", "status", "repeatIndex").collect()))
    tally = logs.stream_status(logs.stream_artifact(spark, str(tmp_path / "log"), "responses", files_per_batch=1), "trialId")
    logs.run_to_end(logs.write_deltas(tally, str(tmp_path / "tally"), str(tmp_path / "cp2")))
    counted = logs.read_latest(spark, str(tmp_path / "tally"), ["label", "status"])
    assert counted.agg(F.sum("n")).collect()[0][0] == 300
