"""Work that remains and rows that are matched late (JON-9, JON-11..18, JON-21, SRT-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import merge_maps
from trialscape.operators.latest import latest_of
from trialscape.operators.votes import has_error


def fill_from_trials(responses: DataFrame, trials: DataFrame) -> DataFrame:
    """JON-9: trial columns fill what a response lacks; of two maps the response wins key by key."""
    shared = [c for c in trials.columns if c in responses.columns and c != "trialId"]
    extra = [c for c in trials.columns if c not in responses.columns]
    types = {f.name: f.dataType.simpleString() for f in responses.schema.fields}
    t = trials.select("trialId", *extra, *[F.col(c).alias(f"__{c}") for c in shared])

    def merged(c: str) -> Column:
        if types[c] == "map<string,string>":
            return merge_maps(f"__{c}", c).alias(c)
        return F.coalesce(c, f"__{c}").alias(c)

    columns = [merged(c) if c in shared else F.col(c) for c in responses.columns]
    return responses.join(t, "trialId", "left").select(*columns, *extra)


def pending_trials(trials: DataFrame, responses: DataFrame, force: bool = False) -> DataFrame:
    """JON-11: trials whose latest response is not a success."""
    if force:
        return trials
    done = latest_of(responses, ["trialId"], ["status"]).where("status = 'success'")
    return trials.join(done.select("trialId"), "trialId", "left_anti")


def with_judges(rows: DataFrame, judges: DataFrame) -> DataFrame:
    """Each row once per judge. The judges of a study are a short configured list, so they travel
    inside the plan as one array value and no join is needed."""
    listed = judges.agg(F.array_sort(F.collect_set("judgeId"))).scalar()
    return rows.withColumn("judgeId", F.explode(listed))


def pending_votes(responses: DataFrame, judges: DataFrame, votes: DataFrame, evals: DataFrame | None = None,
                  force: bool = False) -> DataFrame:
    """JON-12: (trial, judge) pairs still to be judged. Trials recorded as skipped are left out, and
    a vote with status ``error`` does not count as done."""
    judged = responses.where(F.col("validationType") == fixed.JUDGE_METHOD)
    if evals is not None and not force:
        skipped = evals.where("status = 'skipped'").select("trialId").distinct()
        judged = judged.join(skipped, "trialId", "left_anti")
    pairs = with_judges(judged, judges)
    if force:
        return pairs
    done = votes.where(~F.col("status").eqNullSafe("error")).select("trialId", "judgeId").distinct()
    return pairs.join(done, ["trialId", "judgeId"], "left_anti")


def pending_groups(pairs: DataFrame) -> DataFrame:
    """JON-13: how many trials wait for each set of judges. A set is bounded by the judges."""
    per_trial = pairs.groupBy("trialId").agg(F.array_sort(F.collect_set("judgeId")).alias("judges"))
    return per_trial.groupBy(F.array_join("judges", ",").alias("missing_judges")).agg(
        F.count(F.lit(1)).alias("trials")
    )


def pending_scores(responses: DataFrame, evals: DataFrame, method: str = fixed.SCORER_METHOD,
                   force: bool = False) -> DataFrame:
    """JON-14: responses for the deterministic scorer that it has not scored."""
    rows = responses.where(F.col("validationType") == method)
    if force:
        return rows
    done = evals.where(F.col("evaluationMethod") == method).select("trialId").distinct()
    return rows.join(done, "trialId", "left_anti")


def build_evidence(responses: DataFrame, tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """JON-15: one evidence text per response from the blocks its task asks for, in task order.
    A response with a missing block leaves; see ``checks.missing_blocks``.

    The text depends on the pair (instance, task) only, so it is built once per pair and joined."""
    pairs = responses.select("instanceId", "taskId").distinct()
    need = pairs.join(tasks.select("taskId", "contextBlocks"), "taskId", "inner").select(
        "instanceId", "taskId", F.posexplode_outer("contextBlocks").alias("pos", "blockId")
    )
    text = F.when(F.col("title").isNotNull(), F.concat(F.lit("## "), "title", F.lit("\n"), F.coalesce("content", F.lit(""))))
    found = need.join(
        blocks.select("instanceId", "blockId", F.coalesce(text, F.col("content")).alias("text")),
        ["instanceId", "blockId"], "left",
    )
    built = found.groupBy("instanceId", "taskId").agg(
        F.count_if(F.col("blockId").isNotNull() & F.col("text").isNull()).alias("__missing"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("__t"),
    ).where("__missing = 0").select(
        "instanceId", "taskId", F.array_join(F.transform("__t", lambda t: t["text"]), "\n\n").alias("evidence")
    )
    return responses.join(built, ["instanceId", "taskId"], "inner")


def custom_id(trial: str = "trialId", judge: str = "judgeId") -> Column:
    """JON-16: trial and judge slug, at most 64 characters."""
    clean = F.regexp_replace(F.regexp_replace(judge, "[^a-zA-Z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")
    return F.substring(F.concat_ws("-", trial, F.coalesce(F.nullif(clean, F.lit("")), F.lit("judge"))), 1, 64)


def judge_jobs(responses: DataFrame, judges: DataFrame) -> DataFrame:
    """JON-16: one job per successful, judged response and judge."""
    eligible = responses.where((F.col("status") == "success") & (F.col("validationType") == fixed.JUDGE_METHOD))
    return with_judges(eligible, judges).withColumn("custom_id", custom_id())


def job_order(jobs: DataFrame) -> DataFrame:
    """SRT-3: jobs with the same context next to each other. Range partitioning keeps a big
    instance in several neighbouring tasks."""
    blocks = F.array_join(F.array_sort("contextBlocks"), ",")
    keys = [blocks, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                      ("instanceId", "taskId", "provider", "modelName", "trialId")]]
    return jobs.repartitionByRange(*keys).sortWithinPartitions(*keys)


def item_id(items: DataFrame) -> Column:
    """The custom id of a batch item, wherever the provider puts it."""
    first = lambda c: F.nullif(F.col(c), F.lit(""))
    names = [c for c in ("custom_id", "customId") if c in items.columns]
    cols = [first(c) for c in names]
    if "metadata" in items.columns:
        cols += [F.try_element_at("metadata", F.lit(k)) for k in ("custom_id", "customId")]
    return F.coalesce(*cols)


def match_batch(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """JON-17: batch results with their job; results of unknown jobs are dropped."""
    renamed = items.select(item_id(items).alias("__id"), F.struct(*items.columns).alias("item"))
    return jobs.join(renamed, F.col("custom_id") == F.col("__id"), "inner").drop("__id")


def repo_info(tasks: DataFrame, repos: DataFrame) -> DataFrame:
    """JON-18: native tasks with the repository of their language and name."""
    return tasks.join(repos, ["language", "repo"], "inner")


def completed_ids(*sources: DataFrame) -> DataFrame:
    """JON-21: ids known as done from any source."""
    ids = [s.select("trialId") for s in sources]
    both = ids[0]
    for s in ids[1:]:
        both = both.unionByName(s)
    return both.where("trialId IS NOT NULL").distinct()


def non_error_votes(votes: DataFrame) -> DataFrame:
    return votes.where(~has_error())
