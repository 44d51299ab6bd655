"""Progress of a study (AGG-10..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import variant_bool01
from trialscape.operators.latest import latest_of
from trialscape.operators.votes import judge_status

DIMENSIONS = {
    "configuration": "configurationId",
    "representation": "representation",
    "surface": "surface",
    "strategy": "strategy",
    "model": "modelId",
    "instance": "instanceId",
    "task": "taskId",
}


def latest_status(df: DataFrame, seq: str = "seq") -> DataFrame:
    return latest_of(df, ["trialId"], ["status"], seq).withColumn("status", F.coalesce("status", F.lit("unknown")))


def tally(df: DataFrame, seq: str = "seq") -> DataFrame:
    """AGG-13: trials per latest status."""
    return latest_status(df, seq).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status(trials: DataFrame, responses: DataFrame, evals: DataFrame) -> DataFrame:
    """AGG-10: one row per phase. The evaluation phase is measured against successful responses; only
    ``evaluated`` counts as done."""
    def counts(df: DataFrame, done: str) -> DataFrame:
        return latest_status(df).agg(
            F.struct(
                F.count(F.lit(1)).alias("total"),
                F.count_if(F.col("status") == done).alias("done"),
                F.count_if(F.col("status") == "error").alias("failed"),
            ).alias("c")
        )

    totals = trials.agg(F.count(F.lit(1)).alias("planned")).withColumns(
        {"r": counts(responses, "success").scalar(), "e": counts(evals, "evaluated").scalar()}
    )
    zero = F.lit(0).cast("long")
    phases = F.array(
        F.struct(
            F.lit("execute").alias("phase"), F.col("planned").alias("total"), F.col("r.done").alias("success"),
            F.col("r.failed").alias("failed"), F.greatest(zero, F.col("planned") - F.col("r.total")).alias("pending"),
        ),
        F.struct(
            F.lit("eval").alias("phase"), F.col("r.done").alias("total"), F.col("e.done").alias("success"),
            F.col("e.failed").alias("failed"), F.greatest(zero, F.col("r.done") - F.col("e.total")).alias("pending"),
        ),
    )
    return totals.select(F.explode(phases).alias("p")).select("p.*")


def status_by(trials: DataFrame, responses: DataFrame, dimension: str) -> DataFrame:
    """AGG-11: one of seven dimensions; pending means no response at all. With ``strategy`` the pooled
    configurations are listed."""
    column = DIMENSIONS[dimension]
    joined = trials.select("trialId", column, *({"configurationId"} - {column})).join(
        latest_status(responses), "trialId", "left"
    )
    table = joined.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("label")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("pending"),
        F.array_sort(F.collect_set("configurationId")).alias("pooled"),
    )
    if dimension != "strategy":
        return table.drop("pooled")
    return table.withColumn("pooled", F.when(F.size("pooled") > 1, F.array_join("pooled", ", ")))


def status_by_judge(responses: DataFrame, votes: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """AGG-12: configured judges first, then the observed ones; pending counts the answers without a
    vote of that judge."""
    last = latest_of(
        votes.where("judgeId IS NOT NULL AND judgeId != ''"), ["trialId", "judgeId"], ["status", "error"]
    ).select("judgeId", judge_status().alias("s"))
    observed = last.groupBy("judgeId").agg(
        F.count_if(F.col("s") != "error").alias("success"), F.count_if(F.col("s") == "error").alias("failed")
    )
    if configured is None:
        table = observed.withColumn("ord", F.lit(None).cast("int"))
    else:
        table = configured.select("judgeId", "ord").join(observed, "judgeId", "full_outer")
    total = latest_status(responses).agg(F.count_if(F.col("status") == "success")).scalar()
    zero = F.lit(0).cast("long")
    return (
        table.withColumn("total", total)
        .select(
            "judgeId", "ord", "total",
            F.coalesce("success", zero).alias("success"), F.coalesce("failed", zero).alias("failed"),
        )
        .withColumn("pending", F.greatest(zero, F.col("total") - F.col("success") - F.col("failed")))
        .orderBy(F.asc_nulls_last("ord"), "judgeId")
        .drop("ord")
    )


def eval_summary(evals: DataFrame) -> DataFrame:
    """AGG-14: flattened outcome per evaluation."""
    return evals.select(
        "trialId", "taskId", "instanceId", "status", "evaluationMethod", "judgeCount", "judgeErrorCount",
        F.col("outcome.correctness.rating").alias("correctness_rating"),
        variant_bool01(F.col("outcome.correctness.agreement")).alias("correctness_agreement"),
        F.col("outcome.completeness.rating").alias("completeness_rating"),
        variant_bool01(F.col("outcome.completeness.agreement")).alias("completeness_agreement"),
    )
