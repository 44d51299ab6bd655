"""Last-write-wins over append logs (LST-*).

The newest row per key is an aggregate (``max_by``), not a window: rows of a key that fills a
third of the log are reduced before the shuffle and never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """LST-1, LST-2: the last row per key by ``seq``. The first key must not be null or empty;
    further keys treat null and '' as a value of their own."""
    payload = [c for c in df.columns if c not in keys]
    return (
        df.where(F.col(keys[0]).isNotNull() & (F.col(keys[0]).cast("string") != ""))
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.col(seq)).alias("__row"))
        .select(*keys, "__row.*")
    )


def last_rows(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """As :func:`latest`, for wide rows of which a later step shows a few columns: only these travel, and ``seq``
    travels once, as the rows stay columns. Spark's group limit keeps one row per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    known = df.where(F.col(keys[0]).isNotNull() & (F.col(keys[0]).cast("string") != ""))
    return known.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def latest_of(df: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """As :func:`latest`, but only some columns travel, and ``seq`` not twice."""
    payload = [c for c in dict.fromkeys(columns) if c not in keys]
    return (
        df.where(F.col(keys[0]).isNotNull() & (F.col(keys[0]).cast("string") != ""))
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.col(seq)).alias("__row"))
        .select(*keys, "__row.*")
    )


def compact(df: DataFrame, keys: list[str], path: str, seq: str = "seq", fmt: str = "json") -> None:
    """LST-3: rewrite a log to a new path with the last row per key."""
    latest(df, keys, seq).drop(seq).write.format(fmt).save(path)


def votes_in_order(votes: DataFrame, seq: str = "seq") -> DataFrame:
    """LST-4: all votes, those of a trial next to each other and in order. A trial with very many
    votes spans several partitions; nothing is collected."""
    return (
        votes.where("trialId IS NOT NULL AND trialId != ''")
        .repartitionByRange(F.col("trialId"), F.col(seq))
        .sortWithinPartitions("trialId", seq)
    )


def first_vote(votes: DataFrame, seq: str = "seq") -> DataFrame:
    """LST-5: the first vote without an error, else the first vote."""
    payload = [c for c in votes.columns if c != "trialId"]
    failed = F.coalesce(F.length("error"), F.lit(0)) > 0
    return (
        votes.where("trialId IS NOT NULL AND trialId != ''")
        .groupBy("trialId")
        .agg(F.min_by(F.struct(*payload), F.struct(failed.alias("f"), F.col(seq).alias("s"))).alias("__row"))
        .select("trialId", "__row.*")
    )


def dedup_judges(votes_long: DataFrame, seq: str = "seq") -> DataFrame:
    """LST-6: the last rating of each judge per trial and criterion; votes without a judge leave."""
    return latest(votes_long.where("judgeId IS NOT NULL"), ["trialId", "criterion", "judgeId"], seq)


def merge_votes(new: DataFrame, old: DataFrame) -> DataFrame:
    """LST-7: the new votes plus the old votes of judges that are not among them, for the trials
    that were evaluated again."""
    again = old.join(new.select("trialId").distinct(), "trialId", "left_semi")
    kept = again.join(new.select("trialId", "judgeId").distinct(), ["trialId", "judgeId"], "left_anti")
    return new.unionByName(kept.select(*new.columns))


def merge_outcomes(evals: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """LST-7: evaluations with the outcome of the merged votes. It is recomputed for the trials that got votes of
    further judges from the old log and have a vote without an error; others keep their own."""
    from trialscape.operators.votes import CRITERIA, outcome

    merged = merge_votes(new, old)
    added = merged.join(new.select("trialId", "judgeId"), ["trialId", "judgeId"], "left_anti").select("trialId").distinct()
    fresh = outcome(merged.join(added, "trialId", "left_semi"))
    agreement = {c: F.col(f"{c}_agreement").cast("variant").alias("agreement") for c in CRITERIA}
    found = F.struct(*[F.struct(F.col(f"{c}_rating").alias("rating"), agreement[c]).alias(c) for c in CRITERIA])
    again = fresh.select("trialId", found.alias("__outcome"))
    columns = [F.coalesce("__outcome", "outcome").alias(c) if c == "outcome" else c for c in evals.columns]
    return evals.join(again, "trialId", "left").select(*columns)


def task_meta(trials: DataFrame, seq: str = "seq") -> DataFrame:
    """LST-8: task metadata, taken from the last trial of each task."""
    columns = ["taskStatement", "taskTags", "contextBlocks", "validationType"]
    rows = trials.where("taskId IS NOT NULL").select("taskId", *columns, seq)
    return latest(rows, ["taskId"], seq).select(
        "taskId",
        F.col("taskStatement").alias("question_text_catalog"),
        F.coalesce("taskTags", F.array().cast("array<string>")).alias("question_tags_catalog"),
        F.coalesce("contextBlocks", F.array().cast("array<string>")).alias("contextBlocks_catalog"),
        F.col("validationType").alias("validation_type_catalog"),
    )


def upsert(df: DataFrame, new: DataFrame, key: str = "trialId") -> DataFrame:
    """LST-9: rows of the log whose id is not rewritten, plus the new rows."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """SET-1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
