"""Judge votes: long form, plurality, consensus, cost (VOT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import literal_map, sum_non_null
from trialscape.operators.latest import last_rows

CRITERIA = ("correctness", "completeness")


def has_error(error: str = "error") -> Column:
    return F.coalesce(F.length(error), F.lit(0)) > 0


def norm_rating(c: Column | str) -> Column:
    """VOT-2: known spellings of a rating; null counts as misses, unknown words stay."""
    word = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(F.try_element_at(literal_map(fixed.RATING_ALIASES), word), word, F.lit("misses"))


def votes_long(votes: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """VOT-0, JON-19: one row per vote and criterion; the configuration comes from the trial."""
    rows = votes
    if trials is not None:
        owner = trials.select("trialId", "configurationId")
        rows = rows.drop("configurationId").join(owner, "trialId", "inner")
    criteria = F.array(
        *[
            F.struct(
                F.lit(c).alias("criterion"),
                F.col(f"criterias.{c}.rating").alias("rating"),
                F.col(f"criterias.{c}.justification").alias("justification"),
            )
            for c in CRITERIA
        ]
    )
    keep = [
        c for c in ("trialId", "experimentId", "taskId", "instanceId", "configurationId", "strategy", "judgeId", "seq")
        if c in rows.columns
    ]
    renamed = {
        "provider": "provider_judge", "model": "model_judge", "status": "status_vote", "error": "error_vote",
        "inputTokens": "inputTokens_vote", "outputTokens": "outputTokens_vote",
        "totalTokens": "totalTokens_vote", "durationMs": "durationMs_vote", "traceRef": "traceRef_vote",
    }
    return rows.select(
        *keep,
        *[F.col(old).alias(new) for old, new in renamed.items() if old in rows.columns],
        F.explode(criteria).alias("__c"),
    ).select("*", "__c.*").drop("__c")


def outcome(votes: DataFrame) -> DataFrame:
    """VOT-1: plurality per trial over the votes without an error. The rating with most votes wins,
    then the better one, then a known one over an unknown one, then the alphabet. Agreement means
    more than half. Votes without any rating give (misses, agreed)."""
    criteria = F.array(
        *[
            F.struct(
                F.lit(c).alias("criterion"),
                F.when(F.col(f"criterias.{c}").isNotNull(), norm_rating(f"criterias.{c}.rating")).alias("rating"),
            )
            for c in CRITERIA
        ]
    )
    counts = (
        votes.where(~has_error())
        .select("trialId", F.explode(criteria).alias("c"))
        .groupBy("trialId", "c.criterion", "c.rating")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.coalesce(
        F.try_element_at(literal_map({r: i for i, r in enumerate(reversed(fixed.RATINGS))}), F.col("rating")),
        F.lit(-1),
    )
    order = F.struct(-F.col("n"), -rank, F.col("rating"))
    aggs = []
    for c in CRITERIA:
        mine = (F.col("criterion") == c) & F.col("rating").isNotNull()
        best = F.min_by(F.when(mine, F.col("rating")), F.when(mine, order))
        top = F.max(F.when(mine, F.col("n")))
        total = F.sum(F.when(mine, F.col("n")))
        aggs.append(F.coalesce(best, F.lit("misses")).alias(f"{c}_rating"))
        aggs.append(F.coalesce(top * 2 > total, F.lit(True)).alias(f"{c}_agreement"))
    return counts.groupBy("trialId").agg(*aggs)


def judge_counts(votes: DataFrame) -> DataFrame:
    """Per trial: judges that voted, judges that failed, and the sums their evaluation row reports."""
    failed = has_error()
    return votes.groupBy("trialId").agg(
        F.count_if(~failed).alias("judge_count"),
        F.count_if(failed).alias("judge_error_count"),
        F.sum("inputTokens").alias("evaluation_input_tokens"),
        F.sum("outputTokens").alias("evaluation_output_tokens"),
        F.sum("durationMs").alias("evaluation_duration_ms"),
    )


def expected_judges(configured: DataFrame | None, votes: DataFrame) -> DataFrame:
    """VOT-6: judges of the manifest and judges seen in votes."""
    seen = votes.select("judgeId")
    both = seen if configured is None else configured.select("judgeId").unionByName(seen)
    return both.where("judgeId IS NOT NULL").distinct()


def vote_consensus(long: DataFrame, expected: DataFrame | int, judges: list[str] | None = None,
                   seq: str = "seq") -> DataFrame:
    """VOT-3, VOT-4: consensus per trial and criterion over the last rating of each judge.

    ``expected`` is the table of judges (or their number). ``judges`` adds one column each.
    The list built per group is bounded by the number of judges."""
    total = F.lit(expected) if isinstance(expected, int) else expected.agg(F.count_distinct("judgeId")).scalar()
    last = last_rows(long.select("trialId", "criterion", "judgeId", "rating", seq), ["trialId", "criterion", "judgeId"], seq)
    known = F.col("judgeId").isNotNull()
    pair = F.when(known & F.col("rating").isNotNull(), F.struct("judgeId", "rating"))
    grouped = last.groupBy("trialId", "criterion").agg(
        F.count_if(known).alias("n_votes"), F.array_sort(F.collect_list(pair)).alias("__p")
    )
    ratings = F.transform("__p", lambda p: p["rating"])
    counted = grouped.withColumn("__r", ratings).withColumn("__u", F.array_distinct("__r")).withColumn(
        "__c", F.transform("__u", lambda u: F.size(F.filter("__r", lambda r: r == u)))
    ).withColumn("__total", total.cast("long"))
    top_count = F.coalesce(F.array_max("__c"), F.lit(0)).cast("long")
    top_rating = F.try_element_at("__u", F.array_position("__c", F.array_max("__c")).cast("int"))
    majority = (F.col("__total") > 0) & (top_count * 2 > F.col("__total"))
    all_voted = (F.col("n_votes") == F.col("__total")) & (F.col("__total") > 0)
    unanimous = all_voted & (F.size("__u") == 1)
    columns = [
        F.col("n_votes"),
        all_voted.alias("has_all_expected_votes"),
        F.array_join("__r", "|").alias("ratings_tuple"),
        F.size("__u").cast("long").alias("unique_rating_count"),
        majority.alias("has_majority"),
        F.when(majority, top_rating).alias("majority_rating"),
        top_count.alias("majority_count"),
        unanimous.alias("unanimous"),
        F.when(unanimous, top_rating).alias("unanimous_rating"),
        (unanimous & (top_rating == "meets")).alias("unanimous_meet"),
        (unanimous & (top_rating == "partial")).alias("unanimous_partial"),
        (unanimous & (top_rating == "misses")).alias("unanimous_misses"),
        (~majority).alias("no_majority"),
    ]
    by_judge = F.map_from_entries("__p")
    for judge in judges or []:
        columns.append(F.try_element_at(by_judge, F.lit(judge)).alias(f"{judge}_rating"))
    return counted.select("trialId", "criterion", *columns)


def vote_wide(consensus: DataFrame) -> DataFrame:
    """VOT-5: one row per trial, columns ``<criterion>_<metric>``."""
    metrics = [c for c in consensus.columns if c not in ("trialId", "criterion")]
    return consensus.groupBy("trialId").agg(
        *[
            F.max(F.when(F.col("criterion") == c, F.col(m))).alias(f"{c}_{m}")
            for c in CRITERIA
            for m in metrics
        ]
    )


def vote_cost(votes: DataFrame) -> DataFrame:
    """VOT-7: over all rows of the vote log; an empty sum is 0."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return votes.groupBy("trialId").agg(
        total("inputTokens").alias("evaluationInputTokens_votes"),
        total("outputTokens").alias("evaluationOutputTokens_votes"),
        total("totalTokens").alias("evaluationTotalTokens_votes"),
        total("durationMs").alias("evaluationDurationMs_votes_sum"),
        F.count("trialId").alias("judge_vote_rows"),
        F.count("error").alias("judge_vote_errors"),
    )


def judge_info(votes: DataFrame) -> DataFrame:
    """VOT-8: token and time sums per trial; provider and model only when all votes share one."""
    def single(c: str) -> Column:
        value = F.nullif(F.col(c), F.lit(""))
        return F.when(F.min(value) == F.max(value), F.min(value))

    return votes.groupBy("trialId").agg(
        single("provider").alias("provider"),
        single("model").alias("model"),
        F.sum("inputTokens").alias("inputTokens"),
        F.sum("outputTokens").alias("outputTokens"),
        F.sum("durationMs").alias("durationMs"),
    )


def consensus_flags(runs: DataFrame) -> DataFrame:
    """VOT-9: run-level flags from the wide consensus columns; a missing consensus is false."""
    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    def meets(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_majority_rating") == "meets", F.lit(False))

    rows = runs.withColumns(
        {
            **{f"majority_{c}_meet": meets(c) for c in CRITERIA},
            **{f"{c}_unanimous_meet": flag(f"{c}_unanimous_meet") for c in CRITERIA},
            **{f"{c}_consensus": flag(f"{c}_unanimous") for c in CRITERIA},
            **{f"{c}_has_majority": flag(f"{c}_has_majority") for c in CRITERIA},
        }
    )

    def both(pattern: str) -> Column:
        return F.col(pattern.format("correctness")) & F.col(pattern.format("completeness"))

    return rows.withColumns(
        {
            "strict_majority_meet": both("majority_{}_meet"),
            "full_unanimous_meet": both("{}_unanimous_meet"),
            "full_consensus": both("{}_consensus"),
            "has_majority_both_criteria": both("{}_has_majority"),
            "no_majority_any_criterion": ~both("{}_has_majority"),
        }
    )


def collapsed(correctness: str = "correctness_majority_rating", completeness: str = "completeness_majority_rating") -> Column:
    """VOT-10."""
    pair = F.array(F.coalesce(correctness, F.lit("")), F.coalesce(completeness, F.lit("")))
    return (
        F.when(F.array_contains(pair, "misses"), F.lit("misses"))
        .when(F.array_contains(pair, "partial"), F.lit("partial"))
        .when((F.col(correctness) == "meets") & (F.col(completeness) == "meets"), F.lit("meets"))
        .otherwise(F.lit("no_majority"))
    )


def evals_long(evals: DataFrame) -> DataFrame:
    """RSH-6: one row per evaluation and criterion, from the flat evaluation columns."""
    criteria = F.array(
        *[
            F.struct(
                F.lit(c).alias("criterion"),
                F.col(f"{c}_outcome_rating").alias("outcome_rating"),
                F.col(f"{c}_outcome_agreement").alias("outcome_agreement"),
            )
            for c in CRITERIA
        ]
    )
    return evals.select("trialId", "taskId", "instanceId", F.explode(criteria).alias("c")).select(
        "trialId", "taskId", "instanceId", "c.*"
    )


def agreement_check(long: DataFrame, consensus: DataFrame) -> DataFrame:
    """JON-4, VOT-11: stored outcomes next to the recomputed consensus, with five flags. A
    comparison with a missing side is false."""
    def false(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    agreed = F.col("outcome_agreement")
    return long.join(consensus, ["trialId", "criterion"], "left").withColumns(
        {
            "outcome_agreement_matches_majority": false(agreed == F.col("has_majority")),
            "outcome_agreement_matches_unanimity": false(agreed == F.col("unanimous")),
            "outcome_rating_matches_majority": false(F.col("outcome_rating") == F.col("majority_rating")),
            "agreement_true_but_not_unanimous": false(agreed) & ~false(F.col("unanimous")),
            "no_majority_but_outcome_rating_present":
                ~false(F.col("has_majority")) & F.col("outcome_rating").isNotNull(),
        }
    )


def judge_status() -> Column:
    """VOT-12: the explicit status, else error or evaluated."""
    explicit = F.nullif(F.trim("status"), F.lit(""))
    return F.coalesce(explicit, F.when(has_error(), F.lit("error")).otherwise(F.lit("evaluated")))


def vote_tokens() -> Column:
    """VOT-13: input plus output tokens, null when both are missing."""
    return sum_non_null("inputTokens", "outputTokens")
