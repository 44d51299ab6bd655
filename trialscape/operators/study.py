"""Study tables over runs and votes (AGG-16..32, AGG-36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import pct, per_100k, safe_div
from trialscape.functions.stats import null_safe_join, with_quantiles

RUN_COLUMNS = [
    "has_eval", "status_answer", "answer_tokens_cost", "evaluation_tokens_corrected", "total_cost_tokens_corrected",
    "answer_duration_ms", "evaluation_duration_reported_ms", "total_duration_reported_ms", "strict_majority_meet",
    "collapsed_majority_accuracy", "full_consensus", "full_unanimous_meet", "correctness_consensus",
    "completeness_consensus", "correctness_unanimous_meet", "completeness_unanimous_meet",
    "no_majority_any_criterion", "wasted_tokens_no_full_meet", "toolCalls", "mcpToolCalls", "functionCalls", "modelCalls",
]

# The eleven groupings of the study; the tag groupings run on exploded tags.
RUN_GROUPINGS = {
    "overall": [],
    "strategy": ["strategy"],
    "configuration": ["configurationId"],
    "model": ["modelId"],
    "model_configuration": ["modelId", "configurationId"],
    "task": ["taskId"],
    "task_configuration": ["taskId", "configurationId"],
    "representation_configuration": ["representation", "configurationId"],
}
TAG_GROUPINGS = {
    "category": ["category"],
    "category_configuration": ["category", "configurationId"],
    "model_category": ["modelId", "category"],
}


def explode_groupings(df: DataFrame, groupings: dict[str, list[str]], payload: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows once per grouping, with the columns outside a grouping set to null, so that one
    aggregation answers all of them. Returns the rows and the group columns."""
    columns = list(dict.fromkeys(c for g in groupings.values() for c in g))
    types = {f.name: f.dataType for f in df.schema.fields}
    sets = F.array(
        *[
            F.struct(
                F.lit(name).alias("grouping"),
                *[(F.col(c) if c in g else F.lit(None).cast(types[c])).alias(c) for c in columns],
            )
            for name, g in groupings.items()
        ]
    )
    rows = df.select(*payload, F.explode(sets).alias("__g")).select("__g.*", *payload)
    return rows, ["grouping", *columns]


def summarize_runs(runs: DataFrame, gb: list[str], accuracy: int | None = None, percentiles: bool = True) -> DataFrame:
    """AGG-16: cost, duration, quality and waste per group. All but ``runs``, ``evaluated`` and
    ``answer_errors`` look at evaluated runs only. Reports that show no percentile leave them out."""
    ev = F.col("has_eval")
    e = lambda c: F.when(ev, F.col(c))
    n = F.count_if(ev)
    total = lambda c: F.coalesce(F.sum(e(c)), F.lit(0.0))
    flags = lambda c: F.count_if(ev & F.col(c))
    acc = lambda v: F.count_if(ev & (F.col("collapsed_majority_accuracy") == v))
    answer, judged, cost = total("answer_tokens_cost"), total("evaluation_tokens_corrected"), total("total_cost_tokens_corrected")
    strict, full, wasted = flags("strict_majority_meet"), flags("full_unanimous_meet"), total("wasted_tokens_no_full_meet")
    columns = {
        "runs": F.count(F.lit(1)),
        "evaluated": n,
        "answer_errors": F.count_if(~F.col("status_answer").eqNullSafe("success")),
        "answer_tokens_sum": answer,
        "evaluation_tokens_corrected_sum": judged,
        "total_cost_tokens_corrected_sum": cost,
        "answer_tokens_avg": F.avg(e("answer_tokens_cost")),
        "evaluation_tokens_corrected_avg": F.avg(e("evaluation_tokens_corrected")),
        "total_cost_tokens_corrected_avg": F.avg(e("total_cost_tokens_corrected")),
        "eval_share_of_total_cost_pct": pct(judged, cost),
        "answer_duration_ms_avg": F.avg(e("answer_duration_ms")),
        "evaluation_duration_reported_ms_avg": F.avg(e("evaluation_duration_reported_ms")),
        "total_duration_reported_ms_avg": F.avg(e("total_duration_reported_ms")),
        "strict_majority_meet_count": strict,
        "strict_majority_meet_rate_pct": pct(strict, n),
        **{f"collapsed_majority_{v}_pct": pct(acc(v), n) for v in (*fixed.RATINGS, "no_majority")},
        "full_consensus_count": flags("full_consensus"),
        "full_consensus_rate_pct": pct(flags("full_consensus"), n),
        "full_unanimous_meet_count": full,
        "full_unanimous_meet_rate_pct": pct(full, n),
        "correctness_consensus_rate_pct": pct(flags("correctness_consensus"), n),
        "completeness_consensus_rate_pct": pct(flags("completeness_consensus"), n),
        "correctness_unanimous_meet_rate_pct": pct(flags("correctness_unanimous_meet"), n),
        "completeness_unanimous_meet_rate_pct": pct(flags("completeness_unanimous_meet"), n),
        "no_majority_any_criterion_count": flags("no_majority_any_criterion"),
        "no_majority_any_criterion_pct": pct(flags("no_majority_any_criterion"), n),
        "tokens_per_strict_majority_meet": safe_div(cost, strict),
        "tokens_per_full_unanimous_meet": safe_div(cost, full),
        "strict_majority_meets_per_100k_tokens": per_100k(strict, cost),
        "full_unanimous_meets_per_100k_tokens": per_100k(full, cost),
        "wasted_tokens_no_full_meet": wasted,
        "wasted_tokens_no_full_meet_pct": pct(wasted, cost),
        "toolCalls_avg_reported": F.avg(e("toolCalls")),
        "mcpToolCalls_avg_reported": F.avg(e("mcpToolCalls")),
        "functionCalls_avg_reported": F.avg(e("functionCalls")),
        "modelCalls_avg": F.avg(e("modelCalls")),
    }
    table = runs.groupBy(*gb).agg(*[c.alias(k) for k, c in columns.items()])
    wanted = {
        "answer_tokens_median": ("answer_tokens_cost", 50),
        "total_cost_tokens_corrected_median": ("total_cost_tokens_corrected", 50),
        "answer_tokens_p95": ("answer_tokens_cost", 95),
        "total_cost_tokens_corrected_p95": ("total_cost_tokens_corrected", 95),
        "answer_duration_ms_median": ("answer_duration_ms", 50),
        "answer_duration_ms_p95": ("answer_duration_ms", 95),
    }
    if not percentiles:
        return table
    return with_quantiles(table, runs.where(ev), gb, wanted, 1, accuracy)


def summaries(runs: DataFrame, runs_tags: DataFrame, accuracy: int | None = None) -> DataFrame:
    """AGG-17: AGG-16 for eleven groupings, told apart by ``grouping``: one pass over the runs and
    one over the exploded tags."""
    by_run, run_keys = explode_groupings(runs, RUN_GROUPINGS, RUN_COLUMNS)
    by_tag, tag_keys = explode_groupings(runs_tags, TAG_GROUPINGS, RUN_COLUMNS)
    return summarize_runs(by_run, run_keys, accuracy).unionByName(
        summarize_runs(by_tag, tag_keys, accuracy), allowMissingColumns=True
    )


def grouping(table: DataFrame, name: str) -> DataFrame:
    """The rows of one grouping, with its own key columns only."""
    keys = {**RUN_GROUPINGS, **TAG_GROUPINGS}[name]
    others = {c for g in (*RUN_GROUPINGS.values(), *TAG_GROUPINGS.values()) for c in g} - set(keys)
    return table.where(F.col("grouping") == name).drop("grouping", *others)


def judge_cost(votes: DataFrame) -> DataFrame:
    """AGG-18."""
    return votes.groupBy("judgeId", "provider", "model").agg(
        F.count("trialId").alias("vote_rows"),
        F.count_distinct("trialId").alias("run_count"),
        F.coalesce(F.sum("inputTokens"), F.lit(0.0)).alias("input_tokens_sum"),
        F.coalesce(F.sum("outputTokens"), F.lit(0.0)).alias("output_tokens_sum"),
        F.coalesce(F.sum("totalTokens"), F.lit(0.0)).alias("total_tokens_sum"),
        F.avg("totalTokens").alias("avg_total_tokens_per_vote"),
        F.avg("durationMs").alias("avg_duration_ms_per_vote"),
        F.count("error").alias("error_rows"),
    )


def cost_reconciliation(runs: DataFrame) -> DataFrame:
    """AGG-19."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    reported, corrected = total("evaluation_tokens_reported"), total("evaluation_tokens_corrected")
    return runs.agg(
        reported.alias("evals_reported_total_tokens_sum"),
        corrected.alias("judge_votes_corrected_total_tokens_sum"),
        (corrected - reported).alias("missing_tokens_if_using_evals_jsonl"),
        pct(reported, corrected).alias("reported_over_corrected_pct"),
        total("answer_tokens_cost").alias("answers_total_tokens_sum"),
        total("total_cost_tokens_corrected").alias("corrected_total_experiment_tokens"),
    )


def rating_columns() -> dict[str, Column]:
    """Counts, total and percentages per rating, zero where a rating is absent."""
    counts = {r: F.count_if(F.col("rating") == r) for r in fixed.RATINGS}
    total = F.count_if(F.col("rating").isin(*fixed.RATINGS))
    return {
        **counts,
        "total": total,
        **{f"{r}_pct": pct(c, total) for r, c in counts.items()},
    }


def judge_distribution(votes_long: DataFrame) -> DataFrame:
    """AGG-20."""
    return votes_long.groupBy("judgeId", "criterion").agg(*[c.alias(k) for k, c in rating_columns().items()])


def vote_patterns(consensus: DataFrame) -> DataFrame:
    """AGG-21."""
    return consensus.groupBy("criterion", "ratings_tuple").agg(F.count(F.lit(1)).alias("count"))


def agreement_summary(checked: DataFrame) -> DataFrame:
    """AGG-22."""
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.count(F.lit(1))
    majority = false("has_majority")
    return checked.agg(
        n.alias("criterion_rows"),
        F.count_if(false("outcome_agreement")).alias("outcome_agreement_true"),
        F.count_if(false("unanimous")).alias("real_unanimous_rows"),
        F.count_if("agreement_true_but_not_unanimous").alias("agreement_true_but_not_unanimous"),
        F.count_if(~majority).alias("no_majority_rows"),
        F.count_if("no_majority_but_outcome_rating_present").alias("no_majority_but_outcome_rating_present"),
        pct(F.count_if("outcome_agreement_matches_majority"), n).alias("agreement_matches_majority_pct"),
        pct(F.count_if("outcome_agreement_matches_unanimity"), n).alias("agreement_matches_unanimity_pct"),
        pct(F.count_if(majority & F.col("outcome_rating_matches_majority")), F.count_if(majority))
        .alias("rating_matches_majority_when_majority_pct"),
    )


def query_effectiveness(runs: DataFrame, gb: list[str], accuracy: int | None = None, percentiles: bool = True) -> DataFrame:
    """AGG-26: quality against response tokens only; a sum without any value is null."""
    ev = F.col("has_eval")
    tokens = F.when(ev, F.col("totalTokens_answer"))
    duration = F.when(ev, F.col("totalDurationMs_answer"))
    n = F.count_if(ev)
    total = F.sum(tokens)
    full, strict = F.count_if(ev & F.col("full_unanimous_meet")), F.count_if(ev & F.col("strict_majority_meet"))
    wasted = F.sum(F.when(ev & ~F.col("full_unanimous_meet"), F.col("totalTokens_answer")))
    table = runs.groupBy(*gb).agg(
        F.count(F.lit(1)).alias("runs"),
        n.alias("evaluated"),
        total.alias("query_tokens_sum"),
        F.avg(tokens).alias("query_tokens_mean"),
        F.avg(duration).alias("query_duration_ms_mean"),
        strict.alias("strict_majority_success_count"),
        pct(strict, n).alias("strict_majority_success_rate_pct"),
        full.alias("full_unanimous_meet_count"),
        pct(full, n).alias("full_unanimous_meet_rate_pct"),
        safe_div(total, full).alias("query_tokens_per_full_unanimous_meet"),
        per_100k(full, total).alias("full_unanimous_meets_per_100k_query_tokens"),
        wasted.alias("wasted_query_tokens_no_full_meet"),
        pct(wasted, total).alias("wasted_query_tokens_no_full_meet_pct"),
    )
    wanted = {
        "query_tokens_median": ("totalTokens_answer", 50),
        "query_tokens_p95": ("totalTokens_answer", 95),
        "query_duration_ms_median": ("totalDurationMs_answer", 50),
    }
    if not percentiles:
        return table
    return with_quantiles(table, runs.where(ev), gb, wanted, 1, accuracy)


def outcome_distribution(runs: DataFrame, by: str = "configurationId") -> DataFrame:
    """AGG-27: percent of the runs of a group per collapsed outcome, zero where absent."""
    n = F.count(F.lit(1))
    value = F.col("collapsed_majority_accuracy")
    return runs.groupBy(by).agg(
        *[pct(F.count_if(value == v), n).alias(v) for v in (*fixed.RATINGS, "no_majority")]
    )


def vote_distribution(base: DataFrame, entity: str) -> DataFrame:
    """AGG-28: rating counts and percentages, and the average tokens, per criterion and entity."""
    table = base.groupBy("criterion", entity).agg(
        *[c.alias(k) for k, c in rating_columns().items()],
        F.avg("totalTokens_answer").alias("avg_query_tokens"),
    )
    return table.withColumnRenamed("total", "total_votes")


def success_matrix(runs: DataFrame, row: str, column: str, flag: str = "full_unanimous_meet",
                   time: str = "totalDurationMs_answer") -> DataFrame:
    """AGG-29: distinct trials, success and mean time per cell."""
    return runs.where("has_eval").groupBy(row, column).agg(
        F.count_distinct("trialId").alias("runs"),
        pct(F.count_if(F.coalesce(F.col(flag), F.lit(False))), F.count(F.lit(1))).alias("success_rate_pct"),
        F.avg(time).alias("avg_time_ms"),
    )


def pivot_cells(table: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """AGG-29, AGG-32: rows x columns of one measure, columns in the given order."""
    return table.groupBy(row).pivot(column, order).agg(F.first(value, ignorenulls=True))


CATEGORY_MEASURES = {
    "majority_success": "strict_majority_meet_rate_pct",
    "unanimous_success": "full_unanimous_meet_rate_pct",
    "efficiency": "full_unanimous_meets_per_100k_tokens",
    "wasted_tokens": "wasted_tokens_no_full_meet_pct",
    "cost": "total_cost_tokens_corrected_avg",
}


def category_pivot(summary: DataFrame, measure: str, order: list[str]) -> DataFrame:
    """AGG-32."""
    return pivot_cells(summary, "category", "configurationId", CATEGORY_MEASURES[measure], order)


def box_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """AGG-31: count, quartiles, the whisker ends at 1.5 interquartile ranges and the outliers."""
    rows = df.where(F.col(value).isNotNull())
    table = rows.groupBy(*group).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )
    table = with_quantiles(table, rows, group, {"q1": (value, 25), "median": (value, 50), "q3": (value, 75)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = table.select(*group, (F.col("q1") - reach).alias("__lo"), (F.col("q3") + reach).alias("__hi"))
    inside = F.col(value).between(F.col("__lo"), F.col("__hi"))
    ends = null_safe_join(rows.select(*group, value), fences, group, "inner").groupBy(*group).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return null_safe_join(table, ends, group)


def entity_order(distribution: DataFrame, entity: str) -> DataFrame:
    """AGG-36: entities by their mean share of ``meets``, worst first."""
    return distribution.groupBy(entity).agg(F.avg("meets_pct").alias("mean_meets_pct")).orderBy("mean_meets_pct", entity)


def best_by_category(table: DataFrame) -> DataFrame:
    """JON-8, TOP-1..3: best quality, best efficiency and lowest cost configuration per category."""
    from trialscape.operators.ranking import best_per

    quality = best_per(
        table, ["category"],
        [F.desc_nulls_last("full_unanimous_meet_rate_pct"), F.desc_nulls_last("strict_majority_success_rate_pct"), "configurationId"],
    ).select(
        "category", F.col("configurationId").alias("best_quality_configuration"),
        F.col("full_unanimous_meet_rate_pct").alias("best_unanimous_success_pct"),
        F.col("strict_majority_success_rate_pct").alias("majority_success_of_best_quality_pct"),
    )
    efficiency = best_per(
        table, ["category"], [F.desc_nulls_last("full_unanimous_meets_per_100k_query_tokens"), "configurationId"]
    ).select(
        "category", F.col("configurationId").alias("best_efficiency_configuration"),
        F.col("full_unanimous_meets_per_100k_query_tokens").alias("best_unanimous_successes_per_100k_query_tokens"),
    )
    cost = best_per(table, ["category"], [F.asc_nulls_last("query_tokens_mean"), "configurationId"]).select(
        "category", F.col("configurationId").alias("lowest_cost_configuration"),
        F.col("query_tokens_mean").alias("lowest_avg_query_tokens"),
    )
    return quality.join(efficiency, "category", "full_outer").join(cost, "category", "full_outer")


def success_rate_table(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """A report table: chosen columns under new names."""
    return table.select(*[F.col(c).alias(n) for c, n in names.items()])
