"""Behaviour of answers (TXT-1, AGG-23). Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import contains_any, norm_text, word_count

FLAGS = [
    "empty_or_near_empty", "no_information", "not_found", "tool_limitation", "uncertainty_marker", "safe_failure",
    "substantive_answer", "overconfident_failure", "has_number", "has_list_marker", "mentions_context",
]


def behavior_flags(df: DataFrame, text: str = "response", success: str = "full_unanimous_meet") -> DataFrame:
    """TXT-1. The normalised text is computed once and searched for each term list."""
    raw = F.coalesce(text, F.lit(""))
    rows = df.withColumn("__norm", norm_text(text))
    rows = rows.withColumns(
        {
            **{flag: contains_any("__norm", terms) for flag, terms in fixed.BEHAVIOUR_TERMS.items()},
            "empty_or_near_empty": word_count(text) < 5,
            "has_number": F.rlike(raw, F.lit(r"\p{Nd}")),
            "has_list_marker": F.rlike(raw, F.lit(r"(?U)(^|\n)\s*(?:[-*•]|\d+[.)])\s+")),
            "mentions_context": contains_any("__norm", fixed.CONTEXT_TERMS),
        }
    )
    evasive = F.col("no_information") | F.col("not_found")
    rows = rows.withColumns(
        {
            "safe_failure": evasive | F.col("tool_limitation") | F.col("uncertainty_marker"),
            "substantive_answer": ~F.col("empty_or_near_empty") & ~evasive,
        }
    )
    failed = ~F.coalesce(F.col(success), F.lit(False))
    confident = failed & ~F.col("safe_failure") & ~F.col("empty_or_near_empty")
    return rows.withColumn("overconfident_failure", confident).drop("__norm")


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int").cast("double")) * F.lit(100.0)


def summarize_behavior(df: DataFrame, gb: list[str], context: bool = True) -> DataFrame:
    """AGG-23: percent of each flag per group; ``context`` adds success rates and the average cost."""
    aggs = [F.count(F.lit(1)).alias("runs"), *[_rate(f).alias(f"{f}_rate_pct") for f in FLAGS]]
    if context:
        aggs += [
            _rate("full_unanimous_meet").alias("full_unanimous_meet_rate_pct"),
            _rate("strict_majority_meet").alias("strict_majority_meet_rate_pct"),
            F.avg("total_cost_tokens_corrected").alias("total_cost_tokens_corrected_avg"),
        ]
    return df.groupBy(*gb).agg(*aggs)
