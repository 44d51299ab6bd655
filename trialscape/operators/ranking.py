"""Windows, ranks and top-k (WIN-*, TOP-*). Ranks that need a whole group are split into buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape.functions.scalar import pct
from trialscape.functions.stats import monotone_bucket, null_safe_join, running_position


def group_share(df: DataFrame, n: str, by: list[str], name: str = "pct") -> DataFrame:
    """WIN-2: percent of the group total. The totals are aggregated and joined back, so a big
    group is not moved into one task."""
    totals = df.groupBy(*by).agg(F.sum(n).alias("__total"))
    return null_safe_join(df, totals, by).withColumn(name, pct(F.col(n), F.col("__total"))).drop("__total")


def pareto(df: DataFrame, cost: str, quality: str, tie: str) -> DataFrame:
    """WIN-3: rows that no cheaper row matches in quality. Ties: cheapest, then best, then ``tie``.

    Only the best row of each cost can be on the frontier. The running best is taken over cost
    buckets (a bounded number) first and inside each bucket second."""
    rest = [c for c in df.columns if c != cost]
    best = (
        df.where(F.col(cost).isNotNull() & F.col(quality).isNotNull())
        .groupBy(cost)
        .agg(F.min_by(F.struct(*rest), F.struct(-F.col(quality), F.col(tie))).alias("__row"))
        .select(cost, "__row.*")
        .withColumn("__b", monotone_bucket(F.col(cost).cast("double"), 64))
    )
    earlier = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    tops = best.groupBy("__b").agg(F.max(quality).alias("__top")).select("__b", F.max("__top").over(earlier).alias("__best"))
    inside = W.partitionBy("__b").orderBy(cost).rowsBetween(W.unboundedPreceding, -1)
    so_far = F.greatest(F.col("__best"), F.max(quality).over(inside))
    joined = best.join(tops, "__b", "inner").withColumn("__best", so_far)
    return joined.where(F.col("__best").isNull() | (F.col(quality) > F.col("__best"))).select(*df.columns)


def rank_in(df: DataFrame, part: list[str], order: str, tie: list[str], name: str = "rank_in_entity") -> DataFrame:
    """WIN-4: position by rising ``order`` inside each group; rows of one value go by ``tie``."""
    return running_position(df, part, [F.col(order), *[F.col(t) for t in tie]], name)


def minmax(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """WIN-5: scale to [0, 1]; a constant or empty column gives 0.5."""
    bounds = df.groupBy(*(by or [])).agg(F.min(column).alias("__min"), F.max(column).alias("__max"))
    if by:
        rows = null_safe_join(df, bounds, by)
    else:
        rows = df.withColumn("__range", bounds.select(F.struct("__min", "__max")).scalar())
        rows = rows.withColumns({c: F.col(f"__range.{c}") for c in ("__min", "__max")}).drop("__range")
    flat = F.col("__min").isNull() | (F.col("__min") == F.col("__max"))
    scaled = F.when(flat, F.lit(0.5)).otherwise(
        F.try_divide(F.col(column) - F.col("__min"), F.col("__max") - F.col("__min"))
    )
    return rows.withColumn(name, scaled).drop("__min", "__max")


def seq_cap(df: DataFrame, part: list[str], order: list[str], cap: int | None = None, name: str = "sequence") -> DataFrame:
    """WIN-7: running number per group, at most ``cap`` of each. With a cap Spark drops surplus rows
    before the shuffle; without one the group is numbered range by range."""
    columns = [F.col(c) for c in order]
    if cap is None:
        return running_position(df, part, columns, name)
    number = F.row_number().over(W.partitionBy(*part).orderBy(*columns))
    return df.withColumn(name, number).where(F.col(name) <= cap)


def position_ratio(index: str, count: str) -> Column:
    """WIN-8."""
    return (F.col(index) + 0.5) / F.greatest(F.lit(1), F.col(count))


def top_k(df: DataFrame, part: list[str], order: list[Column | str], k: int, min_rate: tuple[str, float] | None = None) -> DataFrame:
    """TOP-4, TOP-5: first ``k`` rows per group after a minimum-rate filter."""
    rows = df if min_rate is None else df.where(F.col(min_rate[0]) >= min_rate[1])
    number = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    return rows.withColumn("__k", number).where(F.col("__k") <= k).drop("__k")


def best_per(df: DataFrame, part: list[str], order: list[Column | str]) -> DataFrame:
    """TOP-1..3."""
    return top_k(df, part, order, 1)


def ranked(df: DataFrame, order: list[Column | str], n: int | None = None) -> DataFrame:
    """TOP-6: a report in order, or its first ``n`` rows."""
    rows = df.orderBy(*order)
    return rows if n is None else rows.limit(n)
