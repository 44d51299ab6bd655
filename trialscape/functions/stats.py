"""Grouped statistics that stay distributed when one group holds most of the rows (AGG-33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape.session import scratch_path


def mean(c: Column | str) -> Column:
    return F.avg(c)


def sample_stddev(c: Column | str) -> Column:
    """Null below two values."""
    return F.stddev_samp(c)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the right keys are dropped. Without keys the right side
    has one row, which the left rows take as a scalar subquery."""
    if not keys:
        row = right.select(F.struct(*right.columns).alias("__row")).scalar()
        found = left.withColumn("__row", row)
        return (found.where("__row IS NOT NULL") if how == "inner" else found).select(*left.columns, "__row.*")
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def monotone_bucket(c: Column, per_octave: int = 1024) -> Column:
    """A whole number that never falls as ``c`` grows. Rows of one huge group are spread
    over these buckets, and comparing buckets orders the rows without sorting them."""
    size = F.floor(F.log2(F.abs(c) + F.lit(1.0)) * F.lit(per_octave)).cast("long")
    return F.when(c < 0, -size).otherwise(size)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, float]],
    min_count: int = 1,
    accuracy: int | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles per group: ``{output: (column, percent)}``.

    Exact by default without holding a group in one task: equal values are counted first,
    buckets of neighbouring values are counted next, and only the buckets that contain a
    wanted rank are sorted. ``accuracy`` switches to the bounded-memory sketch instead.
    Groups with fewer than ``min_count`` values give null.
    """
    columns = sorted({c for c, _ in wanted.values()})
    if accuracy is not None:
        aggs = [
            F.when(F.count(c) >= min_count, F.percentile_approx(c, q / 100.0, accuracy)).alias(out)
            for out, (c, q) in wanted.items()
        ]
        return df.groupBy(*keys).agg(*aggs)

    numbered = {c: i for i, c in enumerate(columns)}
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v"))
                    for c, i in numbered.items()
                ]
            )
        ).alias("__x"),
    ).select(*keys, "__x.*")
    counts = (
        long.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__m", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", monotone_bucket(F.col("__v")))
    )
    series = [*keys, "__m"]
    bins = (
        counts.groupBy(*series, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .withColumn("__before", F.sum("__bn").over(W.partitionBy(*series).orderBy("__b")) - F.col("__bn"))
        .withColumn("__total", F.sum("__bn").over(W.partitionBy(*series)))
    )
    asked = F.array(
        *[
            F.struct(F.lit(i).alias("s"), F.lit(numbered[c]).alias("m"), F.lit(float(q)).alias("q"))
            for i, (c, q) in enumerate(wanted.values())
        ]
    )
    position = (F.col("__total") - 1) * F.col("__q.q") / F.lit(100.0)
    ranked = (
        bins.where(F.col("__total") >= min_count)
        .withColumn("__q", F.explode(F.filter(asked, lambda a: a["m"] == F.col("__m"))))
        .withColumn("__pos", position)
        .withColumn("__lo", F.floor("__pos"))
        .withColumn("__hi", F.ceil("__pos"))
        .withColumn("__r", F.explode(F.array_distinct(F.array("__lo", "__hi"))))
        .where((F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__bn")))
        .select(*series, "__b", "__before", F.col("__q.s").alias("__s"), "__pos", "__lo", "__hi", "__r")
    )
    targets = ranked.groupBy(*series, "__b").agg(
        F.first("__before").alias("__before"),
        F.collect_list(F.struct("__s", "__pos", "__lo", "__hi", "__r")).alias("__ranks"),
    )
    in_bin = W.partitionBy(*series, "__b").orderBy("__v")
    hits = (
        null_safe_join(counts, targets, [*series, "__b"], "inner")
        .withColumn("__end", F.col("__before") + F.sum("__n").over(in_bin))
        .withColumn("__k", F.explode("__ranks"))
        .where((F.col("__k.__r") < F.col("__end")) & (F.col("__k.__r") >= F.col("__end") - F.col("__n")))
        .select(*keys, "__v", "__k.*")
    )
    aggs = []
    for i, out in enumerate(wanted):
        mine = F.col("__s") == i
        low = F.max(F.when(mine & (F.col("__r") == F.col("__lo")), F.col("__v")))
        high = F.max(F.when(mine & (F.col("__r") == F.col("__hi")), F.col("__v")))
        part = F.max(F.when(mine, F.col("__pos") - F.col("__lo")))
        aggs.append((low + (high - low) * part).alias(out))
    return hits.groupBy(*keys).agg(*aggs)


def with_quantiles(
    agg: DataFrame,
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, float]],
    min_count: int = 1,
    accuracy: int | None = None,
) -> DataFrame:
    """Attach :func:`group_quantiles` of ``df`` to an aggregate of the same grouping."""
    return null_safe_join(agg, group_quantiles(df, keys, wanted, min_count, accuracy), keys)


def running_position(df: DataFrame, part: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position of each row in its group (null keys are a group).

    Rows are dealt into ranges of (group, order) and sorted there, so that a group, also one whose rows
    agree in the leading columns of ``order``, fills as many tasks as its share of the table. The sorted
    ranges are written once, as their borders come from a sample. A row's number in its range is shifted
    by the rows of its group in earlier ranges: one row per range and group is added up. Rows that tie
    in all of ``order`` are numbered in any order."""
    at, first, many, shift, held = (f"__{x}_{name}" for x in ("at", "first", "many", "shift", "range"))
    path = scratch_path(df.sparkSession, "ranges")
    sorting = [*[F.col(f"`{p}`") for p in part], *order]
    ranges = df.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    ranges.withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    # the upper 31 bits of an id are the number of its task, tasks are numbered in the order of the ranges
    placed = df.sparkSession.read.parquet(path).withColumn(held, F.shiftright(at, 33))
    sizes = placed.groupBy(*part, held).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(many))
    earlier = W.partitionBy(*part).orderBy(held).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(many).over(earlier), F.lit(0))
    shifts = sizes.select(*part, held, (before - F.col(first) + 1).alias(shift))
    return null_safe_join(placed, shifts, [*part, held]).withColumn(name, F.col(at) + F.col(shift)).drop(at, held, shift)


def running_sum(df: DataFrame, part: list[str], position: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to each row, by a whole-numbered ``position`` without
    repeats: rows are summed in blocks of positions and shifted by the sum of earlier blocks."""
    held, total, shift = (f"__{x}_{name}" for x in ("block", "total", "shift"))
    rows = df.withColumn(held, F.floor(F.col(position) / block))
    earlier = W.partitionBy(*part).orderBy(held).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*part, held).agg(F.sum(value).alias(total))
    shifts = totals.select(*part, held, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(shift))
    inside = W.partitionBy(*part, held).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = null_safe_join(rows.withColumn(name, F.sum(value).over(inside)), shifts, [*part, held])
    return summed.withColumn(name, F.col(name) + F.col(shift)).drop(held, shift)
