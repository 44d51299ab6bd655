"""Set operations (SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.operators.latest import union_runs  # noqa: F401  SET-1


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """SET-2: distinct keys of both; those of ``first`` lead in their order (column ``ord``), the
    others follow in key order. Adds ``ord``."""
    a = first.select(key, F.lit(0).alias("__side"), F.col("ord").cast("long").alias("__ord"))
    b = second.select(key).distinct().select(key, F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__ord"))
    both = a.unionByName(b).where(F.length(key) > 0).groupBy(key).agg(F.min(F.struct("__side", "__ord")).alias("ord"))
    return both.orderBy("ord", key)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def intersect_keys(a: Column | str, b: Column | str) -> Column:
    """SET-4: members of ``a`` that are in ``b``, in the order of ``a``."""
    return F.array_intersect(a, b)


def distinct_calls(df: DataFrame) -> DataFrame:
    """SET-5: each (tool, source, arguments) of a trace once."""
    return df.dropDuplicates(["trialId", "tool_name", "tool_source", "arguments"])
