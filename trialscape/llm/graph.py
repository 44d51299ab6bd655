"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.session import settle


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours are tied to the least id among them and the node itself. Edges
    point from ``u`` to a smaller ``v``."""
    if larger_only:  # neighbours of both directions, the larger ones move
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    met = near.join(least, F.col("u") == F.col("w"))
    if larger_only:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that stands in an edge (``u``, ``v``): the least id reachable.

    Loops and edges with a null end are ignored; repeated edges do no harm. A centre with very
    many edges is reduced before the shuffle, and its join back is left to the skew split. Rounds
    go on until the edges no longer change (about the logarithm of the longest chain); each is
    cut by a checkpoint in the shared folder.
    """
    now = settle(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = settle(_to_least(_to_least(now, True), False))
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
