"""Centroid clustering in whole numbers: centroids in order of their mean, searched outward from the vector's."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.llm.vectors import matrix
from trialscape.session import scratch_path

LIMB = 31
"""Bits of the parts that sums of any size are added up in."""
SLACK = 4e-16
"""Twice the rounding error of a deviation, relative to it."""


def complete(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~broken, F.lit(False))


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python integers if one of them is too large."""
    if not rows.size or np.abs(rows).max() < 2.0**52 / scale:
        return np.floor(rows * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in rows.ravel().tolist()]
    return np.array(exact, object).reshape(rows.shape)


class Search:
    """Nearest centroid of each row: exact squared distance, ties to the smaller number.

    With n components, sums S and deviations D = sqrt(n * sum of squares - S * S), n times the squared
    distance is at least (difference of S)^2 + (difference of D)^2. Centroids stand in order of S. From the
    row's own place the scan takes the nearer neighbour in S of both sides; once its first term is beyond n times the best
    distance, so are all further ones. The second term rejects single centroids. Equal bounds are not
    rejected, as a tie may go to a smaller number.
    """

    def __init__(self, centroids: list[list[int]]) -> None:
        self.k, self.dim = len(centroids), len(centroids[0])
        self.limit = (1 << 30) // self.dim  # below, nothing here passes 62 bits
        self.exact = np.array(centroids, object)
        self.small = max((abs(x) for c in centroids for x in c), default=0) < self.limit
        if self.small:
            rows = self.exact.astype(np.int64)
            sums, spread = self._moments(rows)
            self.number = np.lexsort((np.arange(self.k), sums))
            self.rows, self.sums, self.spread = rows[self.number], sums[self.number], spread[self.number]

    def _moments(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.sum(axis=1)
        return sums, np.sqrt((self.dim * (rows * rows).sum(axis=1) - sums * sums).astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances); distances are Python integers if a row or centroid is huge."""
        if rows.dtype != object and self.small and (not rows.size or np.abs(rows).max() < self.limit):
            return self._scan(rows)
        number, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
        for i, row in enumerate(rows.astype(object)):
            each = ((self.exact - row) ** 2).sum(axis=1)
            number[i] = min(range(self.k), key=lambda c: (each[c], c))
            distance[i] = each[number[i]]
        return number, distance

    def _scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.int64(1) << np.int64(62)
        sums, spread = self._moments(rows)
        best, number = np.full(len(rows), far // self.dim), np.full(len(rows), self.k)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        at = np.arange(len(rows))
        while len(at):
            below, above = low[at], high[at]
            gap_low = np.where(below >= 0, sums[at] - self.sums[below], far)
            gap_high = np.where(above < self.k, self.sums[np.minimum(above, self.k - 1)] - sums[at], far)
            down = gap_low <= gap_high
            gap = np.minimum(gap_low, gap_high)
            go = gap < far
            go[go] = gap[go] ** 2 <= self.dim * best[at[go]]
            at, down, gap = at[go], down[go], gap[go]
            chosen = np.where(down, low[at], high[at])
            low[at] -= down
            high[at] += ~down
            apart = np.abs(spread[at] - self.spread[chosen]) - SLACK * (spread[at] + self.spread[chosen])
            bound = gap.astype(np.float64) ** 2 + np.maximum(apart, 0) ** 2
            near = bound * (1 - 1e-12) <= (self.dim * best[at]).astype(np.float64)
            row, chosen = at[near], chosen[near]
            step = rows[row] - self.rows[chosen]
            distance = (step * step).sum(axis=1)
            name = self.number[chosen]
            better = (distance < best[row]) | ((distance == best[row]) & (name < number[row]))
            best[row[better]], number[row[better]] = distance[better], name[better]
        return number, best


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) with value = sum of part * 2^(LIMB * place); every part fits into 32 bits."""
    place = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _updated(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; empty ones stay. Tasks add up their own
    vectors; one row per centroid, component and limb comes back."""
    search, dim = Search(centroids), len(centroids[0])

    def add_up(batches):
        totals = [[0] * (dim + 1) for _ in centroids]
        for batch in batches:
            rows = whole_numbers(matrix(batch.column(0)), scale)
            if not len(rows):
                continue
            number, _ = search.nearest(rows)
            for c in np.unique(number):
                mine = rows[number == c]
                if mine.dtype != object and np.abs(mine).max() >= 1 << 40:
                    mine = mine.astype(object)
                for d, x in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                    totals[c][d] += x
        out = [(c, d, *limb) for c, t in enumerate(totals) if t[dim] for d, x in enumerate(t) for limb in _limbs(x)]
        columns = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in columns], names=["cluster", "component", "place", "part"]
        )

    parts = vectors.mapInArrow(add_up, "cluster LONG, component LONG, place LONG, part LONG")
    sums = parts.groupBy("cluster", "component", "place").agg(F.sum("part").alias("part"))
    totals: dict[int, list[int]] = {}
    for r in sums.collect():
        totals.setdefault(r.cluster, [0] * (dim + 1))[r.component] += r.part << (LIMB * r.place)
    return [
        [x // totals[c][dim] for x in totals[c][:dim]] if c in totals else old for c, old in enumerate(centroids)
    ]


@dataclass(frozen=True)
class Clusters:
    assigned: DataFrame
    """(vec_id, cluster, distance)"""
    centroids: list[list[int]]


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1",
    vec_id: str = "vec_id", vector: str = "embedding",
) -> Clusters:
    """Lloyd's rounds over vectors turned into integers floor(scale * x), all distances and means exact.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` in that order. Each round
    assigns all vectors and replaces non-empty centroids by the floor of the mean; then all are assigned once
    more. Each round is one pass without a shuffle of vectors; ``k`` centroids travel with the tasks and
    ``k`` sums come back, so ``k * dim`` should be some millions at most.

    Vectors that are null, of another length, or hold null or non-finite components take no part and are
    not returned. Rows that repeat a ``vec_id`` are vectors of their own; in the choice of seeds their content
    decides. A null id counts as empty text. Fewer than ``k`` vectors give as many centroids. Ties go to the smaller
    number. A distance beyond 64 bits is found exactly and given as null. Empty tables give an empty result. Other columns
    are not returned.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kept = kept.where(complete(F.col("vector"), dim))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(place.alias("place"), "vector").orderBy("place", "vector").limit(k).collect()
    if not first:
        return Clusters(kept.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance"), [])
    found = sorted((r.place, r.vector) for r in first)
    centroids = whole_numbers(np.array([v for _, v in found]), scale).tolist()
    for _ in range(rounds):
        centroids = _updated(kept.select("vector"), centroids, scale)
    search = Search(centroids)

    def assign(batches):
        for batch in batches:
            number, distance = search.nearest(whole_numbers(matrix(batch.column(1)), scale))
            known = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(known, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    id_type = kept.schema["vec_id"].dataType.simpleString()
    path = scratch_path(spark, "clusters")
    kept.mapInArrow(assign, f"vec_id {id_type}, cluster INT, distance LONG").write.parquet(path)
    return Clusters(spark.read.parquet(path), centroids)


def inertias(assigned: DataFrame) -> dict[int, int | None]:
    """Distances summed per cluster, exactly; null where one of them is unknown or the sum passes 64 bits."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    rows = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total).alias("total")).collect()
    sums = {r.cluster: None if r.total is None else int(r.total) for r in rows}
    return {c: None if s is None or s >= 1 << 63 else s for c, s in sums.items()}
