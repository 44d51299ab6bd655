"""Nearest neighbours by a block matrix join: int8 tiles bound the cosine, survivors are computed exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialscape.llm.vectors import cosines, matrix, unit, usable

QUERY_BLOCK, STRIP, CHUNK = 1024, 16384, 1024
"""Queries that a task holds, candidates that pass it, and how many of them at a time."""


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, their scale, and the length of what is lost, per row."""
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    lost = rows - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1)) + 1e-12


class Heaps:
    """The ``k`` best candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.codes, self.scale, self.lost = quantise(unit(rows))
        self.owner, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        codes, scale, lost = quantise(unit(rows))
        # products of whole numbers are exact in float32 up to 2^24, else in float64
        kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
        near = (self.codes.astype(kind) @ codes.T.astype(kind)).astype(np.float64) * self.scale[:, None] * scale[None, :]
        slack = lost[None, :] + self.lost[:, None] * (1 + lost[None, :])
        near[self.ids[:, None] == ids[None, :]] = -np.inf
        floor = self.least
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
        if len(starts) > self.k:  # at least k candidates here, of different ids, are this near
            sure = near - slack
            if len(starts) < len(ids):
                sure = np.maximum.reduceat(sure[:, order], starts, axis=1)
            floor = np.maximum(floor, np.partition(sure, -self.k, axis=1)[:, -self.k])
        owner, at = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
        score = cosines(self.rows[owner], rows[at])
        self.owner = np.concatenate((self.owner, owner))
        self.score = np.concatenate((self.score, score))
        self.found = np.concatenate((self.found, ids[at]))
        self._keep()

    def _keep(self) -> None:
        order = np.lexsort((-self.score, self.found, self.owner))  # one row for an id, its best
        owner, found = self.owner[order], self.found[order]
        once = np.ones(len(order), bool)
        once[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        order = order[once]
        order = order[np.lexsort((self.found[order], -self.score[order], self.owner[order]))]
        owner = self.owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        best = order[rank < self.k]
        self.owner, self.score, self.found = self.owner[best], self.score[best], self.found[best]
        full = rank[rank < self.k] == self.k - 1
        self.least[self.owner[full]] = self.score[full]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` of the largest cosine to each
    row of ``queries``, without the query's own id; ties go to the smaller id. Exact: the error
    bound of the int8 products decides what is left out.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without
    id, take no part. Only vectors of the query's length count. If there are fewer than ``k``
    candidates, all are given. Rows that repeat an id count once, with their best score. An empty
    side gives no rows; other columns are ignored.

    Queries are cut into blocks by hash and candidates into strips; a task holds one block of
    queries and sees one strip pass in chunks, so its memory doesn't grow with the tables. Rows of a
    strip travel once per query block.
    """
    own = lambda df: df.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    queries, vectors = own(queries), own(vectors)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    strips = max(1, -(-vectors.count() // STRIP))
    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("v").alias("length")
    left = queries.select(length, spread(blocks).alias("block"), every(strips).alias("strip"), F.lit(0).alias("role"), "id", "v")
    right = vectors.select(length, every(blocks).alias("block"), spread(strips).alias("strip"), F.lit(1).alias("role"), "id", "v")
    cell = ["length", "block", "strip"]
    tiles = left.unionByName(right).repartition(max(blocks * strips, 8), *cell).sortWithinPartitions(*cell, "role")

    def work(batches):
        now, heaps, held = None, None, []

        def result():
            if heaps is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(heaps.ids[heaps.owner]), pa.array(heaps.found), pa.array(heaps.score)], names=["query_id", "vec_id", "score"]
                )

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = sorted({0, len(keys), *cuts.tolist(), *range(0, len(keys), CHUNK)})
            for a, b in zip(edges, edges[1:]):
                cell_now, role = tuple(keys[a, :3].tolist()), keys[a, 3]
                if cell_now != now:
                    yield from result()
                    now, heaps, held = cell_now, None, []
                ids, rows = batch.column(4).slice(a, b - a).to_numpy(), matrix(batch.column(5).slice(a, b - a))
                if role == 0:
                    held.append((ids, rows))
                elif held or heaps is not None:
                    if heaps is None:
                        heaps = Heaps(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), k)
                        held = []
                    heaps.offer(ids, rows)
        yield from result()

    found = tiles.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
