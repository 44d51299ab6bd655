"""Near-duplicate vectors by sorted projection passes: neighbours in random orders are compared."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.llm.graph import components
from trialscape.llm.vectors import cosines, matrix, unit, usable
from trialscape.session import scratch_path

WINDOW = 48
"""Rows before it that a row is compared with in each order, whatever bits they share."""
HELD = 512
"""Groups of equal leading bits of up to so many rows are compared whole where they are met; larger ones in tiles."""
MISS = 1e-4
"""Chance that an isolated pair at the threshold stands in no common window of any pass."""
BITS = 62
TILE = 1024


def passes_for(rows: int, cosine: float) -> int:
    """A pair stays within a window if it shares about log2(rows / WINDOW) leading bits, each with
    chance 1 - angle / pi; so many passes bring the chance of a miss below MISS."""
    bits = math.log2(max(2.0, rows / WINDOW))
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(MISS) / math.log1p(-shared)))


def signatures(rows: np.ndarray, number: int) -> np.ndarray:
    """One key per row: the sides of ``BITS`` random planes of pass ``number``, as digits."""
    planes = np.random.default_rng((20240, number, rows.shape[1])).standard_normal((rows.shape[1], BITS))
    return ((rows @ planes > 0).astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)


class Merger:
    """Union-find over the ids of one task: tells which pairs join two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def counted_bits(rows: int) -> int:
    """Leading bits that ``passes_for`` counts on: rows that share them in a pass must be compared."""
    return int(math.log2(max(2.0, rows / WINDOW)))


def near_pairs(rows: np.ndarray, others: np.ndarray, asked: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``asked`` pairs within reach; what is close to the threshold is settled by ``cosines``."""
    product = unit(rows) @ unit(others).T
    i, j = np.nonzero((product >= cosine - 1e-9) & asked)
    close = np.flatnonzero(product[i, j] < cosine + 1e-9)
    sure = np.ones(len(i), bool)
    sure[close] = cosines(rows[i[close]], others[j[close]]) >= cosine
    return i[sure], j[sure]


def one_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of one pair for each two different labels."""
    differ = np.flatnonzero(a != b)
    if not len(differ):
        return differ
    labels = np.stack((np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])), axis=1)
    return differ[np.unique(labels, axis=0, return_index=True)[1]]


def window_links(rows: DataFrame, cosine: float, bits: int) -> DataFrame:
    """Among rows (pass, length, key, id, v) in order: (u, v), verified pairs within windows and within
    groups of equal leading ``bits``, of which the last ``HELD`` rows are at hand, so many as it takes to
    connect what these connect; and (pass, length, prefix, rows, task) of groups that may not be whole."""

    def work(batches):
        task = TaskContext.get().partitionId()
        last, ids, groups, vectors = None, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            prefix = batch.column(2).to_numpy() >> (BITS - bits)
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), prefix], axis=1)
            cuts = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1)) + 1
            left, right, merger = [], [], Merger()
            edges = sorted({0, len(keys), *cuts.tolist(), *range(0, len(keys), 256)})
            for a, b in zip(edges, edges[1:]):
                now = tuple(keys[a, :2].tolist())
                new_ids, new = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a))
                if now != last:
                    last, ids, groups, vectors = now, new_ids[:0], prefix[:0], new[:0]
                before = len(ids)
                ids, groups = np.concatenate((ids, new_ids)), np.concatenate((groups, prefix[a:b]))
                vectors = np.concatenate((vectors, new))
                i, j = np.arange(before, len(ids))[:, None], np.arange(len(ids))[None, :]
                i, j = near_pairs(new, vectors, (j < i) & ((i - j <= WINDOW) | (groups[i] == groups[j])), cosine)
                i = i + before
                beside = i - j <= WINDOW
                for x, y in zip(ids[i[beside]].tolist(), ids[j[beside]].tolist()):
                    if merger.join(x, y):
                        left.append(x)
                        right.append(y)
                roots = np.array([merger.root(x) for x in ids.tolist()], np.int64)
                for k in one_each(roots[i], roots[j]).tolist():
                    x, y = int(ids[i[k]]), int(ids[j[k]])
                    if merger.join(x, y):
                        left.append(x)
                        right.append(y)
                keep = max(WINDOW, min(HELD, int((groups == groups[-1]).sum())))
                ids, groups, vectors = ids[-keep:], groups[-keep:], vectors[-keep:]
            none = pa.nulls(len(left), pa.int64())
            links = [pa.array(left, pa.int64()), pa.array(right, pa.int64()), none, none, none, none, none]
            yield pa.RecordBatch.from_arrays(links, names=names)
            if len(keys):
                starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
                sizes = np.diff(np.concatenate((starts, [len(keys)])))
                told = sizes > HELD
                told[[0, -1]] = True
                none = pa.nulls(int(told.sum()), pa.int64())
                found = [pa.array(x.astype(np.int64)) for x in (*keys[starts[told]].T, sizes[told], np.full(len(none), task))]
                yield pa.RecordBatch.from_arrays([none, none, *found], names=names)

    names = ["u", "v", "pass", "length", "prefix", "rows", "task"]
    return rows.mapInArrow(work, ", ".join(f"{n} bigint" for n in names))


def crowd_links(classes: DataFrame, signed: DataFrame, crowds: DataFrame, found: DataFrame, cosine: float) -> DataFrame:
    """(u, v): a verified pair for each two components that a tile finds to be linked, within ``crowds``
    (pass, length, prefix): all members of a crowd are compared with those of other components (``found``).

    ``signed`` has (pass, length, prefix, id). A component with half of a crowd is only held against the
    others, so that a large group of near copies costs one row a tile of the others."""
    group = ["pass", "length", "prefix"]
    rows = signed.join(crowds, group).join(found.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    rows = rows.select(*group, "id", F.coalesce("component", "id").alias("own"))
    shares = rows.groupBy(*group, "own").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(
        F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("own", F.struct("n", "own")).alias("main")
    ).where("most < size")
    main = F.col("most") * 2 >= F.col("size")
    shares = shares.select(
        *group, F.when(main, F.col("main")).alias("main"),
        F.ceil(F.when(main, F.col("size") - F.col("most")).otherwise(F.col("size")) / TILE).cast("int").alias("rest"),
        F.when(main, F.ceil(F.col("most") / TILE)).otherwise(0).cast("int").alias("mains"),
    )
    rows = rows.join(shares, group)
    is_main = F.coalesce(F.col("own") == F.col("main"), F.lit(False))
    rows = rows.withColumn(
        "block", F.when(is_main, F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1))))
        .otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    )
    until = F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), until))).select(
        *group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "own", F.col("id").alias("node")
    )
    rows = rows.join(classes.select("id", "v"), F.col("node") == F.col("id")).select(*group, "low", "high", "block", "own", "id", "v")

    def tile(key, group):
        low, high = key[3].as_py(), key[4].as_py()
        block, own, ids = (group.column(i).to_numpy() for i in (5, 6, 7))
        vectors = matrix(group.column(8).combine_chunks())
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        left, right = [], []
        for a in range(0, len(first), 256):
            part = first[a : a + 256]
            if not len(second):
                break
            i, j = near_pairs(vectors[part], vectors[second], own[part][:, None] != own[second][None, :], cosine)
            i, j = part[i], second[j]
            some = one_each(own[i], own[j])
            left.append(ids[i[some]])
            right.append(ids[j[some]])
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"u": whole(left), "v": whole(right)})

    return rows.groupBy(*group, "low", "high").applyInArrow(tile, "u bigint, v bigint")


def direct_links(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links): for members (component, id, n, v), the weight ``n`` of the others of the same
    component within reach, tile by tile; only sums leave a tile. Small components share tiles."""
    sizes = members.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    total = members.count()
    rows = members.join(sizes, F.col("component") == F.col("c"))
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    small = F.col("size") <= TILE // 4
    home = F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(max(1, total // TILE)))).otherwise(F.col("component"))
    rows = rows.withColumns({
        "home": home, "blocks": F.when(small, 1).otherwise(blocks),
    }).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "home", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.size("v").alias("length"), "own", "component", "id", "n", "v",
    )

    def tile(key, group):
        low, high = key[1].as_py(), key[2].as_py()
        own, component, ids, weight = (group.column(i).to_numpy() for i in (4, 5, 6, 7))
        vectors = unit(matrix(group.column(8).combine_chunks()))
        first = np.flatnonzero(own == low)
        second = np.flatnonzero(own == high)
        linked = vectors[first] @ vectors[second].T >= cosine
        linked &= component[first][:, None] == component[second][None, :]
        linked &= ids[first][:, None] != ids[second][None, :]
        found, sums = ids[first], linked @ weight[second]
        if low != high:
            found, sums = np.concatenate((found, ids[second])), np.concatenate((sums, linked.T @ weight[first]))
        return pa.table({"id": found, "links": sums.astype(np.int64)})

    found = dealt.groupBy("home", "low", "high", "length").applyInArrow(tile, "id bigint, links bigint")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Two vectors are linked if their cosine in double precision is at least ``cosine``. Each pass
    sorts all distinct vectors by the sides of random planes and compares every row with the
    ``WINDOW`` rows before it and with those that share the leading bits which the number of passes
    counts on; groups of such rows that are too large for that (a dense topic) are finished in tiles,
    between different components. Verified pairs of all passes make components, and the
    links within a component are then counted in tiles over all its members.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    so do vectors of different lengths, and a row without id (component null, kept). Equal
    vectors are one class with a weight and never paired; every row counts as a vector, so rows
    that repeat an id count each. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = scratch_path(spark, "near-vectors")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})
    rows.where("ok").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")
    ).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    count = classes.count()
    passes, bits = passes_for(count, cosine), counted_bits(count)

    def sign(batches, whole=True):
        for batch in batches:
            for a in range(0, len(batch), 1024):
                ids, lists = batch.column(0).slice(a, 1024), batch.column(1).slice(a, 1024)
                lengths = lists.value_lengths().to_numpy()
                for length in np.unique(lengths):
                    at = pa.array(np.flatnonzero(lengths == length))
                    own_ids, own = ids.take(at), lists.take(at)
                    data = unit(matrix(own))
                    for number in range(passes):
                        columns = [
                            pa.array(np.full(len(own), number, np.int32)), pa.array(np.full(len(own), length, np.int32)),
                            pa.array(signatures(data, number)), own_ids, own,
                        ]
                        names = ["pass", "length", "key", "id", "v"]
                        yield pa.RecordBatch.from_arrays(columns[: 5 if whole else 4], names=names[: 5 if whole else 4])

    signed = classes.select("id", "v").mapInArrow(sign, "pass int, length int, key bigint, id bigint, v array<double>")
    order = ["pass", "length", "key", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = signed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    window_links(signed, cosine, bits).write.parquet(f"{folder}/links")
    written = spark.read.parquet(f"{folder}/links")
    links = written.where(F.col("u").isNotNull()).select("u", "v")
    crowds = written.where(F.col("u").isNull()).groupBy("pass", "length", "prefix").agg(
        F.sum("rows").alias("rows"), F.count_distinct("task").alias("tasks")
    ).where((F.col("rows") > HELD) | (F.col("tasks") > 1)).select("pass", "length", "prefix")
    keyed = classes.select("id", "v").mapInArrow(lambda batches: sign(batches, False), "pass int, length int, key bigint, id bigint")
    keyed = keyed.select("pass", "length", F.shiftright("key", BITS - bits).alias("prefix"), "id")
    found = components(links)
    found.write.parquet(f"{folder}/window-components")
    found = spark.read.parquet(f"{folder}/window-components")
    crowd_links(classes, keyed, crowds, found, cosine).write.parquet(f"{folder}/crowd-links")
    found = components(links.unionByName(spark.read.parquet(f"{folder}/crowd-links")))
    found.write.parquet(f"{folder}/components")
    found = spark.read.parquet(f"{folder}/components").withColumnRenamed("id", "node")
    members = classes.join(found, F.col("id") == F.col("node")).select("component", "id", "n", "v")
    links = direct_links(members, cosine).withColumnRenamed("id", "linked")
    known = (
        classes.select("h1", "h2", "id", "n").join(found, F.col("id") == F.col("node"), "left")
        .join(links, F.col("id") == F.col("linked"), "left")
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n", "links", F.coalesce("component", "id").alias("component"))
    )
    out = rows.select("vec_id", "h1", "h2").join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
