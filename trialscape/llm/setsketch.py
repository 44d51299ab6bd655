"""Near-duplicate texts by SetSketch registers: band, estimate jointly, verify on full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.llm.arrays import blobs, flat, mix, runs, word_hashes
from trialscape.llm.bloom import blocks_for, may_hold
from trialscape.llm.graph import components
from trialscape.session import drop_scratch, scratch_path

BANDS, ROWS = 40, 6
"""A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^40 = 5e-6."""
REGISTERS = BANDS * ROWS
BASE = 1.02
"""Ratio between neighbouring register values."""
LEVELS = 2600
"""Register values are cut to 0..LEVELS + 1; BASE^LEVELS is more than 2^64."""
MARGIN = 0.12
"""Pairs whose estimate is further below the threshold aren't verified: over four and a half standard deviations."""
TILE, TILE_ITEMS = 1024, 1 << 21
"""Members of a block of a tile, and shingles that they have in all: on average, as members are dealt by hash."""
SHARE = 256
"""Partners, on average, that an anchor's value is sent with."""

_MULTIPLIERS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) << np.uint64(20)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``words`` words; a text with fewer words
    has one, made of all of them; one without words has none."""
    data, offsets = flat(column)
    for first, last in runs(offsets):
        own = offsets[first : last + 1]
        hashes, at = word_hashes(data[own[0] : own[-1]], own - own[0])
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(words):
            left = max(0, len(hashes) - k)
            rolled[:left] = mix(rolled[:left] ^ hashes[k:]) if k else mix(hashes)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = mix(np.array([whole ^ h], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: per register the truncated logarithm of the least of
    the items' exponential values. The element-wise maximum of two sketches is that of the union."""
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    short = (items >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(short), 256):
        values = short[first : first + 256, None] * _MULTIPLIERS + _SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: int, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of a set to others (rows of ``b``), all of known sizes, from the
    numbers of registers in which one sketch is above, below or level with the other."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    p, q = np.maximum(chance(u - v * grid), 1e-12), np.maximum(chance(v - u * grid), 1e-12)
    level = np.maximum(1 - p - q, 1e-12)
    fit = above * np.log(p) + below * np.log(q) + (len(a) - above - below) * np.log(level)
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], 1)[:, 0]


def keys_of(matrix: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    rows = matrix.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.ones((len(rows), 1), np.uint64)
    for k in range(ROWS):
        key = mix(key ^ (rows[:, :, k] + np.uint64(1 + (k << 32))))
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b, sketch): two sums identify the set."""

    def work(batches):
        for batch in batches:
            sizes, first, second, found = [], [], [], []
            for items in shingle_sets(batch.column(1), words):
                sizes.append(len(items))
                first.append(items.sum(dtype=np.uint64))
                second.append(mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                found.append(registers(items) if len(items) else np.zeros(REGISTERS, np.uint16))
            sketch = np.concatenate(found) if found else np.zeros(0, np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)),
                    blobs(sketch, np.arange(len(sizes) + 1) * REGISTERS),
                ],
                names=["doc_id", "n_shingles", "print_a", "print_b", "sketch"],
            )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        work, "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, sketch binary"
    )


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, id): a hash of each band of a sketch."""

    def work(batches):
        for batch in batches:
            data, _ = flat(batch.column(1))
            key = keys_of(data.view(np.uint16))
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], names=["band", "id"])

    return classes.select("id", "sketch").mapInArrow(work, "band bigint, id bigint")


def beside_anchor(
    pairs: DataFrame, rows: DataFrame, value: str, read: Callable[[pa.Array], Iterator], holds: Callable[[object, object], bool]
) -> DataFrame:
    """The pairs (``a``, ``b``) for which ``holds(read value of a, of b)``. ``rows`` has (``id``, ``value``).
    ``pairs`` is read twice, so it should be a written table.

    Pairs are dealt by their anchor ``a`` and a share of ``b``, so that a frequent anchor fills
    many tasks; the anchor's values (several, if rows repeat its id) travel once a share and are
    followed by its partners', which pass one by one; any of them may hold. Memory: one anchor and one batch."""
    shares = pairs.groupBy(F.col("a").alias("a2")).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    shared = pairs.join(shares, F.col("a") == F.col("a2")).select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    wanted = shared.select("a", "share", F.lit(0).alias("role"), F.col("a").alias("need")).distinct().unionByName(
        shared.select("a", "share", F.lit(1).alias("role"), F.col("b").alias("need"))
    )
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    asked = rows.where(may_hold(keys, blocks_for(2 * pairs.count()), F.col("id")))  # others are not shuffled
    dealt = (
        asked.select(F.col("id").alias("need"), F.col(value).alias("value")).join(wanted, "need")
        .select("a", "share", "role", "need", "value")
    )
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "a", "share").sortWithinPartitions("a", "share", "role")

    def work(batches):
        anchor, own = None, []
        for batch in batches:
            left, right = [], []
            a, share, role, need = (batch.column(i).to_pylist() for i in range(4))
            for k, found in enumerate(read(batch.column(4))):
                if (a[k], share[k]) != anchor:
                    anchor, own = (a[k], share[k]), []
                if role[k] == 0:
                    own.append(found)
                elif any(holds(x, found) for x in own):
                    left.append(a[k])
                    right.append(need[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(work, "a bigint, b bigint")


def _by_tile(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` of all rows of each (band, low, high), the first three columns; a tile is held in memory."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high")

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield fn(batch.slice(a, b - a))
            held = batch.slice(cuts[-1])
        if held is not None:
            yield fn(held)

    return rows.mapInArrow(work, schema)


def _likely_in_tile(group: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a row, places of its partners): pairs of different components that this tile is the first to hold."""
    band, low, high, block, own, _, size = (group.column(i).to_numpy() for i in range(7))
    sketch = flat(group.column(7))[0].view(np.uint16).reshape(-1, REGISTERS)
    keys = keys_of(sketch)
    for i in np.flatnonzero(own > own.min()):
        at = np.flatnonzero((own < own[i]) & ((block != block[i]) | (low[0] == high[0])))
        at = at[100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i])]
        first = int(np.argmax(keys[i] == band[0]))
        at = at[~(keys[at, :first] == keys[i, :first]).any(axis=1)]
        if len(at):
            near = likely_similarity(sketch[i], sketch[at], size[i], size[at]) >= percent / 100 - MARGIN
            if near.any():
                yield int(i), at[near]


def across_components(
    rows: DataFrame, texts: DataFrame, percent: int, read: Callable[[pa.Array], Iterator], holds: Callable[[object, object], bool]
) -> DataFrame:
    """(u, v): links between components of members that share a band of ``rows`` (band, own, id, size, sketch),
    checked on their ``texts`` (id, text); enough of them that their ends connect all linked components.

    A band is compared in tiles. By the sketches alone a tile first finds the members that have a likely partner in it; only these get
    their texts, each once a tile, and are compared in the same tiles again. There a pair whose
    components are connected already is passed over. So the rows moved grow with the members of tiles, however many
    of their pairs are just below the threshold; a pair belongs to the first band that both share, so it is checked once."""
    counted = rows.groupBy(F.col("band").alias("band2")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("items"))
    blocks = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("items") / TILE_ITEMS)).cast("int")
    sizes = counted.select("band2", blocks.alias("blocks"))
    rows = rows.join(sizes, F.col("band") == F.col("band2")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "own", "id", "size", "sketch"
    )

    def with_partner(group):
        there = np.zeros(group.num_rows, bool)
        for i, at in _likely_in_tile(group, percent):
            there[i] = there[at] = True
        return group.filter(pa.array(there))

    path = scratch_path(rows.sparkSession, "tiles")
    _by_tile(rows, with_partner, rows.schema.simpleString().removeprefix("struct<").removesuffix(">")).write.parquet(path)
    tiles = rows.sparkSession.read.parquet(path)
    asked = texts.where(may_hold(tiles.select(F.col("id").alias("key")), blocks_for(tiles.count()), F.col("id")))
    full = tiles.join(asked.select(F.col("id").alias("id2"), "text"), F.col("id") == F.col("id2")).drop("id2")

    def verified(group):
        own, ids = group.column(4).to_numpy(), group.column(5).to_numpy()
        items, names, left, right = list(read(group.column(8))), {}, [], []

        def name(x):
            while x in names:
                x = names[x]
            return x

        for i, at in _likely_in_tile(group, percent):
            for j in at.tolist():
                a, b = name(own[i]), name(own[j])
                if a != b and holds(items[i], items[j]):
                    names[max(a, b)] = min(a, b)
                    left.append(ids[i])
                    right.append(ids[j])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return _by_tile(full, verified, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both, checked
    on the full sets. Words are runs of anything but ASCII white space, A-Z in lower case. A null
    or wordless text has no shingles and no link. A component is named by its least doc_id, which
    is kept. Rows that repeat a doc_id are one document: their links unite. A row with null doc_id takes no part: its component is null and
    it is kept. An empty table gives no rows; other columns are ignored. doc_id is a whole number.

    Equal sets are one class, represented by its least id, so copies are never paired. Every class
    is first held against one class, of the least ones of its bands that with most bands in common;
    then, in bands whose members still belong to different components, against the band's least
    one if that is of another component; what is then left between components is compared in tiles, by the sketches first. So a large
    group of near copies costs a few comparisons a member, and no link between components is left out.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "near-duplicates")
    sketches(docs, words, text, doc_id).write.parquet(f"{folder}/sketches")
    every = spark.read.parquet(f"{folder}/sketches")
    every.drop("sketch").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    taking_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # the least id of a set; equal sets have equal sketches
    every.where(taking_part).groupBy("print_a", "print_b").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")
    ).write.parquet(f"{folder}/classes")
    drop_scratch(spark, f"{folder}/sketches")
    classes = spark.read.parquet(f"{folder}/classes")
    band_keys(classes).write.parquet(f"{folder}/bands")
    bands = spark.read.parquet(f"{folder}/bands")
    holders = bands.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("band", "a")
    met = bands.join(holders, "band").select("band", "a", F.col("id").alias("b"))
    met.write.parquet(f"{folder}/met")
    drop_scratch(spark, f"{folder}/bands")
    met = spark.read.parquet(f"{folder}/met")

    known = classes.withColumn("value", F.struct("size", "sketch"))
    # the texts that can be asked for, so that later steps read few others
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    shared = met.select(F.col("b").alias("key"))
    texts.where(may_hold(shared, blocks_for(classes.count()), F.col("id"))).write.parquet(f"{folder}/texts")
    full = spark.read.parquet(f"{folder}/texts")

    def read_sketch(column):
        sizes = column.field("size").to_numpy()
        data, _ = flat(column.field("sketch"))
        return zip(sizes.tolist(), data.view(np.uint16).reshape(-1, REGISTERS))

    def near(x, y):
        if 100 * min(x[0], y[0]) < percent * max(x[0], y[0]):
            return False
        return likely_similarity(x[1], y[1][None], x[0], np.array([y[0]]))[0] >= percent / 100 - MARGIN

    def linked(x, y):
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)

    def sets(column):
        return shingle_sets(column, words)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs.write.parquet(f"{folder}/{name}-pairs")
        pairs = spark.read.parquet(f"{folder}/{name}-pairs")
        beside_anchor(pairs, known, "value", read_sketch, near).write.parquet(f"{folder}/{name}-likely")
        likely = spark.read.parquet(f"{folder}/{name}-likely")
        beside_anchor(likely, full, "text", sets, linked).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def still_open(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """(band, a, b, own): the members, with their components, of those bands that still have several."""
        found = components(links)
        tagged = members.join(found, members["b"] == found["id"], "left").select("band", "a", "b", F.coalesce("component", "b").alias("own"))
        several = tagged.groupBy(F.col("band").alias("band2")).agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
        tagged.join(several, F.col("band") == F.col("band2"), "left_semi").write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # of the least members of its bands, the one that a class shares most bands with
    common = met.where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    links = verified(common.groupBy("b").agg(F.max_by("a", F.struct("n", F.negative("a"))).alias("a")).select("a", "b"), "first")
    # rows of one doc_id in several classes
    doubles = (
        rows.where(taking_part).join(classes.select("print_a", "print_b", "id"), ["print_a", "print_b"]).where("doc_id <> id")
        .select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    )
    # the least members of other components
    rest = still_open(met, links, "open-least")
    drop_scratch(spark, f"{folder}/met")
    least = rest.where("a = b").select(F.col("band").alias("band2"), F.col("own").alias("own2"))
    pairs = rest.where("a <> b").join(least, F.col("band") == F.col("band2")).where("own <> own2")
    links = links.unionByName(verified(pairs.select("a", "b").distinct(), "least"))
    # the least one has met all others
    rest = still_open(rest.select("band", "a", "b"), links, "open").where("a <> b").select("band", "own", "b")
    asked = classes.where(may_hold(rest.select(F.col("b").alias("key")), blocks_for(rest.count()), F.col("id")))
    rest = rest.join(asked, F.col("b") == F.col("id")).select("band", "own", "id", "size", "sketch")
    across_components(rest, full, percent, sets, linked).write.parquet(f"{folder}/across")
    more = spark.read.parquet(f"{folder}/across")
    found = components(links.unionByName(more).unionByName(doubles)).select(F.col("id").alias("node"), "component")
    out = rows.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
