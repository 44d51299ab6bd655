"""A blocked Bloom filter made of DataFrame operations: one array of 64-bit words, of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
"""64-bit words of a block; a key sets two bits in each."""
KEYS = 16
"""Keys a block is made for: 16 bits each, about one false hit in a thousand."""
MOST_BLOCKS = 1 << 18
"""Bound of a filter: 8 MB, made for four million keys. More keys fill it more densely, so that it lets
more rows through; none of its own is ever held back."""


def blocks_for(keys: int) -> int:
    return min(MOST_BLOCKS, 1 << max(0, (keys // KEYS).bit_length()))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bits that it sets in the block's words."""
    bits = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("long")

    def bit(n: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * n).bitwiseAND(F.lit(63)).cast("int"))

    return (
        F.pmod(F.xxhash64(key), F.lit(blocks)),
        [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)],
    )


def blocked_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the words of all blocks as one array, for the column ``key``. Keys are reduced to blocks
    before the shuffle, and no more than ``blocks`` rows meet in one task."""
    block, masks = _place(F.col("key"), blocks)
    filled = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    filled = filled.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    dense = keys.sparkSession.range(blocks).join(filled, F.col("id") == F.col("block"), "left")
    words = [F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(WORDS)]
    rows = dense.agg(F.array_sort(F.collect_list(F.struct("id", F.array(*words).alias("w")))).alias("rows"))
    return rows.select(F.flatten(F.transform("rows", lambda r: r["w"])).alias("filter"))


def may_hold(keys: DataFrame, blocks: int, probe: Column) -> Column:
    """False only for probes that are not among the column ``key`` of ``keys``."""
    words = blocked_filter(keys, blocks).scalar()
    block, masks = _place(probe, blocks)
    set_bits = [F.get(words, (block * WORDS + w).cast("int")).bitwiseAND(m) == m for w, m in enumerate(masks)]
    return reduce(lambda a, b: a & b, set_bits)
