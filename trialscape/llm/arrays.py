"""Arrow columns as numpy arrays, and words as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 1 << 20
"""Bytes handled at once; a longer word or document is taken whole."""

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """1, p, p*p, ... modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _STEP)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each non-empty span of ``values``; spans follow each other without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    within = np.arange(ends[-1]) - np.repeat(begins, lengths)
    if ends[-1] != len(values) or starts[0] != 0:
        values = values[within + np.repeat(starts, lengths)]
    terms = (values.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, begins))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of bytes other than ASCII white space, within documents."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside[:-1].copy()
    stops[: len(stops)] &= ~inside[1:] | begins[1:]
    return starts, np.flatnonzero(stops) + 1 - starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, letters A-Z in lower case, and the offsets of the
    documents among them. Works through blocks, so that a long document needs little memory."""
    found, counts = [], np.zeros(len(offsets), np.int64)
    first = 0
    while first < len(data):
        last = min(first + BLOCK, len(data))
        while last < len(data) and not _SPACE[data[last]]:
            ahead = np.flatnonzero(_SPACE[data[last : last + BLOCK]])
            last = last + int(ahead[0]) if len(ahead) else min(last + BLOCK, len(data))
        piece = _LOWER[data[first:last]]
        low, high = np.searchsorted(offsets, first, "right"), np.searchsorted(offsets, last, "left")
        edges = np.concatenate(([0], offsets[low:high] - first, [last - first]))
        starts, lengths = word_spans(piece, edges)
        found.append(span_hashes(piece, starts, lengths))
        counts += np.searchsorted(starts + first, offsets, "left")
        first = last
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose cells are slices of ``values``; offsets count values."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer((np.asarray(offsets) * width).astype(np.int32)), pa.py_buffer(data)],
    )


def add_columns(df: DataFrame, read: str, added: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``fn`` computes from column ``read``, batch by batch; columns
    of the same names are replaced. ``added`` is their schema as text."""
    new = StructType.fromDDL(added)
    kept = df.drop(*[f.name for f in new])
    if read in new.names:
        kept = kept.withColumn("__read", F.col(f"`{read}`")) if read in kept.columns else df.withColumnRenamed(read, "__read").drop(*new.names)
        read = "__read"
    order = kept.columns.index(read)
    out = [i for i, c in enumerate(kept.columns) if c != "__read"]
    names = [kept.columns[i] for i in out] + new.names

    def work(batches):
        for batch in batches:
            columns = fn(batch.column(order))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in out] + columns, names=names)

    schema = StructType([kept.schema.fields[i] for i in out] + new.fields)
    return kept.mapInArrow(work, schema)
