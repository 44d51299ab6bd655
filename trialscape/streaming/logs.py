"""Structured Streaming over the append logs (STR-*).

State is kept by Spark: streaming aggregations hold one row per key in the state store, sinks write one
folder per micro-batch, so a batch that is replayed after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType, TimestampType

from trialscape import schemas
from trialscape.operators.latest import latest
from trialscape.operators.pending import item_id
from trialscape.streaming.levels import Levels


def stream_artifact(spark: SparkSession, folder: str, kind: str, files_per_batch: int | None = None) -> DataFrame:
    """STR-1: a log folder that grows by whole files."""
    reader = spark.readStream.schema(schemas.ARTIFACTS[kind])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.json(folder)


def stream_latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """STR-2: running last row per key; the state is one row per key. Late rows lose by ``seq``."""
    payload = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(seq)).alias("__row"))
    return best.select(*keys, "__row.*")


class _LatestRow(StatefulProcessor):
    """Passes on a key's rows that are later than any before, and forgets a key that has been quiet."""

    def __init__(self, seq_type: StructType, keep_ms: int) -> None:
        self.seq_type, self.keep_ms = seq_type, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.seq_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802 - Spark's name
        best = self.newest.get()[0] if self.newest.exists() else None
        winner, seen = None, None
        for row in rows:
            seen = row["__at"] if seen is None or row["__at"] > seen else seen
            if row["__seq"] is not None and (best is None or row["__seq"] > best):
                best, winner = row["__seq"], row
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seen is not None and best is not None:
            self.newest.update((best,))
            self.handle.registerTimer(seen + self.keep_ms)
        if winner is not None:
            yield winner

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state in RocksDB, which :func:`stream_latest_expiring` needs."""
    session = spark.newSession()
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    session.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return session


def stream_latest_expiring(df: DataFrame, keys: list[str], seq: str, time: str, delay: str, keep_seconds: int) -> DataFrame:
    """STR-2 with bounded state: one ``seq`` per key that was heard of within ``keep_seconds`` of event time before the
    watermark (``time``, up to ``delay`` late). A key heard of again later starts anew; if its row is older than one passed on before,
    the reader of the deltas decides by ``seq``. ``df`` comes from a :func:`state_session`; rows without
    ``time`` or ``seq`` are not passed on."""
    # instants as numbers, which mean the same in Python whatever the time zone
    order = F.unix_micros(seq) if isinstance(df.schema[seq].dataType, TimestampType) else F.col(seq)
    timed = df.where(F.col(time).isNotNull()).withColumns({"__seq": order, "__at": F.unix_millis(time)})
    processor = _LatestRow(StructType([timed.schema["__seq"]]), keep_seconds * 1000)
    rows = timed.withWatermark(time, delay).groupBy(*keys)
    return rows.transformWithState(processor, timed.schema, "Update", "EventTime").drop("__seq", "__at")


def write_levels(updates: DataFrame, levels: Levels, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """The changed rows of each micro-batch into :class:`Levels`; a replayed batch replaces its own."""
    writer = updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(levels.add).trigger(availableNow=True).start()


def write_deltas(updates: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Changed rows of each micro-batch in a folder of its own. Replaying a batch overwrites its folder."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current state: the newest delta of each key."""
    return latest(spark.read.parquet(path), keys, "batch").drop("batch")


def stream_compact(df: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str, fan: int = 4) -> StreamingQuery:
    """STR-2 without any state: each micro-batch is reduced on its own and kept in levels; read with
    ``Levels(path, keys, seq, fan).read(spark)``."""
    return write_levels(df, Levels(path, keys, seq, fan), checkpoint, "append")


def stream_status(df: DataFrame, dimension: Column | str, status: str = "status") -> DataFrame:
    """STR-3: running tallies per dimension and status."""
    label = F.col(dimension) if isinstance(dimension, str) else dimension
    return df.groupBy(label.alias("label"), F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def once_per_key(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """STR-4: each piece of work once, also after a restart; keys are forgotten after ``delay``."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_once(
    df: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str, fan: int = 4,
    before_commit: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """STR-4 for good: each key is delivered once, its first row by ``seq`` of the batch that first has it, however often the query
    stops and resumes.

    A batch writes its fresh rows as ``delivered/batch=n`` and its keys into a ledger of :class:`Levels`. It tells fresh keys
    by the ledger as of batch n - 1, so a batch that is replayed, after a stop anywhere between its output and Spark's
    commit, finds the same keys fresh and replaces what it had written. :func:`read_once` shows
    batches whose ledger is complete. Null keys are keys. ``before_commit`` is called when a batch has written all, before Spark commits it."""
    ledger = Levels(f"{path}/ledger", ["known"], "batch", fan)
    known = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("known", known)
        first = rows.groupBy("known").agg(F.min_by(F.struct(*batch.columns), F.col(seq)).alias("row"))
        done = ledger.read(batch.sparkSession, number - 1)
        fresh = first if done is None else first.join(done.select("known"), "known", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/delivered/batch={number}")
        written = batch.sparkSession.read.schema(fresh.schema).parquet(f"{path}/delivered/batch={number}")
        ledger.add(written.select("known", F.lit(number).alias("batch")), number)
        if before_commit is not None:
            before_commit(number)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def read_once(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`write_once` has delivered; None before its first batch."""
    last = Levels(f"{path}/ledger", ["known"], "batch").last(spark)
    return None if last is None else spark.read.parquet(f"{path}/delivered").where(F.col("batch") <= last).select("row.*")


def stream_match(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """STR-5: batch results as they arrive, joined to the static table of jobs; unknown ids are dropped."""
    renamed = items.select(item_id(items).alias("__id"), F.struct(*items.columns).alias("item"))
    return renamed.join(jobs, F.col("__id") == F.col("custom_id"), "inner").drop("__id")


def run_to_end(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for an available-now query, without a limit unless one is given; a failed one raises."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("stream did not finish")
