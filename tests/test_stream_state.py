"""Levels of deltas, state that expires, and delivery that survives a stop between output and commit."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trialscape.streaming import logs
from trialscape.streaming.levels import Levels


def test_folders_that_count_follow_from_the_number_of_batches():
    for fan in (2, 3, 4):
        levels = Levels("x", ["k"], "s", fan)
        for number in range(200):
            folders = [tuple(int(p.split("=")[1]) for p in f.split("/")) for f in levels.live(number)]
            first = 0
            for level, upto in folders:
                assert upto - first + 1 == fan**level
                first = upto + 1
            assert first == number + 1 and len(folders) <= (fan - 1) * 8


def test_levels_hold_the_last_row_and_replays_change_nothing(spark, tmp_path):
    levels, want = Levels(str(tmp_path), ["k"], "seq", 2), {}
    assert levels.read(spark) is None
    for number in range(9):
        rows = [(f"k{i}", number * 10 + i if number != 4 else 0, f"{number}-{i}") for i in range(number % 3, 5)]
        for k, seq, v in rows:
            if k not in want or seq > want[k][0]:
                want[k] = (seq, v)
        batch = spark.createDataFrame(rows, "k STRING, seq INT, v STRING")
        for _ in range(1 + (number in (3, 7))):  # these are replayed after they had written all
            levels.add(batch, number)
        assert {r.k: (r.seq, r.v) for r in levels.read(spark).collect()} == want
    left = {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("level=*/upto=*")}
    assert left == {*levels.live(8), *levels.live(7)}
    assert len(list((tmp_path / "live").glob("batch=*"))) <= 3


def log_files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    files = sorted(folder.glob("part=*/*.parquet"))
    flat = folder.parent / "log"
    flat.mkdir()
    for i, f in enumerate(files):
        (flat / f"{i}.parquet").write_bytes(f.read_bytes())
        os.utime(flat / f"{i}.parquet", (1e9 + i, 1e9 + i))
    return str(flat)


def test_state_of_quiet_keys_expires(spark, tmp_path):
    schema = "k STRING, minute INT, seq INT"
    batches = [[("a", 0, 1), ("b", 1, 5), ("b", 2, 4)], [("a", 300, 2), ("c", 301, 1)], [("a", 600, 3), ("b", 601, 2)], [("a", 900, 1), ("d", 901, None)]]
    folder = log_files(spark, tmp_path / "made", batches, schema)
    session = logs.state_session(spark)
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    timed = stream.select("k", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "seq")
    levels = Levels(str(tmp_path / "out"), ["k"], "seq", 2)
    query = logs.write_levels(logs.stream_latest_expiring(timed, ["k"], "seq", "ts", "10 minutes", 3600), levels, str(tmp_path / "cp"))
    logs.run_to_end(query)
    assert {r.k: r.seq for r in levels.read(spark).collect()} == {"a": 3, "b": 5, "c": 1}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < 6  # b and c are gone; state and timer rows of the last keys stay


@pytest.mark.parametrize("stop_at", [0, 1, 2])
def test_once_after_a_stop_between_output_and_commit(spark, tmp_path, stop_at):
    schema = "k STRING, n INT"
    batches = [[("a", 1), ("a", 0), (None, 3)], [("a", 5), ("b", 2), (None, 9)], [("b", 1), ("c", 7)]]
    folder = log_files(spark, tmp_path / "made", batches, schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    calls = []

    def stop(number):
        calls.append(number)
        if number == stop_at:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        logs.run_to_end(logs.write_once(stream, ["k"], "n", out, checkpoint, fan=2, before_commit=stop))
    logs.run_to_end(logs.write_once(stream, ["k"], "n", out, checkpoint, fan=2))
    delivered = {(r.k, r.n) for r in logs.read_once(spark, out).collect()}
    assert delivered == {("a", 0), (None, 3), ("b", 2), ("c", 7)} and logs.read_once(spark, out).count() == 4
    assert calls == list(range(stop_at + 1))
