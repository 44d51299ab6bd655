"""Logs whose rows are many times as wide as the tables they come from: what is written, carried and sorted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trialscape.mart import q_read, q_stream
from trialscape.mart import tables as m
from trialscape.operators import runs as runs_ops
from trialscape.operators import select as select_ops


def small_tables(spark, folder):
    """Five orders of four lines; one order comes twice and one has no lines."""
    lines = [
        (k, k + 7 * n, k + n, n, 10.0 * n, 100.5 * n + k, 0.01 * n, 0.02 * n, "R" if n == 4 and k == 2 else "A", "F" if n % 2 else "O", dt.date(2020, 1, 1 + n))
        for k in range(1, 5) for n in range(1, 5)
    ]
    columns = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, " \
        "l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate DATE"
    orders = [(k, k % 2, "FOP"[k % 3], 1.0, dt.date(2020, 1, 1), ("1-URGENT", "5-LOW")[k % 2]) for k in (1, 2, 3, 3, 4, 5)]
    frames = {
        "lineitem": (lines, columns),
        "orders": (orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE, o_orderpriority STRING"),
        "customer": ([(0, "a", 0, 1.0, "BUILDING"), (1, "b", 0, 1.0, "MACHINERY")], "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
        "nation": ([(0, "N", 0)], "n_nationkey INT, n_name STRING, n_regionkey INT"),
        "region": ([(0, "ASIA")], "r_regionkey INT, r_name STRING"),
        "supplier": ([(k, "s", 0, 1.0) for k in range(8)], "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def written(spark, monkeypatch, query, sf):
    """The query's rows and the names of the log parts it wrote."""
    names, save = [], q_stream.sinks.write_jsonl

    def keep(df, path, *given, **named):
        save(df, path, *given, **named)
        names.extend(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect())

    monkeypatch.setattr(q_stream.sinks, "write_jsonl", keep)
    rows = query(spark, sf).collect()
    return rows, names


def test_logs_are_written_compressed_and_read_back_whole(spark, tmp_path, monkeypatch):
    sf = small_tables(spark, tmp_path)
    rows, names = written(spark, monkeypatch, q_stream.artifact_roundtrip, sf)
    assert names and all(n.endswith(".json.gz") for n in names)
    assert sorted((r.trialId, r.status, r.totalTokens) for r in rows) == [("1", "success", 40.0), ("2", "error", 40.0), ("3", "success", 40.0), ("4", "success", 40.0)]
    assert all((r.response is None) == (r.trialId == "2") for r in rows)


def test_experiments_logs_hold_every_line(spark, tmp_path, monkeypatch):
    sf = small_tables(spark, tmp_path)
    rows, names = written(spark, monkeypatch, q_read.load_runs, sf)
    assert names and all(n.endswith(".json.gz") for n in names)
    found = {(r.experiment, r.log): (r.n, r.ids) for r in rows}
    assert {e: found[e, "responses"] for e in q_read.EXPERIMENTS} == {"exp-0": (4, 1), "exp-1": (4, 1), "exp-2": (4, 1), "exp-3": (8, 1)}
    assert found["exp-1", "trials"] == (2, 2) and found["exp-0", "judge_votes"] == (4, 1)


def test_tables_are_read_in_small_splits(spark, tmp_path):
    sf, name = small_tables(spark, tmp_path), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, then in (("128m", str(m.SPLIT)), ("1m", "1m")):
            spark.conf.set(name, given)
            assert m.table(spark, sf, "region").count() == 1 and spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_evaluations_carry_what_they_show_of_votes(spark, tmp_path):
    plan = m.evals(spark, small_tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    reduced = [line for line in plan.splitlines() if "max_by" in line and "judgeId" in line]
    assert reduced and not any("provider" in line for line in reduced)


def test_responses_are_reduced_before_they_meet_their_trials(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    with_text, without = m.latest_responses(spark, sf), m.latest_responses(spark, sf, text=False)
    old = runs_ops.flatten_responses(m.latest(m.responses(spark, sf), ["trialId"]))
    assert with_text.count() == 4
    assert sorted(map(str, runs_ops.flatten_responses(with_text).collect())) == sorted(map(str, old.collect()))
    flat = runs_ops.flatten_responses(without)
    assert "response" not in flat.columns
    assert sorted(map(str, flat.collect())) == sorted(map(str, old.drop("response").collect()))
    plan = without._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("max_by")


def test_details_are_sorted_before_they_are_json(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    rows = select_ops.trial_detail(m.response_log(spark, sf), m.evals(spark, sf), m.votes(spark, sf))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.index("to_json") < plan.index("Sort") and "to_json" not in plan[plan.index("Sort"):]
    found = rows.where("trialId = '2'").select("kind", F.get_json_object("body", "$.status").alias("status"), F.get_json_object("body", "$.trialId").alias("id")).collect()
    assert [r.kind for r in found] == ["response"] + ["vote"] * 4 and found[0].status == "success" and {r.id for r in found} == {"2"}
