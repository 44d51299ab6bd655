"""What travels of wide log rows: the columns that a later step shows, and first responses before they meet their trials."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_wide_logs import small_tables

from trialscape.mart import q_facts, q_ops, q_read, q_study
from trialscape.mart import tables as m
from trialscape.operators import latest as latest_ops
from trialscape.operators import select as select_ops
from trialscape.plans.export import export_rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_last_rows_takes_the_last_row_of_each_key_and_keeps_null_parts_of_keys(spark):
    rows = [("a", "x", 1, "old"), ("a", "x", 3, "new"), ("a", None, 2, "nobody"), ("a", "x", None, "unknown"), ("b", "y", 1, None), ("", "x", 9, "blank"), (None, "x", 9, "none")]
    log = spark.createDataFrame(rows, "k STRING, j STRING, seq INT, v STRING")
    found = latest_ops.last_rows(log, ["k", "j"])
    assert found.columns == log.columns
    assert set(map(tuple, found.collect())) == {("a", "x", 3, "new"), ("a", None, 2, "nobody"), ("b", "y", 1, None)}


def test_latest_of_does_not_carry_the_order_twice(spark):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k STRING, seq INT, v STRING")
    assert [tuple(r) for r in latest_ops.latest_of(log, ["k"], ["v"]).collect()] == [("a", "new")]
    assert [tuple(r) for r in latest_ops.latest_of(log, ["k"], ["v", "seq"]).collect()] == [("a", "new", 2)]
    assert "max_by(struct(v, v#" in plan_of(latest_ops.latest_of(log, ["k"], ["v"]))


def test_facts_without_texts_carry_none(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    assert "repeat(" in plan_of(m.facts(spark, sf))
    assert "repeat(" not in plan_of(q_facts.total_calls(spark, sf))
    assert "repeat(" not in plan_of(q_facts.summary(spark, sf))


def test_trial_object_picks_the_first_response_before_it_meets_its_trial(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    assert plan_of(q_read.trial_object(spark, sf)).count("min_by(struct(") == 2
    log, given = m.response_log(spark, sf), (m.evals(spark, sf), m.votes(spark, sf))
    before = select_ops.trial_object(m.responses(spark, sf), *given)
    after = select_ops.trial_object(log, *given, trials=m.trials(spark, sf).drop("seq"))
    read = lambda df: sorted(tuple(r) for r in df.select("trialId", F.get_json_object("detail", "$.response"), F.get_json_object("detail", "$.tags"), F.get_json_object("detail", "$.judgeVotes")).collect())
    assert read(before) == read(after) and len(read(after)) == 4


def test_lines_by_trial_are_all_lines_in_buckets_that_grow_in_number_only(spark, tmp_path, monkeypatch):
    sf = small_tables(spark, tmp_path / "tables")
    more = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber < 3")
    more.unionByName(more.withColumn("l_orderkey", F.lit(None).cast("long"))).write.mode("append").parquet(f"{sf}/lineitem.parquet")
    stored = m.stored_bytes(spark, f"{sf}/lineitem.parquet")
    monkeypatch.setattr(m, "BUCKET", stored // 5 + 1)
    kept = m.lines_by_trial(spark, sf)
    read = lambda df: sorted(map(str, df.select(*kept.columns).collect()))
    assert read(kept) == read(m.lines(spark, sf)) and kept.where("trialId IS NULL").count() == 8
    assert "5 out of 5" in kept.groupBy("trialId").count()._jdf.queryExecution().executedPlan().toString()


def test_votes_and_responses_are_not_shuffled_again_once_they_lie_by_trial(spark, tmp_path, monkeypatch):
    sf = small_tables(spark, tmp_path)
    monkeypatch.setattr(m, "BUCKET", 1000)
    for query in (q_facts.total_calls, q_facts.summary, q_study.worst_tasks, q_study.pareto, q_study.category_pivot):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(trialId" in line]
        assert moved and not any("judgeId" in line or "criterion" in line for line in moved), query.__name__


def exchanges(spark, query, sf) -> tuple[int, int]:
    """How often a query deals rows by trial and by range."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    return plan.count("Exchange hashpartitioning(trialId"), plan.count("Exchange rangepartitioning(trialId")


def test_objects_of_trials_meet_where_their_lines_lie(spark, tmp_path, monkeypatch):
    """Only planned trials are dealt, once for responses and once for evaluations."""
    sf = small_tables(spark, tmp_path)
    monkeypatch.setattr(m, "BUCKET", 1000)
    assert exchanges(spark, q_read.trial_object, sf) == (2, 0)


def test_trial_object_carries_shown_columns_and_lists_equal_votes_by_their_text(spark):
    responses = spark.createDataFrame([("a", 2, "later", "x"), ("a", 1, None, "x"), ("b", 1, "yes", "x")], "trialId STRING, seq INT, response STRING, unseen STRING")
    trials = spark.createDataFrame([("a", "m1", "u"), ("a", "m1", "u")], "trialId STRING, modelId STRING, unseen STRING")
    evals = spark.createDataFrame([("a", 1, "error"), ("a", 2, None)], "trialId STRING, seq INT, status STRING")
    votes = spark.createDataFrame([("a", 2, "j1", {"k": "v"}), ("a", 1, "j3", None), ("a", 1, "j2", None)], "trialId STRING, seq INT, judgeId STRING, notes MAP<STRING, STRING>")
    found = select_ops.trial_object(responses, evals, votes, trials=trials)
    assert not any("unseen" in line for line in plan_of(found).splitlines() if "min_by" in line)
    assert {r.trialId: r.detail for r in found.collect()} == {
        "a": '{"trialId":"a","response":null,"model":{"id":"m1"},"evaluation":{"trialId":"a"},"judgeVotes":['
             '{"judgeId":"j2","trialId":"a"},{"judgeId":"j3","trialId":"a"},{"judgeId":"j1","notes":{"k":"v"},"trialId":"a"}]}',
        "b": '{"trialId":"b","response":"yes","model":{"id":null},"evaluation":null,"judgeVotes":null}',
    }


def test_details_are_dealt_by_range_only_and_exports_not_at_all_once_lines_lie_by_trial(spark, tmp_path, monkeypatch):
    sf = small_tables(spark, tmp_path)
    monkeypatch.setattr(m, "BUCKET", 1000)
    assert exchanges(spark, q_ops.trial_detail, sf) == (1, 1)
    assert exchanges(spark, q_ops.export_query, sf) == (2, 0)


def test_details_carry_their_id_once_and_any_number_of_ranges_gives_the_same_order(spark):
    log = spark.createDataFrame([("first", "a", 1), ("second", "a", 2), (None, "b", 1), ("nobody", None, 1)], "response STRING, trialId STRING, seq INT")
    evals = spark.createDataFrame([("a", 1, None)], "trialId STRING, seq INT, status STRING")
    votes = spark.createDataFrame([("a", 9, "j2"), ("a", 8, "j1"), ("c", 1, None)], "trialId STRING, seq INT, judgeId STRING")
    found = select_ops.trial_detail(log, evals, votes)
    moved = next(line for line in plan_of(found).splitlines() if "Sort [" in line)
    assert moved and "struct(trialId" not in plan_of(found)[plan_of(found).index(moved):] and "struct(response" in plan_of(found)
    expected = [
        (None, "response", '{"response":"nobody"}'), ("a", "response", '{"response":"first","trialId":"a"}'), ("a", "evaluation", '{"trialId":"a"}'),
        ("a", "vote", '{"trialId":"a","judgeId":"j1"}'), ("a", "vote", '{"trialId":"a","judgeId":"j2"}'), ("b", "response", '{"trialId":"b"}'), ("c", "vote", '{"trialId":"c"}'),
    ]
    for ranges in (None, 1, 3):
        rows = select_ops.trial_detail(log, evals, votes, ranges=ranges)
        assert [tuple(r) for r in rows.collect()] == expected
        assert ranges is None or rows.rdd.getNumPartitions() <= ranges
    assert [r.kind for r in select_ops.trial_detail(log, evals, votes, "a", ranges=2).collect()] == ["response", "evaluation", "vote", "vote"]


def test_exports_carry_what_they_show_of_evaluations(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    reduced = [line for line in plan_of(export_rows(m.responses(spark, sf), m.evals(spark, sf), m.votes(spark, sf))).splitlines() if "max_by(struct(outcome" in line]
    assert reduced and not any("details" in line or "dataset" in line for line in reduced)
