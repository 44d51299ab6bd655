"""Operators against plain Python on seeded random rows, and small worked cases."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialscape.functions import scalar, stats, text
from trialscape.operators import corpus, metrics, planning, ranking, segments, study, symbols, votes
from trialscape.operators.latest import dedup_judges, first_vote, latest
from trialscape.sources.sinks import csv_table


def percentile(values, q):
    data = sorted(values)
    at = (len(data) - 1) * q / 100.0
    lo, hi = math.floor(at), math.ceil(at)
    return data[lo] + (data[hi] - data[lo]) * (at - lo)


def test_quantiles_match_plain_python_even_for_one_huge_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 50), 7.0, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(7)
    got = {r.k: r for r in stats.group_quantiles(df, ["k"], {"m": ("v", 50), "p": ("v", 95), "lo": ("v", 0), "hi": ("v", 100)}).collect()}
    for key in {"hot", "a", "b", None}:
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key].m == pytest.approx(percentile(values, 50)) and got[key].p == pytest.approx(percentile(values, 95))
        assert (got[key].lo, got[key].hi) == (min(values), max(values))


def test_latest_ignores_row_order_and_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None, ""]), i, f"v{i}") for i in range(200)]
    want = {k: max(i for x, i, _ in rows if x == k) for k in "abc"}
    for parts in (1, 5):
        shuffled = rows[:]
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled + shuffled[:50], "trialId STRING, seq INT, v STRING").repartition(parts)
        assert {r.trialId: r.seq for r in latest(df, ["trialId"]).collect()} == want


def vote_rows(spark, rows):
    ddl = ("trialId STRING, judgeId STRING, error STRING, status STRING, seq INT, "
           "criterias STRUCT<correctness: STRUCT<rating: STRING, justification: STRING>, completeness: STRUCT<rating: STRING, justification: STRING>>")
    return spark.createDataFrame([(t, j, e, None, i, ((c, None), (k, None))) for i, (t, j, e, c, k) in enumerate(rows)], ddl)


def test_plurality_ties_and_unknown_ratings(spark):
    df = vote_rows(spark, [
        ("t1", "a", None, "Partially meets", "odd"), ("t1", "b", None, " MEETS", "misses"),
        ("t2", "a", "x", "meets", "meets"), ("t3", "a", None, "zeta", "beta"), ("t3", "b", None, "eta", None),
    ])
    got = {r.trialId: tuple(r)[1:] for r in votes.outcome(df).collect()}
    assert got == {"t1": ("meets", False, "misses", False), "t3": ("eta", False, "misses", False)}


def test_consensus_against_three_expected_judges(spark):
    df = vote_rows(spark, [("t1", "a", None, "meets", "meets"), ("t1", "b", None, "meets", "misses"), ("t1", "b", None, "misses", "meets"), ("t1", "c", None, "meets", "meets"), ("t2", "a", None, "meets", None)])
    table = {(r.trialId, r.criterion): r for r in votes.vote_consensus(votes.votes_long(df), 3, ["a", "b"]).collect()}
    row = table["t1", "correctness"]
    assert (row.ratings_tuple, row.majority_rating, row.unanimous, row.b_rating) == ("meets|misses|meets", "meets", False, "misses")
    assert table["t1", "completeness"].unanimous_meet and not table["t2", "completeness"].has_majority
    assert dedup_judges(votes.votes_long(df)).count() == 8
    assert first_vote(vote_rows(spark, [("t", "a", "e", "x", "x"), ("t", "b", None, "y", "y")])).collect()[0].judgeId == "b"


def test_robustness_counts_groups_without_success_values(spark):
    ddl = ("configurationId STRING, taskId STRING, instanceId STRING, repeatIndex INT, modelId STRING, representation STRING, surface STRING, "
           "primary_success BOOLEAN, primary_score DOUBLE, duration_ms DOUBLE, total_tokens DOUBLE")
    rows = [("c", t, "i", 1, "m", "r", "s", s, x, 1000.0 * n, float(n)) for n, (t, s, x) in enumerate(
        [("q1", True, 1.0), ("q1", False, 0.5), ("q2", True, 1.0), ("q3", None, None)])]
    table = {r.robustness_axis: r for r in metrics.robustness(spark.createDataFrame(rows, ddl), ["configurationId"]).collect()}
    task = table["task"]
    assert (task.n_groups, task.primary_success_rate_mean, task.primary_success_rate_range) == (3, 0.75, 0.5)
    assert task.duration_sec_stddev == pytest.approx(statistics.stdev([0, 1, 2, 3]))
    assert table["model"].n_groups == 1 and table["model"].primary_score_mean is None


def test_pareto_and_positions(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(1, 60)), float(rng.randint(1, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, cost DOUBLE, quality DOUBLE").repartition(5)
    best, want = -1.0, []
    for i, c, q in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if q > best:
            want.append(i)
            best = q
    assert sorted(r.id for r in ranking.pareto(df, "cost", "quality", "id").collect()) == sorted(want)
    order = [r.id for r in ranking.rank_in(df, [], "cost", ["id"]).orderBy("rank_in_entity").collect()]
    assert order == [i for i, *_ in sorted(rows, key=lambda r: (r[1], r[0]))]
    flat = ranking.minmax(df.withColumn("k", F.lit(1.0)), "k", "n").select("n").distinct().collect()
    assert [r.n for r in flat] == [0.5]


def test_short_ids(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("identity"))
    ids = [r.trialId for r in planning.short_ids(df, "identity").collect()]
    assert len(set(ids)) == 500 and {len(i) for i in ids} == {10}
    twice = planning.short_ids(df.unionByName(df), "identity").select(F.length("trialId").alias("n")).distinct().collect()
    assert [r.n for r in twice] == [64]


def test_templates(spark):
    df = spark.createDataFrame([("What role does {person_name} have in {x}?", {"person_name": "Avery", "y": "1"}, "t", "i")],
                               "taskTemplate STRING, parameters MAP<STRING, STRING>, taskId STRING, instanceId STRING")
    assert df.select(planning.render("taskTemplate", "parameters")).collect()[0][0] == "What role does Avery have in ?"
    assert {(r.problem, r.parameter) for r in planning.template_gaps(df).collect()} == {("missing", "x"), ("unused", "y")}


def test_csv_text_follows_the_contract(spark):
    values = [0.5, 2.0, 26612.55, 100000.5, 1234567.25, 0.0000123, 1e20, -0.1, 0.1 + 0.2, None]
    df = spark.createDataFrame([(v, True) for v in values], "v DOUBLE, b BOOLEAN")
    want = [None if v is None else (str(int(v)) if v.is_integer() else f"{v:.6g}") for v in values]
    assert [r.v for r in csv_table(df).collect()] == want


def test_marker_styles_and_overrides(spark):
    body = "# File: a.py\n\nx = 1\n\n// Path: b.js\nlet y\n/* File: c.c */\n<!-- path: a.py -->\n# Repository: r\nz\n"
    df = spark.createDataFrame([("w", body, "d")], "workspaceId STRING, text STRING, default_path STRING")
    assert {r.path: r.content for r in segments.split_files(df).collect()} == {"a.py": "z\n", "b.js": "let y\n", "c.c": ""}


def test_html_unescape_precedes_tag_removal(spark):
    df = spark.createDataFrame([("a&nbsp;b<br/> c &lt;i&gt;d&lt;/i&gt;  e",), ("<p></p>",), (None,)], "h STRING")
    assert [r[0] for r in df.select(text.html_to_text("h")).collect()] == ["a b\nc d e", None, None]


def test_symbol_tree_keeps_ancestors(spark):
    tree = '[{"kind":"class","name":"Greeter","children":[{"kind":"method","name":"greet","code":"def greet"}]},{"kind":"function","name":"é","symbol_id":"given"}, 3]'
    files = spark.createDataFrame([("w", "p.py", tree)], "workspaceId STRING, path STRING, t STRING").select("workspaceId", "path", F.parse_json("t").alias("symbols"))
    flat = symbols.flatten_symbols(files, depth=3)
    rows = {r.qualified_name: r for r in flat.collect()}
    assert set(rows) == {"Greeter", "Greeter.greet", "é"} and rows["é"].symbol_id == "given"
    assert rows["Greeter.greet"].ancestors == [rows["Greeter"].symbol_id]
    assert {r.qualified_name for r in symbols.list_symbols(flat, kind="method").collect()} == {"Greeter", "Greeter.greet"}


def test_symbol_tree_of_any_depth(spark):
    tree = "".join(f'[{{"kind":"class","name":"c{i}","children":' for i in range(11)) + "[]" + "}]" * 11
    files = spark.createDataFrame([("w", "p.py", tree)], "workspaceId STRING, path STRING, t STRING").select("workspaceId", "path", F.parse_json("t").alias("symbols"))
    assert sorted(r.depth for r in symbols.flatten_symbols(files).collect()) == list(range(11))


def test_context_reaches_as_far_as_the_budget(spark):
    files = spark.range(9000).select(F.lit("r").alias("repo"), F.col("id").cast("long").alias("pos"), F.concat(F.lit("f"), F.col("id")).alias("path"), F.lit("x").alias("source"))
    cells = spark.createDataFrame([(f"i{b}", "r", "f4000", b, 0.5) for b in (2000, 7000)], "instance_id STRING, repo STRING, path STRING, requested_context_tokens INT, position_ratio DOUBLE")
    one, two = corpus.pack_context(cells, files, bucket=512), corpus.pack_context(cells, files)
    assert {r.instance_id: r["count"] for r in one.groupBy("instance_id").count().collect()} == {"i2000": 2000, "i7000": 7000}
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_file_order_has_no_longest_chain(spark):
    files = spark.createDataFrame([("r", p) for p in "fedcba"], "repo STRING, path STRING")
    needs = spark.createDataFrame([("r", a, b) for a, b in zip("abcde", "bcdef")], "repo STRING, path STRING, needs STRING")
    assert [(r.path, r.level) for r in corpus.topo_order(files, needs).orderBy("pos").collect()] == list(zip("fedcba", range(6)))


def test_file_order_puts_cycles_last(spark):
    files = spark.createDataFrame([("r", p) for p in "abcd"], "repo STRING, path STRING")
    needs = spark.createDataFrame([("r", "a", "b"), ("r", "c", "d"), ("r", "d", "c"), ("r", "b", "missing")], "repo STRING, path STRING, needs STRING")
    assert [r.path for r in corpus.topo_order(files, needs).orderBy("pos").collect()] == ["b", "a", "c", "d"]


def test_numbers_and_years(spark):
    df = spark.sql("SELECT parse_json('{\"a\": true, \"b\": \"7\", \"c\": 7}') AS v, 'in 1999, not 12005, doi.org/10.1/x). 2004' AS t")
    row = df.select(*[scalar.variant_number(F.col("v"), f"$.{k}").alias(k) for k in "abc"], scalar.years("t").alias("y")).collect()[0]
    assert (row.a, row.b, row.c, row.y) == (None, None, 7.0, [1999, 2004])


def test_join_without_keys_takes_the_one_row(spark):
    left = spark.createDataFrame([(1,), (None,)], "a INT")
    right = spark.createDataFrame([(7, None)], "b INT, c STRING")
    for how in ("left", "inner"):
        joined = stats.null_safe_join(left, right, [], how)
        assert joined.columns == ["a", "b", "c"] and [tuple(r) for r in joined.orderBy("a").collect()] == [(None, 7, None), (1, 7, None)]
        assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()
    none = right.where("b > 7")
    assert stats.null_safe_join(left, none, []).where("b IS NULL").count() == 2 and stats.null_safe_join(left, none, [], "inner").count() == 0


def test_whole_table_statistics(spark):
    """Without groups: quartiles and whiskers over all rows, also of an empty table."""
    rows = spark.createDataFrame([(float(i),) for i in range(1, 12)] + [(100.0,), (None,)], "v DOUBLE")
    found = stats.group_quantiles(rows, [], {"q1": ("v", 25), "m": ("v", 50)}).collect()
    assert [tuple(r.asDict()[k] for k in ("q1", "m")) for r in found] == [(3.75, 6.5)]
    box = study.box_stats(rows, [], "v").collect()
    assert [(r.n, r.median, r.whisker_low, r.whisker_high, r.outliers) for r in box] == [(12, 6.5, 1.0, 11.0, 1)]
    empty = study.box_stats(rows.where("v < 0"), [], "v").collect()
    assert [(r.n, r.median, r.whisker_low) for r in empty] == [(0, None, None)]
