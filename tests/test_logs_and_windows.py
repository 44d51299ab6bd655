"""Line numbers of split logs, ranks and running sums over ranges, context windows by token offsets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trialscape.functions.stats import running_position, running_sum
from trialscape.operators import corpus
from trialscape.sources.artifacts import corrupt_lines, load_runs, read_artifact, require_objects


def split_session(spark, size):
    small = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        small.conf.set(key, size)
    return small


def test_line_numbers_of_a_log_read_in_splits(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("a", "b", "c"):
        lines = []
        for number in range(1, 400):
            kind = rng.randrange(8)
            text = {0: "", 1: "  ", 2: '{"trialId": "x"', 3: "[1]", 4: '"é' + "y" * rng.randrange(300) + '"'}.get(kind, json.dumps({"trialId": f"t{number}", "status": "é" * rng.randrange(40)}))
            lines.append(text)
            if kind in (2, 3, 4):
                want.append((name, number, text))
        (tmp_path / name).mkdir()
        end = {"a": "\n", "b": "\r\n", "c": "\n"}[name]
        (tmp_path / name / "responses.jsonl").write_bytes((end.join(lines) + (end if name != "c" else "")).encode())
    dirs = [str(tmp_path / d) for d in "abc"]
    for size in ("200", "1500", "100m"):
        small = split_session(spark, size)
        found = corrupt_lines(small, dirs, "responses")
        got = sorted((r.file.split("/")[-2], r.line_number, r.line) for r in found.collect())
        assert got == sorted(want)
    assert small.read.text(dirs[0] + "/responses.jsonl").rdd.getNumPartitions() == 1
    assert split_session(spark, "200").read.text(dirs[0] + "/responses.jsonl").rdd.getNumPartitions() > 20
    with pytest.raises(ValueError, match=rf"a/responses.jsonl:{want[0][1]}: not a JSON object"):
        require_objects(split_session(spark, "200"), dirs)
    assert read_artifact(spark, dirs, "responses", strict=False).count() == sum(1 for d in "abc" for x in (tmp_path / d / "responses.jsonl").read_text().splitlines() if x.startswith("{") and x.endswith("}"))


def test_load_runs_names_the_broken_line(spark, tmp_path):
    (tmp_path / "trials.jsonl").write_text('{"trialId": "a"}\n\n{"trialId": \n')
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ValueError, match="trials.jsonl:3: not a JSON object"):
        load_runs(spark, [str(tmp_path)], check_lines=True)
    (tmp_path / "trials.jsonl").write_text('{"trialId": "a"}\n')
    assert load_runs(spark, [str(tmp_path)], check_lines=True).trials.count() == 1
    require_objects(spark, str(tmp_path / "nowhere"))


def test_positions_and_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, None]), i, rng.randrange(9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g STRING, v INT, id INT, w INT").repartition(7)
    low = lambda x: (x is not None, x or 0)
    want = {}
    for group in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (low(r[1]), -r[2])), 1):
            want[r[2]] = n
    got = running_position(frame, ["g"], [F.col("v"), F.desc("id")], "n")
    assert got.columns == ["g", "v", "id", "w", "n"] and {r.id: r.n for r in got.collect()} == want
    alone = running_position(frame, [], [F.desc("id")], "n").collect()
    assert all(r.n == 3000 - r.id for r in alone)
    sums = running_sum(got, ["g"], "n", "w", "total", block=50).collect()
    assert all(r.total == sum(x[3] for x in rows if x[0] == r.g and want[x[2]] <= r.n) for r in random.Random(3).sample(sums, 200))
    assert running_position(frame.where("false"), ["g"], [F.col("v")], "n").count() == 0


def test_one_value_is_ranked_by_many_tasks(spark):
    """All rows agree in the group and the leading column; the ties still deal them over the ranges."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart, as large ones do
    rows = apart.range(20000).select(F.lit("all").alias("g"), F.lit(0.5).alias("v"), F.xxhash64("id").alias("id"))
    ranges = rows.repartitionByRange(F.col("g"), F.col("v"), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 12000
    got = running_position(rows, ["g"], [F.col("v"), F.col("id")], "n")
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 20001))


@pytest.mark.parametrize("step", [1, 7, 1024])
def test_context_windows(spark, step):
    rng = random.Random(4)
    files = [(f"r{r}", i, f"f{i}", "x" * rng.choice([0, 3, 9, 40, 4000])) for r in range(3) for i in range(60)]
    asked = [(f"n{k}", f"r{rng.randrange(3)}", f"f{rng.randrange(60)}", rng.choice([1, 30, 400, 5000]), rng.choice([0.0, 0.3, 0.99])) for k in range(60)] + [("lost", "r0", "none", 9, 0.5)]
    packed = corpus.pack_context(spark.createDataFrame(asked, "instance_id STRING, repo STRING, path STRING, requested_context_tokens INT, position_ratio DOUBLE"),
                                 spark.createDataFrame(files, "repo STRING, pos LONG, path STRING, source STRING"), bucket=step)
    tokens = {(r, i): max(1, len(s) // 4) for r, i, _, s in files}
    want = set()
    for name, repo, path, budget, ratio in asked[:-1]:
        at = int(path[1:])
        left = max(0, budget - tokens[repo, at])
        want.add((name, repo, at))
        for way, room in ((-1, int(left * ratio)), (1, left - int(left * ratio))):
            i = at + way
            while (repo, i) in tokens and tokens[repo, i] <= room:
                room -= tokens[repo, i]
                want.add((name, repo, i))
                i += way
    assert {(r.instance_id, r.repo, r.pos) for r in packed.collect()} == want
