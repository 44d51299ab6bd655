"""Catalogs, contexts, blocks, pages and corpora on disk; the study and the run manifest as files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from trialscape.operators import checks
from trialscape.plans.analysis import write_analysis
from trialscape.sources import artifacts, catalog, sinks
from trialscape.sources.sinks import write_tables
from trialscape.streaming import logs

from test_study_and_streams import study_logs


def test_tasks_and_instances(spark, tmp_path):
    tasks = [{"id": " a ", "statement": "s", "tags": ["t"], "validation": {"type": "judge"}}, {"id": "b", "validation": {"type": "repoqa-scorer", "threshold": 0.5}, "contextBlock": ["x"]}]
    (tmp_path / "tasks.json").write_text(json.dumps({"datasetId": "d", "version": "1", "tasks": tasks}, indent=1))
    rows = catalog.read_tasks(spark, str(tmp_path)).collect()
    assert [(r.ord, r.taskId, r.statement, r.tags, r.validationType, r.contextBlocks) for r in rows] == [(0, "a", "s", ["t"], "judge", []), (1, "b", "", [], "repoqa-scorer", ["x"])]
    assert catalog.read_instances(spark, str(tmp_path)).count() == 0
    for bad in ({"id": "c", "validation": {"type": "guess"}}, {"id": "c", "question": "old", "validation": {"type": "judge"}}, {"id": "c"}):
        (tmp_path / "tasks.json").write_text(json.dumps({"datasetId": "d", "tasks": [bad]}))
        with pytest.raises(Exception, match="task not accepted: c"):
            catalog.read_tasks(spark, str(tmp_path)).collect()
    (tmp_path / "tasks.instance.json").write_text(json.dumps({"datasetId": "d", "instances": [{"instanceId": "i", "tasks": [{"id": "a", "parameters": {"k": "v"}}, {"id": "b"}]}, {"instanceId": "j"}]}))
    assert [(r.instanceId, r.taskId, r.parameters) for r in catalog.read_instances(spark, str(tmp_path)).collect()] == [("i", "a", {"k": "v"}), ("i", "b", {}), ("j", None, {})]


def test_contexts_blocks_and_pages(spark, tmp_path):
    for name, blocks in (("i", {"blocks": {"b1": {"title": "T", "content": "c"}, "b2": "plain", "b3": None}}), ("j", {"b1": {"content": "x"}, "b4": {}})):
        (tmp_path / "context" / name).mkdir(parents=True)
        (tmp_path / "context" / name / catalog.fixed.CONTEXT_FILES["blocks"]).write_text(json.dumps(blocks))
    (tmp_path / "context" / "i" / "notes.txt").write_text("a\nb\n")
    assert [(r.instanceId, r.representation, r.content) for r in catalog.read_contexts(spark, str(tmp_path), "notes.txt").collect()] == [("i", "notes.txt", "a\nb\n")]
    found = {(r.instanceId, r.blockId, r.title, r.content) for r in catalog.read_blocks(spark, str(tmp_path)).collect()}
    assert found == {("i", "b1", "T", "c"), ("i", "b2", None, "plain"), ("j", "b1", "b1", "x"), ("j", "b4", "b4", "")}
    instances = spark.createDataFrame([("i",), ("j",), ("k",)], "instanceId STRING")
    assert [r.instanceId for r in catalog.missing_contexts(instances, catalog.read_contexts(spark, str(tmp_path), "notes.txt")).orderBy("instanceId").collect()] == ["j", "k"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_bytes("é".encode())
    (tmp_path / "pages" / "b.html").write_bytes(b"\xe9")
    assert [r.html for r in catalog.read_pages(spark, str(tmp_path / "pages")).collect()] == ["é", "é"]
    (tmp_path / "ids.txt").write_text(" t1 \n\n  \nt2\n")
    assert sorted(r.trialId for r in artifacts.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["t1", "t2"]


def test_corpora(spark, tmp_path):
    needle = {"name": "f", "path": "a.py", "description": "d", "start_line": 1, "end_line": 2}
    body = {"python": [{"repo": "r", "content": {"a.py": "x\n", "b.py": "y"}, "needles": [needle]}, {"repo": "s", "content": {"c.py": ""}}], "go": []}
    (tmp_path / "corpus.json").write_text(json.dumps(body))
    (tmp_path / "corpus.json.gz").write_bytes(gzip.compress(json.dumps(body).encode()))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"language": k, "repo_ord": i, **r}) for k, many in body.items() for i, r in enumerate(many)))
    whole = [catalog.read_corpus(spark, str(tmp_path / n)) for n in ("corpus.json", "corpus.json.gz")] + [catalog.read_corpus_lines(spark, str(tmp_path / "lines.json"))]
    for repos in whole:
        assert {(r.repo, r.repo_ord, r.path, r.source) for r in catalog.corpus_files(repos).collect()} == {("r", 0, "a.py", "x\n"), ("r", 0, "b.py", "y"), ("s", 1, "c.py", "")}
        assert [(r.repo, r.needle_count, r.needle_ord, r.name, r.end_line) for r in catalog.corpus_needles(repos).collect()] == [("r", 1, 0, "f", 2)]


def test_study_as_files(spark, tmp_path):
    names = write_analysis(*study_logs(spark), [f"c{i}" for i in range(4)], str(tmp_path / "study"))
    assert len(names) == 43 and all((tmp_path / "study" / n).is_dir() for n in names)
    row = spark.read.csv(str(tmp_path / "study" / "summary_overall"), header=True).collect()[0]
    assert (row.runs, row.total_cost_tokens_corrected_sum) == ("32", "608")
    with pytest.raises(Exception, match="already exists"):
        write_tables({names[0]: spark.range(1)}, str(tmp_path / "study"))
    write_tables({names[0]: spark.range(1)}, str(tmp_path / "study"), force=True)


def test_configurations_of_several_manifests(spark):
    rows = spark.createDataFrame([("e1", "t1", "c"), ("e2", "t2", "c"), ("e2", "t3", "d")], "experimentId STRING, trialId STRING, configurationId STRING")
    defined = spark.createDataFrame([("e1", "c", "s1", "r", "o"), ("e2", "c", "s2", "r", "o"), ("e2", "c", "s2", "r", "o")], "experimentId STRING, configurationId STRING, strategy STRING, representation STRING, surface STRING")
    found = {r.trialId: r.definition and r.definition.strategy for r in checks.with_config(rows, defined).collect()}
    assert found == {"t1": "s1", "t2": "s2", "t3": None}


def test_a_log_folder_as_a_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(3):
        (tmp_path / "log" / f"{i}.json").write_text(json.dumps({"trialId": f"t{i}", "status": "success"}) + "\n")
    stream = logs.stream_artifact(spark, str(tmp_path / "log"), "responses", files_per_batch=1).select("trialId", "status")
    query = logs.write_deltas(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    logs.run_to_end(query)
    assert sorted((r.trialId, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("t0", 0), ("t1", 1), ("t2", 2)] or spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_every_value_is_a_file_in_the_folder_of_its_task_and_a_task_reads_many(spark, tmp_path, monkeypatch):
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    values = [b"\xe9", b"two\nlines", None, b"", *[b"same"] * 96]
    df = spark.createDataFrame([(v,) for v in values], "value BINARY").select(F.col("value").cast("string").alias("value")).repartition(3)
    expected = sorted(["\u00e9\n", "two\nlines\n", "\n", "\n", *["same\n"] * 96])
    try:
        for kind in ("files", "store"):
            if kind == "store":
                monkeypatch.setattr(sinks, "local_folder", lambda spark, path: None)
            path = str(tmp_path / kind)
            sinks.write_each(df, path)
            assert sorted(p.name for p in (tmp_path / kind).iterdir() if p.is_dir()) == ["part=0", "part=1", "part=2"]
            spark.conf.set(name, before)
            pages = catalog.read_pages(spark, path)
            assert pages.rdd.getNumPartitions() < 10 and sorted(r.html for r in pages.collect()) == expected
        monkeypatch.undo()
        sinks.write_each(df.where("false"), str(tmp_path / "none"))
        assert catalog.read_pages(spark, str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.set(name, before)


def test_a_task_that_runs_twice_leaves_one_folder(tmp_path, monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(sinks.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 4))
    rows = [SimpleNamespace(value=b"a"), SimpleNamespace(value=None)]
    for _ in range(2):
        sinks._write_files(str(tmp_path), iter(rows))
    assert [p.name for p in tmp_path.iterdir()] == ["part=4"]
    assert sorted(p.read_bytes() for p in (tmp_path / "part=4").iterdir()) == [b"\n", b"a\n"]
