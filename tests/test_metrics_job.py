"""Small runs on disk through the whole metrics job; expected values worked out by hand."""

import json

import pytest

from trialscape.plans.metrics import compute_metrics, run_facts, traces_of
from trialscape.operators import checks, metrics
from trialscape.operators.select import Selector, failure_cases, select_rows
from trialscape.sources.artifacts import load_runs, read_artifact
from trialscape.sources.manifest import configurations

TREATMENT = {"configurationId": "c1", "strategy": "local_mcp", "representation": "json", "surface": "ops"}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def trial(tid, **more):
    return {"trialId": tid, "experimentId": "exp", "dataset": {"id": "d", "version": "v1"}, "instanceId": "i1", "taskId": "q1", "taskTags": ["tag"],
            "modelId": "m1", "model": "m-one", "repeatIndex": 1, "validationType": "judge", **TREATMENT, "metadata": dict(TREATMENT), **more}


def make_run(root, trials, responses=(), evals=(), votes=()):
    root.mkdir(parents=True, exist_ok=True)
    (root / "manifest.json").write_text(json.dumps({
        "provisioningArtifactVersion": 2, "experimentId": "exp",
        "configurations": {"c1": {k: v for k, v in TREATMENT.items() if k != "configurationId"}},
        "surfaces": {"ops": {"type": "operations", "operations": ["find"]}}, "dataset": {"id": "d", "contentHash": "h"},
    }))
    lines(root / "trials.jsonl", trials)
    for name, rows in (("responses", responses), ("evals", evals), ("judge_votes", votes)):
        if rows:
            lines(root / f"{name}.jsonl", rows)
    return str(root)


def judged(tid, correctness="meets", completeness="partial", agree=(1, 0.0), **more):
    outcome = {"correctness": {"rating": correctness, "agreement": agree[0]}, "completeness": {"rating": completeness, "agreement": agree[1]}}
    return {**trial(tid), "status": "evaluated", "evaluationMethod": "judge", "judgeCount": 2, "judgeErrorCount": 0, "outcome": outcome, **more}


def vote(tid, judge, correctness, completeness, **more):
    return {"trialId": tid, "judgeId": judge, "criterias": {"correctness": {"rating": correctness}, "completeness": {"rating": completeness}}, **more}


def test_planned_only_rows_survive(spark, tmp_path):
    facts = run_facts(load_runs(spark, [make_run(tmp_path / "a", [trial("t1")])]))
    row = facts.collect()[0]
    assert (row.response_present, row.evaluation_present, row.modelName) == (False, False, "m-one")
    assert failure_cases(facts).count() == 0


def test_split_votes_and_last_line_wins(spark, tmp_path):
    first = {**trial("t1"), "status": "error", "response": "x", "timing": {}}
    second = {**trial("t1"), "status": "success", "response": "y" * 300, "timing": {}, "metricsSummary": {"totalTokens": 7, "toolCalls": True}}
    run = make_run(tmp_path / "a", [trial("t1")], [first, second], [judged("t1")],
                   [vote("t1", "a", "meets", "partial"), vote("t1", "b", "meets", "misses")])
    row = run_facts(load_runs(spark, [run])).collect()[0]
    assert row.execution_status == "success" and row.total_tokens == 7.0 and row.tool_calls is None
    assert (row.primary_metric_name, row.primary_success, row.primary_score) == ("judge_meets", False, 0.75)
    assert (row.judge_agreement_mean, row.judge_unanimous) == (0.5, False)
    assert row.response_excerpt == "y" * 280 + "…"


def test_unanimity_without_votes_uses_agreement(spark, tmp_path):
    run = make_run(tmp_path / "a", [trial("t1"), trial("t2"), trial("t3")], evals=[judged("t1", agree=(True, True)), judged("t2"), judged("t3", agree=("yes", 1))])
    rows = {r.trialId: r.judge_unanimous for r in run_facts(load_runs(spark, [run])).collect()}
    assert rows == {"t1": True, "t2": False, "t3": None}


def test_scorer(spark, tmp_path):
    scored = {**trial("t1", validationType="repoqa-scorer"), "status": "evaluated", "evaluationMethod": "repoqa-scorer",
              "details": {"outcome": {"passed": True}, "repoqa": {"bestSimilarScore": 0.875}}}
    row = run_facts(load_runs(spark, [make_run(tmp_path / "a", [trial("t1")], evals=[scored])])).collect()[0]
    assert (row.primary_metric_name, row.primary_success, row.primary_score, row.evaluation_method_consistent) == ("pass", True, 0.875, False)


@pytest.mark.parametrize("nested", [True, False])
def test_trace_flags(spark, tmp_path, nested):
    response = {**trial("t1"), "status": "success", "response": "r", "timing": {}, "metricsSummary": {"mcpToolCalls": 1, "inputTokens": 3}}
    run = make_run(tmp_path / "a", [trial("t1")], [response])
    body = {"nativeMcp": {"visibleToolCallCount": 1}, "serverMcp": [{"toolName": "x"}]}
    (tmp_path / "a/traces/executions").mkdir(parents=True)
    (tmp_path / "a/traces/executions/t1.json").write_text(json.dumps({"trace": body} if nested else body))
    logs = load_runs(spark, [run])
    row = run_facts(logs, traces_of(spark, logs, [run], "executions")).collect()[0]
    assert row.execution_trace_available and row.native_mcp_observable and row.server_mcp_observable and row.usage_observable


def test_selector_and_grouping(spark, tmp_path):
    ok = {**trial("t1"), "status": "success", "response": "r", "timing": {}}
    bad = {**trial("t2", modelId="m2"), "status": "error", "response": "", "timing": {}}
    facts = run_facts(load_runs(spark, [make_run(tmp_path / "a", [trial("t1"), trial("t2", modelId="m2")], [ok, bad])]))
    chosen = select_rows(facts, Selector(status=("success",)), "execution_status")
    table = metrics.effectiveness(chosen, ["dataset_id", "modelId"]).collect()
    assert [(r.dataset_id, r.modelId, r.n_trials) for r in table] == [("d", "m1", 1)]


def test_contract_is_refused(spark, tmp_path):
    bent = trial("t2", representation="html")
    a = make_run(tmp_path / "a", [trial("t1"), trial("t1"), bent, trial("t3", taskTags=["bad|tag"]), trial("t4", question="old")])
    b = make_run(tmp_path / "b", [trial("t3")])
    logs = load_runs(spark, [a, b])
    found = {(r.rule, r.key) for r in checks.contract_violations(logs.trials, logs.responses, logs.evals, logs.manifests).collect()}
    assert found >= {("duplicate_in_log", "t1"), ("treatment_differs", "t2"), ("pipe_in_tag", "t3"), ("duplicate_across_inputs", "t3"), ("legacy_column", "t4")}
    with pytest.raises(ValueError):
        checks.refuse(checks.contract_violations(logs.trials, logs.responses, logs.evals, logs.manifests))


def test_violations_agree_with_the_single_checks(spark, tmp_path):
    other = {**TREATMENT, "surface": "web"}
    a = make_run(tmp_path / "a", [
        trial("t1"), trial("t1", **other), trial("t2", metadata={}), trial("t3", taskTags=["x|y", "z"]), trial("t4", question="old"),
        trial(""), trial("", **other), trial(None), trial("t5", configurationId="c9"), trial("t6"), trial("t7", taskTags=None), trial("t8", taskTags=[])],
        [{**trial("t1"), "status": "success", "timing": {}}, trial("t6"), {**trial("t7", answer="a"), "status": "error"}, {**trial("t9"), "timing": {}}],
        [judged("t6", strategy=None), judged("t8"), judged("t8")])
    b = make_run(tmp_path / "b", [trial("t3"), trial("t6"), trial("t6"), trial("t10")], evals=[judged("t2", question="kept")])
    logs = load_runs(spark, [a, b])
    found = checks.contract_violations(logs.trials, logs.responses, logs.evals, logs.manifests)
    rows = [(r.rule, r.key) for r in found.collect()]
    definitions = configurations(logs.manifests)
    every = logs.trials.select("trialId", "metadata", *checks.TREATMENT)
    for df in (logs.responses, logs.evals):
        every = every.unionByName(df.select(*every.columns))
    one = definitions.dropDuplicates(["configurationId"])
    single = {
        "duplicate_in_log": checks.dup_within(logs.trials), "duplicate_across_inputs": checks.dup_across(logs.trials),
        "unknown_configuration": checks.unknown_config(every, definitions), "treatment_differs": checks.bad_treatments(every, one),
        "treatment_conflict": checks.treatment_conflicts(every), "pipe_in_tag": checks.bad_tags(logs.trials),
        "legacy_column": checks.legacy_rows(logs.trials).unionByName(checks.legacy_rows(logs.responses)), "not_a_response": checks.not_responses(logs.responses),
    }
    want = {(rule, r.trialId) for rule, df in single.items() for r in df.select("trialId").collect()}
    assert set(rows) == want and {rule for rule, _ in want} == set(single)
    trials_only = ("duplicate_across_inputs", "treatment_conflict")
    assert all(rows.count(x) == 1 for x in rows if x[0] in trials_only)


def test_broken_line_fails_the_job(spark, tmp_path):
    run = make_run(tmp_path / "a", [trial("t1")])
    with open(tmp_path / "a/trials.jsonl", "a") as out:
        out.write('{"trialId": \n')
    with pytest.raises(Exception, match="not a JSON object"):
        read_artifact(spark, run, "trials").collect()
    assert read_artifact(spark, run, "trials", strict=False).count() == 1


def test_missing_trials(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        load_runs(spark, [str(tmp_path / "empty")])
    good = make_run(tmp_path / "a", [trial("t1")])
    with pytest.warns(UserWarning):
        assert load_runs(spark, [good, str(tmp_path / "empty")]).trials.count() == 1


def test_whole_job_writes_ten_tables(spark, tmp_path):
    run = make_run(tmp_path / "a", [trial("t1"), trial("t2", taskId="q2")], evals=[judged("t1", completeness="meets")])
    out = tmp_path / "out"
    compute_metrics(spark, [run], str(out))
    assert {p.name for p in out.iterdir()} == {
        "trial_metrics.csv", "aggregate_metrics.csv", "dimension_summary.csv", "failure_cases.csv", "dimensions", "summary.json", "metrics-manifest.json"}
    text = "".join(p.read_text() for p in sorted((out / "dimensions/effectiveness.csv").glob("part-*")))
    assert "d,c1,2,1,judge_meets,1,1,1,1," in text
    with pytest.raises(Exception):
        compute_metrics(spark, [run], str(out))
