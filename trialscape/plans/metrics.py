"""Logs of one or more experiments in, ten metric tables out (SNK-9)."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from trialscape.operators import checks, metrics
from trialscape.operators.facts import FACT_COLUMNS, build_trial_facts
from trialscape.operators.select import Selector, failure_cases, select_eval, select_rows
from trialscape.session import drop_scratch, scratch_path
from trialscape.sources.artifacts import RunLogs, load_runs, path_exists
from trialscape.sources.manifest import configurations
from trialscape.sources.sinks import metrics_manifest, run_manifest, write_csv, write_summary
from trialscape.sources.traces import read_traces, resolve_traces

DEFAULT_GROUP = ["dataset_id", "configurationId"]


def run_facts(logs: RunLogs, execution_traces: DataFrame | None = None, eval_traces: DataFrame | None = None) -> DataFrame:
    return build_trial_facts(logs.trials, logs.responses, logs.evals, logs.votes, execution_traces, eval_traces)


def traces_of(spark: SparkSession, logs: RunLogs, dirs: list[str], kind: str) -> DataFrame | None:
    """Trace of each trial, found by reference or by name; None when no directory has any."""
    from trialscape.operators.latest import latest_of

    present = [d for d in dirs if path_exists(spark, f"{d.rstrip('/')}/traces/{kind}")]
    if not present:
        return None
    rows = logs.responses if kind == "executions" else logs.evals
    refs = latest_of(rows, ["trialId"], ["traceRef"])
    owned = logs.trials.select("trialId", "experimentDir").join(refs, "trialId", "left")
    found = resolve_traces(owned, read_traces(spark, present, kind))
    return found.select("trialId", found["trace"].alias("body")).where("body IS NOT NULL")


def metric_tables(facts: DataFrame, gb: list[str] | None = None, accuracy: int | None = None) -> dict[str, DataFrame]:
    """The tables by name, each in canonical order."""
    group = metrics.check_group(gb or DEFAULT_GROUP)
    order = metrics.canonical_order
    identity = ["dataset_id", "experimentId", "trialId"]
    return {
        "trial_metrics": order(facts.select(*FACT_COLUMNS), identity),
        "aggregate_metrics": order(metrics.aggregate_metrics(facts, group, accuracy), group),
        "dimension_summary": order(metrics.dimension_summary(facts, group), ["dimension", "group_key", "metric"]),
        "failure_cases": order(failure_cases(facts), identity),
        "dimensions/effectiveness": order(metrics.effectiveness(facts, group, accuracy), group),
        "dimensions/efficiency": order(metrics.efficiency(facts, group, accuracy), group),
        "dimensions/robustness": order(metrics.robustness(facts, group), [*group, "robustness_axis"]),
        "dimensions/evaluation_reliability": order(metrics.eval_reliability(facts, group, accuracy), group),
        "dimensions/observability": order(metrics.observability(facts, group), group),
    }


def compute_metrics(spark: SparkSession, dirs: list[str], out: str, gb: list[str] | None = None, selector: Selector | None = None,
                    eval_status: tuple = (), not_eval_status: tuple = (), force: bool = False, accuracy: int | None = None) -> None:
    """The whole job. The contract is checked first; the facts are written once to the shared scratch folder, because
    all ten tables read them, and removed at the end."""
    logs = load_runs(spark, dirs)
    checks.refuse(checks.contract_violations(logs.trials, logs.responses, logs.evals, logs.manifests))
    facts = run_facts(logs, traces_of(spark, logs, dirs, "executions"), traces_of(spark, logs, dirs, "evals"))
    facts = select_eval(select_rows(facts, selector or Selector(), "execution_status"), eval_status, not_eval_status)
    mode = "overwrite" if force else "error"
    kept = scratch_path(spark, "facts")
    try:
        facts.write.parquet(kept)
        facts = spark.read.parquet(kept)
        for name, table in metric_tables(facts, gb, accuracy).items():
            write_csv(table, f"{out}/{name}.csv", mode=mode)
        group = metrics.check_group(gb or DEFAULT_GROUP)
        write_summary(metrics.summary(facts, accuracy, group), f"{out}/summary.json", mode)
        inputs = metrics_manifest(logs.trials, logs.responses, logs.evals, logs.votes, logs.manifests)
        asked = asdict(selector or Selector())
        chosen = {k: [str(x) for x in v] for k, v in [*asked.items(), *((f"not_{k}", v) for k, v in asked["without"].items())] if v and k != "without"}
        defined = None if logs.manifests is None else configurations(logs.manifests)
        write_summary(run_manifest(inputs, group, chosen, configurations=defined), f"{out}/metrics-manifest.json", mode)
    finally:
        drop_scratch(spark, kept)
