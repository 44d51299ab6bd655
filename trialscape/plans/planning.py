"""From an experiment design to planned trials (PLN-1..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscape.operators.planning import canonical_id, expand_trials, merge_params, render, scope, short_ids, with_parameters


def plan_trials(experiment: str, tasks: DataFrame, instances: DataFrame, instance_tasks: DataFrame, models: DataFrame,
                configurations: DataFrame, repeats: int = 1, task_scope: list[str] | None = None,
                instance_scope: list[str] | None = None, common: dict[str, str] | None = None) -> DataFrame:
    """tasks(datasetId, taskId, statement, tags, validationType, contextBlocks), instances(datasetId, instanceId),
    instance_tasks(instanceId, taskId, parameters), models(provider, modelId, modelName),
    configurations(configurationId, strategy, representation, surface)."""
    cells = expand_trials(
        scope(instances.select("datasetId", "instanceId"), "instanceId", instance_scope),
        scope(tasks, "taskId", task_scope), models, configurations, repeats,
    )
    rows = with_parameters(cells, instance_tasks).withColumn("experimentId", F.lit(experiment))
    rows = rows.withColumns(
        {"taskTemplate": F.col("statement"), "taskStatement": render("statement", "parameters"), "canonicalId": canonical_id()}
    )
    shared = F.create_map(*[F.lit(x) for kv in (common or {}).items() for x in kv]).cast("map<string,string>")
    rows = rows.withColumn("params", merge_params(shared, F.lit(None).cast("map<string,string>"), "modelName"))
    metadata = F.struct("canonicalId", "configurationId", "strategy", "representation", "surface")
    return short_ids(rows, "canonicalId").withColumn("metadata", metadata).drop("statement")
