"""Row selection (FLT-*). All predicates are plain columns, so they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import first_usable
from trialscape.operators.pending import fill_from_trials

COLUMN_OF = {
    "provider": "provider",
    "instance": "instanceId",
    "task": "taskId",
    "configuration": "configurationId",
    "strategy": "strategy",
    "representation": "representation",
    "surface": "surface",
    "repetition": "repeatIndex",
    "trial": "trialId",
}
BY_KEYS = {
    "configuration": "configurationId",
    "strategy": "strategy",
    "representation": "representation",
    "surface": "surface",
    "instance": "instanceId",
}


@dataclass(frozen=True)
class Selector:
    """Values to keep and values to drop, per dimension; an empty tuple means no condition."""

    provider: tuple = ()
    model: tuple = ()
    instance: tuple = ()
    task: tuple = ()
    configuration: tuple = ()
    strategy: tuple = ()
    representation: tuple = ()
    surface: tuple = ()
    repetition: tuple = ()
    trial: tuple = ()
    status: tuple = ()
    without: dict = field(default_factory=dict)

    def __post_init__(self):
        known = {f.name for f in fields(self)} - {"without", "trial"}
        unknown = set(self.without) - known
        if unknown:
            raise ValueError(f"cannot exclude by {sorted(unknown)}")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _member(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _model_column(df: DataFrame) -> str:
    return "modelName" if "modelName" in df.columns else "model"


def predicate(df: DataFrame, selector: Selector, status: str = "status") -> Column:
    """FLT-1..4. Keeping tests membership, so null fails; dropping lets null rows stay. A model is
    meant by its id or its name."""
    column_of = {**COLUMN_OF, "status": status}
    conditions = []
    for name, column in column_of.items():
        if getattr(selector, name):
            conditions.append(_member(column, getattr(selector, name)))
        if selector.without.get(name):
            conditions.append(~_member(column, selector.without[name]))
    name = _model_column(df)
    if selector.model:
        conditions.append(_member("modelId", selector.model) | _member(name, selector.model))
    if selector.without.get("model"):
        dropped = selector.without["model"]
        conditions.append(~(_member("modelId", dropped) | _member(name, dropped)))
    return _all(conditions)


def select_rows(df: DataFrame, selector: Selector, status: str = "status") -> DataFrame:
    return df.where(predicate(df, selector, status))


def select_eval(df: DataFrame, include: tuple = (), exclude: tuple = ()) -> DataFrame:
    """FLT-5 on fact rows."""
    conditions = []
    if include:
        conditions.append(_member("evaluation_status", include))
    if exclude:
        conditions.append(~_member("evaluation_status", exclude))
    return df.where(_all(conditions))


def by_filters(df: DataFrame, tokens: list[str]) -> DataFrame:
    """FLT-6: ``key=value`` filters. Values of one key are alternatives, keys must all hold."""
    wanted: dict[str, set[str]] = {}
    for token in tokens:
        key, sep, value = token.partition("=")
        key = key.strip().lower()
        if not sep or key not in {"model", *BY_KEYS}:
            raise ValueError(f"expected key=value with a key of {['model', *BY_KEYS]}: {token}")
        wanted.setdefault(key, set()).add(value.strip())
    conditions = []
    for key, values in wanted.items():
        members = sorted(values)
        if key == "model":
            name = _model_column(df)
            conditions.append(
                F.coalesce(F.col("modelId"), F.lit("")).isin(*members)
                | F.coalesce(F.col(name), F.lit("")).isin(*members)
            )
        else:
            conditions.append(_member(BY_KEYS[key], members))
    return df.where(_all(conditions))


def semi(df: DataFrame, ids: DataFrame, key: str = "trialId") -> DataFrame:
    """FLT-7: rows whose id is in a table of ids of any size."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def trial_detail(responses: DataFrame, evals: DataFrame, votes: DataFrame, trial_id: str | None = None,
                 seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """FLT-8: everything about a trial (or about every trial) as JSON rows: the first response, the
    latest evaluation and each vote in order. An id filter reaches all three scans. Rows are picked and sorted as
    they are, without a second copy of their id, and written as JSON last, as the text is several times as wide.
    They are sorted in so many ``ranges``, or in as many as the session has partitions."""
    order_type = votes.schema[seq].dataType
    kinds = {"response": responses, "evaluation": evals, "vote": votes}

    def part(df: DataFrame) -> DataFrame:
        rows = df if trial_id is None else df.where(F.col("trialId") == trial_id)
        return rows.select("trialId", F.col(seq).alias("__s"), F.struct(*[c for c in df.columns if c not in ("trialId", seq)]).alias("body"))

    def one(df: DataFrame, rank: int, kind: str, pick) -> DataFrame:
        return part(df).groupBy("trialId").agg(pick("body", "__s").alias(kind)).select(
            "trialId", F.lit(rank).alias("part"), F.lit(None).cast(order_type).alias("__s"), kind
        )

    def written(kind: str) -> Column:
        fields = [F.col("trialId" if c == "trialId" else f"{kind}.`{c}`").alias(c) for c in kinds[kind].columns if c != seq]
        return F.to_json(F.when(F.col(kind).isNotNull(), F.struct(*fields)))

    rows = one(responses, 0, "response", F.min_by)
    each = part(votes).select("trialId", F.lit(2).alias("part"), "__s", F.col("body").alias("vote"))
    for other in (one(evals, 1, "evaluation", F.max_by), each):
        rows = rows.unionByName(other, allowMissingColumns=True)
    by = ("trialId", "part", "__s")
    rows = rows.orderBy(*by) if ranges is None else rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    kind = F.when(F.col("part") == 0, F.lit("response")).when(F.col("part") == 1, F.lit("evaluation")).otherwise(F.lit("vote"))
    return rows.select("trialId", kind.alias("kind"), F.coalesce(*[written(k) for k in kinds]).alias("body"))


def trial_object(responses: DataFrame, evals: DataFrame, votes: DataFrame, trial_id: str | None = None, seq: str = "seq",
                 trials: DataFrame | None = None) -> DataFrame:
    """FLT-8: one JSON object per trial with a response: its identity, model, tags, status, response, measurements,
    parameters and metadata, the latest evaluation and all votes in order (null where there are none). ``trials`` fill
    what the first response lacks, once it is picked; a log that has these columns needs none. Only shown columns
    travel, the id as the key by which all parts meet, and votes become JSON once they have met their trial."""
    shown = [*fixed.DETAIL_FIELDS, "modelId", "modelName"]

    def part(df: DataFrame) -> DataFrame:
        return df if trial_id is None else df.where(F.col("trialId") == trial_id)

    def whole(df: DataFrame) -> Column:
        return F.struct(*[c for c in df.columns if c != seq])

    def earliest(df: DataFrame, *more: str) -> DataFrame:
        own = [c for c in df.columns if c != "trialId" and c in (*shown, *more)]
        return df.groupBy("trialId").agg(F.min_by(F.struct(*own), F.col(seq)).alias("r"))

    if trials is not None:
        first = earliest(part(responses), seq)
        responses = fill_from_trials(first.select("trialId", "r.*"), trials.select(*[c for c in trials.columns if c in shown]))
        first = earliest(responses)  # a trial may be planned twice
    else:
        first = earliest(part(responses))
    last = part(evals).groupBy("trialId").agg(F.max_by(whole(evals), F.col(seq)).alias("evaluation"))
    listed = F.collect_list(F.struct(F.col(seq).alias("s"), whole(votes).alias("v")))
    each = part(votes).groupBy("trialId").agg(listed.alias("v"))
    given = [c for c in fixed.DETAIL_FIELDS if c in responses.columns]
    model = F.struct(*[F.col(f"r.{old}").alias(new) for old, new in (("modelId", "id"), ("modelName", "name")) if old in responses.columns])
    renamed = {"taskTags": "tags", "metricsSummary": "metrics", "repeatIndex": "index"}
    head = [F.col("trialId" if c == "trialId" else f"r.{c}").alias(renamed.get(c, c)) for c in given]
    texts = F.sort_array(F.transform("v", lambda x: F.struct(x["s"].alias("s"), F.to_json(x["v"]).alias("v"))))
    body = F.struct(*head, model.alias("model"), F.parse_json(F.to_json("evaluation")).alias("evaluation"),
                    F.transform(texts, lambda x: F.parse_json(x["v"])).alias("judgeVotes"))
    joined = first.join(last, "trialId", "left").join(each, "trialId", "left")
    return joined.select("trialId", F.to_json(body, {"ignoreNullFields": "false"}).alias("detail"))


def successful(df: DataFrame) -> Column:
    """FLT-9: no error message and a status that means success."""
    status = F.lower(F.coalesce(F.col("status"), F.lit("")))
    clean = F.coalesce(F.length("errorMessage"), F.lit(0)) == 0
    return clean & status.isin("", "success", "completed", "ok")


def response_text(*columns: str) -> Column:
    """FLT-10: the first text that is not blank."""
    return first_usable(*columns)


FAILURE_COLUMNS = [
    "dataset_id", "experimentId", "trialId", "taskId", "instanceId", "modelId", "configurationId",
    "execution_status", "evaluation_status", "evaluation_method", "primary_metric_name",
    "primary_success", "primary_score", "error_message", "response_excerpt",
]


def failure_cases(facts: DataFrame) -> DataFrame:
    """FLT-11."""
    failed = (
        (F.col("response_present") & ~F.col("execution_status").eqNullSafe("success"))
        | F.coalesce(F.col("evaluation_status").isin("error", "skipped"), F.lit(False))
        | F.col("primary_success").eqNullSafe(False)
        | (F.col("primary_success").isNull() & F.col("evaluation_present"))
    )
    return facts.where(failed).select(*FAILURE_COLUMNS)


def list_discrepancies(checked: DataFrame, trial: str | None = None, criterion: str | None = None,
                       limit: int | None = None) -> DataFrame:
    """FLT-12: rows without unanimity or without a majority, in trial order."""
    conditions = [~F.coalesce("unanimous", F.lit(False)) | ~F.coalesce("has_majority", F.lit(False))]
    if trial:
        conditions.append(F.col("trialId") == trial)
    if criterion:
        conditions.append(F.col("criterion") == criterion)
    rows = checked.where(_all(conditions)).select(
        "trialId", "taskId", "criterion", "ratings_tuple", "has_majority", "majority_rating",
        "unanimous", "outcome_rating", "outcome_agreement",
    )
    return rows if limit is None else rows.orderBy("trialId", "criterion").limit(limit)


def behavior_examples(df: DataFrame, flag: str, configuration: str | None = None, task: str | None = None,
                      limit: int | None = None) -> DataFrame:
    """FLT-13: rows with a behaviour flag set."""
    conditions = [F.col(flag)]
    if configuration:
        conditions.append(F.col("configurationId") == configuration)
    if task:
        conditions.append(F.col("taskId") == task)
    rows = df.where(_all(conditions)).select(
        "trialId", "taskId", "modelId", "configurationId", "representation",
        "full_unanimous_meet", "strict_majority_meet", flag, "response",
    )
    return rows if limit is None else rows.orderBy("trialId").limit(limit)


def list_votes(votes_long: DataFrame, trial_id: str | None = None) -> DataFrame:
    """FLT-14: votes of one trial, or of all."""
    rows = votes_long if trial_id is None else votes_long.where(F.col("trialId") == trial_id)
    return (
        rows
        .select("trialId", "criterion", "judgeId", "rating", "justification", "totalTokens_vote", "durationMs_vote")
        .orderBy("trialId", "criterion", "judgeId")
    )


def answers_of_interest(runs: DataFrame, configurations: DataFrame, tasks: list[str],
                        strategy: str = "inline") -> DataFrame:
    """FLT-15: answers to some tasks under the configurations of one strategy."""
    wanted = configurations.where(F.col("strategy") == strategy).select("configurationId").distinct()
    return (
        runs.where(_member("taskId", tasks))
        .join(wanted, "configurationId", "left_semi")
        .select(
            "trialId", "instanceId", "modelId", "configurationId", "taskId", "taskStatement", "response",
            "strict_majority_meet", "full_unanimous_meet", "collapsed_majority_accuracy",
            "totalTokens_answer", "totalDurationMs_answer",
        )
        .orderBy("taskId", "configurationId", "modelId", "instanceId")
    )
