"""Factorial planning (PLN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import canonical_json, col, merge_maps, sha_prefix

PLACEHOLDER = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"


def scope(df: DataFrame, column: str, ids: list[str] | DataFrame | None) -> DataFrame:
    """PLN-2: an empty scope keeps all. A list is a predicate, a table is a semi-join."""
    if ids is None or (isinstance(ids, list) and not ids):
        return df
    if isinstance(ids, list):
        return df.where(F.col(column).isin(*ids))
    return df.join(ids.select(column).distinct(), column, "left_semi")


def with_parameters(cells: DataFrame, instance_tasks: DataFrame) -> DataFrame:
    """PLN-3: parameters of the instance for the task; cells without any keep an empty map."""
    empty = F.create_map().cast("map<string,string>")
    parameters = instance_tasks.select("instanceId", "taskId", "parameters")
    return cells.join(parameters, ["instanceId", "taskId"], "left").withColumn("parameters", F.coalesce("parameters", empty))


def merge_params(common: Column | str, specific: Column | str, model_name: Column | str) -> Column:
    """PLN-4: the model's parameters win over the common ones; ``model_name`` is always set."""
    return merge_maps(merge_maps(common, specific), F.create_map(F.lit("model_name"), col(model_name)))


def placeholders(template: Column | str) -> Column:
    return F.regexp_extract_all(col(template), F.lit(PLACEHOLDER), F.lit(1))


def render(template: Column | str, params: Column | str) -> Column:
    """PLN-5: placeholders replaced in order of appearance; a missing parameter becomes ''."""
    text, values = col(template), col(params)

    def fill(done: Column, key: Column) -> Column:
        value = F.coalesce(F.try_element_at(values, key), F.lit(""))
        return F.replace(done, F.concat(F.lit("{"), key, F.lit("}")), value)

    return F.aggregate(placeholders(text), text, fill)


def template_gaps(cells: DataFrame, template: str = "taskTemplate", params: str = "parameters",
                  keys: tuple[str, ...] = ("taskId", "instanceId")) -> DataFrame:
    """PLN-6: parameters a template misses and parameters it does not use."""
    asked, given = F.array_distinct(placeholders(template)), F.map_keys(params)

    def named(problem: str, names: Column) -> Column:
        return F.transform(names, lambda p: F.struct(F.lit(problem).alias("problem"), p.alias("parameter")))

    gaps = F.concat(named("missing", F.array_except(asked, given)), named("unused", F.array_except(given, asked)))
    return cells.select(*keys, F.explode(gaps).alias("g")).select(*keys, "g.*")


def canonical_id(experiment: str = "experimentId") -> Column:
    """PLN-7: sorted compact JSON of the identity of a trial."""
    f = F.col
    plain = {"representation": f("representation"), "strategy": f("strategy")}
    full = {**plain, "surface": f("surface")}

    def identity(parts: dict[str, Column]) -> Column:
        return canonical_json(
            {
                "identityVersion": F.lit(2), "experimentId": f(experiment), "taskId": f("taskId"),
                "instanceId": f("instanceId"), "provider": f("provider"), "modelName": f("modelName"),
                "configurationId": f("configurationId"),
                "configuration": F.struct(*[c.alias(k) for k, c in parts.items()]), "repeatIndex": f("repeatIndex"),
            }
        )

    return F.when(F.coalesce(F.length("surface"), F.lit(0)) > 0, identity(full)).otherwise(identity(plain))


def short_ids(df: DataFrame, identity: str, name: str = "trialId", least: int = 10, most: int = 64) -> DataFrame:
    """PLN-8: hash prefixes of the shortest common length, at least ``least``, that keeps all rows apart.

    Prefixes of that length can only meet inside a bucket of equal leading characters, and there two
    neighbours in hash order share the most. Hashes are made distinct first, so a bucket stays tiny;
    identities that occur twice can never be told apart and take the full hash."""
    from pyspark.sql import Window as W

    hashed = df.withColumn("__h", F.sha2(F.col(identity), 256))
    unique = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    bucket = W.partitionBy(F.substring("__h", 1, least)).orderBy("__h")
    pairs = unique.withColumn("__next", F.lead("__h").over(bucket))
    lengths = F.sequence(F.lit(least), F.lit(most))
    shared = F.array_max(F.filter(lengths, lambda n: F.substr("__h", F.lit(1), n) == F.substr("__next", F.lit(1), n)))
    length = pairs.agg(
        F.when(F.max("__n") > 1, F.lit(most))
        .otherwise(F.least(F.lit(most), F.coalesce(F.max(shared), F.lit(least - 1)) + 1)).cast("int")
    ).scalar()
    return hashed.withColumn("__len", length).withColumn(name, F.substr("__h", F.lit(1), F.col("__len"))).drop("__h", "__len")


def resolve_surface(configurations: DataFrame, surfaces: DataFrame) -> DataFrame:
    """PLN-9: definition, surface type and operations of each configuration."""
    return configurations.join(surfaces.select("experimentId", "surface", "type", "operations"), ["experimentId", "surface"], "left")


def fingerprint(content: Column | str, n: int = 16) -> Column:
    """PLN-10."""
    return sha_prefix(content, n)


def inline_cache_key(model: str, instance: str, representation: str, content: str) -> Column:
    """PLN-10: key of a prompt that carries the whole context."""
    text = F.concat_ws("|", model, instance, representation, fingerprint(content))
    return F.concat(F.lit("inl:"), F.col(representation), F.lit(":"), sha_prefix(text, 32))


def judge_cache_key(model: str, instance: str, content: str) -> Column:
    return F.concat(F.lit("jud:ctx:"), sha_prefix(F.concat_ws("|", model, instance, fingerprint(content)), 32))


def expand_trials(instances: DataFrame, tasks: DataFrame, models: DataFrame, configurations: DataFrame,
                  repeats: int, salts: int = 16) -> DataFrame:
    """PLN-1: instances x tasks of a dataset, times models, configurations and repeats.

    The design lists (models, configurations) are short and configured, so they ride in the plan as
    one array value each. Instances meet the task catalog of their dataset by an equi-join; a
    dataset with very many instances is salted, the catalog is repeated per salt."""
    def listed(df: DataFrame) -> Column:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()

    model = F.struct(
        "provider", F.coalesce("modelId", "modelName").alias("modelId"), "modelName"
    )
    m = models.select(model.alias("m")).select("m.*")
    left = instances.withColumn("__salt", F.pmod(F.xxhash64("instanceId"), F.lit(salts)))
    right = tasks.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    cells = left.join(right, ["datasetId", "__salt"], "inner").drop("__salt")
    grown = cells.withColumn("__m", F.explode(listed(m))).withColumn("__c", F.explode(listed(configurations)))
    return grown.select(*cells.columns, "__m.*", "__c.*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeatIndex"))
