"""URL filters: a blocked Bloom filter of the listed URLs lets possible hits through to an exact hash join."""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape.llm.bloom import blocks_for, may_hold

def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in count() if (n := f"{w}_{i}" if i else w).lower() not in taken) for w in wanted]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from
    there up to ``?``, ``#`` or the end. Both are empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def listed_urls(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """A list written out: ``{"example.org/es/": "block"}``."""
    return spark.createDataFrame(list(rules.items()), "rule STRING, verdict STRING")


def _canonical(listed: DataFrame) -> DataFrame:
    """(key, rule_host, rule_path, verdict): one row per canonical URL. A host has no slash, so the text
    of both parts tells them apart."""
    host = lower_ascii(F.regexp_extract("rule", "^[^/]*", 0))
    path = F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    return (
        listed.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .select(host.alias("rule_host"), F.regexp_replace(path, "[?#].*$", "").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("rule_host", "rule_path").alias("key"), "rule_host", "rule_path", "verdict")
    )


def judge_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", blocks: int | None = None
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` has a ``rule`` (``host/path``, as ``example.org/es/``) and its ``verdict``. A rule fits its
    host and all subdomains if the url's path starts with the rule's. The longest rule that fits wins (code
    points of host and path together, then the longer host); ``rule`` is null and the verdict is ``default``
    where none does.

    A url has one candidate per listed number of labels and listed length of a path. Those that the filter
    lets through are joined with the list by their text, which removes false hits. Only hosts and paths with
    a possible hit go on to the join; its skewed keys are left to the skew split of adaptive execution.

    Null urls and urls without ``://`` have empty parts and get the default. Rules without text or verdict
    count for nothing; of equal rules the greatest verdict (``block`` before ``allow``) counts. Repeated
    rows are judged each. Empty tables give empty results, an empty list gives the default everywhere.
    Other columns are kept; input columns named ``host``, ``path``, ``rule`` or ``verdict`` are replaced.
    """
    rules = _canonical(listed)
    labels = F.size(F.split("rule_host", "[.]"))
    facts = rules.agg(
        F.count(F.lit(1)).alias("n"), F.max(labels).alias("labels"), F.collect_set(F.char_length("rule_path")).alias("lengths")
    ).first()
    blocks = blocks or blocks_for(facts["n"])

    host, path = host_and_path(F.col(f"`{url}`"))
    dropped = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in dropped]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))

    own = F.split("host", "[.]", -1)
    least = F.greatest(F.lit(1), F.size(own) - F.lit((facts["labels"] or 1) - 1))
    suffixes = F.transform(F.sequence(least, F.size(own)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(facts["lengths"])]).cast("array<int>")
    starts = F.filter(lengths, lambda n: n <= F.char_length("path"))
    probes = (
        parts.select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(starts).alias("length"))
        .select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("length"))).alias("probe"))
    )
    possible = probes.where(may_hold(rules, blocks, F.col("probe"))).distinct()

    size = F.struct(F.char_length("key"), F.char_length("rule_host"))
    longest = (
        possible.join(rules, F.col("probe") == F.col("key"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("key", "verdict"), size).alias("won"))
    )
    at_host, at_path, won = free_names(parts, "at_host", "at_path", "won")
    found = longest.select(F.col("host").alias(at_host), F.col("path").alias(at_path), F.col("won").alias(won))
    joined = parts.join(found, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left")
    return joined.select(
        *kept, "host", "path", F.col(won)["key"].alias("rule"), F.coalesce(F.col(won)["verdict"], F.lit(default)).alias("verdict")
    )
