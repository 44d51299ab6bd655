"""One text that carries several files (DOC-9). Whole texts are cut inside a row; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.functions.text import lines_of, trim_blank_edges

# Fixed forms of the marker lines.
MARKER = r"(?i)^\s*(?:#\s*|//\s*|--\s*|/\*\s*|<!--\s*)(?:File|Path)\s*:\s*(.*?)\s*(?:\*/\s*|-->\s*)?$"
REPOSITORY = r"(?i)^\s*(?:#\s*|//\s*|--\s*|/\*\s*|<!--\s*)(?:Repository|Repo)\s*:.*$"
BUILD_MARKER = r"^\s*(?:#|//|--|/\*+|<!--)\s*(?:Path|File)\s*:\s*(.+?)\s*(?:\*/|-->)?\s*$"
BUILD_REPOSITORY = r"^\s*(?:#|//|--|/\*+|<!--)\s*Repository\s*:.*$"


def _cut(df: DataFrame, lines: Column, marker: str, repository: str, keep: list[str], default: Column | None) -> DataFrame:
    """(keep, pos, path, lines): the lines between a marker and the next one. Lines before the first
    marker belong to ``default`` when it is given."""
    kept = F.filter(lines, lambda x: ~F.rlike(x, F.lit(repository)))
    rows = df.select(*keep, *([] if default is None else [default.alias("__default")]), kept.alias("__lines"))
    indexed = F.transform("__lines", lambda x, i: F.when(F.rlike(x, F.lit(marker)), i + 1))
    rows = rows.withColumn("__marks", F.filter(indexed, lambda i: i.isNotNull()))
    ends = F.concat(F.slice("__marks", 2, F.greatest(F.lit(0), F.size("__marks") - 1)), F.array(F.size("__lines") + 1))

    def part(at: Column, i: Column) -> Column:
        stop = F.get(F.col("__ends"), i)
        return F.struct(
            F.trim(F.regexp_extract(F.get(F.col("__lines"), at - 1), marker, 1)).alias("path"),
            F.slice("__lines", at + 1, F.greatest(F.lit(0), stop - at - 1)).alias("lines"),
        )

    rows = rows.withColumn("__ends", F.when(F.size("__marks") > 0, ends).otherwise(F.array().cast("array<int>")))
    parts = F.transform("__marks", part)
    if default is not None:
        first = F.coalesce(F.get("__marks", F.lit(0)), F.size("__lines") + 1)
        head = F.struct(F.col("__default").alias("path"), F.slice("__lines", 1, first - 1).alias("lines"))
        parts = F.filter(F.concat(F.array(head), parts), lambda p: F.size(p["lines"]) > 0)
    return rows.select(*keep, F.posexplode(parts).alias("pos", "__p")).select(*keep, "pos", "__p.*")


def split_files(df: DataFrame, key: str = "workspaceId", text: str = "text") -> DataFrame:
    """DOC-9 as the reader sees it: marker lines of any case start a file, repository lines are skipped,
    blank edge lines leave, a later file of the same path replaces an earlier one."""
    parts = _cut(df, lines_of(text), MARKER, REPOSITORY, [key], None)
    body = trim_blank_edges(F.array_join("lines", "\n"))
    content = F.when(F.length(body) > 0, F.concat(body, F.lit("\n"))).otherwise(F.lit(""))
    return parts.groupBy(key, "path").agg(F.max_by(content, "pos").alias("content"))


def split_built_files(df: DataFrame, key: str = "workspaceId", text: str = "text", default_path: str = "default_path") -> DataFrame:
    """DOC-9 as the builder sees it: lines before a marker belong to the default path, and pieces of
    the same path are joined by an empty line. The pieces of a path are bounded by one text."""
    lines = F.split(F.col(text), "\n")
    parts = _cut(df, lines, BUILD_MARKER, BUILD_REPOSITORY, [key], F.col(default_path))
    piece = F.regexp_replace(F.array_join("lines", "\n"), "^\n+|\n+$", "")
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("unknown"))
    grouped = parts.withColumn("piece", piece).groupBy(key, path.alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("__p")
    )
    return grouped.select(key, "path", F.array_join(F.transform("__p", lambda p: p["piece"]), "\n\n").alias("content"))
