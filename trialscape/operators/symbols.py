"""Code workspaces: nested symbols as flat rows with their parent chain (DOC-5..8, DOC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import first_string, variant_array, variant_text

_NODE = "array<struct<v:variant,ord:int,id:string,parent_id:string,names:array<string>,ids:array<string>>>"


def _quoted(c: Column) -> Column:
    """A JSON string literal in ASCII. A text that needs no escape is only put in quotes."""
    simple = F.rlike(c, F.lit(r"^[ !#-\[\]-~]*\z"))
    plain = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        high = F.lit(55296) + F.shiftright(code - 65536, 10)
        low = F.lit(56320) + F.pmod(code - 65536, F.lit(1024))
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        return F.when(code < 128, ch).when(code < 65536, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    wide = F.array_join(F.transform(F.split(plain, ""), escape), "")
    escaped = F.when(F.rlike(plain, F.lit(r"^[\x00-\x7f]*$")), plain).otherwise(wide)
    return F.when(simple, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(escaped)


def _line(v: Column, *paths: str) -> Column:
    """A line number as it stands in JSON, ``null`` when missing."""
    found = [F.nullif(F.to_json(F.try_variant_get(v, p, "variant")), F.lit("0")) for p in paths]
    return F.coalesce(*[F.nullif(f, F.lit("null")) for f in found], F.lit("null"))


def _named(v: Column) -> Column:
    return F.coalesce(first_string(variant_text(v, "$.name")), F.lit("<anonymous>"))


def symbol_id(path: Column, v: Column, kind: Column, qualified: Column, ord_: Column) -> Column:
    """The given id, else ``repoqa:`` and 20 hex digits of the hash of six fields in key order."""
    raw = F.concat(
        F.lit('{"end_line": '), _line(v, "$.end_line", "$.endLine"),
        F.lit(', "kind": '), _quoted(kind), F.lit(', "path": '), _quoted(path),
        F.lit(', "qualified_name": '), _quoted(qualified),
        F.lit(', "sibling_index": '), ord_.cast("string"),
        F.lit(', "start_line": '), _line(v, "$.start_line", "$.startLine"), F.lit("}"),
    )
    given = first_string(variant_text(v, "$.symbol_id"), variant_text(v, "$.symbolId"))
    return F.coalesce(given, F.concat(F.lit("repoqa:"), F.substring(F.sha2(raw, 256), 1, 20)))


def _kind(v: Column) -> Column:
    return F.coalesce(first_string(variant_text(v, "$.kind")), F.lit("symbol"))


def _qualified(v: Column, names: Column) -> Column:
    """Given, else the names of the ancestors and the own one joined by dots."""
    given = first_string(variant_text(v, "$.qualified_name"), variant_text(v, "$.qualifiedName"))
    return F.coalesce(given, F.array_join(F.concat(names, F.array(_named(v))), "."))


def flatten_symbols(files: DataFrame, depth: int | None = None) -> DataFrame:
    """DOC-5: one row per symbol of ``files`` (workspaceId, path, symbols VARIANT) with its kind, names,
    ids, line range, code, level and the ids of its ancestors, outermost first.

    Levels are unrolled as column expressions, so nothing is shuffled. How many there are is found
    first, by looking twice as deep until nothing is left there; a caller who knows ``depth`` saves
    that pass, and a deeper tree then fails the job instead of losing symbols."""
    path = F.col("path")

    def node(v: Column, i: Column, parent: Column, names: Column, ids: Column) -> Column:
        """A symbol with its id, worked out once; ``names`` and ``ids`` are those of its ancestors."""
        own = symbol_id(path, v, _kind(v), _qualified(v, names), i)
        return F.struct(
            v.alias("v"), i.alias("ord"), own.alias("id"), parent.alias("parent_id"), names.alias("names"), ids.alias("ids")
        )

    def level_of(items: Column, parent: Column, names: Column, ids: Column) -> Column:
        listed = F.transform(items, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        objects = F.filter(listed, lambda x: F.startswith(F.schema_of_variant(x["v"]), F.lit("OBJECT")))
        return F.transform(objects, lambda x: node(x["v"], x["i"], parent, names, ids)).cast(_NODE)

    def children(n: Column) -> Column:
        kids = F.coalesce(variant_array(n["v"], "$.children"), F.array().cast("array<variant>"))
        own = F.struct(F.concat(n["names"], F.array(_named(n["v"]))).alias("names"), F.concat(n["ids"], F.array(n["id"])).alias("ids"))
        # bound to a name, as each child would work them out again
        return F.flatten(F.transform(F.array(own), lambda a: level_of(kids, n["id"], a["names"], a["ids"])))

    none = F.array().cast("array<string>")
    top = F.coalesce(F.try_variant_get("symbols", "$", "array<variant>"), F.array().cast("array<variant>"))

    def unrolled(levels: int) -> DataFrame:
        rows = files.withColumn("__l0", level_of(top, F.lit(None).cast("string"), none, none))
        for level in range(1, levels + 1):
            rows = rows.withColumn(f"__l{level}", F.flatten(F.transform(F.col(f"__l{level - 1}"), children)))
        return rows

    if depth is None:
        depth = 4
        while not unrolled(depth).where(F.size(f"__l{depth}") > 0).isEmpty():
            depth *= 2
    rows = unrolled(depth)
    too_deep = F.size(f"__l{depth}") > 0
    failed = F.raise_error(F.concat(F.lit(f"symbols nested deeper than {depth} in "), path)).cast(_NODE)
    keep = [c for c in files.columns if c != "symbols"]
    # the check stands inside the explode: as a filter it would be pushed down and make every level once more
    found = F.concat(*[F.col(f"__l{i}") for i in range(depth)])
    nodes = F.explode(F.when(too_deep, failed).otherwise(found)).alias("n")
    v = F.col("n.v")
    return rows.select(*keep, nodes).select(
        *keep,
        F.col("n.id").alias("symbol_id"),
        F.col("n.parent_id").alias("parent_id"), F.col("n.ids").alias("ancestors"), F.size("n.ids").alias("depth"),
        F.col("n.ord").alias("sibling_index"), _kind(v).alias("kind"), _named(v).alias("name"),
        _qualified(v, F.col("n.names")).alias("qualified_name"),
        F.nullif(_line(v, "$.start_line", "$.startLine"), F.lit("null")).try_cast("int").alias("start_line"),
        F.nullif(_line(v, "$.end_line", "$.endLine"), F.lit("null")).try_cast("int").alias("end_line"),
        F.try_variant_get(v, "$.code", "string").alias("code"),
        F.try_variant_get(v, "$.signature", "string").alias("signature"),
        F.try_variant_get(v, "$.documentation", "string").alias("documentation"),
    )


def list_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """DOC-6: files with language, parse status and the number of symbols at every level."""
    counts = symbols.groupBy("workspaceId", "path").agg(F.count(F.lit(1)).alias("symbol_count"))
    return files.join(counts, ["workspaceId", "path"], "left").select(
        "workspaceId", *[c for c in ("repository",) if c in files.columns], "path", "language",
        F.coalesce("symbol_count", F.lit(0).cast("long")).alias("symbol_count"),
        F.coalesce(F.nullif(F.col("parse_status"), F.lit("")), F.lit("unknown")).alias("parse_status"),
    )


def kind_matches(kind: str, column: str = "kind") -> Column:
    """``function`` asks for functions and methods."""
    return F.col(column).isin("function", "method") if kind == "function" else F.col(column) == kind


def path_matches(path: str, column: str = "path") -> Column:
    prefix = path.strip().rstrip("/")
    if not prefix:
        return F.lit(True)
    return (F.col(column) == prefix) | F.startswith(F.col(column), F.lit(f"{prefix}/"))


def with_ancestors(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits and every symbol above one of them."""
    above = hits.select("workspaceId", "path", F.explode("ancestors").alias("symbol_id"))
    wanted = hits.select("workspaceId", "path", "symbol_id").unionByName(above).distinct()
    return symbols.join(wanted, ["workspaceId", "path", "symbol_id"], "left_semi")


def list_symbols(symbols: DataFrame, path: str | None = None, kind: str | None = None) -> DataFrame:
    """DOC-7: symbols below a path, of a kind; the ancestors of a match stay, code leaves."""
    rows = symbols if path is None else symbols.where(path_matches(path))
    if kind is not None:
        rows = with_ancestors(rows, rows.where(kind_matches(kind)))
    return rows.drop("code")


def get_symbol(symbols: DataFrame, ids: DataFrame | str) -> DataFrame:
    """DOC-8: symbols by id; a string or a table of (workspaceId, symbol_id)."""
    if isinstance(ids, str):
        return symbols.where(F.col("symbol_id") == ids.strip())
    return symbols.join(ids, ["workspaceId", "symbol_id"], "left_semi")


def read_file(files: DataFrame, visible: DataFrame) -> DataFrame:
    """DOC-8: files with their visible content. A workspace with a single file falls back to its
    unparsed code; files without any content leave."""
    only = files.groupBy("workspaceId").agg((F.count(F.lit(1)) == 1).alias("__only"))
    joined = files.join(visible.select("workspaceId", "path", "content"), ["workspaceId", "path"], "left").join(only, "workspaceId")
    content = F.coalesce("content", F.when(F.col("__only"), F.col("unparsed_code")))
    return joined.select("workspaceId", "path", "language", content.alias("content")).where("content IS NOT NULL")


def _normal(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(c), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def visible_symbols(symbols: DataFrame, texts: DataFrame, text: str = "content") -> DataFrame:
    """DOC-11: symbols whose code occurs in the visible text of their file. Parents of visible symbols
    stay without code and documentation, and with their signature only if that is visible."""
    joined = symbols.join(texts.select("workspaceId", "path", _normal(text).alias("__t")), ["workspaceId", "path"], "inner")

    def seen(c: str) -> Column:
        needle = _normal(c)
        return F.coalesce((F.length(needle) > 0) & F.contains(F.col("__t"), needle), F.lit(False))

    marked = joined.withColumns({"__seen": seen("code"), "__sig": seen("signature")}).drop("__t")
    kept = with_ancestors(marked, marked.where("__seen"))
    shown = F.col("__seen")
    return kept.withColumns(
        {
            "code": F.when(shown, F.col("code")), "documentation": F.when(shown, F.col("documentation")),
            "signature": F.when(shown | F.col("__sig"), F.col("signature")),
        }
    ).drop("__seen", "__sig")
