"""Scalar column expressions: strings, numbers, maps, JSON, hashes, time (SCL-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


# --- strings -----------------------------------------------------------------

def norm_text(c: Column | str) -> Column:
    """Null becomes '', white space runs become one blank, edges trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")))


def contains_any(c: Column | str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(t)) for t in terms])


def truncate(c: Column | str, n: int) -> Column:
    text = col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    text = col(c)
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_string(*cs: Column | str) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def first_usable(*cs: Column | str) -> Column:
    """First value that is not blank, as it stands."""
    return F.coalesce(*[F.when(F.length(F.trim(col(c))) > 0, col(c)) for c in cs])


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(WORD)).cast("long")


def years(c: Column | str) -> Column:
    """Every 19xx / 20xx number of a text, as an array of integers."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(YEAR), F.lit(0))
    return F.transform(found, lambda y: y.try_cast("int"))


def first_year(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(19|20)\d{2}", 0).try_cast("int")


def last_year(c: Column | str) -> Column:
    return F.try_element_at(
        F.regexp_extract_all(col(c), F.lit(r"(?:19|20)\d{2}"), F.lit(0)), F.lit(-1)
    ).try_cast("int")


def doi(c: Column | str) -> Column:
    """The identifier behind ``doi.org/`` up to the next white space, without end punctuation."""
    tail = F.regexp_extract(col(c), r"(?i)doi\.org/(\S+)", 1)
    return F.nullif(F.regexp_replace(tail, r"[.,;]+$", ""), F.lit(""))


def slug(c: Column | str, default: str = "item", keep: str = "a-zA-Z0-9", lower: bool = True) -> Column:
    """Everything outside ``keep`` becomes '_', edges trimmed, an empty result becomes ``default``."""
    text = F.regexp_replace(F.regexp_replace(col(c), f"[^{keep}]+", "_"), "^_+|_+$", "")
    text = F.lower(text) if lower else text
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def file_slug(c: Column | str) -> Column:
    text = F.replace(F.trim(col(c)), F.lit("/"), F.lit("_slash_"))
    text = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(text, "^_|_$", ""), F.lit("")), F.lit("unknown"))


# --- numbers -----------------------------------------------------------------

def safe_div(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, null when b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column) -> Column:
    return safe_div(a, b) * F.lit(100.0)


def per_100k(a: Column, b: Column) -> Column:
    return safe_div(a, b) * F.lit(100000.0)


def clamp0(c: Column | str) -> Column:
    return F.greatest(F.lit(0), col(c))


def seconds(ms: Column | str) -> Column:
    return col(ms).cast("double") / F.lit(1000.0)


def sum_non_null(*cs: Column | str) -> Column:
    """Sum of the non-null values, null when all are null."""
    values = [col(c).cast("double") for c in cs]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)


def share(flag: Column | str) -> Column:
    """Aggregate: share of true among the non-null values."""
    return F.avg(col(flag).cast("int").cast("double"))


def coerce_numeric(df, columns: list[str]):
    """SRC-14: values that are no numbers become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def est_tokens(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4)).cast("long")


# --- time --------------------------------------------------------------------

def duration_ms(started: Column | str, finished: Column | str) -> Column:
    """Milliseconds between two ISO time stamps, never negative; null where one is missing or broken."""
    a = F.try_to_timestamp(col(started))
    b = F.try_to_timestamp(col(finished))
    micros = F.unix_micros(b) - F.unix_micros(a)
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), F.floor(micros / 1000)).cast("long"))


# --- arrays and maps ---------------------------------------------------------

def join_tags(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(F.coalesce(col(c), F.array().cast("array<string>")), sep)


def sorted_by(c: Column | str, field: str) -> Column:
    """An array of structs in the order of one field, whatever the types of the others."""
    def order(a: Column, b: Column) -> Column:
        return F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)

    return F.array_sort(col(c), order)


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(c)))


def merge_maps(left: Column | str, right: Column | str) -> Column:
    """Union of two maps; the right one wins."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(col(left), empty), F.coalesce(col(right), empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def lookup(mapping: dict, key: Column | str) -> Column:
    return F.try_element_at(literal_map(mapping), col(key))


# --- JSON and hashes ---------------------------------------------------------

def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with the keys in sorted order; nulls stay."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def is_json_object(c: Column | str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(col(c))), F.lit("OBJECT")), F.lit(False))


def variant_kind(v: Column, path: str) -> Column:
    """First word of the type at a path: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, VOID."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^[A-Z]+", 0)


def variant_object(v: Column, path: str = "$") -> Column:
    """An object at a path as MAP<STRING, VARIANT>, without a look below its keys; other types give null."""
    return F.try_variant_get(v, path, "map<string,variant>")


def variant_number(v: Column, path: str) -> Column:
    """A number at a path; booleans and strings are no numbers."""
    return F.when(
        variant_kind(v, path).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT"),
        F.try_variant_get(v, path, "double"),
    )


def variant_text(v: Column, path: str) -> Column:
    """A string at a path; other types give null."""
    return F.when(variant_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def variant_array(v: Column, path: str) -> Column:
    """A list at a path as ARRAY<VARIANT>; other types give null."""
    return F.try_variant_get(v, path, "array<variant>")


def variant_bool01(v: Column) -> Column:
    """true / false, or the numbers 0 and 1; anything else is null."""
    kind = variant_kind(v, "$")
    number = variant_number(v, "$")
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
        number.isin(0.0, 1.0), number == 1.0
    )


def sha_prefix(c: Column | str, n: int) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, n)


def sha256_normal(c: Column | str) -> Column:
    """Lower case, trimmed, without the ``sha256:`` prefix; null unless 64 hex digits remain."""
    text = F.regexp_replace(F.lower(F.trim(col(c))), "^sha256:", "")
    return F.when(F.rlike(text, F.lit("^[0-9a-f]{64}$")), text)
