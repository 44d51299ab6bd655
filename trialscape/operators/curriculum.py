"""Curriculum documents kept as VARIANT (TXT-5, DOC-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import col, doi as doi_of, variant_array, variant_kind, years

_NO_ITEMS = "array<variant>"


def _items(v: Column, path: str) -> Column:
    return F.coalesce(variant_array(v, path), F.array().cast(_NO_ITEMS))


def _text(v: Column, path: str) -> Column:
    """Any scalar as trimmed text, '' as null."""
    value = F.try_variant_get(v, path, "variant")
    plain = F.when(variant_kind(v, path).isin("OBJECT", "ARRAY"), F.to_json(value)).otherwise(F.try_variant_get(v, path, "string"))
    return F.nullif(F.trim(plain), F.lit(""))


def _whole(v: Column, path: str) -> Column:
    return F.when(F.rlike(_text(v, path), F.lit(r"^[+-]?\d+$")), _text(v, path)).try_cast("int")


def _texts(v: Column, path: str) -> Column:
    found = F.transform(_items(v, path), lambda x: _text(x, "$"))
    return F.filter(found, lambda x: x.isNotNull())


def _objects(df: DataFrame, arrays: Column, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, F.posexplode(arrays).alias("ord", "item"))
    return rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def education(df: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    columns = keep or [c for c in df.columns if c != body]
    lists = F.concat(*[_items(F.col(body), f"$.education.{k}") for k in ("degrees", "postDoctoral", "complementaryCourses")])
    i = F.col("item")
    return _objects(df, lists, columns).select(
        *columns, "ord", _text(i, "$.degreeName").alias("degree_name"), _text(i, "$.title").alias("title"),
        _text(i, "$.institution").alias("institution"), _text(i, "$.country").alias("country"),
        _whole(i, "$.interval.start").alias("start_year"), _whole(i, "$.interval.end").alias("end_year"),
        *[_texts(i, f"$.{k}").alias(k) for k in ("details", "advisors", "funding")],
    )


def projects(df: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    columns = keep or [c for c in df.columns if c != body]
    i = F.col("item")
    return _objects(df, _items(F.col(body), "$.projects"), columns).select(
        *columns, "ord", F.replace(_text(i, "$.type"), F.lit("_"), F.lit(" ")).alias("kind"),
        _text(i, "$.name").alias("name"), _text(i, "$.description").alias("description"),
        _whole(i, "$.interval.start").alias("start_year"), _whole(i, "$.interval.end").alias("end_year"),
        _texts(i, "$.details").alias("details"),
    )


def _kind(category: Column) -> Column:
    low = F.lower(category)
    any_of = lambda *words: F.coalesce(
        F.rlike(low, F.lit("|".join(words))), F.lit(False))
    return (
        F.when(any_of("periódico", "periodic", "journal"), F.lit("journal"))
        .when(any_of("anais", "congresso", "conference"), F.lit("conference"))
        .when(any_of("aceitos"), F.lit("accepted"))
        .otherwise(category)
    )


def publications(df: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Fields of each publication; what is missing is read from its free text. Entries without
    anything usable leave. ``details`` lists the other fields in key order."""
    columns = keep or [c for c in df.columns if c != body]
    i = F.col("item")
    rows = _objects(df, _items(F.col(body), "$.production.bibliographical"), columns).withColumn("text", _text(i, "$.text"))
    text = F.col("text")
    parts = F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    told_title = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    tokens = F.split(F.replace(text, F.lit("."), F.lit(" ")), r"\s+")
    plausible = F.filter(
        F.transform(F.filter(tokens, lambda t: F.rlike(t, F.lit(r"^\d{4}$"))), lambda t: t.cast("int")),
        lambda y: y.between(1900, 2100),
    )
    told_people = F.when(
        F.contains(text, F.lit(".")),
        F.filter(F.transform(F.split(F.substring_index(text, ".", 1), ";"), lambda x: F.trim(x)), lambda p: F.length(p) > 0),
    )
    given_year, given_people = _whole(i, "$.year"), _texts(i, "$.authors")
    rows = rows.withColumn("title", F.coalesce(_text(i, "$.title"), told_title))
    marker = F.concat("title", F.lit("."))
    at = F.expr("locate(concat(title, '.'), text)")
    told_venue = F.when(at > 0, F.trim(F.substring_index(F.trim(F.substr(text, at + F.length(marker))), ",", 1)))
    raw_doi = _text(i, "$.doi")
    own_doi = F.when(
        F.contains(F.lower(raw_doi), F.lit("doi.org/")), F.substr(raw_doi, F.locate("doi.org/", F.lower(raw_doi)) + 8)
    ).otherwise(raw_doi)
    known = ("category", "year", "authors", "title", "venue", "doi")
    others = F.map_filter(F.expr("try_cast(item AS map<string,variant>)"), lambda k, _: ~k.isin(*known))
    one = lambda e: F.when(
        F.startswith(F.schema_of_variant(e["value"]), F.lit("ARRAY")), _texts(e["value"], "$")
    ).otherwise(F.array_compact(F.array(F.concat(e["key"], F.lit(": "), _text(e["value"], "$")))))
    details = F.coalesce(F.flatten(F.transform(F.map_entries(others), one)), F.array().cast("array<string>"))
    table = rows.select(
        *columns, "ord", _kind(_text(i, "$.category")).alias("kind"), "title",
        F.coalesce(F.nullif(given_year, F.lit(0)), F.try_element_at(plausible, F.lit(-1))).alias("year"),
        F.coalesce(_text(i, "$.venue"), F.nullif(told_venue, F.lit(""))).alias("venue"),
        F.when(F.size(given_people) > 0, given_people).otherwise(F.coalesce(told_people, F.array().cast("array<string>"))).alias("authors"),
        F.coalesce(own_doi, doi_of(text)).alias("doi"), details.alias("details"),
    )
    empty = F.coalesce(F.col("title"), F.col("year").cast("string"), F.col("venue"), F.col("doi")).isNull()
    return table.where(~(empty & (F.size("authors") == 0) & (F.size("details") == 0)))


def curriculum_records(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """TXT-5: ``kind`` is education, projects or publications."""
    return {"education": education, "projects": projects, "publications": publications}[kind](df, body)


def section(body: Column | str, name: str, default: str = "{}") -> Column:
    """DOC-1: a section that is an object, else the default shape."""
    v = col(body)
    found = F.when(variant_kind(v, f"$.{name}") == "OBJECT", F.try_variant_get(v, f"$.{name}", "variant"))
    return F.coalesce(found, F.parse_json(F.lit(default)))


def _year(v: Column, path: str) -> Column:
    kind = variant_kind(v, path)
    number = F.when(kind.isin("BIGINT", "INT"), F.try_variant_get(v, path, "int"))
    digits = F.when(kind == "STRING", F.trim(F.try_variant_get(v, path, "string")))
    return F.coalesce(number, F.when(F.rlike(digits, F.lit(r"^\d+$")), digits).try_cast("int"))


def item_years(item: Column) -> Column:
    """First and last year of an item: its ``year``, else its ``interval``, else the years of its text."""
    year, start, end = _year(item, "$.year"), _year(item, "$.interval.start"), _year(item, "$.interval.end")
    is_text = F.schema_of_variant(item) == "STRING"
    told = years(F.when(is_text, F.try_variant_get(item, "$", "string")).otherwise(F.to_json(item)))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    return (
        F.when(year.isNotNull(), span(year, year))
        .when(start.isNotNull() | end.isNotNull(), span(F.coalesce(start, end), F.coalesce(end, start)))
        .otherwise(span(F.array_min(told), F.array_max(told)))
    )


def in_years(item: Column, start: int | None = None, end: int | None = None) -> Column:
    """DOC-2 as a predicate. Items without any year leave once there is a bound."""
    if start is None and end is None:
        return F.lit(True)
    span = item_years(item)
    keep = span["first"].isNotNull()
    if start is not None:
        keep = keep & (span["last"] >= start)
    if end is not None:
        keep = keep & (span["first"] <= end)
    return F.coalesce(keep, F.lit(False))


def year_window(items: Column | str, start: int | None = None, end: int | None = None) -> Column:
    """DOC-2 on an array of items; null gives an empty list."""
    kept = F.filter(col(items), lambda i: in_years(i, start, end))
    return F.coalesce(kept, F.array().cast(_NO_ITEMS))


def items_section(df: DataFrame, name: str, start: int | None = None, end: int | None = None, body: str = "body") -> DataFrame:
    """One row per item of a section with an ``items`` list, in order, inside the year window."""
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.posexplode(_items(F.col(body), f"$.{name}.items")).alias("ord", "item"))
    return rows.where(in_years(F.col("item"), start, end))


def supervisions(df: DataFrame, start: int | None = None, end: int | None = None, body: str = "body") -> DataFrame:
    """DOC-3: one row per supervision with its level and state."""
    groups = [
        F.struct(F.lit(level).alias("level"), F.lit(state).alias("state"), _items(F.col(body), f"$.supervisions.{level}.{state}").alias("items"))
        for level in fixed.SUPERVISION_LEVELS for state in ("completed", "ongoing")
    ]
    return _grouped(df, groups, ["level", "state"], start, end, body)


def activities(df: DataFrame, start: int | None = None, end: int | None = None, body: str = "body") -> DataFrame:
    """DOC-3: one row per academic activity with the name of its list."""
    groups = [
        F.struct(F.lit(name).alias("list"), _items(F.col(body), f"$.academicActivities.{name}").alias("items"))
        for name in fixed.ACTIVITY_LISTS
    ]
    return _grouped(df, groups, ["list"], start, end, body)


def _grouped(df: DataFrame, groups: list[Column], names: list[str], start, end, body: str) -> DataFrame:
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.explode(F.array(*groups)).alias("g")).select(*keep, "g.*")
    rows = rows.select(*keep, *names, F.posexplode("items").alias("ord", "item"))
    return rows.where(in_years(F.col("item"), start, end))


def trajectory(df: DataFrame, body: str = "body") -> DataFrame:
    """DOC-4: education and experience of each person."""
    keep = [c for c in df.columns if c != body]
    return df.select(
        *keep, _items(F.col(body), "$.education.items").alias("education"), _items(F.col(body), "$.experience.items").alias("experience")
    )


def research_interests(df: DataFrame, body: str = "body") -> DataFrame:
    """DOC-4: the expertise section."""
    keep = [c for c in df.columns if c != body]
    return df.select(*keep, section(body, "expertise").alias("expertise"))
