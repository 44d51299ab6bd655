"""Records inside curriculum pages (TXT-4): one row per education entry, project or publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape.functions.scalar import first_year, last_year
from trialscape.functions.text import html_section, html_section_until, html_to_text, strip_markup, unescape

# Fixed patterns of the page layout.
_LEFT = (
    r'<div class="layout-cell layout-cell-3 text-align-right">'
    r'<div class="layout-cell-pad-5 text-align-right"><b>([^<]+)</b></div></div>'
)
_RIGHT = r'<div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">'
EDUCATION = r"(?s)" + _LEFT + _RIGHT + r"(.*?)</div></div>"
PROJECT = (
    r"(?s)<a name='PP_[^']*'></a>" + _LEFT + _RIGHT + r'(.*?)<br class="clear" /></div></div>.*?' + _RIGHT + r"(.*?)</div></div>"
)
ARTICLE = r'(?s)<div class="artigo-completo">(.*?)</div><br class="clear"><br class="clear">'
PAPER = r'(?s)<span class="transform">(.*?)</span>'
ARTICLE_YEAR = r"data-tipo-ordenacao='ano'>(\d{4})</span>"
ARTICLE_DOI = r'icone-doi" href="https?://dx\.doi\.org/([^"]+)"'
PAPER_DOI = r'dx\.doi\.org/([^"\s]+)'
PROJECT_SECTIONS = {
    "ProjetosPesquisa": "research",
    "ProjetoDesenvolvimentoTecnologico": "development",
    "ProjetoDesenvolvimentoTecnologicoPI": "development",
    "OutrosProjetos": "other",
    "OutrosProjetosPI": "other",
}


def _found(c: Column, pattern: str) -> Column:
    return strip_markup(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))


def _found_all(c: Column, pattern: str) -> Column:
    items = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    return F.filter(items, lambda x: F.length(x) > 0)


def _records(df: DataFrame, section: Column, pattern: str, names: list[str], keep: list[str]) -> DataFrame:
    groups = [F.regexp_extract_all(F.col("__s"), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    rows = df.select(*keep, section.alias("__s"))  # a filter here would make the section, and the page, once more
    zipped = rows.select(*keep, *groups).select(*keep, F.posexplode(F.arrays_zip(*names)).alias("ord", "__r"))
    return zipped.select(*keep, "ord", "__r.*")


def _lines(c: str) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 0)


def _before(c: Column, sign: str) -> Column:
    return F.trim(F.substring_index(c, sign, 1))


def education(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    columns = keep or [c for c in df.columns if c != html]
    rows = _records(df, html_section(html, "FormacaoAcademicaTitulacao"), EDUCATION, ["years", "raw"], columns)
    rows = rows.withColumn("body", html_to_text("raw")).where("body IS NOT NULL").withColumn("__l", _lines("body"))
    place = F.get("__l", F.lit(1))
    country = F.regexp_replace(F.trim(F.substring_index(place, ",", -1)), r"\.+$", "")
    return rows.select(
        *columns, "ord",
        _before(F.get("__l", F.lit(0)), ".").alias("degree_name"),
        _found(F.col("body"), r"Título:\s*([^,]+)").alias("title"),
        place.alias("institution"),
        F.when(F.contains(place, F.lit(",")), country).alias("country"),
        first_year("years").alias("start_year"), last_year("years").alias("end_year"),
        F.slice("__l", 3, F.greatest(F.lit(0), F.size("__l") - 2)).alias("details"),
        _found_all(F.col("body"), r"Orientador:\s*([^\.]+)").alias("advisors"),
        _found_all(F.col("body"), r"Bolsista do\(a\):\s*([^\.]+)").alias("funding"),
    )


def projects(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    columns = keep or [c for c in df.columns if c != html]
    sections = F.array(
        *[F.struct(F.lit(k).alias("kind"), html_section(html, a).alias("text")) for a, k in PROJECT_SECTIONS.items()]
    )
    parts = df.select(*columns, F.posexplode(sections).alias("section", "__x")).select(*columns, "section", "__x.kind", "__x.text")
    rows = _records(parts, F.col("text"), PROJECT, ["years", "raw_title", "raw_body"], [*columns, "section", "kind"])
    rows = rows.withColumns({"name": html_to_text("raw_title"), "body": html_to_text("raw_body")})
    rows = rows.where("name IS NOT NULL OR body IS NOT NULL").withColumn("details", _lines("body"))
    described = F.try_element_at(F.filter("details", lambda d: F.startswith(d, F.lit("Descrição:"))), F.lit(1))
    return rows.select(
        *columns, "section", "ord", "kind", "name",
        F.trim(F.substr(described, F.lit(len("Descrição:") + 1))).alias("description"),
        first_year("years").alias("start_year"), last_year("years").alias("end_year"), "details",
    )


def publications(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Journal, conference and accepted papers. Text is ``authors . title. venue, ...``. Pages are read once."""
    columns = keep or [c for c in df.columns if c != html]
    sections = {
        "journal": ("ArtigosCompletos", "TrabalhosPublicadosAnaisCongresso", ARTICLE),
        "conference": ("TrabalhosPublicadosAnaisCongresso", "ArtigosAceitos", PAPER),
        "accepted": ("ArtigosAceitos", "OutrasProducoesBibliograficas", PAPER),
    }

    def part(kind: str, start: str, end: str, pattern: str) -> Column:
        found = F.regexp_extract_all(html_section_until(html, start, end), F.lit(pattern), F.lit(1))
        return F.transform(found, lambda raw, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), raw.alias("raw")))

    records = F.concat(*[part(kind, *where) for kind, where in sections.items()])
    journal, raw = F.col("kind") == "journal", F.col("raw")
    doi = F.when(journal, F.regexp_extract(raw, ARTICLE_DOI, 1)).otherwise(F.regexp_extract(raw, PAPER_DOI, 1))
    found = df.select(*columns, F.explode(records).alias("__r")).select(*columns, "__r.*").select(
        *columns, "kind", "ord", unescape(raw).alias("__text"), doi.alias("__doi"),
        F.when(journal, F.nullif(F.regexp_extract(raw, ARTICLE_YEAR, 1), F.lit(""))).alias("__year"),
    )
    # texts come out of an explode, below which no filter is pushed: they are made, and seen by Python, once
    rows = found.select(
        *columns, "kind", "ord", "__year", strip_markup(F.nullif(F.col("__doi"), F.lit(""))).alias("doi"),
        F.explode(F.array(strip_markup("__text"))).alias("text"),
    ).where("text IS NOT NULL")
    at = F.locate(" . ", F.col("text"))
    people = F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text"))
    rest = F.when(at > 0, F.substr("text", at + 3)).otherwise(F.lit(""))
    stop = F.locate(". ", rest)
    venue = F.trim(F.substring_index(F.substr(rest, stop + 2), ",", 1))
    return rows.select(
        *columns, "kind", "ord",
        F.when(stop > 0, F.nullif(F.trim(F.substr(rest, F.lit(1), stop - 1)), F.lit(""))).alias("title"),
        last_year(F.coalesce("__year", "text")).alias("year"),
        F.when(stop > 0, venue).alias("venue"),
        F.filter(F.transform(F.split(people, ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("authors"),
        "doi",
        F.array("text").alias("details"),
    )


def html_records(df: DataFrame, kind: str, html: str = "html") -> DataFrame:
    """TXT-4: ``kind`` is education, projects or publications."""
    return {"education": education, "projects": projects, "publications": publications}[kind](df, html)


def profile(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Identity of the person: name, nationality and citation names."""
    columns = keep or [c for c in df.columns if c != html]

    def labelled(anchor: str, label: str) -> Column:
        pattern = rf"(?s)<b>{label}</b></div></div>{_RIGHT}(.*?)</div></div>"
        return F.nullif(F.regexp_extract(html_section(html, anchor), pattern, 1), F.lit(""))

    names = F.coalesce(html_to_text(labelled("Identificacao", "Nome em citações bibliográficas")), F.lit(""))
    return df.select(
        *columns,
        html_to_text(F.nullif(F.regexp_extract(html, r'<h2 class="nome">([^<]+)</h2>', 1), F.lit(""))).alias("name"),
        html_to_text(labelled("Identificacao", "País de Nacionalidade")).alias("nationality"),
        F.filter(F.transform(F.split(names, ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("citation_names"),
    )
