"""Queries: answer behaviour, HTML, curricula, code workspaces, corpora."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions import scalar, text as text_fn
from trialscape.mart import tables as m
from trialscape.mart.registry import cte, register, rounded
from trialscape.session import settle
from trialscape.operators import behavior, corpus, curriculum, html as html_ops, segments, select as select_ops, symbols


def docs(spark, sf):
    return m.table(spark, sf, "documents")


# --- behaviour ---------------------------------------------------------------

def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(norm, '{t}')" for t in terms) + ")"


cte("x_norm", """
SELECT d.doc_id, d.lang, d.source, d.text, lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS norm, coalesce(l.quality = 1, false) AS good,
  len(regexp_extract_all(d.text, '[\\p{L}\\p{N}_]+')) AS words FROM documents d LEFT JOIN labels l USING (doc_id)""")
cte("x_flags", f"""
SELECT *, no_information OR not_found OR tool_limitation OR uncertainty_marker AS safe_failure, NOT empty_or_near_empty AND NOT (no_information OR not_found) AS substantive_answer,
  NOT good AND NOT (no_information OR not_found OR tool_limitation OR uncertainty_marker) AND NOT empty_or_near_empty AS overconfident_failure
FROM (SELECT doc_id, lang, source, good, {", ".join(f"{_any(t)} AS {k}" for k, t in fixed.BEHAVIOUR_TERMS.items())}, words < 5 AS empty_or_near_empty,
  regexp_matches(text, '\\p{{Nd}}') AS has_number, regexp_matches(text, '(^|\\n)\\s*(?:[-*•]|\\d+[.)])\\s+') AS has_list_marker, {_any(fixed.CONTEXT_TERMS)} AS mentions_context FROM x_norm)""")


def flagged(spark, sf):
    labels = m.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = docs(spark, sf).join(labels, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return behavior.behavior_flags(rows, "text", "good")


@register("behavior_flags", f"SELECT doc_id, {', '.join(behavior.FLAGS)} FROM x_flags")
def behavior_flags(spark, sf):
    return flagged(spark, sf).select("doc_id", *behavior.FLAGS)


_RATES = ", ".join(f"count(*) FILTER ({f}) / CAST(count(*) AS DOUBLE) * 100.0 AS {f}_rate_pct" for f in behavior.FLAGS)


@register("behavior_by_lang", f"SELECT lang, count(*) AS runs, {_RATES} FROM x_flags GROUP BY lang")
def behavior_by_lang(spark, sf):
    return behavior.summarize_behavior(flagged(spark, sf), ["lang"], context=False)


@register("behavior_by_source_lang", f"SELECT source, lang, count(*) AS runs, {_RATES} FROM x_flags GROUP BY source, lang")
def behavior_by_source_lang(spark, sf):
    return behavior.summarize_behavior(flagged(spark, sf), ["source", "lang"], context=False)


@register("behavior_of_runs", """
SELECT configurationId, count(*) AS runs, count(*) FILTER (len(regexp_extract_all(response, '[\\p{L}\\p{N}_]+')) < 5) / CAST(count(*) AS DOUBLE) * 100.0 AS empty_or_near_empty_rate_pct,
  count(*) FILTER (regexp_matches(response, '[0-9]')) / CAST(count(*) AS DOUBLE) * 100.0 AS has_number_rate_pct,
  count(*) FILTER (fullm) / CAST(count(*) AS DOUBLE) * 100.0 AS full_unanimous_meet_rate_pct, avg(cost) AS total_cost_tokens_corrected_avg
FROM x_runs GROUP BY configurationId""")
def behavior_of_runs(spark, sf):
    from trialscape.mart.q_study import runs

    table = behavior.summarize_behavior(behavior.behavior_flags(runs(spark, sf, text=True)), ["configurationId"])
    return table.select("configurationId", "runs", "empty_or_near_empty_rate_pct", "has_number_rate_pct",
                        "full_unanimous_meet_rate_pct", "total_cost_tokens_corrected_avg")


def _flag_rows(spark, sf):
    return flagged(spark, sf).select(
        F.col("doc_id").alias("trialId"), F.lit("t").alias("taskId"), F.col("source").alias("modelId"), F.col("lang").alias("configurationId"),
        F.lit("text").alias("representation"), F.col("good").alias("full_unanimous_meet"), F.col("good").alias("strict_majority_meet"),
        "has_number", F.col("text").alias("response"),
    )


@register("behavior_examples", """
SELECT doc_id, lang FROM x_flags WHERE has_number AND lang = 'en'""")
def behavior_examples(spark, sf):
    found = select_ops.behavior_examples(_flag_rows(spark, sf), "has_number", configuration="en", limit=None)
    return found.select(F.col("trialId").alias("doc_id"), F.col("configurationId").alias("lang"))


@register("behavior_examples_first", """
SELECT doc_id, lang FROM x_flags WHERE has_number AND lang = 'fr' ORDER BY doc_id LIMIT 25""")
def behavior_examples_first(spark, sf):
    """The first 25 of one configuration; the limit is the listing's own."""
    found = select_ops.behavior_examples(_flag_rows(spark, sf), "has_number", configuration="fr", task="t", limit=25)
    return found.select(F.col("trialId").alias("doc_id"), F.col("configurationId").alias("lang"))


@register("word_and_token_counts", """
SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words, greatest(1, length(text) // 4) AS tokens FROM documents""")
def word_and_token_counts(spark, sf):
    return docs(spark, sf).select("doc_id", scalar.word_count("text").alias("words"), scalar.est_tokens("text").alias("tokens"))


# --- pages -------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<br[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\\s+\\n', chr(10), 'g'), '\\n\\s+', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_PLAIN = "regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@register("html_text", f"SELECT page_id, nullif({_CLEAN.format(_PLAIN)}, '') AS text FROM pages")
def html_text(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", text_fn.html_to_text("html").alias("text"))


@register("html_title", f"""
SELECT page_id, nullif({_CLEAN.format("regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', chr(34)), '&amp;?', '&', 'g')")}, '') AS title,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def html_title(spark, sf):
    p = m.table(spark, sf, "pages")
    title = text_fn.html_to_text(text_fn.slice_between("html", "<title>", "</title>", keep_start=False))
    return p.select("page_id", title.alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@register("html_slices", """
SELECT page_id, CASE WHEN strpos(html, '<article>') = 0 THEN '' WHEN strpos(substr(html, strpos(html, '<article>') + 1), '</article>') = 0 THEN substr(html, strpos(html, '<article>'))
  ELSE substr(html, strpos(html, '<article>'), strpos(substr(html, strpos(html, '<article>') + 1), '</article>')) END AS article FROM pages""")
def html_slices(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", text_fn.slice_between("html", "<article>", "</article>").alias("article"))


@register("page_decoding", "SELECT page_id, html FROM pages")
def page_decoding(spark, sf):
    """Every second page as Latin-1 bytes where its characters allow it, the others as UTF-8."""
    from trialscape.sources.catalog import decode_page

    p = m.table(spark, sf, "pages")
    narrow = F.rlike("html", F.lit(r"^[\x00-\x7f -ÿ]*$")) & F.rlike("html", F.lit(r"[à-ÿ][a-z ]"))
    content = F.when(narrow & (F.col("page_id") % 2 == 0), F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    return p.select("page_id", decode_page(content).alias("html"))


def _t(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _cell(left: Column, right: Column) -> Column:
    return _t(
        '<div class="layout-cell layout-cell-3 text-align-right"><div class="layout-cell-pad-5 text-align-right"><b>', left,
        '</b></div></div><div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">', right, "</div></div>",
    )


def curriculum_pages(spark, sf):
    """A curriculum page per order, written in the page layout from the order's own values."""
    o = m.table(spark, sf, "orders")
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    degree = _t("Degree ", k, ". more<br>Institute of &Aacute;", F.col("o_custkey"), ", Land ", k % 7, ".<br/>Título: Work ", k,
                ", Ano<br>Orientador: Prof ", F.col("o_custkey"), ".<br>Bolsista do(a): Fund ", F.col("o_orderstatus"), ".")
    entry = _cell(_t(year - 4, " - ", year), degree)
    second = F.when(k % 3 == 0, _cell(_t(year - 9), F.lit("Course A. x<br>School B"))).otherwise(F.lit(""))
    project = _t(
        "<a name='PP_x", k, "'></a>", '<div class="layout-cell layout-cell-3 text-align-right"><div class="layout-cell-pad-5 text-align-right"><b>',
        year, " - Atual", '</b></div></div><div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">Project &amp; ', k,
        '<br class="clear" /></div></div><div>x</div><div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">Descrição: About ',
        F.col("o_orderpriority"), "<br>Situação: open</div></div>",
    )
    article = _t(
        '<div class="artigo-completo"><span data-tipo-ordenacao=\'ano\'>', year, '</span><a class="icone-doi" href="http://dx.doi.org/10.1/', k,
        '"></a>A, B; C, D . Title ', k, ". Venue ", k % 5, ', v. 1</div><br class="clear"><br class="clear">',
    )
    paper = _t('<span class="transform">E, F . Paper ', k, ". Conf ", k % 3, ", in ", year, "</span>")
    page = _t(
        '<h2 class="nome">Person ', k, '</h2><a name="Identificacao"></a>',
        _cell(F.lit("x"), F.lit("y")), "<b>País de Nacionalidade</b></div></div><div class=\"layout-cell layout-cell-9\"><div class=\"layout-cell-pad-5\">Land ", k % 7,
        "</div></div>", "<b>Nome em citações bibliográficas</b></div></div><div class=\"layout-cell layout-cell-9\"><div class=\"layout-cell-pad-5\">P, ", k, "; Q, ", k,
        '</div></div><div class="title-wrapper">', '<a name="FormacaoAcademicaTitulacao"></a>', entry, second, '<div class="title-wrapper">',
        '<a name="OutrosProjetos"></a>', project, '<div class="title-wrapper"><a name="ArtigosCompletos"></a>', article,
        '<a name="TrabalhosPublicadosAnaisCongresso"></a>', paper, '<a name="ArtigosAceitos"></a><a name="OutrasProducoesBibliograficas"></a>',
    )
    return o.select(k.alias("id"), page.alias("html"))


@register("html_education", """
SELECT o_orderkey AS id, 0 AS ord, 'Degree ' || o_orderkey AS degree_name, 'Work ' || o_orderkey AS title, 'Institute of Á' || o_custkey || ', Land ' || (o_orderkey % 7) || '.' AS institution,
  'Land ' || (o_orderkey % 7) AS country, year(o_orderdate) - 4 AS start_year, year(o_orderdate) AS end_year, 'Prof ' || o_custkey AS advisors, 'Fund ' || o_orderstatus AS funding FROM orders
UNION ALL SELECT o_orderkey, 1, 'Course A', NULL, 'School B', NULL, year(o_orderdate) - 9, year(o_orderdate) - 9, '', '' FROM orders WHERE o_orderkey % 3 = 0""")
def html_education(spark, sf):
    rows = html_ops.html_records(curriculum_pages(spark, sf), "education")
    return rows.select("id", "ord", "degree_name", "title", "institution", "country", F.col("start_year").cast("long").alias("start_year"),
                       F.col("end_year").cast("long").alias("end_year"), F.array_join("advisors", ";").alias("advisors"), F.array_join("funding", ";").alias("funding"))


@register("html_projects", """
SELECT o_orderkey AS id, 'other' AS kind, 'Project & ' || o_orderkey AS name, 'About ' || o_orderpriority AS description, year(o_orderdate) AS start_year, year(o_orderdate) AS end_year FROM orders""")
def html_projects(spark, sf):
    rows = html_ops.html_records(curriculum_pages(spark, sf), "projects")
    return rows.select("id", "kind", "name", "description", F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"))


@register("html_publications", """
SELECT o_orderkey AS id, 'journal' AS kind, 'Title ' || o_orderkey AS title, year(o_orderdate) AS year, 'Venue ' || (o_orderkey % 5) AS venue, year(o_orderdate) || 'A, B|C, D' AS authors, '10.1/' || o_orderkey AS doi FROM orders
UNION ALL SELECT o_orderkey, 'conference', 'Paper ' || o_orderkey, year(o_orderdate), 'Conf ' || (o_orderkey % 3), 'E, F', NULL FROM orders""")
def html_publications(spark, sf):
    rows = html_ops.html_records(curriculum_pages(spark, sf), "publications")
    return rows.select("id", "kind", "title", F.col("year").cast("long").alias("year"), "venue", F.array_join("authors", "|").alias("authors"), "doi")


@register("html_profile", """
SELECT o_orderkey AS id, 'Person ' || o_orderkey AS name, 'Land ' || (o_orderkey % 7) AS nationality, 'P, ' || o_orderkey || '|Q, ' || o_orderkey AS citation_names FROM orders""")
def html_profile(spark, sf):
    return html_ops.profile(curriculum_pages(spark, sf)).select("id", "name", "nationality", F.array_join("citation_names", "|").alias("citation_names"))


# --- curriculum JSON ---------------------------------------------------------

def curricula(spark, sf):
    """A curriculum document per customer."""
    c = m.table(spark, sf, "customer")
    k = F.col("c_custkey")
    year = (k % 40 + 1980).cast("int")
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("int")

    def item(title=text, y=number, start=text, end=text, extra=text):
        span = F.when(start.isNotNull() | end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
        return F.struct(title.alias("degreeName"), y.alias("year"), span.alias("interval"), extra.alias("note"))

    degrees = F.array(item(_t("BSc ", k), start=year.cast("string"), end=(year + 4).cast("string")), item(F.lit("PhD"), y=year + 9))
    items = F.array(item(F.lit("a"), y=year), item(F.lit("b"), start=year.cast("string"), end=(year + 5).cast("string")), item(F.lit("c"), extra=_t("in ", year + 2, " and ", year + 8)), item(F.lit("d")))
    papers = F.array(
        F.struct(F.lit("Artigo em periódico").alias("category"), _t("Full ", k).alias("title"), year.cast("string").alias("year"), F.array(F.lit("A"), F.lit("B")).alias("authors"),
                 F.lit("V").alias("venue"), _t("http://doi.org/10/", k).alias("doi"), text.alias("text"), F.lit("1-2").alias("pages")),
        F.struct(F.lit("Anais").alias("category"), text.alias("title"), text.alias("year"), F.array().cast("array<string>").alias("authors"), text.alias("venue"), text.alias("doi"),
                 _t("X, Y; Z. Told ", k, ". Place, p. 3. ", year, " https://doi.org/10.9/", k, ".").alias("text"), text.alias("pages")),
        F.struct(F.lit("x").alias("category"), text.alias("title"), text.alias("year"), F.array().cast("array<string>").alias("authors"), text.alias("venue"), text.alias("doi"), text.alias("text"), text.alias("pages")),
    )
    plans = F.array(F.struct(F.lit("research_project").alias("type"), _t("P ", k).alias("name"), F.lit(" d ").alias("description"),
                             F.struct(year.cast("string").alias("start"), text.alias("end")).alias("interval")))
    done = F.struct(F.struct(items.alias("completed"), F.when(k % 2 == 0, items).alias("ongoing")).alias("masters"), F.struct(items.alias("completed")).alias("doctoral"))
    body = F.struct(
        F.struct(degrees.alias("degrees"), items.alias("items")).alias("education"), plans.alias("projects"), F.struct(papers.alias("bibliographical")).alias("production"),
        done.alias("supervisions"), F.struct(items.alias("editorialBoards")).alias("academicActivities"), F.struct(items.alias("items")).alias("experience"),
        F.when(k % 5 != 0, F.struct(F.col("c_mktsegment").alias("area"))).alias("expertise"),
    )
    return c.select(k.alias("id"), F.try_parse_json(F.to_json(body)).alias("body"))


cte("x_people", "SELECT c_custkey AS id, CAST(c_custkey % 40 + 1980 AS INTEGER) AS y, c_mktsegment AS seg FROM customer")


@register("curriculum_publications", """
SELECT id, 'journal' AS kind, 'Full ' || id AS title, y AS year, 'V' AS venue, 'A|B' AS authors, '10/' || id AS doi, 'pages: 1-2' AS details FROM x_people
UNION ALL SELECT id, 'conference', 'Told ' || id, y, 'Place', 'X, Y|Z', '10.9/' || id, 'text: X, Y; Z. Told ' || id || '. Place, p. 3. ' || y || ' https://doi.org/10.9/' || id || '.' FROM x_people""")
def curriculum_publications(spark, sf):
    rows = curriculum.curriculum_records(curricula(spark, sf), "publications")
    return rows.select("id", "kind", "title", "year", "venue", F.array_join("authors", "|").alias("authors"), "doi", F.array_join("details", "|").alias("details"))


@register("curriculum_projects", "SELECT id, 'research project' AS kind, 'P ' || id AS name, 'd' AS description, y AS start_year, CAST(NULL AS INTEGER) AS end_year FROM x_people")
def curriculum_projects(spark, sf):
    return curriculum.curriculum_records(curricula(spark, sf), "projects").select("id", "kind", "name", "description", "start_year", "end_year")


@register("curriculum_education", """
SELECT id, 0 AS ord, 'BSc ' || id AS degree_name, y AS start_year, y + 4 AS end_year FROM x_people UNION ALL SELECT id, 1, 'PhD', NULL, NULL FROM x_people""")
def curriculum_education(spark, sf):
    return curriculum.curriculum_records(curricula(spark, sf), "education").select("id", "ord", "degree_name", "start_year", "end_year")


cte("x_items", """
SELECT id, 0 AS ord, 'a' AS name, y AS lo, y AS hi FROM x_people UNION ALL SELECT id, 1, 'b', y, y + 5 FROM x_people
UNION ALL SELECT id, 2, 'c', y + 2, y + 8 FROM x_people""")


@register("year_window", "SELECT id, ord, name FROM x_items WHERE hi >= 1995 AND lo <= 2003")
def year_window(spark, sf):
    rows = curriculum.items_section(curricula(spark, sf), "education", 1995, 2003)
    return rows.select("id", "ord", F.try_variant_get("item", "$.degreeName", "string").alias("name"))


@register("year_window_array", "SELECT id, count(*) FILTER (lo <= 1999) AS kept, 4 AS unbounded FROM x_items GROUP BY id")
def year_window_array(spark, sf):
    items = F.try_variant_get("body", "$.experience.items", "array<variant>")
    return curricula(spark, sf).select(
        "id", F.size(curriculum.year_window(items, end=1999)).cast("long").alias("kept"), F.size(curriculum.year_window(items)).cast("long").alias("unbounded")
    )


@register("supervision_groups", """
SELECT level, state, count(*) AS n FROM (SELECT 'masters' AS level, 'completed' AS state, * FROM x_items UNION ALL SELECT 'masters', 'ongoing', * FROM x_items WHERE id % 2 = 0
  UNION ALL SELECT 'doctoral', 'completed', * FROM x_items) WHERE hi >= 2000 GROUP BY level, state""")
def supervision_groups(spark, sf):
    return curriculum.supervisions(curricula(spark, sf), start=2000).groupBy("level", "state").agg(F.count(F.lit(1)).alias("n"))


@register("activity_groups", "SELECT 'editorialBoards' AS list, count(*) AS n FROM x_items WHERE lo <= 1990")
def activity_groups(spark, sf):
    return curriculum.activities(curricula(spark, sf), end=1990).groupBy("list").agg(F.count(F.lit(1)).alias("n"))


@register("trajectory", "SELECT id, 4 AS education, 4 AS experience FROM x_people")
def trajectory(spark, sf):
    t = curriculum.trajectory(curricula(spark, sf))
    return t.select("id", F.size("education").cast("long").alias("education"), F.size("experience").cast("long").alias("experience"))


@register("section_projection", "SELECT id, CASE WHEN id % 5 <> 0 THEN '{\"area\":\"' || seg || '\"}' ELSE '{\"area\":\"none\"}' END AS expertise, '{}' AS missing FROM x_people")
def section_projection(spark, sf):
    rows = curricula(spark, sf)
    own = curriculum.section("body", "expertise", '{"area":"none"}')
    return rows.select("id", F.to_json(own).alias("expertise"), F.to_json(curriculum.section("body", "profile")).alias("missing"))


# --- code workspaces ---------------------------------------------------------

cte("x_lines", """
SELECT doc_id, i - 1 AS i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)""")
cte("x_parts", """
SELECT doc_id, i, j - 1 AS j, parts[j] AS part FROM (SELECT doc_id, i, string_split(line, '. ') AS parts FROM x_lines), unnest(range(1, len(parts) + 1)) t(j)""")


def workspaces(spark, sf):
    """A file per document: its lines are classes, the sentences of a line are their methods; every
    seventh line names its sentences functions, every fifth document has ids of its own."""
    k = F.col("doc_id")

    def method(s, j, i):
        return F.struct(
            F.when(i % 7 == 0, F.lit("function")).otherwise(F.lit("method")).alias("kind"), _t("m", j).alias("name"), (j + 1).alias("start_line"), (j + 2).alias("end_line"),
            s.alias("code"), F.lit(None).cast("string").alias("symbol_id"),
        )

    def line(x, i):
        return F.struct(
            F.lit("class").alias("kind"), _t("L", i).alias("name"), i.alias("start_line"), (i + 1).alias("end_line"), x.alias("code"),
            F.when(k % 5 == 0, _t("own-", k, "-", i)).alias("symbol_id"), F.transform(F.split(x, r"\. "), lambda s, j: method(s, j, i)).alias("children"),
        )

    tree = F.transform(F.split("text", "\n"), line)
    return docs(spark, sf).select(
        F.col("source").alias("workspaceId"), _t("src/", F.col("lang"), "/", k, ".py").alias("path"), F.lit("python").alias("language"),
        F.when(k % 2 == 0, F.lit("ok")).alias("parse_status"), F.col("text").alias("unparsed_code"), F.try_parse_json(F.to_json(tree)).alias("symbols"),
    )


_FILE = "source AS workspaceId, 'src/' || lang || '/' || doc_id || '.py' AS path"
_LINE_ID = """CASE WHEN doc_id % 5 = 0 THEN 'own-' || doc_id || '-' || i ELSE 'repoqa:' || substr(sha256('{"end_line": ' || (i + 1) || ', "kind": "class", "path": "src/' || lang || '/' || doc_id
  || '.py", "qualified_name": "L' || i || '", "sibling_index": ' || i || ', "start_line": ' || CASE WHEN i = 0 THEN 'null' ELSE CAST(i AS VARCHAR) END || '}'), 1, 20) END"""
cte("x_symbols", f"""
SELECT {_FILE}, {_LINE_ID} AS symbol_id, NULL AS parent_id, 0 AS depth, 'class' AS kind, 'L' || i AS qualified_name, nullif(i, 0) AS start_line, doc_id, i, -1 AS j, line AS code
FROM x_lines JOIN documents USING (doc_id)
UNION ALL SELECT {_FILE}, 'repoqa:' || substr(sha256('{{"end_line": ' || (j + 2) || ', "kind": "' || CASE WHEN i % 7 = 0 THEN 'function' ELSE 'method' END || '", "path": "src/' || lang || '/' || doc_id
  || '.py", "qualified_name": "L' || i || '.m' || j || '", "sibling_index": ' || j || ', "start_line": ' || (j + 1) || '}}'), 1, 20), {_LINE_ID}, 1,
  CASE WHEN i % 7 = 0 THEN 'function' ELSE 'method' END, 'L' || i || '.m' || j, j + 1, doc_id, i, j, part FROM x_parts JOIN documents USING (doc_id)""")


def flat(spark, sf):
    return symbols.flatten_symbols(workspaces(spark, sf).select("workspaceId", "path", "symbols"), depth=3)


def flat_table(spark, sf):
    """The flat symbols as a table: looking up ancestors reads them twice."""
    return settle(flat(spark, sf))


@register("flatten_tree", "SELECT workspaceId, path, symbol_id, parent_id, depth, kind, qualified_name, CAST(start_line AS INTEGER) AS start_line FROM x_symbols")
def flatten_tree(spark, sf):
    return flat(spark, sf).select("workspaceId", "path", "symbol_id", "parent_id", "depth", "kind", "qualified_name", "start_line")


@register("recursive_counts", f"""
SELECT {_FILE}, 'python' AS language, coalesce(n, 0) AS symbol_count, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'unknown' END AS parse_status
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM x_symbols GROUP BY doc_id) USING (doc_id)""")
def recursive_counts(spark, sf):
    return symbols.list_files(workspaces(spark, sf), flat(spark, sf))


@register("list_symbols", """
SELECT path, symbol_id, kind FROM x_symbols s WHERE path LIKE 'src/en/%' AND (kind = 'function' OR kind = 'method')
UNION ALL SELECT path, symbol_id, kind FROM x_symbols s WHERE path LIKE 'src/en/%' AND kind = 'class'""")
def list_symbols(spark, sf):
    return symbols.list_symbols(flat_table(spark, sf), "src/en/", "function").select("path", "symbol_id", "kind")


@register("list_symbols_kind", """
SELECT path, qualified_name, kind FROM x_symbols WHERE kind = 'method' OR (kind = 'class' AND i % 7 <> 0)""")
def list_symbols_kind(spark, sf):
    return symbols.list_symbols(flat_table(spark, sf), kind="method").select("path", "qualified_name", "kind")


@register("get_symbols", "SELECT workspaceId, symbol_id, code FROM x_symbols WHERE doc_id % 5 = 0 AND i % 2 = 0 AND j = -1")
def get_symbols(spark, sf):
    rows = docs(spark, sf).where("doc_id % 5 = 0").select(
        F.col("source").alias("workspaceId"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    ids = rows.where("i % 2 = 0").select("workspaceId", _t("own-", F.col("doc_id"), "-", F.col("i")).alias("symbol_id"))
    return symbols.get_symbol(flat(spark, sf), ids).select("workspaceId", "symbol_id", "code")


@register("read_files", f"""
SELECT {_FILE}, text AS content FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT {_FILE}, text FROM documents WHERE doc_id % 3 <> 0 AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) = 1)""")
def read_files(spark, sf):
    files = workspaces(spark, sf)
    visible = files.where(F.regexp_extract("path", r"/(\d+)\.py$", 1).cast("int") % 3 == 0).withColumn("content", F.col("unparsed_code"))
    return symbols.read_file(files, visible).select("workspaceId", "path", "content")


@register("visible_symbols", """
SELECT path, qualified_name, CASE WHEN seen THEN code END AS code FROM (SELECT s.*, trim(s.code, chr(10) || ' ' || chr(9) || chr(13)) <> '' AND contains(h.half, trim(s.code, chr(10) || ' ' || chr(9) || chr(13))) AS seen,
  bool_or(trim(s.code, chr(10) || ' ' || chr(9) || chr(13)) <> '' AND contains(h.half, trim(s.code, chr(10) || ' ' || chr(9) || chr(13)))) OVER (PARTITION BY s.doc_id, s.i) AS family
  FROM x_symbols s JOIN (SELECT doc_id, trim(substr(text, 1, length(text) // 2), chr(10) || ' ' || chr(9) || chr(13)) AS half FROM documents) h USING (doc_id)) WHERE seen OR (j = -1 AND family)""")
def visible_symbols(spark, sf):
    texts = workspaces(spark, sf).select("workspaceId", "path", F.substr("unparsed_code", F.lit(1), F.floor(F.length("unparsed_code") / 2).cast("int")).alias("content"))
    return symbols.visible_symbols(flat_table(spark, sf), texts).select("path", "qualified_name", "code")


def marked(spark, sf):
    """Each document twice in one text, under markers of several styles."""
    k = F.col("doc_id").cast("string")
    body = _t("# Repository: r\n# File: a/", k, ".py\n\n", F.col("text"), "\n\n// Path: b.js\n", F.col("lang"), "\n<!-- File: b.js -->\n", F.col("source"), "\n/* path: c.c */\n\n")
    return docs(spark, sf).select(k.alias("workspaceId"), body.alias("text"), F.lit("start").alias("default_path"))


_EDGES = "regexp_replace(regexp_replace(text, '^([ \\t\\r]*\\n)+', ''), '(\\n[ \\t\\r]*)+$', '')"


@register("split_files", f"""
SELECT CAST(doc_id AS VARCHAR) AS workspaceId, 'a/' || doc_id || '.py' AS path, CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN '' ELSE {_EDGES} || chr(10) END AS content FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'b.js', source || chr(10) FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'c.c', '' FROM documents""")
def split_files(spark, sf):
    return segments.split_files(marked(spark, sf))


@register("split_built_files", """
SELECT CAST(doc_id AS VARCHAR) AS workspaceId, 'a/' || doc_id || '.py' AS path, trim(text, chr(10)) AS content FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'b.js', lang || chr(10) || chr(10) || source || chr(10) || '/* path: c.c */' FROM documents""")
def split_built_files(spark, sf):
    return segments.split_built_files(marked(spark, sf))


@register("trim_tree", "SELECT conv_id, turn, trim(text) AS a, trim(role) AS b FROM conversations")
def trim_tree(spark, sf):
    c = m.table(spark, sf, "conversations")
    pad = lambda x: F.concat(F.lit("  "), x, F.lit("\n "))
    nested = c.select("conv_id", "turn", F.struct(F.array(pad(F.col("text"))).alias("list"), F.create_map(F.lit(" k"), pad(F.col("role"))).alias("map")).alias("v"))
    trimmed = nested.select("conv_id", "turn", text_fn.trim_tree(F.col("v"), nested.schema["v"].dataType).alias("v"))
    return trimmed.select("conv_id", "turn", F.col("v.list")[0].alias("a"), F.element_at("v.map", F.lit(" k")).alias("b"))


# --- corpora -----------------------------------------------------------------

LANGS = {"en": "py", "fr": "Python", "de": "js", "es": "golang"}
_LANG_SQL = "CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'Python' WHEN 'de' THEN 'js' ELSE 'golang' END"
_NORM_SQL = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'javascript' ELSE 'go' END"
_SHORT_SQL = "CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'js' ELSE 'go' END"


def corpus_files(spark, sf):
    return docs(spark, sf).select(
        scalar.lookup(LANGS, "lang").alias("language"), F.substr("source", F.lit(4)).cast("int").alias("repo_ord"), F.concat_ws("/", "source", "lang").alias("repo"),
        _t("d", F.col("doc_id")).alias("path"), F.col("text").alias("source"), "doc_id",
    )


def corpus_needles(spark, sf):
    """A needle per labelled document; toxic ones point to a file that does not exist, low quality ones lack a description."""
    l = m.table(spark, sf, "labels")
    d = docs(spark, sf).join(l, "doc_id", "inner")
    return d.select(
        scalar.lookup(LANGS, "lang").alias("language"), F.substr("source", F.lit(4)).cast("int").alias("repo_ord"), F.concat_ws("/", "source", "lang").alias("repo"),
        F.lit(10).alias("needle_count"), (F.col("doc_id") % 10).alias("needle_ord"), "doc_id", _t(" n", F.col("doc_id")).alias("name"),
        F.when(F.col("toxic") == 1, F.lit("nowhere")).otherwise(_t("d", F.col("doc_id"))).alias("path"), F.when(F.col("quality") == 1, F.lit("what it does")).otherwise(F.lit(" ")).alias("description"),
        F.lit(0).alias("start_line"), F.when(F.col("doc_id") % 2 == 0, F.lit(2)).alias("end_line"), F.lit(3).alias("start_byte"), F.lit(40).alias("end_byte"),
    )


def ordered_needles(spark, sf):
    rows = corpus_needles(spark, sf).withColumn("needle_ord", F.col("doc_id"))
    return corpus.select_needles(rows, corpus_files(spark, sf))


cte("x_needles", f"""
SELECT doc_id, {_LANG_SQL} AS language, {_NORM_SQL} AS normalized_language, source || '/' || lang AS repo, 'n' || doc_id AS name, text,
  row_number() OVER (PARTITION BY {_NORM_SQL} ORDER BY CAST(substr(source, 4) AS INTEGER), {_LANG_SQL}, doc_id) AS sequence, {_SHORT_SQL} AS short
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0""")
cte("x_needle_ids", "SELECT *, short || '_' || CASE WHEN sequence < 1000 THEN lpad(CAST(sequence AS VARCHAR), 3, '0') ELSE CAST(sequence AS VARCHAR) END AS base_id FROM x_needles")


@register("select_needles", "SELECT doc_id, normalized_language, sequence, base_id FROM x_needle_ids")
def select_needles(spark, sf):
    return ordered_needles(spark, sf).select("doc_id", "normalized_language", "sequence", "base_id")


@register("select_needles_cap", "SELECT doc_id, base_id FROM x_needle_ids WHERE normalized_language IN ('python', 'go') AND sequence <= 15")
def select_needles_cap(spark, sf):
    rows = corpus_needles(spark, sf).withColumn("needle_ord", F.col("doc_id"))
    return corpus.select_needles(rows, corpus_files(spark, sf), ["PY", "golang"], 15).select("doc_id", "base_id")


@register("expand_instances", """
SELECT doc_id, base_id || s.label AS instance_id, s.size AS requested_context_tokens FROM x_needle_ids CROSS JOIN (VALUES (2048, '_ctx2k'), (500, '_ctx500')) s(size, label)""")
def expand_instances(spark, sf):
    return corpus.expand_instances(ordered_needles(spark, sf), [2048, 500, 2048]).select("doc_id", "instance_id", "requested_context_tokens")


@register("instances_index", """
SELECT base_id || '_ctx2k' AS instanceId, base_id AS baseId, sequence, repo, name AS needleName, 2048 AS requestedContextTokens, 'context/' || base_id || '_ctx2k' AS contextDir FROM x_needle_ids""")
def instances_index(spark, sf):
    table = corpus.instances_index(corpus.expand_instances(ordered_needles(spark, sf), [2048]))
    return table.select("instanceId", "baseId", "sequence", "repo", "needleName", "requestedContextTokens", "contextDir")


@register("target_slice", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) WHEN length(text) >= 40 THEN substr(text, 4, 37) ELSE '' END AS target
FROM documents JOIN labels USING (doc_id)""")
def target_slice(spark, sf):
    needles = corpus_needles(spark, sf).select("doc_id", "start_line", "end_line", "start_byte", "end_byte")
    joined = needles.join(corpus_files(spark, sf).select("doc_id", "source"), "doc_id", "inner")
    return joined.select("doc_id", corpus.target_text().alias("target"))


cte("x_places", """
SELECT source || '/' || lang AS repo, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS pos, greatest(1, length(text) // 4) AS tokens, text FROM documents""")
for _size, _label in ((2048, "2k"), (16384, "16k"), (65536, "64k")):
    cte(f"x_cells_{_label}", f"""
SELECT base_id || '_ctx{_label}' AS instance_id, p.repo, p.pos AS mid, CAST(floor(greatest(0, {_size} - p.tokens) * 0.55::DOUBLE) AS BIGINT) AS before,
  greatest(0, {_size} - p.tokens) - CAST(floor(greatest(0, {_size} - p.tokens) * 0.55::DOUBLE) AS BIGINT) AS after FROM x_needle_ids n JOIN x_places p USING (doc_id)""")
    cte(f"x_packed_{_label}", f"""
SELECT instance_id, repo, pos, doc_id, tokens FROM (
  SELECT c.instance_id, c.repo, p.pos, p.doc_id, p.tokens, c.mid, c.before, c.after,
    sum(p.tokens) OVER (PARTITION BY c.instance_id, sign(p.pos - c.mid) ORDER BY abs(p.pos - c.mid)) AS run
  FROM x_cells_{_label} c JOIN x_places p ON c.repo = p.repo) WHERE pos = mid OR (pos < mid AND run <= before) OR (pos > mid AND run <= after)""")


def placed_files(spark, sf):
    from trialscape.operators.ranking import seq_cap

    f = corpus_files(spark, sf).select("repo", "path", "source", "doc_id")
    return seq_cap(f, ["repo"], ["doc_id", "path"], name="pos").withColumn("pos", F.col("pos") - 1)


def packed(spark, sf, size=2048):
    cells = corpus.expand_instances(ordered_needles(spark, sf), [size]).withColumn("position_ratio", F.lit(0.55))
    files = placed_files(spark, sf)
    return corpus.pack_context(cells.select("instance_id", "repo", "path", "requested_context_tokens", "position_ratio"), files), files


def packed_places(spark, sf, size):
    rows, _ = packed(spark, sf, size)
    return rows.select("instance_id", "pos", F.substr("path", F.lit(2)).cast("long").alias("doc_id"), "tokens")


@register("pack_context", "SELECT instance_id, pos, doc_id, tokens FROM x_packed_2k")
def pack_context(spark, sf):
    return packed_places(spark, sf, 2048)


@register("pack_context_16k", "SELECT instance_id, pos, doc_id, tokens FROM x_packed_16k")
def pack_context_16k(spark, sf):
    return packed_places(spark, sf, 16384)


@register("pack_context_64k", "SELECT instance_id, pos, doc_id, tokens FROM x_packed_64k")
def pack_context_64k(spark, sf):
    return packed_places(spark, sf, 65536)


@register("render_context", """
SELECT instance_id, n.short AS language, CASE WHEN normalized_language = 'python' THEN '#' ELSE '//' END || ' Repository: ' || n.repo || chr(10) || CASE WHEN normalized_language = 'python' THEN '#' ELSE '//' END
  || ' File: d' || n.doc_id || chr(10) || chr(10) || regexp_replace(c.code, '^\\n+|\\n+$', '', 'g') || chr(10) AS context, c.tokens AS code_context_ntokens
FROM (SELECT instance_id, string_agg(text, chr(10) ORDER BY x_packed_2k.pos) AS code, CAST(sum(x_packed_2k.tokens) AS BIGINT) AS tokens
  FROM x_packed_2k JOIN documents USING (doc_id) GROUP BY instance_id) c JOIN x_needle_ids n ON c.instance_id = n.base_id || '_ctx2k'""")
def render_context(spark, sf):
    rows, files = packed(spark, sf)
    texts = corpus.code_context(rows, files)
    cells = corpus.expand_instances(ordered_needles(spark, sf), [2048]).select("instance_id", "normalized_language", "repo", "path")
    joined = cells.join(texts, "instance_id", "inner")
    return joined.select("instance_id", corpus.short_language(F.col("normalized_language")).alias("language"), corpus.render_context().alias("context"), "code_context_ntokens")


cte("x_bodies", """
SELECT doc_id AS id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents""")
cte("x_goals", """
SELECT item_id AS id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM benchmark""")
_GRAMS = "SELECT id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS g FROM {} WHERE len(w) > 0"
cte("x_docgrams", _GRAMS.format("x_bodies"))
cte("x_goalgrams", _GRAMS.format("x_goals"))
cte("x_scores", """
SELECT d.id, t.id AS target, count(*) AS shared, any_value(d.n) AS dn, any_value(t.n) AS tn FROM (SELECT id, len(g) AS n, unnest(g) AS gram FROM x_docgrams) d
JOIN (SELECT id, len(g) AS n, unnest(g) AS gram FROM x_goalgrams) t USING (gram) GROUP BY d.id, t.id""")


def answers(spark, sf):
    d = docs(spark, sf)
    status = F.when(F.col("doc_id") % 13 == 0, F.lit("error")).otherwise(F.lit("success"))
    return d.select(F.col("doc_id").alias("response_id"), F.lit("all").alias("scope"), status.alias("status"), "text", (F.col("doc_id") % 40).alias("wanted"))


def goals(spark, sf):
    return m.table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.lit("all").alias("scope"), "text")


@register("gram_overlap", "SELECT id AS response_id, target AS target_id, shared, dn AS response_grams, tn AS target_grams FROM x_scores")
def gram_overlap(spark, sf):
    rows = corpus.gram_overlap(answers(spark, sf), goals(spark, sf))
    return rows.select("response_id", "target_id", "shared", F.col("response_grams").cast("long").alias("response_grams"), F.col("target_grams").cast("long").alias("target_grams"))


@register("score_responses", """
SELECT doc_id AS response_id, CASE WHEN doc_id % 13 = 0 THEN 'skipped' ELSE 'evaluated' END AS status, s.target AS best_target, coalesce(s.score, 0) AS best_score,
  coalesce(s.target = doc_id % 40, false) AS is_best_match, coalesce(s.target = doc_id % 40 AND s.score >= 0.8, false) AS passed
FROM documents LEFT JOIN (SELECT id, arg_min(target, (-score, target)) AS target, max(score) AS score FROM (SELECT id, target, CAST(shared AS DOUBLE) / tn AS score FROM x_scores WHERE id % 13 <> 0) GROUP BY id) s ON doc_id = s.id""")
def score_responses(spark, sf):
    return corpus.score_responses(answers(spark, sf), goals(spark, sf), measure="recall").drop("reason")


@register("score_dice", """
SELECT doc_id AS response_id, round(coalesce(s.score, 0), 9) AS best_score FROM documents LEFT JOIN (
  SELECT id, max(shared * 2.0::DOUBLE / (dn + tn)) AS score FROM x_scores WHERE id % 13 <> 0 GROUP BY id) s ON doc_id = s.id""")
def score_dice(spark, sf):
    return rounded(corpus.score_responses(answers(spark, sf), goals(spark, sf)).select("response_id", "best_score"), "best_score", digits=9)


@register("needle_repositories", """
SELECT doc_id, source || '/' || lang AS repo, n AS files FROM documents JOIN (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) USING (source, lang) JOIN labels USING (doc_id)""")
def needle_repositories(spark, sf):
    from trialscape.operators.pending import repo_info

    repos = corpus_files(spark, sf).groupBy("language", "repo").agg(F.count(F.lit(1)).alias("files"))
    return repo_info(corpus_needles(spark, sf).select("doc_id", "language", "repo"), repos).select("doc_id", "repo", "files")


@register("topo_order", """
WITH RECURSIVE up(p, k, level) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT p, k // 4, level + 1 FROM up WHERE k > 0)
SELECT CAST(p AS VARCHAR) AS path, CAST(max(level) AS INTEGER) AS level, row_number() OVER (ORDER BY max(level), CAST(p AS VARCHAR)) - 1 AS pos FROM up GROUP BY p""")
def topo_order(spark, sf):
    p = m.table(spark, sf, "part")
    files = p.select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"))
    needs = p.select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.floor(F.col("p_partkey") / 4).cast("string").alias("needs"))
    return corpus.topo_order(files, needs).select("path", "level", "pos")
