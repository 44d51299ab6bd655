"""Work that is done once: pages are made once, Python sees a text once."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trialscape.functions import text as text_fn
from trialscape.operators import html as html_ops
from trialscape.operators import symbols


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_publications_read_pages_once(spark, tmp_path):
    article = '<div class="artigo-completo"><span data-tipo-ordenacao=\'ano\'>2001</span>A, B . T{0}. V, x</div><br class="clear"><br class="clear">'
    page = (
        '<a name="ArtigosCompletos"></a>' + article.format(1) + article.format("&amp;2") + '<a name="TrabalhosPublicadosAnaisCongresso"></a>'
        '<span class="transform">E . P &eacute;. C, in 1999 dx.doi.org/10.2/x</span><span class="transform"><b></b></span>'
        '<a name="ArtigosAceitos"></a><span class="transform">G . Q. D, 2003</span><a name="OutrasProducoesBibliograficas"></a>'
    )
    spark.createDataFrame([(1, page), (2, ""), (3, None)], "id INT, html STRING").write.parquet(str(tmp_path / "p"))
    found = html_ops.publications(spark.read.parquet(str(tmp_path / "p")))
    rows = [tuple(r) for r in found.select("id", "kind", "ord", "title", "year", "venue", "doi").orderBy("kind", "ord").collect()]
    assert rows == [
        (1, "accepted", 0, "Q", 2003, "D", None), (1, "conference", 0, "P é", 1999, "C", "10.2/x"),
        (1, "journal", 0, "T1", 2001, "V", None), (1, "journal", 1, "T&2", 2001, "V", None),
    ]
    plan = optimized(found)
    assert plan.count("Relation [") == 1 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("start, end", [("<a>", "</a>"), ("aa", "ab"), ("ab", "a"), ("a", "ab"), ("b", "b")])
@pytest.mark.parametrize("keep", [True, False])
def test_slices_of_any_marks(spark, start, end, keep):
    texts = [None, "", "a", "xaab", "aaab", "x<a>1</a>2</a>", "<a>", "</a><a>3", "bab", "abab", "aabaab", "bb", "xbxb"]

    def slow(s):
        at = -1 if s is None else s.find(start)
        if at < 0:
            return ""
        tail = s[at if keep else at + len(start):]
        stop = tail.find(end, 1 if keep else 0)
        return tail if stop < 0 else tail[:stop]

    df = spark.createDataFrame(list(enumerate(texts)), "i INT, s STRING")
    got = dict(df.select("i", text_fn.slice_between(F.col("s"), start, end, keep_start=keep)).collect())
    assert got == {i: slow(s) for i, s in enumerate(texts)}


def test_symbol_levels_are_made_once(spark, tmp_path):
    odd = 'a"b\\é\tx'
    inner = {"kind": "method", "name": odd, "start_line": 3, "children": [{"name": "deep"}]}
    trees = [("w", "p", json.dumps([{"kind": "class", "name": "A", "children": [inner, 5, inner]}])), ("w", "q", None)]
    spark.createDataFrame(trees, "workspaceId STRING, path STRING, tree STRING").write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).select("workspaceId", "path", F.try_parse_json("tree").alias("symbols"))
    found = symbols.flatten_symbols(files, depth=3)
    assert "Filter CASE" not in optimized(found)
    rows = {(r.depth, r.sibling_index): r for r in found.collect()}
    assert sorted(rows) == [(0, 0), (1, 0), (1, 2), (2, 0)]

    def own_id(kind, name, index, line):
        fields = {"end_line": None, "kind": kind, "path": "p", "qualified_name": name, "sibling_index": index, "start_line": line}
        return "repoqa:" + hashlib.sha256(json.dumps(fields).encode()).hexdigest()[:20]

    name = "A." + rows[1, 2].name
    assert rows[0, 0].symbol_id == own_id("class", "A", 0, None) and rows[1, 2].symbol_id == own_id("method", name, 2, 3)
    assert rows[2, 0].qualified_name == f"{name}.deep" and rows[2, 0].ancestors[0] == rows[0, 0].symbol_id
    with pytest.raises(Exception, match="nested deeper than 2 in p"):
        symbols.flatten_symbols(files, depth=2).collect()
