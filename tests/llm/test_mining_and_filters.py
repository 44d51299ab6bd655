"""Phrases, centroids and URL filters against brute-force versions, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialscape.llm import bloom, centroids, phrases, queries, urls
from trialscape.llm.arrays import flat

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_collocations(rows, least, most, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, most + 1) for i in range(len(ws) - m + 1))
    held = {}
    for (lang, p), c in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if c >= least:
                    key = (lang, p[i : i + size])
                    held[key] = max(held.get(key, 0), c)
    out = []
    for lang in {k for k, _ in f}:
        found = []
        for (own, p), a in f.items():
            if own == lang and len(p) > 1 and a >= least and not 100 * held.get((lang, p), 0) >= percent * a:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(4)
    words = ["The", "the", "a", "Über", "über", "New", "york", "x\x85y", "\xa0", "it's", "né"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "?\r\n"]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 80))) for _ in range(80)]
    made += ["in new york city " * 40, "the the the the the the", "", "   ", ",.;", "one", made[0], made[0], "new york " * 20000]
    return [(t, ("en", "fr", None)[i % 3]) for i, t in enumerate(made)] + [(None, "en"), (None, None), ("only here", "de"), ("the the", "und")]


@pytest.mark.parametrize("least, most, percent, top", [(3, 5, 100, 2000), (2, 3, 60, 7), (1, 4, 100, 50)])
def test_collocations(spark, speech, least, most, percent, top):
    docs = spark.createDataFrame(speech, "text STRING, lang STRING").withColumns({c: F.lit("x") for c in ("phrase", "words", "f", "rank", "n")})
    got = phrases.collocations(docs.repartition(3), least, most, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(speech, least, most, percent, top)


@pytest.mark.parametrize("size", [1, 50, 700, 1 << 20])
def test_blocks_are_cut_between_pieces(speech, monkeypatch, size):
    """Words next to each other in a piece stay so, whatever the size of a block."""
    monkeypatch.setattr(phrases, "BLOCK", size)
    want, got = Counter(), Counter()
    for text, _ in speech:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            want.update(zip([None, *ws], ws))
    for data, edges in phrases.blocks(*flat(pa.array([t for t, _ in speech]))):
        code, distinct, piece = phrases.words_of(data, edges)
        ws = distinct.take(pa.array(code)).to_pylist()
        got.update((ws[i - 1] if i and piece[i - 1] == piece[i] else None, w) for i, w in enumerate(ws))
    assert got == want


def test_collocations_without_any(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text STRING, lang STRING")
    assert phrases.collocations(docs, 2).count() == 0 and phrases.collocations(docs.where("false"), 1).count() == 0


def test_a_full_filter_changes_nothing(spark, speech, monkeypatch):
    docs = spark.createDataFrame(speech, "text STRING, lang STRING")
    monkeypatch.setattr(phrases, "_bits", lambda hashes, size: (np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)))
    assert sorted(map(tuple, phrases.collocations(docs, 3).collect())) == brute_collocations(speech, 3, 5, 100, 2000)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 2^63 long before the score does."""
    assert spark.sql("SELECT (1000BD * (CAST(3000000000 AS DECIMAL(20,0)) * CAST(9000000000000 AS DECIMAL(20,0)))) div "
                     "(CAST(4000000000 AS DECIMAL(20,0)) * CAST(3000000001 AS DECIMAL(20,0)))").first()[0] == 1000 * 3000000000 * 9000000000000 // (4000000000 * 3000000001)


def brute_clusters(rows, k, rounds, scale, dim, seed):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in fine]
    place = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, _, v in sorted((place(i), v, w) for (i, v), (_, w) in zip(fine, ints))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in ints]
        for n in range(len(centres)):
            mine = [v for (_, v), c in zip(ints, own) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d) for i, v in ints for d, n in [near(v)]], centres


def vectors(rng, many, dim, size):
    return [[rng.gauss(0, size) for _ in range(dim)] for _ in range(many)]


@pytest.mark.parametrize("size, k", [(0.1, 16), (0.02, 7), (1e5, 5), (1e30, 4), (1e306, 3)])
def test_centroids(spark, size, k):
    rng = random.Random(int(k))
    rows = list(enumerate(vectors(rng, 150, 8, size)))
    rows += [(i + 200, rows[i][1]) for i in range(10)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(300, [0.0] * 8), (301, None), (302, [1.0] * 7), (303, [1.0] * 7 + [math.nan]), (304, [None] + [1.0] * 7), (305, [math.inf] * 8), (306, [])]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumns({"cluster": F.lit("x"), "distance": F.lit("y"), "place": F.lit(0)})
    found = centroids.cluster_vectors(frame.repartition(3), k, 2, 64, 8, "s")
    assigned, centres = brute_clusters(rows, k, 2, 64, 8, "s")
    assert found.centroids == centres and found.assigned.columns == ["vec_id", "cluster", "distance"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    known = [(i, n, d if d < 1 << 63 else None) for i, n, d in assigned]
    assert sorted(map(tuple, found.assigned.collect()), key=order) == sorted(known, key=order)
    sums = centroids.inertias(found.assigned)
    for c in sums:
        each = [d for _, n, d in assigned if n == c]
        assert sums[c] == (None if max(each) >= 1 << 63 else sum(each))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4 == 0), 0.0]) for i in range(12)]
    found = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>"), 12, 1, 1, 2)
    assert sorted(map(tuple, found.assigned.collect())) == brute_clusters(rows, 12, 1, 1, 2, "1")[0]
    search = centroids.Search([[4, 0], [0, 4], [0, 4], [2, 2]])
    assert [x.tolist() for x in search.nearest(np.array([[2, 0], [0, 2], [3, 1], [0, 0]]))] == [[0, 1, 0, 3], [4, 4, 2, 8]]


def test_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for spread in (1, 3, 30, 100000):
        centres = rng.integers(-spread, spread + 1, (40, 6))
        rows = rng.integers(-spread, spread + 1, (500, 6))
        number, distance = centroids.Search(centres.tolist()).nearest(rows)
        each = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (number == each.argmin(axis=1)).all() and (distance == each.min(axis=1)).all()


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id LONG, embedding ARRAY<FLOAT>")
    for rows in (frame, frame.where("false")):
        found = centroids.cluster_vectors(rows, dim=2)
        assert found.assigned.count() == 0 and found.centroids == [] and centroids.inertias(found.assigned) == {}
    assert sorted(map(tuple, centroids.cluster_vectors(frame, dim=1).assigned.collect())) == [(1, 0, 0)]


def brute_verdict(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match("[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER), re.match("[^?#]*", rest[len(raw):])[0]
    fits = []
    for rule, verdict in rules.items():
        rule_host, rule_path = re.match("[^/]*", rule)[0].translate(LOWER), rule[len(re.match("[^/]*", rule)[0]):]
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fits.append((len(rule_host + rule_path), len(rule_host), rule_host + rule_path, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("blocks", [None, 1, 64])
def test_url_filter(spark, blocks):
    rng = random.Random(9)
    rules = dict(queries.LISTED) | {"Other.example.org/": "block", "example.org": "allow", "a.b.c.example.org/en/1/2": "allow", "de/é": "block"}
    rules |= {f"h{i}.net/p{i % 7}": "block" for i in range(300)}  # more than one block of the filter holds
    hosts = ["example.org", "EXAMPLE.org", "x.Example.ORG", "org", ".org", "badexample.org", "example.org.", "x.y.com", "com", "net", "", "a.b.c.example.org", "user@h.de", "é.de", "h5.net", "z.h12.net", "h299.net"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/17", "/en/1/2/3", "/fr/", "/FR/", "/de/x", "//es/", "/é😀x", "/p5/x", "/p6"]
    links = [rng.choice(["http://", "https://", "://", "HTTP:", ""]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/es/", "#a://b", "?"]) for _ in range(600)]
    links += [None, "", "http://", "no scheme", "http://example.org/es/" + "x/" * 40000, "http://" + "a." * 5000 + "example.org/en/1", "https://example.org/es/\nx"]
    rows = [(i % 500, u, "own", "own", "kept") for i, u in enumerate(links)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, host STRING, Verdict STRING, won STRING")
    got = urls.judge_urls(pages.repartition(3), urls.listed_urls(spark, rules), default="none", blocks=blocks)
    assert got.columns == ["page_id", "url", "won", "host", "path", "rule", "verdict"]
    want = [(i, u, "kept", *brute_verdict(u, rules, "none")) for i, u, *_ in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len({w[5] for w in want}) > 8


def test_url_filter_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id LONG, url STRING")
    none = urls.listed_urls(spark, {"a.org/": "block"}).where("false")
    assert sorted(map(str, urls.judge_urls(pages, none).select("rule", "verdict").collect())) == ["Row(rule=None, verdict='allow')"] * 2
    assert urls.judge_urls(pages.where("false"), urls.listed_urls(spark, queries.LISTED)).count() == 0
    twice = spark.createDataFrame([("A.org/", "allow"), ("a.org/", "block"), (None, "block"), ("b.org/", None)], "rule STRING, verdict STRING")
    assert [r.verdict for r in urls.judge_urls(pages.limit(1), twice).collect()] == ["block"]


def test_the_filter_lets_few_strangers_through(spark):
    """A filter made for the list passes all listed URLs and about one stranger in a thousand."""
    keys = spark.range(4000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    probes = spark.range(8000).select("id", F.concat(F.lit("h"), "id", F.lit(".org/")).alias("probe"))
    passed = [r.id for r in probes.where(bloom.may_hold(keys, bloom.blocks_for(4000), F.col("probe"))).select("id").collect()]
    assert set(range(4000)) <= set(passed) and len(passed) - 4000 < 40
