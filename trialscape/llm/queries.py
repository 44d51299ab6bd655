"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape.llm import (
    blockjoin, bpe, centroids, langid, lattice, lines, packing, phrases, pii, projection, secrets, setsketch, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(column: str = "doc_id"):
    """crc32 of an id as text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


@query
def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the ranks are the vocabulary of byte_bpe_50k.json without its added token; tests hold both against each other
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    packed = packing.pack_documents(docs, path, public_tokenizers.PATTERN, window=1024, end_id=0, special=packing.ADDED)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_hash() % 5 == 0
    known = langid.identify_languages(docs.select("doc_id", "text"), docs.where(~held_out).select("text", "lang"))
    return known.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_digest(secrets.find_secrets(docs), tuple(r.kind for r in secrets.BASE))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_digest(pii.find_personal_data(docs), pii.BASE_KINDS)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs, min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = r"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM pieces),
held AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, pos, line, held.first IS NOT NULL AND held.first <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN held ON keyed.k = held.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode_documents(bpe.encode_documents(docs, path).drop("text"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op10_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.near_duplicates(docs, words=2, percent=80)


@query
def op3_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


@query
def op7_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return blockjoin.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


SQL["op7_block_join"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", id_hash() % 7 == 2)
    scored = lattice.score_documents(docs, "NOT held_out", public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(docs, min_count=100, most_words=5, percent=100, top=2000)


SQL["op11_phrase_streams"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spoken AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM spoken GROUP BY lang),
places AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM spoken),
runs AS (SELECT lang, ws, i, unnest(generate_series(1, least(5, len(ws) - i + 1))) AS m FROM places),
f AS MATERIALIZED (
  SELECT lang, m, ws[i : i + m - 1] AS p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, p, f AS a, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT cuts.lang, cuts.p, a, k, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1 : k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1 : cuts.m]
  JOIN n ON n.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[s : s + size - 1] AS p, max(f) AS longer
  FROM (SELECT lang, p, f, size, unnest(generate_series(1, m - size + 1)) AS s
        FROM (SELECT *, unnest(generate_series(2, m - 1)) AS size FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (
  SELECT lowest.*, array_to_string(lowest.p, ' ') AS phrase
  FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.p = lowest.p
  WHERE coalesce(100 * longer < 100 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op12_outward_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = centroids.cluster_vectors(vectors, k=16, rounds=3, scale=64, dim=64, seed="1")
    sums = centroids.inertias(found.assigned)
    whole = None if None in sums.values() else sum(sums.values())
    facts = [
        (c, sums.get(c), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(found.centroids)
    ]
    per_cluster = spark.createDataFrame(facts, "cluster INT, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING")
    return found.assigned.join(per_cluster, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _rounds_sql(rounds: int) -> str:
    """The rounds of op12 as table expressions: centroids c0, vectors a0 with their nearest, centroids c1, ..."""
    nearest = """
a{0} AS MATERIALIZED (
  SELECT vec_id, e, c, d FROM (
    SELECT v.vec_id, v.e, c{0}.c, list_sum(list_transform(list_zip(v.e, c{0}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v, c{0})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    moved = """
c{1} AS MATERIALIZED (
  SELECT c{0}.c, coalesce(moved.e, c{0}.e) AS e FROM c{0} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{0}) GROUP BY c, i) GROUP BY c) moved ON moved.c = c{0}.c)"""
    return ",".join([nearest.format(0), *[(moved + "," + nearest.replace("{0}", "{1}")).format(n, n + 1) for n in range(rounds)]])


SQL["op12_outward_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v QUALIFY c < 16),{_rounds_sql(3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = a3.c
"""

LISTED = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.listed_urls(spark, LISTED)).drop("url")


SQL["op13_url_filter"] = """
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rest),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT host, path, arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) AS won
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, parts.host, parts.path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.host = parts.host AND fits.path = parts.path
"""
