"""Vector operators and the pipeline against brute force."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trialscape.llm import blockjoin, projection
from trialscape.llm.graph import components

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, v STRING"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(size=16) * 0.15).astype(np.float32).tolist()) for i in range(120)]
    rows += [(2000 + i, rows[5][1]) for i in range(150)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [1.0] * 15 + [float("nan")]),
             (3005, [1.0] * 15 + [float("inf")]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3050, [3e38] * 16), (None, rows[7][1])]
    return rows, spark.createDataFrame([(i, v, 1, "x", "x") for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return a @ b / np.sqrt((a @ a) * (b @ b))


def test_near_duplicate_vectors(spark, vectors):
    rows, table = vectors
    good = usable(rows)
    links, parent = dict.fromkeys([i for i, _ in rows], 0), {i: i for i, _ in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and cosine(a, b) >= 0.95:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = projection.near_duplicate_vectors(table).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_links, r.component_id) == (links[r.vec_id], root(r.vec_id)) and r.kept == (r.vec_id == r.component_id)
    assert projection.near_duplicate_vectors(table.where("false")).count() == 0


def test_pairs_in_a_dense_topic_are_found(spark):
    """A third of the rows share most leading bits without being linked; all planted pairs among them must be found."""
    rng, dim, size = np.random.default_rng(11), 64, 3000
    normal = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, dim)))
    topic = np.sqrt(0.92) * normal(1) + np.sqrt(0.08) * normal(size)
    step = normal(60)
    own = topic[:60] / np.linalg.norm(topic[:60], axis=1, keepdims=True)
    step -= (step * own).sum(axis=1, keepdims=True) * own
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    rows = np.concatenate((topic, 0.955 * own + np.sqrt(1 - 0.955**2) * step, normal(2 * size))).astype(np.float32)
    whole = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    parent, links = list(range(len(rows))), np.zeros(len(rows), int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(whole @ whole.T >= 0.95, 1))):
        links[[i, j]] += 1
        x, y = sorted((root(i), root(j)))
        parent[y] = x
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in projection.near_duplicate_vectors(table).collect()}
    assert links.sum() >= 100 and found == {i: (links[i], root(i)) for i in range(len(rows))}


def test_nearest(spark, vectors):
    rows, table = vectors
    good = usable(rows)
    found = {}
    for r in blockjoin.nearest(table.where("vec_id % 50 = 0"), table, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    queries = [(i, a) for i, a in good if i % 50 == 0]
    assert set(found) == {i for i, _ in queries}
    for i, a in queries:
        want = sorted((-round(cosine(a, b), 12), j) for j, b in good if j != i and len(a) == len(b))[:5]
        assert [j for j, _ in found[i]] == [j for _, j in want]
        assert np.allclose([s for _, s in found[i]], [-s for s, _ in want])
    assert blockjoin.nearest(table.where("false"), table).count() == 0
    few = table.where("vec_id IN (3006, 3007)")
    assert blockjoin.nearest(few, few, 5).count() == 2


def test_nearest_with_many_rows_of_one_id():
    rng = np.random.default_rng(5)
    query = rng.normal(size=(1, 16))
    rows = np.concatenate((query + 0.01 * rng.normal(size=(9, 16)), query + rng.normal(size=(40, 16))))
    ids = np.array([7] * 9 + list(range(100, 140)))
    heaps = blockjoin.Heaps(np.array([1]), query, 5)
    heaps.offer(ids, rows)
    best = {}
    for i, v in zip(ids.tolist(), rows):
        best[i] = max(best.get(i, -1), cosine(query[0], v))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    assert heaps.found.tolist() == want and np.allclose(heaps.score, [best[i] for i in want])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 102), (101, 100)]
    found = components(spark.createDataFrame(chain, "u BIGINT, v BIGINT")).collect()
    assert {(r.id, r.component) for r in found} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_pipeline_stages_take_effect(spark, tmp_path):
    body = " ".join(f"the word number w{k} of the text" for k in range(40))
    texts = [body, body + " more", "A shared line of text\nThe first text of the set", "the other of\na shared LINE of text\nwrite to me@example.com",
             "12 34 !!", None, "the reader of the text is here and there with an end " * 3]
    rows = [(i, t, None if i % 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {0, 1, 2, 3, 6}
    assert kept[1][3] == "the other of\nwrite to me@example.com" and kept[1][2] == texts[2]
    assert set(kept[2]) == {0, 2, 3, 6}
    assert kept[3][3] == "the other of\nwrite to <EMAIL>"
    packed = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in kept[3].items():
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in packed if r.doc_id == i), "<u4")
        assert own.decode(ids[:-1].tolist()) == text and ids[-1] == 0
    empty = docs.where(F.lit(False))
    assert [stage(spark, empty, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_stages_keep_columns_named_like_their_own(spark):
    names = ["score", "lang_pred", "__lang", "n_lines", "n_dropped", "others", "__goes"]
    texts = ["The first line here\nand a second one", "the first line here\nsomething else", None, "12 34"]
    rows = [(i, t, "en", *["mine"] * len(names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id BIGINT", "text STRING", "lang STRING", *[f"{n} STRING" for n in names]]))
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == rows[:2]
    found = corpus_pipeline.line_dedup(spark, docs, "")
    want = [rows[0], (1, "something else", *rows[1][2:]), (2, "", *rows[2][2:]), rows[3]]
    assert found.columns == docs.columns and sorted(tuple(r) for r in found.collect()) == want


def test_language_stage_rejects_by_score(spark, monkeypatch):
    rows = [(0, "the word of the text is here", "en"), (1, "le mot de la phrase est ici", "fr"), (2, "the end", None), (2, "the end", None), (None, "the end", "fr")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert len(kept) == 5 and all(r.lang in ("en", "fr") for r in kept) and len({r.lang for r in kept if r.doc_id == 2}) == 1
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.01)
    assert corpus_pipeline.language(spark, docs, "").count() == 0
