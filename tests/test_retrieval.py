"""Chunks, search and embeddings on small examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import chunking, retrieval


def pack(text, size, overlap, sep):
    """The packing rule, stated once more in plain Python."""
    out, buf, start = [], "", 0
    for part in text.split(sep):
        if buf and len(buf) + len(part) + len(sep) > size:
            out.append((buf.strip(), start, start + len(buf)))
            keep = buf[-overlap:] if len(buf) > overlap else ""
            start += len(buf) - len(keep)
            buf = keep + sep + part if keep else part
        else:
            buf = buf + sep + part if buf else part
    if buf.strip():
        out.append((buf.strip(), start, start + len(buf)))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 40)))
    return ["", "   ", "one paragraph", "x" * 900, "\n\n\n\n"] + ["\n\n".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)]


@pytest.mark.parametrize("size, overlap", [(512, 50), (60, 10), (20, 5)])
def test_chunks(spark, size, overlap):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, content string")
    got = {}
    for r in chunking.chunk_documents(docs, size=size, overlap=overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.start_idx, r.end_idx))
    for i, text in enumerate(texts()):
        assert got.get(i, []) == pack(text, size, overlap, "\n\n"), text


def vectors_frame(spark, n=300, dim=8, name="vec_id"):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.integers(-2, 3, dim) if i % 50 else np.zeros(dim))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, embedding array<float>")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("block", [1 << 20, 200])
def test_search_equals_brute_force(spark, metric, block, monkeypatch):
    """Small integer vectors give many tied scores; small blocks force many tiles and many pieces."""
    monkeypatch.setattr(retrieval, "TILE_BYTES", block)
    monkeypatch.setattr(retrieval, "MAX_SCORES", 64)
    rows, index = vectors_frame(spark)
    queries, query_frame = vectors_frame(spark, 7, name="query_id")
    got = {}
    for r in retrieval.search(index, query_frame, 10, metric).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    scores = {"cosine": lambda a, b: unit(a) @ unit(b), "dot": lambda a, b: a @ b, "euclidean": lambda a, b: -np.linalg.norm(a - b)}[metric]
    for qid, q in queries:
        want = sorted(((round(float(scores(np.array(v), np.array(q))), 9), i) for i, v in rows), key=lambda s: (-s[0], s[1]))[:10]
        assert [round(got[qid][k][1], 9) for k in range(1, 11)] == pytest.approx([s for s, _ in want])


def test_bad_vectors_take_no_place(spark):
    good = [(i, [1.0, float(i)]) for i in range(20)]
    bad = [(100 + i, [float("nan"), 1.0]) for i in range(4)]
    index = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, embedding array<float>")
    for k in (3, 10):
        assert retrieval.search(index, queries, k).count() == k
    with pytest.raises(ValueError, match="unique"):
        retrieval.search(index, queries.unionByName(queries), 3)


def test_a_stored_index_can_be_probed_after_a_reload(spark, tmp_path):
    _, index = vectors_frame(spark)
    _, queries = vectors_frame(spark, 5, name="query_id")
    celled, model = retrieval.build_cells(index, nlist=6)
    path = str(tmp_path / "index")
    retrieval.save_index(celled, path, model=model)
    centres = retrieval.load_centres(spark, path)
    assert centres.shape == (6, 8)
    stored = retrieval.load_index(spark, path)
    assert stored.count() == index.count()
    found = retrieval.probe_search(stored, centres, queries, 5, nprobe=6)
    exact = retrieval.search(index, queries, 5)
    assert retrieval.recall(found, exact).agg(F.min("recall")).first()[0] > 0.5


def test_search_returns_all_rows_of_a_short_index(spark):
    _, index = vectors_frame(spark, 4)
    _, queries = vectors_frame(spark, 2, name="query_id")
    assert retrieval.search(index, queries, 10).count() == 8


def test_all_cells_give_the_exact_result(spark):
    _, index = vectors_frame(spark)
    _, queries = vectors_frame(spark, 5, name="query_id")
    celled, model = retrieval.build_cells(index, nlist=6)
    exact = retrieval.search(index, queries, 5).select("query_id", F.round("score", 9).alias("score"), "rank").collect()
    probed = retrieval.probe_search(celled, np.array(model.clusterCenters()), queries, 5, nprobe=6).select("query_id", F.round("score", 9).alias("score"), "rank").collect()
    assert sorted(exact) == sorted(probed)
    assert retrieval.probe_search(celled, np.array(model.clusterCenters()), queries, 5, nprobe=1).count() > 0


def test_index_round_trip(spark, tmp_path):
    _, index = vectors_frame(spark, 20)
    retrieval.save_index(index.withColumn("cell", F.col("vec_id") % 3), str(tmp_path / "i"))
    assert retrieval.load_index(spark, str(tmp_path / "i")).count() == 20
    assert retrieval.load_index(spark, str(tmp_path / "i"), [1]).count() == 7


def test_normalised_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_prompt_budget(spark):
    hits = spark.createDataFrame([(1, "q", 1, "a" * 1500, "s1", 0.9), (1, "q", 2, "b" * 1500, "s2", 0.8), (1, "q", 3, "c", "s3", 0.7)],
                                 "query_id int, query_text string, rank int, content string, source string, score double")
    prompt = retrieval.build_prompts(hits).first()["prompt"]
    assert prompt.count("b") >= 500 and "b" * 501 not in prompt and "s3" not in prompt and prompt.endswith("USER QUESTION: q\n\nANSWER:")
    assert "**Finding 1** (Score: 0.90, Source: s1)" in retrieval.template_answers(hits).first()["answer"]


@pytest.mark.parametrize("nprobe, spread", [(1, 0.05), (2, 0.3), (6, 2.0)])
def test_bounded_cells_lose_no_hit(spark, nprobe, spread):
    """Tight and loose clusters, zero vectors, ties; what is visited depends on the radii, the hits do not."""
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in heads[i % 12] * (1 + i % 3) + spread * rng.normal(size=8)]) for i in range(240)]
    rows += [(300 + i, [0.0] * 8) for i in range(3)] + [(400 + i, rows[5][1]) for i in range(4)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in heads[i] + 0.1 * rng.normal(size=8)]) for i in range(6)] + [(9, [0.0] * 8)],
                                    "query_id int, embedding array<double>")
    celled, model = retrieval.build_cells(index, nlist=12)
    celled = celled.cache()
    centres = np.array(model.clusterCenters())
    found, visited = retrieval.bounded_search(celled, centres, retrieval.cell_radii(celled, centres), queries, 7, nprobe)
    exact = retrieval.search(index, queries, 7)
    rounded = lambda df: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert rounded(found) == rounded(exact)
    cells = {r.query_id: r.cells for r in visited.collect()}
    assert set(cells) == {0, 1, 2, 3, 4, 5, 9} and max(cells.values()) <= len(centres)
    if spread < 0.1:
        assert sum(cells[i] for i in range(6)) < 6 * len(centres) / 2


def test_best_possible_score_bounds_every_member():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 5)), rng.normal(size=(20, 5))
    centre = x.mean(0, keepdims=True)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    radius = np.arccos(unit(x) @ unit(centre)[0]).max()
    assert ((unit(q) @ unit(x).T).max(1) <= retrieval.best_possible(q, centre, np.array([radius]))[:, 0] + 1e-12).all()


def test_cells_of_many_rows_are_fitted_on_a_bounded_sample(spark, monkeypatch):
    """Every row gets a cell; only the fit is over a sample. Tables up to the bound are fitted whole."""
    fitted = []
    fit = retrieval.KMeans.fit
    monkeypatch.setattr(retrieval.KMeans, "fit", lambda self, df, *a: (fitted.append(df.count()), fit(self, df, *a))[1])
    index = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*[F.cos(F.col("id") * k) for k in (1, 2, 3)]).alias("embedding"))
    celled, _ = retrieval.build_cells(index, nlist=4, fit_rows=500)
    assert 300 < fitted[0] < 700 and celled.count() == 4000 and celled.select("cell").distinct().count() == 4
    retrieval.build_cells(index, nlist=4)
    assert fitted[1] == 4000


def test_corpus_vectors_are_those_of_the_fitted_embedder(spark):
    texts = spark.createDataFrame([(1, "The cat sat"), (2, "the dog -- sat!"), (3, ""), (4, "cat cat dog"), (4, "the")], "doc_id long, content string")
    got = retrieval.embed_corpus(texts)
    want = retrieval.embed(texts, retrieval.fit_lexical_embedder(texts))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
