"""What a search moves and holds, where clusters can't be left out and where vectors repeat."""

import tracemalloc

import numpy as np
import pytest

from telar.operators import nearest, retrieval


def wanted(x, asked, k, ids):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = set()
    for q in asked:
        score = np.round((u * u[q]).sum(1), 12)
        out |= {(int(ids[q]), int(ids[i]), r) for r, i in enumerate(np.lexsort((ids, -score))[:k], 1)}
    return out


def test_a_query_moves_once_a_cell(spark, monkeypatch):
    """Without structure a query visits nearly all clusters; it is still a row, with each cell once."""
    monkeypatch.setattr(nearest, "CELL", 500)
    monkeypatch.setattr(nearest, "TILE", 100, raising=False)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 40)
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    asked = chunks.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    corpus = nearest.clustered(chunks, 10)
    rows = nearest.visits(corpus, asked, 5).collect()
    assert len(rows) == 150 and np.mean([r["visited"] for r in rows]) > 100
    assert all(len(set(r["cells"])) == len(r["cells"]) <= 20 for r in rows)
    got = {(r["query_id"], r["id"], r["rank"]) for r in nearest.search(corpus, asked, 5).collect()}
    assert got == wanted(x, range(0, 3000, 20), 5, np.arange(3000))


def test_centres_are_fitted_in_little_memory():
    x = nearest.unit(np.random.default_rng(4).normal(size=(20_000, 16))).astype(np.float32)
    tracemalloc.start()
    try:
        nearest.fitted(x, 1000, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_in_many_cells(spark, monkeypatch, kind):
    """Each vector 25 times, ids dealt at random: copies tie, and the lesser id wins."""
    monkeypatch.setattr(nearest, "CELL", 300)
    monkeypatch.setattr(nearest, "TILE", 70, raising=False)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(100, 24)).astype(np.float32 if kind == "float" else np.float64), 25, axis=0)
    ids = rng.permutation(2500)
    chunks = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"id long, embedding array<{kind}>")
    asked = chunks.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"], r["rank"]) for r in retrieval.top_k(chunks, asked, 30, 40).collect()}
    assert got == wanted(x, np.flatnonzero(ids % 20 == 0), 30, ids)


def test_mmr_of_copies(spark, monkeypatch):
    """Candidates that are copies of one another tie, and the better rank is chosen, in whatever cells they are."""
    monkeypatch.setattr(nearest, "CELL", 300, raising=False)
    monkeypatch.setattr(nearest, "TILE", 70, raising=False)
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(120, 48)).astype(np.float32), 5, axis=0)
    ids = rng.permutation(600)
    chunks = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, embedding array<float>")
    asked = chunks.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    u, at = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), {int(i): n for n, i in enumerate(ids)}
    want = set()
    found = sorted((q, r, i) for q, i, r in wanted(x, np.flatnonzero(ids % 20 == 0), 12, ids))
    for q in sorted({f[0] for f in found}):
        left, picked = [at[i] for a, _, i in found if a == q], []
        for place in range(1, 5):
            value = [round(0.5 * round(float((u[c] * u[at[q]]).sum()), 12) - 0.5 * (max(float((u[c] * u[p]).sum()) for p in picked) if picked else 0), 12) for c in left]
            picked.append(left.pop(int(np.argmax(value))))
            want.add((q, int(ids[picked[-1]]), place))
    assert {(r["query_id"], r["id"], r["rank"]) for r in retrieval.mmr(chunks, asked).collect()} == want


@pytest.mark.parametrize("name, k", [("citations", 3), ("context_assembly", 5)])
def test_no_more_hits_than_are_used(spark, sf_dir, monkeypatch, name, k):
    from telar.plans import questions

    asked, search = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda chunks, queries, k: asked.append(k) or search(chunks, queries, k))
    rows = questions.QUERIES[name](spark, sf_dir).count()
    assert rows == questions.asked(spark, sf_dir).count() and asked == [k]


def test_pages_move_a_query_once(spark, sf_dir, monkeypatch):
    from telar.plans import questions

    seen, visits = [], nearest.visits
    monkeypatch.setattr(nearest, "visits", lambda *a: seen.append(visits(*a)) or seen[-1])
    assert questions.pages_per_source(spark, sf_dir).count() > 0
    assert seen[0].count() == questions.asked(spark, sf_dir).count()  # not times the clusters
