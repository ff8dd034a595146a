"""What a task of exact retrieval holds does not depend on how many vectors it gets."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evalgrove.operators import retrieval


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")


def best(m, ids, k, cosine=False):
    """By brute force: (query_id, idx, rank) of the k best for each of ids, ties by id."""
    u = m.astype(np.float32).astype(float)
    if cosine:
        u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    found = set()
    for q in ids:
        s = np.round(u @ u[q], 9)
        order = [int(v) for v in np.lexsort((np.arange(len(s)), -s)) if v != q]
        found |= {(q, v, r + 1) for r, v in enumerate(order[:k])}
    return found


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "TILE", (3, 11), raising=False)


def test_a_task_holds_a_tile_of_scores(spark, monkeypatch):
    """2,048 queries against a batch of 10,000 vectors."""
    tasks = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: tasks.append(f) or spark.createDataFrame([], schema))
    rng = np.random.default_rng(3)
    m = rng.normal(size=(2_048, 4)).astype(np.float32)
    retrieval.top_k(vectors(spark, m), vectors(spark, m[:1]), 4)
    more = rng.normal(size=(20_000, 4)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 10_000) + 5_000), pa.array(list(more[at : at + 10_000]))], ["vec_id", "embedding"]) for at in (0, 10_000)]
    tracemalloc.start()
    out = [b for f in tasks for b in f(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert sum(b.num_rows for b in out) == 4 * 2_048
    s = np.round(m[17].astype(float) @ more.astype(float).T, 9)
    assert [r["idx"] for b in out for r in b.to_pylist() if r["query_id"] == 17] == [int(v) + 5_000 for v in np.argsort(-s)[:4]]


@pytest.mark.parametrize("cosine", [False, True])
def test_tiles_give_the_rows_of_brute_force(spark, small_tiles, cosine):
    """Vectors are repeated, so that ranks are a matter of ids too."""
    m = np.random.default_rng(5).integers(-2, 3, size=(60, 3)).astype(float)
    m = np.concatenate([m, m[:40]])
    v = vectors(spark, m).repartition(3)
    got = retrieval.top_k(v.filter("vec_id % 4 = 0"), v, 6, cosine=cosine).collect()
    assert {(r.query_id, r.idx, r["rank"]) for r in got} == best(m, range(0, 100, 4), 6, cosine)


def test_a_task_of_near_pairs_holds_two_bounded_groups(spark, monkeypatch):
    """F8: the groups grow in number, not in size, and are compared a tile at a time."""
    cells = []
    real = type(spark.range(1).groupBy("id")).applyInArrow
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda self, f, schema: cells.append(self._df) or real(self, f, schema))
    monkeypatch.setattr(retrieval, "GROUP", 40, raising=False)
    monkeypatch.setattr(retrieval, "PAIRS", 3, raising=False)
    m = np.random.default_rng(7).normal(size=(200, 4))
    m[150:] = m[:50]
    got = retrieval.near_pairs(vectors(spark, m), 0.9, blocks=2).collect()
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = sorted((i, j) for i in range(200) for j in range(i + 1, 200) if np.round(u[i] @ u[j], 9) > 0.9)
    assert sorted((r.a, r.b) for r in got) == want
    assert max(r["count"] for r in cells[0].groupBy("x", "y").count().collect()) < 2 * 25
