"""Brute force and edge cases of the operators on embeddings."""

import fractions
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import embedding_dedup, topk_search

V = "vec_id long, embedding array<float>, label int"


def table(spark, m, start=0):
    return spark.createDataFrame([(start + i, None if r is None else [None if x is None else float(x) for x in r], 0) for i, r in enumerate(m)], V)


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, 16))
    m = np.repeat(base, 5, axis=0) + rng.normal(size=(n // 5 * 5, 16)) * rng.choice([0.0, 0.05, 0.25], size=(n // 5 * 5, 1))
    return m.astype(np.float32)


def test_embedding_links_and_recall(spark):
    m = clustered(1500)
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    out = embedding_dedup.near_duplicates(table(spark, m)).toPandas().set_index("vec_id").sort_index()
    assert (out.n_links.to_numpy() <= links.sum(1)).all()
    assert out.n_links.sum() >= 0.9 * links.sum()
    assert (out.kept == (out.component_id == out.index)).all()


def shifted(n, mean_cosine, cosine, dims=64, seed=3):
    """Pairs at ``cosine`` of unit vectors whose cosines are about ``mean_cosine`` otherwise."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    first = unit(np.sqrt(mean_cosine) * unit(rng.normal(size=dims)) + np.sqrt(1 - mean_cosine) * unit(rng.normal(size=(n // 2, dims))))
    aside = rng.normal(size=first.shape)
    aside = unit(aside - (aside * first).sum(1, keepdims=True) * first)
    return np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * aside])


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("cosine", [0.902, 0.918])
def test_embedding_recall_near_the_threshold(spark, mean_cosine, cosine):
    m = shifted(3000, mean_cosine, cosine)
    links = m @ m.T >= 0.9
    np.fill_diagonal(links, False)
    t = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(m)], "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.near_duplicates(t).toPandas().set_index("vec_id").sort_index()
    assert (out.n_links.to_numpy() <= links.sum(1)).all()
    assert out.n_links.sum() >= 0.9 * links.sum() > 0


def test_embedding_exact(spark):
    m = clustered(700, seed=4)
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    out = embedding_dedup.near_duplicates(table(spark, m), exact=True).toPandas().set_index("vec_id").sort_index()
    assert (out.n_links.to_numpy() == links.sum(1)).all()


def test_embedding_large_list(spark):
    """One group larger than several blocks: every link counts once."""
    rng = np.random.default_rng(2)
    m = (np.ones(16) + 0.02 * rng.normal(size=(1300, 16))).astype(np.float32)
    out = embedding_dedup.near_duplicates(table(spark, np.concatenate([m, m[:10]]))).toPandas()
    assert (out.n_links == 1309).all() and (out.component_id == 0).all()


def test_embedding_edges(spark):
    odd = [None, [0.0] * 4, [1.0, None, 0, 0], [float("nan"), 1, 0, 0], [float("inf"), 1, 0, 0], [1, 2, 3, 4], [2, 4, 6, 8], [1, 2, 3, 4], [1e-38, 0, 0, 0], [1, 0, 0], []]
    t = table(spark, odd).withColumn("component_id", F.lit(0)).withColumn("rep", F.lit(0))
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(t).collect()}
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i in (0, 1, 2, 3, 4, 10))
    assert [(out[i].n_links, out[i].component_id) for i in (5, 6, 7)] == [(2, 5)] * 3
    assert [(out[i].n_links, out[i].component_id) for i in (8, 9)] == [(1, 8)] * 2
    assert embedding_dedup.near_duplicates(t.limit(0)).count() == 0
    again = embedding_dedup.near_duplicates(table(spark, [[1, 2], [1, 2]]).union(table(spark, [[1, 2]])))
    assert sorted((r.vec_id, r.n_links) for r in again.collect()) == [(0, 1), (0, 1), (1, 1)]


def brute_top(m, ids, k=10, every=100):
    q = np.floor(np.asarray(m, float) * 1024)
    s = (q @ q.T).astype(int)
    return {(ids[i], r + 1, v, sc) for i in range(len(ids)) if ids[i] % every == 0
            for r, (sc, v) in enumerate((-a, b) for a, b in sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k])}


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    m = np.round(clustered(1000, 3), 1)  # many ties
    m[200:260] = m[200]
    out = {tuple(r) for r in topk_search.top_k(table(spark, m)).select("query_id", "rank", "vec_id", "score").collect()}
    assert out == brute_top(m, list(range(1000)))


def test_topk_edges(spark):
    rows = [[1, 2], [1, 2], None, [float("nan"), 1], [1, None], [0, 0]]
    t = table(spark, rows).withColumn("rank", F.lit(0)).union(spark.createDataFrame([(None, [1.0, 1.0], 0, 0)], V + ", rank int"))
    out = {tuple(r) for r in topk_search.top_k(t).collect()}
    assert out == {(0, 1, 1, 5 * 1024 * 1024), (0, 2, 5, 0)}
    assert topk_search.top_k(t.limit(0)).count() == 0


def test_topk_of_any_size(spark, monkeypatch):
    """Components that doubles can't score exactly, scores beyond a long, and vectors of unlike lengths."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 20)
    rng = np.random.default_rng(4)
    m = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(300)]
    m[7], m[100], m[101], m[150], m[200] = [1e9, 1.0, -1e9, 0.5], [123456789.25, 987654.5, 1e7, -3.0], [2.0], [1e300, 1e300, 0.0, 0.0], [1e150, -1e9, 1.0, 0.0]
    rows = [(i, v, 0) for i, v in enumerate(m)]
    out = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    q = [[math.floor(fractions.Fraction(x) * 1024) for x in v] for v in m]
    limit = 2**124
    want = set()
    for i in range(0, 300, 100):
        scores = [(max(-limit, min(limit, sum(a * b for a, b in zip(q[i], q[j])))), -j) for j in range(300) if j != i]  # noqa: B905
        want |= {(i, r, -j, max(-(2**63), min(2**63 - 1, s))) for r, (s, j) in enumerate(sorted(scores, reverse=True)[:10], 1)}
    assert {tuple(r) for r in out} == want


def test_topk_skips_far_cells(spark, monkeypatch):
    """In clustered vectors a query does not go to the shards of every cell, and the result stays whole."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 100)
    rng = np.random.default_rng(6)
    corners = np.array(np.meshgrid([-50, 50], [-50, 50], [-50, 50])).reshape(3, 8).T
    m = (np.repeat(corners, 200, axis=0) + rng.normal(size=(1600, 3))).astype(np.float32)
    sent = []
    whole = topk_search.visits
    monkeypatch.setattr(topk_search, "visits", lambda q, *a: sent.append((whole(q, *a).count(), q.count(), int(a[2].sum()))) or whole(q, *a))
    out = {tuple(r) for r in topk_search.top_k(table(spark, m)).select("query_id", "rank", "vec_id", "score").collect()}
    assert out == brute_top(m, list(range(1600)))
    assert sent[0][0] < sent[0][1] * (sent[0][2] - 1) / 2


def test_kdtree_bounds_hold():
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(500, 8)), rng.normal(size=(20, 8))
    tree = topk_search.KDTree(p)
    b = tree.bounds(q)
    for node, (i, j) in enumerate(tree.span):
        assert (b[:, node] >= (q @ tree.points[i:j].T).max(axis=1) - 1e-9).all()


def test_shards_go_only_where_queries_are(spark):
    """Of 40 shards and 6 blocks, only the pairs that hold queries get a shard's vectors."""
    v = spark.range(4000).select((F.col("id") % 40).cast("int").alias("shard"), "id", F.array(F.lit(1.0)).alias("vec"))
    q = spark.range(90).select((F.col("id") % 3).cast("int").alias("shard"), (F.col("id") % 2).cast("int").alias("block"), "id")
    out = topk_search.shipped(v, q)
    assert out.count() == 3 * 2 * 100
    assert {(r.shard, r.block) for r in out.select("shard", "block").distinct().collect()} == {(i % 3, i % 2) for i in range(90)}
