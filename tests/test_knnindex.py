"""The index gives what the full search gives, and visits little of clustered data."""

import numpy as np
import pytest

from tablefill.operators import knnindex
from tablefill.operators.knn import knn_topk
from conftest import SF01


def rows_of(df):
    return sorted((r.query_id, r.pos, r.table_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [64 * 8 * 16, 1 << 20])
def test_equals_full_search(spark, block_bytes):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    index = knnindex.build(emb, "vec_id", block_bytes=block_bytes)
    got = knnindex.search(index, emb, 5, query_id="vec_id", exclude_self=True)
    assert rows_of(got) == rows_of(knn_topk(emb, emb, 5, query_id="vec_id", example_id="vec_id", exclude_self=True))


def clustered(spark, n, seed=4, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(0, 0.02, (n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2:n // 2 + n // 3] = x[0]  # one vector a third of all times
    return spark.createDataFrame([(f"e{i:05d}", v) for i, v in enumerate(x.tolist())], "table_id string, embedding array<double>")


def test_visits_few_blocks_of_clusters(spark):
    shares = []
    for n in (600, 6000):
        ex = clustered(spark, n)
        q = ex.filter("table_id < 'e00060'").withColumnRenamed("table_id", "query_id")
        visited = []
        index = knnindex.build(ex, block_bytes=24 * 8 * 32)
        got = knnindex.search(index, q, 4, visited=visited)
        assert rows_of(got) == rows_of(knn_topk(q, ex, 4))
        shares.append(visited[0][0] / visited[0][1])
    assert shares[1] < 0.35


def test_balls_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knnindex, "MAX_BALLS", 10)
    ex = clustered(spark, 1500)
    q = ex.limit(40).withColumnRenamed("table_id", "query_id")
    index = knnindex.build(ex, block_bytes=24 * 8 * 16)
    assert len(index.balls) < index.blocks.count()
    assert rows_of(knnindex.search(index, q, 6)) == rows_of(knn_topk(q, ex, 6))


def test_awkward_vectors(spark):
    schema = "table_id string, embedding array<double>"
    ex = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", [1.0, None]), (None, [1.0, 1.0]),
                                ("e", [0.0, 0.0]), ("f", [1.0, 0.0])], schema)
    q = spark.createDataFrame([("x", [2.0, 1.0]), ("y", None), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.query_id, r.pos, r.table_id) for r in knnindex.knn_pruned(q, ex, 2).orderBy("query_id", "pos").collect()] == [
        ("x", 1, "a"), ("x", 2, "f"), ("z", 1, "a"), ("z", 2, "e")]
    assert knnindex.knn_pruned(q, ex.limit(0), 2).count() == 0
    assert knnindex.knn_pruned(q.limit(0), ex, 2).count() == 0


@pytest.mark.parametrize("shard_bytes", [64 * 8 * 100, 32 << 20])
def test_a_query_travels_once_a_shard(spark, monkeypatch, shard_bytes):
    """Vectors without clusters: every query visits nearly all of many balls,
    but travels to the few shards that hold them, not to each ball."""
    monkeypatch.setattr(knnindex, "SHARD_BYTES", shard_bytes, raising=False)
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    index = knnindex.build(emb, "vec_id", block_bytes=64 * 8 * 16)
    queries = emb.selectExpr("cast(vec_id AS string) AS qid", "cast(embedding AS array<double>) AS qv", "cast(NULL AS double) AS kth")
    shards = -(-500 * 64 * 8 // shard_bytes)
    assert len(index.balls) >= 30
    assert knnindex._visits(queries, index, 5, False).count() <= 500 * (shards + 1)
    got = knnindex.search(index, emb, 5, query_id="vec_id", exclude_self=True)
    assert rows_of(got) == rows_of(knn_topk(emb, emb, 5, query_id="vec_id", example_id="vec_id", exclude_self=True))
