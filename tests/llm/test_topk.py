"""Search results against all products; what the bounds leave out on clustered vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tablefill.llm import topk

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())),
                     StructField("v", StringType()), StructField("score", StringType()), StructField("id", StringType())])


def brute(rows, every, k):
    taking = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in taking:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), c) for c, w in taking if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0, k).collect()))


def test_random_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]  # many equal scores
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, -0.125]) for i in range(60)]  # one vector many times
    rows += [(7, rows[7][1]), (10, rows[10][1]), (15, [3.0] * 6)]  # repeated rows; an id with two vectors
    rows += [(None, [9.0] * 6), (2000, None), (2005, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2010, [float("nan")] * 6),
             (2015, [float("inf")] * 6), (2020, []), (2025, [1.0, 1.0])]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_fewer_than_k(spark):
    rows = [(0, [1.0, 2.0]), (3, [0.5, 0.5]), (5, [-1.0, 1.0])]
    assert search(spark, rows) == brute(rows, 5, 5)
    assert search(spark, rows[:1]) == []
    assert search(spark, []) == []


def test_products_beyond_floats(spark):
    rows = [(i, [float(2**22 + i), 2.0**21 - i]) for i in range(12)]  # products near 2^60
    assert search(spark, rows) == brute(rows, 5, 5)


def clustered(rng, n, dim=16, clusters=20):
    centres = rng.normal(0, 4, (clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.05, (n, dim))


def test_bounds_prune_and_lose_nothing(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(clustered(rng, 2000).tolist()))
    assert search(spark, rows, every=50) == brute(rows, 50, 5)
    # on these clusters a query with its k-th best visits few of the runs
    x = np.floor(256 * np.array([v for _, v in rows]))
    square = float((x * x).sum(axis=1).max())
    points = topk.lifted(x, square)
    pivots = topk.fit_pivots(points)
    d = topk.distances(points, pivots)
    cell, far = d.argmin(axis=1), d.min(axis=1)
    runs = pa.table({"run": np.unique(cell), "cell": np.unique(cell),
                     "least": [far[cell == c].min() for c in np.unique(cell)], "most": [far[cell == c].max() for c in np.unique(cell)]})
    kth = [int(np.sort(x @ x[q])[-6]) for q in range(0, 2000, 50)]
    open_queries = spark.createDataFrame([(q, 0, [int(y) for y in x[q]], t) for q, t in zip(range(0, 2000, 50), kth)],
                                         "query_id long, twin long, qv array<bigint>, kth long")
    visited = topk.visits(open_queries, runs, 0, runs.num_rows, 16, square, pivots).count()
    assert visited < 0.5 * len(kth) * runs.num_rows


@pytest.mark.parametrize("seed", range(5))
def test_best_of(seed):
    rng = np.random.default_rng(seed)
    scores, ids = rng.integers(0, 4, (7, 30)).astype(float), rng.permutation(30)
    row, col = topk.best_of(scores, ids, 5, np.full(7, -np.inf))
    for q in range(7):
        want = sorted((-scores[q, c], ids[c]) for c in range(30))[:5]
        assert [(-scores[q, c], ids[c]) for c in col[row == q]] == want
