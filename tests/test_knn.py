"""Blocked KNN equals brute force, across several blocks on both sides."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tablefill.operators.knn import BestPairs, _block_topk, block_grid, exact_scores, knn_topk, order_examples
from conftest import SF01


def test_blocked_knn_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    nn = knn_topk(emb, emb, 5, query_id="vec_id", example_id="vec_id", exclude_self=True,
                  q_block_rows=70, e_block_rows=90)  # 8 x 6 blocks
    got = {}
    for r in nn.collect():
        got.setdefault(r.query_id, []).append((r.pos, r.table_id))
    pdf = emb.toPandas()
    ids = pdf.vec_id.astype(str).to_numpy()
    mat = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    scores = mat @ mat.T
    np.fill_diagonal(scores, -np.inf)
    for i, qid in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:5]
        assert [t for _, t in sorted(got[qid])] == [ids[j] for j in order]


def test_orders(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet").limit(50)
    nn = knn_topk(emb, emb, 3, query_id="vec_id", example_id="vec_id", exclude_self=True)
    hi = {(r.query_id, r.pos): r.table_id for r in nn.collect()}
    lo = {(r.query_id, r.pos): r.table_id for r in order_examples(nn, "lowest first").collect()}
    assert all(lo[(q, 4 - p)] == t for (q, p), t in hi.items())
    rnd = order_examples(nn, "random", seed=1).collect()
    assert sorted((r.query_id, r.table_id) for r in rnd) == sorted((q, t) for (q, _), t in hi.items())


def test_ties_break_by_smaller_id_across_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(f"e{i:03d}", base[i % 6].tolist()) for i in range(120)]  # every vector 20 times
    ex = spark.createDataFrame(rows, "table_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", base[i % 6].tolist()) for i in range(12)], "query_id string, embedding array<double>")
    nn = knn_topk(q, ex, 7, q_block_rows=5, e_block_rows=25)  # 3 x 5 blocks
    got = {}
    for r in nn.collect():
        got.setdefault(r.query_id, []).append((r.pos, r.table_id))
    ids = np.array([r[0] for r in rows])
    mat = np.array([r[1] for r in rows])
    for i in range(12):
        s = np.cumsum(mat * base[i % 6], axis=1)[:, -1]
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:7]
        assert [t for _, t in sorted(got[f"q{i}"])] == [ids[j] for j in order]


def test_payload_rides_along_across_blocks(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    nn = knn_topk(emb, emb, 3, query_id="vec_id", example_id="vec_id", exclude_self=True,
                  q_block_rows=70, e_block_rows=90, query_payload=("label",), example_payload=("label",))
    labels = {str(r.vec_id): r.label for r in emb.select("vec_id", "label").collect()}
    rows = nn.collect()
    assert len(rows) == 500 * 3
    assert all(r.q_label == labels[r.query_id] and r.e_label == labels[r.table_id] for r in rows)


def blocks_of(q, e, ids="{}"):
    return (pd.DataFrame({"qid": [ids.format(i) for i in range(len(q))], "qvec": list(q)}),
            pd.DataFrame({"eid": [ids.format(i) for i in range(len(e))], "evec": list(e)}))


def plain_top(q, e, k, own=False):
    out = set()
    for i in range(len(q)):
        s = exact_scores(np.repeat(q[i:i + 1], len(e), axis=0), e)
        order = sorted((j for j in range(len(e)) if not own or j != i), key=lambda j: (-s[j], str(j)))[:k]
        out |= {(str(i), str(j), s[j]) for j in order}
    return out


def test_memory_does_not_grow_with_ties():
    """Most examples share no component with a query: nearly all scores tie at 0."""
    rng = np.random.default_rng(5)
    q, e = np.zeros((400, 64)), np.zeros((12000, 64))
    q[np.arange(400), rng.integers(0, 8, 400)] = 1.0
    e[np.arange(12000), rng.integers(8, 64, 12000)] = 1.0
    e[:3] = 0.0
    e[:3, 0] = 1.0
    qdf, edf = blocks_of(q, e)
    tracemalloc.start()
    got = _block_topk(5, False)(qdf, edf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # 4.9 GB with every tied pair's vectors at hand
    assert set(zip(got.query_id, got.table_id, got.score, strict=True)) == plain_top(q, e, 5)


def test_ids_are_not_compared_pair_by_pair():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    qdf, edf = blocks_of(x, x, "x" * 400 + "{}")
    start = time.process_time()
    got = _block_topk(3, True)(qdf, edf)
    assert time.process_time() - start < 2.5  # 16 million comparisons of 400 characters take longer
    assert len(got) == 12000 and (got.query_id != got.table_id).all()


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e140])
def test_tiles_give_the_plain_ranking(monkeypatch, scale):
    """Small tiles; vectors of all lengths, zeros, repeats and infinite components."""
    for name, value in (("ROWS", 7), ("COLUMNS", 31), ("FIRST", 9)):
        monkeypatch.setattr(BestPairs, name, value, raising=False)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 6)) * 10.0 ** rng.integers(-6, 6, (150, 1)) * scale
    x[20:60] = x[100]
    x[60:75] = 0.0
    qdf, edf = blocks_of(x, x)
    got = _block_topk(4, True)(qdf, edf)
    assert set(zip(got.query_id, got.table_id, got.score, strict=True)) == plain_top(x, x, 4, own=True)
    bad = x.copy()
    bad[10, 2], bad[11, 0] = np.inf, np.nan
    got = _block_topk(4, True)(qdf, blocks_of(x, bad)[1])
    assert len(got) == 600 and np.isfinite(got.score).all() and not got.table_id.isin(["10", "11"]).any()


def test_the_last_turn_of_the_grid_is_full():
    """28 cells on 12 slots took three turns, the last with four cells: 36 smaller ones do."""
    assert block_grid(720_000, 720_000, 116_508, 233_016, 12) == (9, 4)
    assert block_grid(2_000, 2_000, 116_508, 233_016, 12) == (8, 1)  # at least 256 queries a block
    for nq, ne, slots in ((10**6, 10**6, 12), (90_000, 90_000, 8), (5_000, 300_000, 7), (0, 0, 4)):
        bq, be = -(-nq // 10_000) or 1, -(-ne // 20_000) or 1
        more, same = block_grid(nq, ne, 10_000, 20_000, slots)
        assert same == be and more >= bq
        if bq * be >= slots:
            assert -(-more * be // slots) == -(-bq * be // slots)  # no further turn
