"""Sampling properties: exactly k distinct, deterministic, k > n raises."""

import pytest
from pyspark.sql import functions as F

from tablefill.operators.sampling import dense_index, sample_examples, sample_fixed, subsample


def _frames(spark, nq=40, nc=30):
    q = spark.createDataFrame([(f"q{i}",) for i in range(nq)], "query_id string")
    c = spark.createDataFrame([(f"t{i:03d}",) for i in range(nc)], "table_id string")
    return q, c


def test_sample_exact_k_distinct_and_repeatable(spark):
    q, c = _frames(spark)
    a = sample_examples(q, c, k=5, seed=1).collect()
    b = sample_examples(q, c, k=5, seed=1).collect()
    assert sorted(a) == sorted(b)
    per_q = {}
    for r in a:
        per_q.setdefault(r.query_id, []).append((r.pos, r.table_id))
    assert len(per_q) == 40
    for rows in per_q.values():
        assert sorted(p for p, _ in rows) == [1, 2, 3, 4, 5]
        assert len({t for _, t in rows}) == 5
    other = sample_examples(q, c, k=5, seed=2).collect()
    assert sorted(a) != sorted(other)


def test_sample_k_equals_n_and_too_large(spark):
    q, c = _frames(spark, nq=3, nc=6)
    full = sample_examples(q, c, k=6, seed=3).collect()
    assert all(len({r.table_id for r in full if r.query_id == qq}) == 6 for qq in ("q0", "q1", "q2"))
    with pytest.raises(ValueError):
        sample_examples(q, c, k=7)


def test_dense_index_is_a_bijection(spark):
    c = spark.range(0, 2500).select(F.format_string("id%05d", "id").alias("table_id"))
    idx = dense_index(c, "table_id").collect()
    assert sorted(r.idx for r in idx) == list(range(2500))


def test_fixed_and_subsample(spark):
    q, c = _frames(spark)
    f = sample_fixed(q, c, k=3, seed=9).collect()
    assert len({(r.pos, r.table_id) for r in f}) == 3 and len(f) == 120
    pool = sample_examples(q, c, k=6, seed=1)
    s = subsample(pool, 2, seed=0).collect()
    pool_rows = {(r.query_id, r.table_id) for r in pool.collect()}
    assert len(s) == 80 and all((r.query_id, r.table_id) in pool_rows for r in s)


def test_fixed_sample_amount_from_seed(spark):
    from tablefill.operators.sampling import fixed_amount
    q, c = _frames(spark, nq=3, nc=30)
    for seed in (1, 2, 3, 4):
        got = sample_fixed(q, c, k=None, seed=seed).collect()
        k = fixed_amount(seed)
        assert 1 <= k <= 5 and len(got) == 3 * k
        assert sorted(got) == sorted(sample_fixed(q, c, k=None, seed=seed).collect())


def test_samples_larger_than_their_population_raise(spark):
    import pytest
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    c = spark.createDataFrame([("t1",), ("t2",)], "table_id string")
    with pytest.raises(ValueError):
        sample_fixed(q, c, k=5)
    pool = q.crossJoin(c)
    assert subsample(pool, 2).count() == 4
    with pytest.raises(Exception, match="larger than population"):
        subsample(pool, 3).collect()
