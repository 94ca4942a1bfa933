"""Model slot: batching, retry with truncation, the dummy and sequence models."""

import json

import pytest
from pyspark.sql import functions as F

from sequence_model import SequenceModel
from tablefill.operators.infer import PromptTooLong, complete, constant_model, embed_hash, mean_pool


class ShortContextModel:
    """Refuses prompts of more than 4 whitespace tokens."""

    def __call__(self):
        def model(prompts):
            out = []
            for p in prompts:
                if len(p.split()) > 4:
                    raise PromptTooLong(p)
                out.append(p.upper())
            return out
        return model


def test_retry_with_keep_last(spark):
    df = spark.createDataFrame([("a b",), ("a b c d e f",)], "prompt string")
    got = {r.prompt: (r.completion, r.truncated)
           for r in complete(df, ShortContextModel(), on_too_long="keep_last", keep_last_n=3).collect()}
    assert got == {"a b": ("A B", False), "a b c d e f": ("D E F", True)}
    with pytest.raises(Exception):
        complete(df, ShortContextModel()).collect()


def test_sequence_model_answers_after_lead():
    model = SequenceModel(n=3, max_chars=1000)()
    prompt = 'x\nColumn:\n["Customer#000000009"] [/INST]\n["'
    ans = model([prompt])[0]
    assert json.loads('["' + ans) == ["Customer#000000010", "Customer#000000011", "Customer#000000012"]
    assert model(['x\nColumn:\n["abc"] [/INST]\n["'])[0] == "]"


def test_constant_model(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    assert constant_model(df).first().completion == "Dummy prediction"


def test_embed_hash_unit_norm_and_mean_pool(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "zz"), (4, None), (5, "  ")], "id long, text string")
    e = {r.id: r.embedding for r in embed_hash(df, "text", "id", dim=16).collect()}
    assert abs(sum(x * x for x in e[1]) - 1.0) < 1e-5 and sum(e[2]) == 0.0
    assert len(e) == 5 and e[4] == [0.0] * 16 and e[5] == [0.0] * 16
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 4.0])], "g int, embedding array<double>")
    got = {(r.g, r.dim): round(r.value, 6) for r in mean_pool(v, "g").collect()}
    assert got == {(0, 0): 0.707107, (0, 1): 0.707107, (1, 0): 0.6, (1, 1): 0.8}


class FlakyModel:
    """Raises a non-retryable error on prompts containing 'boom'."""

    def __call__(self):
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("backend down")
            if any(len(p.split()) > 4 for p in prompts):
                raise PromptTooLong("long")
            return [p.upper() for p in prompts]
        return model


def test_retry_only_on_listed_errors(spark):
    df = spark.createDataFrame([("a b c d e f",)], "prompt string")
    got = complete(df, FlakyModel(), on_too_long="keep_last", keep_last_n=2, retry_on=(PromptTooLong,)).first()
    assert (got.completion, got.truncated) == ("E F", True)
    boom = spark.createDataFrame([("boom",)], "prompt string")
    with pytest.raises(Exception):
        complete(boom, FlakyModel(), on_too_long="keep_last", keep_last_n=2, retry_on=(PromptTooLong,)).collect()


class LengthEncoder:
    """A toy encoder: (len, vowels) normalised to unit length."""

    def __call__(self):
        import math

        def encode(texts):
            out = []
            for t in texts:
                v = [float(len(t)), float(sum(c in "aeiou" for c in t))]
                n = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / n for x in v])
            return out
        return encode


def test_encoder_slot(spark):
    from tablefill.operators.infer import embed
    df = spark.createDataFrame([(1, "banana"), (2, "xyz")], "id long, text string")
    got = {r.id: r.embedding for r in embed(df, "text", LengthEncoder(), batch_size=1).collect()}
    assert [round(x, 4) for x in got[1]] == [round(6 / 45 ** 0.5, 4), round(3 / 45 ** 0.5, 4)]
    assert got[2] == [1.0, 0.0]


class Answer:
    """A factory whose model answers with one letter."""

    def __init__(self, letter):
        self.letter = letter

    def __call__(self):
        return lambda prompts: [self.letter for _ in prompts]


def test_short_lived_factories_keep_their_own_answers(spark):
    df = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    for i in range(20):
        assert complete(df, Answer(chr(97 + i))).first().completion == chr(97 + i)


class Refusing:
    """Refuses a batch with a long prompt; the answer tells the size of its batch."""

    def __call__(self):
        def model(prompts):
            if any(len(p.split()) > 3 for p in prompts):
                raise PromptTooLong("too long")
            return [str(len(prompts)) for _ in prompts]
        return model


def test_only_refused_prompts_are_asked_alone(spark):
    prompts = [("a b c d e",)] + [("a",)] * 7
    df = spark.createDataFrame(prompts, "prompt string").coalesce(1)
    got = complete(df, Refusing(), on_too_long="keep_last", keep_last_n=2, retry_on=(PromptTooLong,)).collect()
    assert [r.truncated for r in got] == [True] + [False] * 7
    assert [r.completion for r in got] == ["1", "1", "2", "2", "4", "4", "4", "4"]


def test_keep_last_needs_a_number(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    with pytest.raises(ValueError):
        complete(df, Refusing(), on_too_long="keep_last")


def test_replay_depends_on_the_examples(spark):
    from tablefill.operators.infer import Replay, answer
    prompts = spark.createDataFrame([(f"q{i}", "p") for i in range(30)], "query_id string, prompt string")
    recorded = spark.createDataFrame([(f"q{i}", v, f"{i}/{v}") for i in range(30) for v in range(4)],
                                     "query_id string, variant int, completion string")
    chosen = []
    for table in ("a", "b"):
        examples = prompts.selectExpr("query_id", "1 AS pos", f"'{table}' AS table_id")
        got = {r.query_id: r.completion for r in answer(prompts, Replay(recorded, 4), examples).collect()}
        assert all(got[f"q{i}"].startswith(f"{i}/") for i in range(30))
        chosen.append(got)
    assert chosen[0] != chosen[1]


def test_row_local_vectors_equal_the_aggregated_ones(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "zz"), (4, None), (5, "  "), (6, "x " * 500 + "y\tz\x0bé")], "id long, text string")
    for float32 in (True, False):
        a, b = ({r.id: r.embedding for r in embed_hash(df, "text", "id", dim=16, float32=float32, unique_ids=u).collect()} for u in (True, False))
        assert a == b
    plan = embed_hash(df, "text", "id", unique_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pooling_by_partial_sums(spark):
    import numpy as np
    from tablefill.operators.infer import pool_vectors
    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else f"g{i % 5}" if i % 3 else "hot", rng.normal(size=4 if i % 7 else 3).tolist() if i % 13 else None, float(i % 2))
            for i in range(500)]
    df = spark.createDataFrame(rows, "g string, embedding array<double>, m double").repartition(6)
    for mask in (None, "m"):
        got = {r.g: r.embedding for r in pool_vectors(df, "g", mask=mask).collect()}
        for g in {r[0] for r in rows}:
            mine = [(np.append(v, [0.0] * (4 - len(v))), w if mask else 1.0) for k, v, w in rows if k == g and v is not None]
            mean = sum(v * w for v, w in mine) / max(sum(w for _, w in mine), 1e-9)
            assert np.allclose(got[g], mean / np.linalg.norm(mean))
    assert pool_vectors(df.limit(0), "g").count() == 0
    rows = [r["count"] for r in pool_vectors(df, "g").groupBy("g").count().collect()]
    assert set(rows) == {1}


def test_validated_pick_ends_with_the_last_query(spark, monkeypatch):
    from conftest import SF001
    from sequence_model import SequenceModel
    from tablefill.operators.sampling import sample_examples
    from tablefill.operators.tables import split_seeds
    from tablefill.plans import suggest as plans
    from tablefill.sources import derived
    q, parts = split_seeds(derived.customer_tables(spark, SF001), 3), derived.part_tables(spark, SF001)
    pool = sample_examples(q, parts, k=3, seed=1)
    calls = []
    real = plans.suggest
    monkeypatch.setattr(plans, "suggest", lambda *a, **b: calls.append(1) or real(*a, **b))
    everything = [r.c_name for r in spark.read.parquet(f"{SF001}/customer.parquet").select("c_name").collect()]
    answer = json.dumps(everything)[2:]
    picked = plans.pick_examples(q, pool, parts, lambda: (lambda prompts: [answer] * len(prompts)), amount=2, tries=6)
    assert {r["round"] for r in picked.collect()} == {0} and len(calls) == 1
