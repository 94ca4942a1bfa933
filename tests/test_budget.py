"""Chat budget properties on the driver's conversations."""

import pytest
from pyspark.sql import functions as F

from tablefill.operators.budget import count_message_tokens, fit_messages, keep_last_tokens
from conftest import SF01


def test_fit_messages_keeps_suffix_and_system(spark):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    fitted = fit_messages(conv, 200).collect()
    by_conv = {}
    for r in fitted:
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        rows.sort(key=lambda r: r.turn)
        if rows[0].overflow:
            assert not any(r.kept for r in rows)
            continue
        assert rows[0].tokens_after <= 200
        others = rows[1:] if rows[0].role == "system" else rows
        if rows[0].role == "system":
            assert rows[0].kept
        flags = [r.kept for r in others]
        # kept messages form a suffix, dropped ones come in pairs
        assert flags == sorted(flags)
        assert flags.count(False) % 2 == 0


def test_fit_messages_small_example(spark):
    rows = [(1, 0, "system", "a b"), (1, 1, "user", "w " * 10), (1, 2, "assistant", "x"), (1, 3, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # costs: system 3+1+2=6, user 3+1+10=14, assistant 3+1+1=5, user 5; total 6+14+5+5+3 = 33
    got = {r.turn: r.kept for r in fit_messages(df, 20).collect()}
    # dropping goes in pairs: start index 2 (of non-system) keeps only the last user message
    assert got == {0: True, 1: False, 2: False, 3: True}
    assert count_message_tokens(df).first().tokens == 33


def test_keep_last_tokens(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",)], "t string")
    got = [r.k for r in df.select(keep_last_tokens("t", 3).alias("k")).collect()]
    assert got == [["c", "d", "e"], ["a", "b"]]
    assert df.select(keep_last_tokens("t", 0).alias("k")).first().k == []


def test_fit_chat_drops_example_pairs(spark):
    from tablefill.operators.budget import fit_chat
    msgs = [("system", "s"), ("user", "u1 " * 50), ("assistant", "a1"), ("user", "u2 " * 5), ("assistant", "a2"),
            ("user", "q")]
    df = spark.createDataFrame([("q1", [{"role": r, "content": c} for r, c in msgs])],
                               "query_id string, messages array<struct<role:string,content:string>>")
    out = fit_chat(df, 40).first()
    assert [m.role for m in out.messages] == ["system", "user", "assistant", "user"]
    assert out.messages[1].content.startswith("u2") and not out.overflow
    assert fit_chat(df, 5).first().overflow


def test_message_cost_with_name(spark):
    from tablefill.operators.budget import message_cost
    df = spark.createDataFrame([("user", "a b", "bob smith"), ("user", "a b", None)], "role string, text string, name string")
    assert [r.c for r in df.select(message_cost("role", "text", name="name").alias("c")).collect()] == [9, 6]


def test_keep_last_text_is_an_exact_suffix(spark):
    from tablefill.functions.text import keep_last_text
    from tablefill.operators.infer import _keep_last_text
    texts = ["a b\n\nc  d\te", "  lead x y", "short", "", "a\n", "x  y z\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (0, 1, 2, 3):
        got = [r.k for r in df.select(keep_last_text("t", n).alias("k")).collect()]
        for t, g in zip(texts, got):
            assert g == _keep_last_text(t, n)
            toks = t.split()
            if len(toks) > n:
                assert t.endswith(g) and g.split() == (toks[-n:] if n else [])
            else:
                assert g == t


def plain_fit(rows, limit):
    """Drop the two oldest non-system messages until the chat fits: (kept turns, tokens after) or None."""
    cost = {t: 3 + len(r.split()) + len(x.split()) for t, r, x in rows}
    rows = sorted(rows)
    lead = rows[:1] if rows[0][1] == "system" else []
    rest = rows[len(lead):]
    while True:
        total = sum(cost[t] for t, _, _ in lead + rest) + 3
        if total <= limit:
            return {t for t, _, _ in lead + rest}, total
        if len(rest) < 2:
            return None
        rest = rest[2:]


@pytest.fixture()
def many_slices(spark):
    """Small tables would be merged into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_equals_the_plain_rule(spark, many_slices):
    """Many small conversations and one that holds a third of all messages, in many slices."""
    import random
    rng = random.Random(3)
    chats = {}
    for c in range(300):
        n = rng.randrange(1, 9)
        chats[c] = [(t, "system" if t == 0 and rng.random() < 0.5 else "user", "w " * rng.randrange(30)) for t in range(n)]
    chats[1000] = [(t, "system" if t == 0 else "user", "w " * rng.randrange(3)) for t in range(800)]
    chats[1001] = [(t, "user", "w " * 40) for t in range(301)]
    rows = [(c, *m) for c, ms in chats.items() for m in ms]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    for limit in (60, 2500):
        got = {}
        for r in fit_messages(df, limit).collect():
            got.setdefault(r.conv_id, []).append(r)
        small = {r.conv_id: r for r in fit_messages(df, limit, bounded=True).filter("turn = 0").collect()}
        for c, ms in chats.items():
            want = plain_fit(ms, limit)
            assert len(got[c]) == len(ms)
            assert {r.turn for r in got[c] if r.kept} == (want[0] if want else set())
            assert {(r.overflow, r.tokens_after) for r in got[c]} == {(want is None, want[1] if want else None)}
            assert (small[c].overflow, small[c].tokens_after) == (want is None, want[1] if want else None)


def test_scan_splits_a_conversation(spark, many_slices):
    """No join on the conversation in the plan, and no slice holds all of a hot one."""
    rows = [(1, t, "user", "w w") for t in range(4000)] + [(c, 0, "user", "w") for c in range(2, 4002)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fitted = fit_messages(df, 200)
    plan = fitted._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    from tablefill.operators import budget
    sliced = []
    real = budget.materialize
    budget.materialize = lambda x: sliced.append(real(x)) or sliced[-1]
    try:
        assert fit_messages(df, 200).filter("kept").groupBy("conv_id").count().count() == 4001
    finally:
        budget.materialize = real
    held = [r["count"] for r in sliced[0].filter("conv_id = 1").groupBy("_slice").count().collect()]
    assert len(held) > 3 and max(held) < 2500
