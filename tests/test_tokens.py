"""Budgets by a rank file's ids, against the library called text by text."""

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from tablefill.operators.budget import count_message_tokens, fit_messages
from tablefill.operators.tokens import RankFile, with_last_tokens, with_message_cost, with_token_counts
from conftest import SF001
from test_budget import many_slices  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODER = RankFile(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(PATH), special_tokens={})


def test_keep_last(spark, library):
    texts = ["", None, "short", "é日本語 " * 40, "word " * 100, "<|endoftext|> a b c d e f g h", "🙂" * 30]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, kept string")
    for n in (0, 1, 5):
        got = {r.id: (r.kept, r.n) for r in with_last_tokens(df, "text", n, ENCODER, count="n").collect()}
        for i, t in enumerate(texts):
            ids = library.encode_ordinary(t or "")
            want = t if len(ids) <= n else library.decode(ids[-n:] if n else [])
            assert got[i] == (want, len(ids))


def test_counts_and_costs(spark, library):
    rows = [(1, 0, "system", "You fill tables.", None), (1, 1, "user", "é " * 30, "bob smith"), (1, 2, None, None, "x"), (2, 0, "user", "hi", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    size = lambda t: len(library.encode_ordinary(t or ""))
    got = {(r.conv_id, r.turn): r.n for r in with_token_counts(df, {"text": "n"}, ENCODER).collect()}
    assert got == {(c, t): size(x) for c, t, _, x, _ in rows}
    costed = with_message_cost(df, ENCODER, name="name")
    want = {(c, t): 3 + size(r) + size(x) + (size(n) + 1 if n is not None else 0) for c, t, r, x, n in rows}
    assert {(r.conv_id, r.turn): r.cost for r in costed.collect()} == want
    sums = {r.conv_id: r.tokens for r in count_message_tokens(costed, cost="cost").collect()}
    assert sums == {c: 3 + sum(v for k, v in want.items() if k[0] == c) for c in (1, 2)}
    assert with_message_cost(df.limit(0), ENCODER).count() == 0


def test_fit_by_ids(spark, library, many_slices):  # noqa: F811
    chats = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = {}
    for r in chats.collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, 3 + len(library.encode_ordinary(r.role)) + len(library.encode_ordinary(r.text))))
    got = {}
    for r in fit_messages(with_message_cost(chats, ENCODER), 600, cost="cost").collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.kept, r.tokens_after)
    assert any(not k for x in got.values() for k, _ in x.values())
    for c, messages in rows.items():
        messages.sort()
        lead = messages[:1] if messages[0][1] == "system" else []
        rest = messages[len(lead):]
        while sum(m[2] for m in lead + rest) + 3 > 600 and len(rest) >= 2:
            rest = rest[2:]
        total = sum(m[2] for m in lead + rest) + 3
        kept = {m[0] for m in lead + rest} if total <= 600 else set()
        assert {t for t, (k, _) in got[c].items() if k} == kept
        assert {a for _, a in got[c].values()} == {total if total <= 600 else None}
