"""Elias-Fano sequences, ids against the library, files written and read back."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablefill.llm import tokenbin

PATH = public_tokenizers.path(tokenbin.VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=200))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    back = tokenbin.EliasFano.from_bytes(tokenbin.EliasFano.encode(values).to_bytes())
    assert (back.select_many(np.arange(len(values))) == values).all()
    some = np.array([i for i in range(len(values)) if i % 3], np.int64)[::-1]
    assert (back.select_many(some) == values[some]).all()
    assert [back.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(10_000, 700))
    assert len(tokenbin.EliasFano.encode(ends).to_bytes()) < 10_000 * 2
    with pytest.raises(IndexError):
        tokenbin.EliasFano.encode(ends).select(10_000)


def test_packing_takes_blocks():
    """Sparse numbers over several blocks, with little memory beside them."""
    import tracemalloc
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 62, 200_003, dtype=np.uint64))
    tracemalloc.start()
    coded = tokenbin.EliasFano.encode(values)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    back = tokenbin.EliasFano.from_bytes(coded.to_bytes())
    at = rng.integers(0, len(values), 2000)
    assert (back.select_many(at) == values[at]).all() and [back.select(i) for i in at[:200].tolist()] == values[at[:200]].tolist()
    with pytest.raises(IndexError):
        back.select_many(np.array([len(values)]))


def test_ids_must_be_whole_numbers(spark, scratch):
    with pytest.raises(ValueError, match="whole numbers"):
        tokenbin.write_tokens(spark.createDataFrame([("a", "b")], "doc_id string, text string"), f"file://{scratch}/x")


@pytest.fixture(scope="module")
def encoder():
    return tokenbin.word_encoder(PATH)


TEXTS = ["", "a", "Don't STOP's it's ÀÉÎ×÷ß ÿŸ 12ab34", "rock'n'roll 'S'T ''s !'s ' 'rest 'lll", "'", "a'", "'s", "ΑΣ İstanbul ½x µ ª",
         "<|endoftext|> a<|startoftext|>b", "日本語 １２３", "x́ ́ 각", "a\x1cb\x85c\xa0d", "A.B,C--d__e $$$ #a"]


def test_ids_are_the_librarys(encoder):
    plain = encoder.tokenizer
    for texts in (TEXTS, [t * 3 for t in TEXTS], [" ".join(TEXTS)]):
        got = encoder(pa.array(texts))
        for text, blob in zip(texts, got, strict=True):
            assert np.frombuffer(blob, "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_files(spark, awkward, nothing, encoder, scratch):
    docs = awkward.unionByName(awkward.selectExpr(*[f"doc_id - 40 AS {c}" if c == "doc_id" else c for c in awkward.columns]))
    got = tokenbin.token_files(docs).orderBy("start").collect()
    want, start = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokenbin.token_files(nothing).count() == 0


def test_small_files_and_select(spark, table, encoder, scratch):
    docs = table([(10 * i, f"text number {i} " * (i % 5)) for i in range(40)])
    made = tokenbin.write_tokens(docs, scratch + "/t", shard_ids=30).collect()
    assert len(made) > 5 and sum(r.n_docs for r in made) == 40
    for r in made:
        shard = tokenbin.Shard(open(f"{scratch}/t/{r.name}", "rb").read())
        for i in range(shard.n_docs):
            n = shard.doc_id(i) // 10
            assert shard.ids(i).tolist() == [*encoder.tokenizer.encode(f"text number {n} " * (n % 5), add_special_tokens=False).ids, 1]
