"""Held-out accuracy of the two classifiers, gradients, and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablefill.llm import langid, toxicity

SYLLABLES = {"aa": ["ba", "ko", "mi", "tu", "la"], "bb": ["schr", "enz", "ung", "ach", "ig"], "cc": ["что", "мир", "да", "нет", "лук"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    bad = ["wretch", "villain", "oafish", "gormless"]
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(["aa", "bb", "cc"])
        w = prose(rng, lang, rng.choice([5, 40, 200])).split(" ")
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    return rows, labels


def test_backpropagation_is_the_gradient():
    rng = np.random.default_rng(3)
    net = langid.Network.new(["x", "y"], 3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 1, 0])
    valid = (np.arange(6)[:, None] < np.array([6, 3, 5, 1])).astype(float)

    def loss():
        p = net.positions(x)
        return -(np.log(p[:, np.arange(4), y]) * valid).sum() / valid.sum()

    grads = net.gradients(x, y, valid)
    for name, g in grads.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            old, eps = net.w[name][at], 1e-3
            net.w[name][at] = old + eps
            up = loss()
            net.w[name][at] = old - eps
            down = loss()
            net.w[name][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4), name


def test_windows_cover_every_byte():
    texts = ["", "a" * 64, "b" * 65, "é" * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    x, rows, length = langid.windows(data, offsets)
    assert b"".join(bytes(w[:n]) for w, n in zip(x, length, strict=True)) == bytes(data)
    assert rows.tolist() == [1, 2, 2, 3, 3, 3, 3]


def test_languages_held_out(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    out = [(i, lang) for i, _, lang in corpus[0] if got[i].held_out]
    assert 100 < len(out) < 300
    assert np.mean([got[i].lang_pred == lang for i, lang in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_held_out(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(corpus[1], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    out = [(got[i].predicted, y) for i, y in corpus[1] if got[i].held_out]
    assert np.mean([p == y for p, y in out]) > 0.97
    model = toxicity.fit(docs, labels)
    seen, unseen, clean = model.score(pa.array(["wretch villain villain", "wretchh v1llain oafishh", "bakomi tulami lala"]))
    assert seen > 0.7 and unseen > 0.7 and clean < 0.3


def test_labels_of_the_held_out_fold_are_not_read(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(corpus[1], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    from tablefill.llm.common import held_out
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_a_long_text_is_not_averaged_away(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(corpus[1], "doc_id long, toxic int"))
    words = prose(random.Random(5), "aa", 20_000).split(" ")
    words[9_000:9_000] = ["villain", "wretch", "gormless", "oafish"]
    assert model.score(pa.array([" ".join(words)]))[0] > 0.7


def test_awkward_rows(spark, corpus, awkward, nothing):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(corpus[1], "doc_id long, toxic int"))
    got = {(r.doc_id, r.text): r.toxicity for r in toxicity.with_score(awkward, model).collect()}
    assert got[1, None] == got[2, ""] == got[8, "!!! ... 123"] == 0 and all(0 <= v <= 1 for v in got.values())
    langs = {(r.doc_id, r.text): (r.lang_pred, r.s) for r in langid.with_language(awkward, langid.fit(docs), score_col="s").collect()}
    assert langs[1, None] == langs[2, ""] == langs[8, "!!! ... 123"] == ("und", 0.0)
    assert {x for x, _ in langs.values()} <= {"und", "aa", "bb", "cc"}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(nothing, labels).count() == 0 and langid.languages(nothing).count() == 0
    # nothing to learn from: no labels, one class, no words, no language
    ids = spark.createDataFrame([(i, y) for i in range(9) for y in (0, 1)], "doc_id long, toxic int")
    for marks in (labels, ids.where("toxic = 0")):
        assert {r.score for r in toxicity.toxicity_scores(awkward, marks).collect()} == {0.0}
    none = langid.languages(awkward.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def plain_network(net, text):
    """Mean probabilities over the bytes of a text, one byte and one unit at a time."""
    from math import exp, tanh
    w, h = {k: v.astype(float) for k, v in net.w.items()}, len(net.w["cf"])
    data, total = text.encode(), np.zeros(len(net.langs))
    sig = lambda x: 1 / (1 + exp(-x))
    for at in range(0, len(data), langid.WINDOW):
        window = data[at:at + langid.WINDOW]
        padded = window + b" " * (langid.WINDOW - len(window))
        states = {}
        for d in "fb":
            state = [0.0] * h
            for t in (range(len(padded)) if d == "f" else range(len(padded) - 1, -1, -1)):
                row = w[f"x{d}"][padded[t]]
                rec = [sum(state[j] * w[f"u{d}"][j, k] for j in range(h)) for k in range(3 * h)]
                z = [sig(row[k] + rec[k]) for k in range(h)]
                r = [sig(row[h + k] + rec[h + k]) for k in range(h)]
                new = [tanh(row[2 * h + k] + r[k] * (rec[2 * h + k] + w[f"c{d}"][k])) for k in range(h)]
                state = [z[k] * state[k] + (1 - z[k]) * new[k] for k in range(h)]
                states[d, t] = state
        for t in range(len(window)):
            both = states["f", t] + states["b", t]
            out = np.array([w["b"][m] + sum(both[k] * w["v"][k, m] for k in range(2 * h)) for m in range(len(net.langs))])
            e = np.exp(out - out.max())
            total += e / e.sum()
    return total / max(1, len(data))


def test_network_equals_plain_loops():
    net = langid.Network.new(["x", "y", "z"], 3, np.random.default_rng(4))
    texts = ["", "a", "héllo wörld " * 9, "x" * langid.WINDOW, "y" * (langid.WINDOW + 1)]
    got = net.probabilities(pa.array(texts))
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(p, plain_network(net, t) if t else 0, atol=1e-5)


def plain_word_score(table, word):
    """Mean over the word's n-grams, hashed character by character."""
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
    codes = [2, *low.encode(), 1]
    assert re.fullmatch("[a-z0-9]+", low)
    scores = []
    for n in toxicity.WIDTHS:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i:i + n]:
                h = (h * 0x01000193 % 2**32) ^ c
            x = (h * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32
            x ^= x >> 15
            scores.append(table[(x * 0x2C1B3C6D % 2**32) >> (32 - toxicity.BUCKET_BITS)])
    return sum(map(float, scores)) / max(1, len(scores))


def test_document_scores_equal_plain_loops():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(0, 2, 1 << toxicity.BUCKET_BITS).astype(np.float32), rng.normal(0, 1, toxicity.TOP + 2), 3.0)
    texts = ["one", "Some WORDS and more words, x1 yy2!", "a b c d e f g h " * 30]
    for text, got in zip(texts, model.score(pa.array(texts)), strict=True):
        import re
        words = [x for x in re.findall("[A-Za-z0-9]+", text) if re.search("[A-Za-z]", x)]
        best = sorted((plain_word_score(model.table, x) for x in words), reverse=True)[:toxicity.TOP]
        x = [np.tanh(v / 2) for v in best] + [-1.0] * (toxicity.TOP - len(best)) + [min(np.log1p(len(words)), 3.0), 1.0]
        assert got == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-4)


def test_one_long_text_does_not_end_the_sample(spark, corpus):
    """A text beyond the room for its class is passed over, not the rest with it."""
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(corpus[1], "doc_id long, toxic int")
    long = spark.createDataFrame([(10**6 + i, "bako " * 40_000, "aa") for i in range(40)], docs.schema)
    marks = spark.createDataFrame([(10**6 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs.unionByName(long), labels.unionByName(marks), sample_chars=100_000)
    bad, good = model.score(pa.array(["wretch villain oafish", "bakomi tulami lala"]))
    assert bad > 0.7 > 0.3 > good


def test_language_sample_is_bounded_before_it_is_ranked(spark):
    """What one task ranks is about four times the sample, in any number of partitions."""
    rows = [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(20_000)]
    for parts in (4, 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        net = langid.fit(docs, sample_rows=50, learn=lambda c: c.isNotNull())
        assert net.langs == ["en", "fr"]


def test_scoring_memory_is_that_of_a_slice():
    import tracemalloc

    from tablefill.llm.common import slices
    rng = random.Random(8)
    texts = [prose(rng, "aa", 300) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), np.ones(toxicity.TOP + 2), 8.0)
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    try:
        assert sum(len(model.score(part.column(1))) for part in slices(batch, 1)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
