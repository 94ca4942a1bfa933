"""Search against exhaustive BM25 scores, planted items, items in shards."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablefill.llm import decontam


def items(rng, n):
    """Items that share common words and have rare ones."""
    return [" ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
                     for _ in range(rng.randint(3, 50))) + "." for _ in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_wand_returns_all_above_the_threshold(seed):
    rng = random.Random(seed)
    texts = items(rng, 60)
    index = decontam.Index(list(range(60)), texts, min_score=rng.choice([0.2, 0.5, 0.8]))
    for _ in range(80):
        words = rng.choice(texts).split() + [f"w{rng.randrange(400)}" for _ in range(20)]
        rng.shuffle(words)
        hashes, _ = decontam.word_hashes(pa.array([" ".join(words[:rng.randint(1, 50)])]))
        terms = np.flatnonzero(np.isin(index.terms, hashes))
        scores = np.zeros(60)
        for t in terms:
            at = slice(index.at[t], index.at[t + 1])
            scores[index.item[at]] += index.weight[at]
        want = {i: scores[i] for i in np.flatnonzero(scores >= index.threshold - 1e-9)}
        got = dict(index.wand(terms))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
        if want:
            assert len(index.survivors(np.zeros(len(terms), np.int64), terms))


@pytest.mark.parametrize(("text", "parts"), [
    ("What is it? It is a thing.", ("What is it? ", "It is a thing.")),
    ("Q text here\nAnswer: forty two", ("Q text here\n", "forty two")),
    ("one two three four five six", ("one two three four ", "five six")),
    ("one", ("one", "one"))])
def test_question_and_answer(text, parts):
    assert decontam.split_item(text) == parts


def planted(rng, texts):
    fill = lambda n: " ".join(f"f{rng.randrange(3000)}" for _ in range(n))
    docs, want = [], set()
    for i in range(60):
        parts = [fill(rng.randrange(200))]
        for k in rng.sample(range(len(texts)), i % 3):
            parts += [texts[k] if i % 2 else texts[k].upper().replace(" ", "\n "), fill(rng.randrange(100))]
            want.add((i, k))
        docs.append((i, " ".join(parts)))
    docs.append((100, texts[3][:len(texts[3]) // 2]))  # half an item
    return docs, want


def test_planted_items_in_any_number_of_shards(spark, table):
    """One, about 10 and about 50 indexes: the same rows, scores included."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(12, 55))) + "." for _ in range(50)]
    docs, want = planted(rng, texts)
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    size = sum(map(len, texts))
    results = []
    for shards in (1, 10, 50):
        got = decontam.contaminated(table(docs), bench, shard_bytes=size // shards + 1).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.question_overlap >= decontam.MIN_QUESTION and r.answer_overlap >= decontam.MIN_ANSWER for r in got)
        results.append(sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in got))
    assert results[0] == results[1] == results[2]


def test_item_ids_of_any_type(spark, table):
    texts = ["what is the capital of the moon base. it is tycho city as you know.", "another question with many words here. an answer of some words."]
    bench = spark.createDataFrame([("a-1", texts[0]), ("b/2", texts[1])], "item_id string, text string")
    got = decontam.contaminated(table([(1, f"x y {texts[0]} z"), (2, texts[1])]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, "a-1"), (2, "b/2")}


@pytest.mark.parametrize("seed", range(3))
def test_no_passage_above_a_threshold_is_lost(seed):
    """The test on essential words lets every passage through that an exhaustive score puts above a threshold."""
    rng = random.Random(seed)
    texts = items(rng, 80)
    index = decontam.Index(list(range(80)), texts)
    passages = [" ".join(rng.choice(texts).split()[:rng.randint(2, 50)] + [f"w{rng.randrange(400)}" for _ in range(15)]) for _ in range(60)]
    words, rows = decontam.word_hashes(pa.array(passages))
    at = np.searchsorted(index.terms, words)
    at[at == len(index.terms)] = 0
    known = index.terms[at] == words
    pairs = np.unique(np.stack([rows[known], at[known]]), axis=1)
    want = set()
    for p in range(60):
        scores = np.zeros(80)
        for t in pairs[1][pairs[0] == p]:
            scores[index.item[index.at[t]:index.at[t + 1]]] += index.weight[index.at[t]:index.at[t + 1]]
        if (scores >= index.threshold - 1e-9).any():
            want.add(p)
    assert want and want <= set(index.survivors(pairs[0], pairs[1]).tolist())


def test_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "text without an id"), (None, "text without an id"), (4, "...")], "item_id long, text string")
    got = decontam.contaminated(awkward, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == [("None", "3"), ("None", "None")]
    assert decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(awkward, bench.limit(0)).count() == 0
