"""Signatures estimate probability Jaccard; classes against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablefill.llm import minhash


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def bag(text):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text or "") if x]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact(x, y):
    """The definition, term by term."""
    common = x.keys() & y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in common)


def brute_classes(pairs):
    bags = {t: bag(t) for _, t in pairs}
    texts = [t for t in bags if bags[t]]
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if exact(bags[a], bags[b]) >= 0.8 - 1e-9:
                up[find(a)] = find(b)
    least = {}
    for i, t in pairs:
        if bags[t] and i is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    return Counter((i, least.get(find(t)) if bags[t] else i) for i, t in pairs)


def test_probability_jaccard_is_the_definition():
    rng = random.Random(1)
    for _ in range(60):
        x = Counter({k: rng.choice([1, 1, 2, 5]) for k in rng.sample(range(30), 12)})
        y = Counter({k: rng.choice([1, 1, 2, 5]) for k in rng.sample(range(30), 15)})
        a, b = (tuple(np.array(v) for v in zip(*sorted(c.items()), strict=True)) for c in (x, y))
        assert minhash.probability_jaccard(*a, *b) == pytest.approx(exact(x, y))


def test_signatures_estimate_it():
    rng = np.random.default_rng(2)
    estimates, truths = [], []
    for share in (0.2, 0.5, 0.8):
        for _ in range(25):
            both = rng.integers(0, 2**63, int(100 * share))
            a, b = (np.unique(np.append(both, rng.integers(0, 2**63, 60 - len(both) // 2))).astype(np.uint64) for _ in range(2))
            wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
            rows = np.repeat([0, 1], [len(a), len(b)])
            s = minhash.signatures(rows, np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), 2)
            estimates.append((s[0] == s[1]).mean())
            truths.append(minhash.probability_jaccard(a, wa, b, wb))
    assert abs(np.mean(np.array(estimates) - truths)) < 0.02
    assert np.abs(np.array(estimates) - truths).max() < 0.2


def test_signature_does_not_depend_on_the_slice():
    texts = ["a b c d e f g", "", "x y", "a b c d e f g h"]
    whole = minhash.signatures(*[x if k < 2 else x.astype(float) for k, x in enumerate(minhash.weighted_shingles(pa.array(texts)))], 4)
    for i, t in enumerate(texts):
        r, h, c = minhash.weighted_shingles(pa.array([t]))
        assert (minhash.signatures(r, h, c.astype(float), 1)[0] == whole[i]).all()


def corpus(seed=4):
    rng = random.Random(seed)
    base = words(rng, 150)
    pairs = []
    for k in range(60):  # copies altered little to much: links near the threshold, several components
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        pairs.append((k, " ".join(w)))
    pairs += [(100 + k, " ".join(words(rng, 40))) for k in range(30)]
    pairs += [(200 + k, pairs[5][1]) for k in range(10)] + [(300, "one two"), (301, "one two"), (302, "two one"), (303, None), (304, ""), (305, "  ")]
    pairs += [(306, "one two"), (306, "one two"), (None, "one two"), (400, "a " * 300), (401, "a " * 290)]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("block", [1024, 7])
def test_classes_are_those_of_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    pairs = corpus()
    got = Counter(tuple(r) for r in minhash.duplicate_classes(table(pairs)).collect())
    assert got == brute_classes(pairs)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    names = [bytes([i // 256, i % 256]) for i in range(600)]
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[300], names[i]) for i in range(301, 400)]
    rng.shuffle(edges)
    found = {bytes(r.node): bytes(r.root) for r in minhash.components(spark.createDataFrame(
        [(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert len({found[x] for x in names[:200]}) == 1 and len({found[x] for x in names[300:400]}) == 1
    assert len(set(found.values())) == 2 and len(found) == 300
    assert minhash.components(spark.createDataFrame([], "a binary, b binary")) is None


def test_awkward_rows(awkward, nothing):
    got = sorted(map(str, minhash.duplicate_classes(awkward).collect()))
    assert len(got) == awkward.count() and all(r.doc_id == r.class_id for r in minhash.duplicate_classes(awkward).collect())
    assert minhash.duplicate_classes(nothing).count() == 0
    kept = minhash.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1  # a repeated row goes
    assert minhash.keep_first(nothing).count() == 0


def test_keep_first(table):
    pairs = corpus()
    keep = minhash.keep_first(table(pairs)).collect()
    classes = brute_classes(pairs)
    assert Counter(r.doc_id for r in keep if r.doc_id is not None) == Counter({i for i, c in classes if i == c and i is not None})
    assert sum(r.doc_id is None for r in keep) == 1


def test_rows_are_told_by_id_and_text(spark):
    a = " ".join(f"w{k}" for k in range(100))
    near = a.replace("w50", "other")
    b = " ".join(f"v{k}" for k in range(100))

    def kept(rows):
        return sorted(map(tuple, minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()))

    assert kept([(2, b), (4, a), (4, b), (5, a)]) == [(2, b), (4, a)]
    assert len(kept([(4, a), (4, near)])) == 1
    assert kept([(4, a), (4, b), (4, a)]) == sorted([(4, a), (4, b)])
    assert kept([(4, a), (3, near), (4, b), (7, b), (8, ""), (8, ""), (9, None)]) == sorted([(3, near), (4, b), (8, ""), (9, None)], key=lambda r: r[0])
