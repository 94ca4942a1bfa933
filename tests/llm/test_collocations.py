"""Phrases against plain counting; intervals against a search of the text."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from tablefill.llm import collocations

SCHEMA = StructType([StructField(c, StringType()) for c in ("text", "lang", "phrase", "shard", "n")])


def brute(rows, least=30, top=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p)
                       and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, t.decode(), -a, left, right, sizes[lang], -s) for r, (s, a, t, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, lang, "x", None, "y") for t, lang in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "a", "x-y", " ", "1"]
    rows = []
    for _ in range(n):
        w = [rng.choice(words) + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", "\x0b", "  "]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            w.insert(rng.randrange(len(w) + 1), "new york city hall ")
        rows.append(("".join(w), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_phrases_equal_plain_counting(spark, shard_bytes):
    rows = texts(1, 1500)
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows, shard_bytes=shard_bytes) == want


def test_limit_ties_and_overlaps(spark):
    rows = [("b a. a b. c d", "en")] * 40 + [("x x x x x x", "en")] * 10 + [("q r s t u", "de")] * 33
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, top=2) == brute(rows, top=2)


def test_awkward_rows(spark):
    assert found(spark, []) == []
    rows = [(None, "en"), ("", "en"), (" \t\n., ", None), ("...", "fr"), ("long", None), ("w " * 200_000, "de"), ("ü" * 50_000 + " a. " * 40, "de")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(10))
def test_extensions_on_both_sides(seed):
    rng = np.random.default_rng(seed)
    ids = np.append(np.append(0, rng.integers(0, 5, 200)), 0)
    index = collocations.Index(forward=collocations.transform(ids), reverse=collocations.transform(ids[::-1]))

    def count(p):
        return sum(tuple(ids[i:i + len(p)]) == p for i in range(len(ids) - len(p) + 1))

    known = np.arange(1, 5)
    phrases, places = [(int(x),) for x in known], index.singles(known)
    for _ in range(3):
        assert [count(p) for p in phrases] == places[2].tolist()
        nexts = []
        for side in ("forward", "reverse"):
            here, there = places[:2] if side == "forward" else places[1::-1]
            parent, symbol, here, there, n = index.extend(side, here, there, places[2])
            good = symbol > 0
            longer = [((int(s),) + phrases[k]) if side == "forward" else (phrases[k] + (int(s),)) for k, s in zip(parent[good], symbol[good])]
            assert [count(p) for p in longer] == n[good].tolist() and len(set(longer)) == len(longer)
            both = (here, there) if side == "forward" else (there, here)
            nexts.append((longer, (both[0][good], both[1][good], n[good])))
        phrases, places = nexts[seed % 2]
