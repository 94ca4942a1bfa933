"""Counts against plain Python, EM on planted rules, odd tables."""

import random
import re
from collections import Counter

from tablefill.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def check(df, pairs):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())
    want = []
    for i, t in pairs:
        p = plain(t)
        want.append((str(i), *p, p[0] < 50 or 100 * p[4] > 50 * p[0]))
    assert got == sorted(want)


def test_counts(table):
    rng = random.Random(1)
    parts = ["a", "b", "c", "é", "  ", "\n", "\n\n", "\t", "#", "|", "a b c", "\x0b", "\x1c", "word"]
    pairs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(120)))) for i in range(150)]
    pairs += [(900, "x y z " * 40), (901, "line one\n" * 30), (902, " ".join(f"w{k}" for k in range(500)))]
    check(quality.judge(table(pairs)), pairs)


def test_awkward_rows(awkward, nothing):
    pairs = [(r.doc_id, r.text) for r in awkward.collect()]
    check(quality.judge(awkward), pairs)
    assert not any(r.kept for r in quality.judge(awkward).collect() if r.base_failed)
    assert quality.judge(nothing).count() == 0


def test_em_finds_the_bad_texts(table):
    rng = random.Random(2)
    prose = lambda n: ". ".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(12)) for _ in range(n)) + "."
    good = [(i, prose(rng.randint(10, 40))) for i in range(300)]
    bad = [(1000 + i, prose(20).replace(" ", "### ")) for i in range(30)]
    kept = {r.doc_id: r.kept for r in quality.judge(table(good + bad)).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)
