"""Nodes against a plain trie."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablefill.llm import prefixtrie

SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
                     StructField("text", StringType()), StructField("depth", StringType()), StructField("owner", StringType())])


def grouped(rows):
    out = {}
    for c, n, role, text in sorted((r for r in rows if r[0] is not None),
                                   key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def graft(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), sum(q not in kids for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, make=prefixtrie.grafted_trie):
    return sorted(map(tuple, make(spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)).collect()), key=str)


def conversations(seed, n, longest, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "hello", "a b"][:kinds])) for _ in range(rng.randrange(longest))]
        rows += [(c * (-1) ** (c % 7 == 6), k if k else None, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_a_plain_trie(spark, seed):
    rows = conversations(seed, 150, 7, 2 + seed)
    assert nodes(spark, rows) == brute(graft(grouped(rows)))
    assert nodes(spark, rows, prefixtrie.conversation_trie) == brute(grouped(rows))


def test_paths_in_segments(spark, monkeypatch):
    """Long conversations are cut; the pieces join at the same nodes, whatever the grafted head is."""
    monkeypatch.setattr(prefixtrie, "SEGMENT", 10)
    rows = [(c, k, "user", f"{k * 3 % 5}" if k < 25 + c % 4 else f"{c}-{k}") for c in range(12) for k in range(38)]
    rows += [(100, k, "user", f"{k * 3 % 5}") for k in range(20)] + [(101, 0, "a", "b")]
    assert nodes(spark, rows, prefixtrie.conversation_trie) == brute(grouped(rows))
    assert nodes(spark, rows) == brute(graft(grouped(rows)))


def test_one_conversation_many_times(spark):
    rows = [(c, k, "user", t) for c in range(0, 2000, 5) for k, t in enumerate(("hello", "é"))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many shards, which share all nodes
    try:
        assert nodes(spark, rows, prefixtrie.conversation_trie) == brute(grouped(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    assert nodes(spark, []) == []
    rows = [(None, 0, "user", "lost"), (4, None, None, None), (4, None, None, None), (4, 1, "user", "x"), (4, 1, "user", "x"),
            (9, 0, "us", "er"), (14, 0, "use", "r"), (19, 0, "user", ""), (-3, 0, "user", "y" * 100_000), (3, 2, "user", "z")]
    assert nodes(spark, rows) == brute(graft(grouped(rows)))
    assert nodes(spark, rows, prefixtrie.conversation_trie) == brute(grouped(rows))
    # nothing before the head and nothing after it: a conversation without turns ends at the root
    lonely = next(c for c in range(10**6, 10**7) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert [r[:5] for r in nodes(spark, [(lonely, 0, "user", "x")])] == [(lonely, 0, None, 1, 0)]
