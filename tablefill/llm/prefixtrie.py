"""Prefix trie of conversations by vertical bitmaps.

Conversations in the order of their turns are dealt out by ranges, so that
equal beginnings lie in few shards. A shard numbers its conversations and keeps,
for every (position, turn), the bitset of the conversations that have this turn there.
A depth-first walk intersects a node's bitset with these postings: every
intersection is a child, its popcount the members, and the members without a
further turn are the end list. A node's name is a 128-bit sum over the turns on
its path, so the shards' parts of one node are added up by name.

What belongs to a subtree is a sum over members. The smallest member of a node
owns it; what a conversation owns is the end of its path, from its top node on. A
node is a child, and a leaf is counted, where its owner is; and the tokens saved
below a node are, for each member but the owner, the bytes of the path from the
node to where the path of that member is its own. A first walk gives the owners, a second
one these sums. No member list meets in one place: nodes hold counts, and the end
lists stay in sorted pieces that are hashed one after another.

Paths longer than SEGMENT turns are walked in segments that start at the name
their earlier turns give, so one conversation can be of any length.

Rows without a conversation id are left out. Null role or text is the empty string; turns go
by number, null first, then role, then text; repeated rows are repeated
turns. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefill.llm.common import mix, stored
from tablefill.operators.ranking import rank_within

SEGMENT = 1024
SHARD = 4096  # segments of a shard, at most
SHARD_TURNS = 1 << 17
NO_ENDS = hashlib.sha256(b"").hexdigest()
_LANES = ("a_high", "a_low", "b_high", "b_low")
_NEVER = np.int64((1 << 62))


def ordered_turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, place, turn, size)``: each turn's place in its conversation,
    a digest of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("number"), role.alias("role"), text.alias("text"))
    # nulls are ordered by a column of their own: range slices sort nulls first either way
    ranked = rank_within(rows, "conv", [F.col("number").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return ranked.select("conv", "place", digest.alias("turn"), F.octet_length("text").cast("long").alias("size"))


def packs(turns: DataFrame) -> DataFrame:
    """``(conv, part, turns)``: up to SEGMENT consecutive turns in one row."""
    part = F.floor((F.col("place") - 1) / SEGMENT).cast("int")
    return (turns.groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "turn", "size"))).alias("turns")))


def grafted(parts: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """Conversations whose first ``head`` turns are those of conversation
    ``base`` (none if it is absent): ``(conv, part, start, turns)`` with the
    depth at which each part starts."""
    heads = parts.where("part = 0").select(F.col("conv").alias("base"), F.slice("turns", 1, longest_head).alias("base_turns"))
    first = (parts.where("part = 0").withColumns({"base": base, "head": head}).join(heads, "base", "left")
             .withColumn("taken", F.slice(F.coalesce("base_turns", F.expr("slice(turns, 1, 0)")), F.lit(1), F.col("head"))))
    gaps = first.select("conv", (F.col("head") - F.size("taken")).alias("gap"))
    first = first.select("conv", "part", F.lit(0).cast("long").alias("start"),
                         F.concat("taken", F.expr("filter(turns, x -> x.place > head)")).alias("turns"))
    more = parts.where("part > 0").join(gaps, "conv")
    return first.unionByName(more.select("conv", "part", (F.col("part").cast("long") * SEGMENT - F.col("gap")).alias("start"), "turns"))


def whole(parts: DataFrame) -> DataFrame:
    """The conversations as they are, in the form of ``grafted``."""
    return parts.withColumn("start", F.col("part").cast("long") * SEGMENT)


def names(turns: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each turn (two words of its digest) at a depth adds to the name of its path."""
    with np.errstate(over="ignore"):
        at = mix(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        a, b = mix(turns[:, 0] ^ at), mix(turns[:, 1] + at)
        return mix(a + (b << np.uint64(1))), mix(b ^ (a >> np.uint64(1)) ^ at)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, digest words and sizes of the turns of each row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    digests = b"".join(flat.field("turn").to_pylist())
    return (np.append(0, np.cumsum(lengths)), np.frombuffer(digests, np.uint64).reshape(-1, 2),
            flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64))


def segments(paths: DataFrame) -> DataFrame:
    """Paths in the order of their turns, with what comes before each part:
    ``(conv, start, turns, a, b, before, total, last)``."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, turns, size = unpacked(batch.column(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            start = batch.column(2).to_numpy()
            add = names(turns, start[row] + np.arange(len(row)) - offsets[row])
            lanes = []
            for lane in add:
                sums = np.append(np.uint64(0), np.cumsum(lane))
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                lanes += [(total >> np.uint64(32)).astype(np.int64), (total & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            sums = np.append(0, np.cumsum(size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, lanes), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                names=["conv", "part", "start", "turns", *_LANES, "bytes"])

    schema = "conv long, part int, start long, turns array<struct<turn: binary, size: long>>"
    bare = paths.select("conv", "part", "start", F.transform("turns", lambda x: F.struct(x["turn"].alias("turn"), x["size"].alias("size"))).alias("turns"))
    summed = bare.mapInArrow(totals, schema + "".join(f", {c} long" for c in (*_LANES, "bytes")))
    inside = Window.partitionBy("conv").orderBy("part")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumns(
        {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in _LANES}
        | {"before": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "total": F.sum("bytes").over(Window.partitionBy("conv")),
           "last": F.lead("part").over(inside).isNull()}).drop("part", "bytes")
    return summed


def dealt(segs: DataFrame) -> DataFrame:
    """Segments by ranges of their beginnings, equal ones by conversation."""
    keyed = segs.withColumns({f"t{k}": F.get(F.col("turns.turn"), F.lit(k)) for k in range(3)})
    order = ["start", *_LANES, "t0", "t1", "t2", "conv"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("t0", "t1", "t2")


def shards(batches: Iterator[pa.RecordBatch], turns_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column(turns_at).value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + SHARD_TURNS
            end = min(max(int(np.searchsorted(ends, most, side="right")), at + 1), at + SHARD, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def bits(which: np.ndarray) -> int:
    return int.from_bytes(np.packbits(which, bitorder="little").tobytes(), "little")


class Walk:
    """The nodes of one shard, parents before children.

    ``members`` are bitsets; ``stop`` are those whose segment ends at the node."""

    def __init__(self, shard: pa.RecordBatch):
        get = lambda c: shard.column(shard.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        offsets, turns, size = unpacked(shard.column(shard.schema.get_field_index("turns")))
        n = shard.num_rows
        lengths = np.diff(offsets)
        start = get("start")
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(row)) - offsets[row]
        add = names(turns, start[row] + place)
        _, same = np.unique(turns, axis=0, return_inverse=True) if len(turns) else (None, np.zeros(0, np.int64))
        same, place = same.reshape(-1).tolist(), place.tolist()
        postings: dict[tuple[int, int], int] = {}
        for j, p, t in zip(row.tolist(), place, same, strict=True):
            postings[p, t] = postings.get((p, t), 0) | 1 << j
        longer = [bits(lengths > p) for p in range(int(lengths.max(initial=0)) + 1)]
        add = [x.tolist() for x in add]
        size, first = size.tolist(), offsets.tolist()
        roots: dict[tuple, int] = {}
        lanes = [get(c).astype(np.uint64) for c in _LANES]
        with np.errstate(over="ignore"):
            a, b = (lanes[0] << np.uint64(32)) + lanes[1], (lanes[2] << np.uint64(32)) + lanes[3]
        for j, key in enumerate(zip(start.tolist(), a.tolist(), b.tolist(), get("before").tolist(), strict=True)):
            roots[key] = roots.get(key, 0) | 1 << j
        self.members, self.parent, self.depth, self.start = [], [], [], []
        self.a, self.b, self.path, self.size, self.stop = [], [], [], [], []
        mask = (1 << 64) - 1
        stack = [(-1, set_, s, 0, a, b, before, 0) for (s, a, b, before), set_ in roots.items()]
        while stack:
            up, set_, s, p, a, b, path, last = stack.pop()
            me = len(self.members)
            rest = set_ & longer[p]
            for out, x in ((self.members, set_), (self.parent, up), (self.depth, s + p), (self.start, s), (self.a, a),
                           (self.b, b), (self.path, path), (self.size, last), (self.stop, set_ & ~rest)):
                out.append(x)
            while rest:
                j = (rest & -rest).bit_length() - 1
                k = first[j] + p
                child = set_ & postings[p, same[k]]
                rest &= ~child
                stack.append((me, child, s, p + 1, (a + add[0][k]) & mask, (b + add[1][k]) & mask, path + size[k], size[k]))

    def own(self, i: int) -> bool:
        """Not a root that an earlier segment has given already."""
        return self.parent[i] >= 0 or self.start[i] == 0

    def sums(self, values: list, into=lambda x, y: x + y, none=0) -> list:
        """``values`` of the members of every node, added up from the ends."""
        out = []
        for set_ in self.stop:
            total = none
            while set_:
                total = into(total, values[(set_ & -set_).bit_length() - 1])
                set_ &= set_ - 1
            out.append(total)
        for i in range(len(out) - 1, -1, -1):
            if self.parent[i] >= 0:
                out[self.parent[i]] = into(out[self.parent[i]], out[i])
        return out

    def names(self) -> list[pa.Array]:
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return [pa.array(self.depth, pa.int64()), signed(self.a), signed(self.b)]


def first_walk(segs: DataFrame) -> DataFrame:
    """Per shard and node: ``(depth, a, b, n, ended, owner, above)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, at):
            walk = Walk(shard)
            conv, last = (shard.column(shard.schema.get_field_index(c)).to_pylist() for c in ("conv", "last"))
            over = bits(np.array(last, bool))
            owner = walk.sums(conv, min, 1 << 63)
            mine = [i for i in range(len(walk.members)) if walk.own(i)]
            take = pa.array(mine, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(x.take(take) for x in walk.names()), pa.array([walk.members[i].bit_count() for i in mine], pa.int64()),
                 pa.array([(walk.stop[i] & over).bit_count() for i in mine], pa.int64()), pa.array([owner[i] for i in mine], pa.int64()),
                 pa.array([walk.path[i] - walk.size[i] for i in mine], pa.int64())],
                names=["depth", "a", "b", "n", "ended", "owner", "above"])

    at = segs.columns.index("turns")
    return segs.mapInArrow(run, "depth long, a long, b long, n long, ended long, owner long, above long")


def owners(partial: DataFrame) -> DataFrame:
    """``(conv, top, forks, leaf)``: of each conversation that owns nodes, the
    depth of its first, the bytes of the path above that, and whether its last is a leaf."""
    nodes = partial.groupBy("depth", "a", "b").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"),
                                                  F.min("owner").alias("conv"), F.min("above").alias("above"))
    return nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.min_by("above", "depth").alias("forks"),
                                     F.max((F.col("n") == F.col("ended")).cast("int")).alias("leaf"))


_PARTS = ("depth long, a long, b long, up_a long, up_b long, n long, owner long, owner_forks long, forks long, "
          "leaves long, children long, above long, ends array<long>")


def second_walk(segs: DataFrame) -> DataFrame:
    """Per shard and node the sums over its members, and its end list.
    ``segs`` with the columns of ``owners`` (null where nothing is owned)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, at):
            walk = Walk(shard)
            get = lambda c: shard.column(shard.schema.get_field_index(c))  # noqa: B023, E731
            conv, last = get("conv").to_pylist(), get("last").to_pylist()
            top = get("top").fill_null(_NEVER).to_pylist()
            total = get("total").to_pylist()
            forks = [t if f is None else f for f, t in zip(get("forks").to_pylist(), total, strict=True)]
            owner = walk.sums(list(zip(conv, top, forks, strict=True)), min, (1 << 63, 0, 0))
            sums, leaves = walk.sums(forks), walk.sums(get("leaf").fill_null(0).to_pylist())
            children = [0] * len(walk.members)
            for i, up in enumerate(walk.parent):
                if up >= 0:
                    children[up] += owner[i][1] <= walk.depth[i]
            own = [walk.own(i) for i in range(len(walk.members))]
            ends = []
            for set_ in walk.stop:
                ids = []
                while set_:
                    j = (set_ & -set_).bit_length() - 1
                    if last[j]:
                        ids.append(conv[j])
                    set_ &= set_ - 1
                ends.append(sorted(ids))
            none = lambda values: pa.array([x if o else None for x, o in zip(values, own, strict=True)], pa.int64())  # noqa: B023, E731
            depth, a, b = walk.names()
            up = pa.array([p if p >= 0 else None for p in walk.parent], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [depth, a, b, a.take(up), b.take(up), pa.array([s.bit_count() if o else 0 for s, o in zip(walk.members, own, strict=True)], pa.int64()),
                 none([x[0] for x in owner]), none([x[2] for x in owner]), none(sums), none(leaves), pa.array(children, pa.int64()),
                 none([p - s for p, s in zip(walk.path, walk.size, strict=True)]),
                 pa.array([x if o else [] for x, o in zip(ends, own, strict=True)], pa.list_(pa.int64()))],
                names=[x.strip().split(" ")[0] for x in _PARTS.split(",")])

    at = segs.columns.index("turns")
    return segs.mapInArrow(run, _PARTS)


def end_digests(parts: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)`` of the nodes at which conversations end.
    Ids are sorted by ranges and joined in pieces; the pieces of a node are hashed as they pass."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else np.zeros(0, np.int64)
            ids = batch.column(3).cast(pa.string()).to_pylist()
            ends = np.append(new[1:], batch.num_rows)
            at = pa.array(new)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns), pa.array([",".join(ids[i:j]) for i, j in zip(new, ends, strict=True)], pa.string())],
                names=["depth", "a", "b", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[1] for r in rows], pa.string())],
                names=["depth", "a", "b", "ends_sha256"])

        for batch in batches:
            done = []
            for depth, a, b, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (depth, a, b) == key:
                    state.update(b"," + text.encode())
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (depth, a, b), hashlib.sha256(text.encode())
            if done:
                yield out(done)
        if key is not None:
            yield out([(key, state.hexdigest())])

    key = ["depth", "a", "b"]
    ids = parts.where(F.size("ends") > 0).select(*key, F.explode("ends").alias("conv"))
    pieces = ids.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(
        joined, "depth long, a long, b long, first long, text string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of ``(conv, part, start, turns)``: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = ["depth", "a", "b"]
    segs = stored(segments(paths))
    owned = stored(owners(first_walk(dealt(segs))))
    parts = stored(second_walk(dealt(segs.join(owned, "conv", "left"))))
    owner = F.when(F.col("n") > 0, F.struct("owner", "owner_forks"))
    nodes = parts.groupBy(*key).agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.sum("n").alias("n_convs"), F.min(owner).alias("owner"),
        F.sum("forks").alias("forks"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"), F.max("above").alias("above"))
    nodes = stored(nodes.select(
        *key, "up_a", "up_b", F.col("owner.owner").alias("conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("forks") - F.col("owner.owner_forks") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens")))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(up, ["depth", "up_a", "up_b"], "left").join(end_digests(parts), key, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def conversation_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Trie of the conversations as they are."""
    return trie(whole(packs(ordered_turns(df, id_col, turn_col, role_col, text_col))))


def grafted_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Trie of the conversations rebuilt by the rule of the query: the first
    ``crc32(id) % 9`` turns come from conversation ``id - id % 5``."""
    parts = stored(packs(ordered_turns(df, id_col, turn_col, role_col, text_col)))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    return trie(grafted(parts, F.col("conv") - F.col("conv") % 5, head, 8))


def oracle_sql() -> str:
    return """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
               lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), heads AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
), own AS (
  SELECT t.conv_id, t.pos + 1000 AS d, t.role, t.text FROM t JOIN c ON c.conv_id = t.conv_id AND t.pos > c.h
), seq AS (
  SELECT c.conv_id, coalesce(s.s, []) AS s FROM c LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY d) AS s FROM (SELECT * FROM heads UNION ALL SELECT * FROM own) GROUP BY conv_id
  ) s ON s.conv_id = c.conv_id
), members AS (
  SELECT conv_id, d, list_slice(s, 1, d) AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS e
  FROM members GROUP BY d, p
), kids AS (
  SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), plain AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.p[n.d].text) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.p = n.p
), below AS (
  SELECT list_slice(p, 1, k) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM plain) GROUP BY 1
)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, b.n_leaves, b.saved_tokens, sha256(x.e) AS ends_sha256
FROM plain x JOIN below b ON b.p = x.p LEFT JOIN nodes u ON x.d > 0 AND u.p = list_slice(x.p, 1, x.d - 1)"""
