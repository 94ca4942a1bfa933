"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is its five-word shingles with their counts as weights (a text of fewer
words is one shingle of all of them). Each shingle sends arrivals of a Poisson
process, whose rate is its weight, to random components; a component keeps the
shingle that arrives first. Two texts agree in a component with their
*probability Jaccard* similarity. Arrivals are made in rounds for all shingles
of a slice of texts at once; a shingle stops when its next arrival would come
after the latest first arrival of its text, so most stop after a round or two.

Steps, all on Spark:

1. Texts with equal MD5 are one *node*; only nodes are compared, so a group of
   exact copies costs one row a copy.
2. ``BANDS`` bands of ``ROWS`` components put nodes into buckets. A pair at 0.8
   shares none with a probability of 5e-8.
3. In each bucket the node with the most neighbours is the centre; all others
   are verified against it (the exact similarity of the whole texts), and
   verified links are joined into components.
4. Only buckets whose other nodes are still in several components are looked
   at again: blocks of about ``BLOCK_ROWS`` nodes or ``BLOCK_BYTES`` of text
   meet pairwise in a task (but for two blocks of the bucket's largest
   component), which verifies the pairs whose signatures agree well enough and
   that it has not linked yet, and emits the links. A pair is tested in the
   first bucket it shares. No pairs are written out.
5. Components again; every document gets its class, the smallest id in it.

Null, empty and wordless texts are never duplicates: their class is their own
id. Rows without an id take part and get the class of their text. Repeated
rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefill.llm.common import free_name, mix, shingles, slices, span_hashes, stored, string_parts, word_spans

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
#: Signatures of a pair at SIMILARITY agree less than this with a probability of 3e-5 (four deviations).
LIKELY = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COMPONENTS) ** 0.5
BLOCK_ROWS = 1024
BLOCK_BYTES = 16 << 20


# --- sketches ----------------------------------------------------------------

def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle, by row, then hash."""
    data, offsets = string_parts(texts)
    starts, ends, rows = word_spans(data, offsets)
    hashes, rows, _ = shingles(span_hashes(data, starts, ends), rows, WIDTH)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))) if len(rows) else rows
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures (n x COMPONENTS, low 32 bits of the winning
    shingles); all zero for a row without shingles."""
    times = np.full((n, COMPONENTS), np.inf)
    winner = np.zeros((n, COMPONENTS), np.uint32)
    latest = np.full(n, np.inf)
    arrival = np.zeros(len(rows))
    turn = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(rows):
            turn += np.uint64(1)
            draw = mix(hashes + np.multiply(turn, np.uint64(0x9E3779B97F4A7C15)))
            arrival = arrival - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / weights
            early = arrival < latest[rows]
            rows, hashes, weights, arrival, draw = (x[early] for x in (rows, hashes, weights, arrival, draw))
            slot = rows * COMPONENTS + (mix(draw) >> np.uint64(32)).astype(np.int64) % COMPONENTS
            flat = times.ravel()
            np.minimum.at(flat, slot, arrival)
            best = flat[slot] == arrival
            winner.ravel()[slot[best]] = hashes[best].astype(np.uint32)
            latest = times.max(axis=1)
    return winner


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n x BANDS) bucket of each band."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key ^ (parts[:, :, k] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    return key


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), for
    sorted hashes; by ordering all j by x_j / y_j, in n log n."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if len(ia) == 0:
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    if (x == y).all():  # one ratio: all common weights over all weights
        return float(x.sum() / (x.sum() + only_a + only_b))
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    at = np.searchsorted(ratio, ratio, side="left")
    above = only_a + np.append(np.cumsum(x[::-1])[::-1], 0)[at]
    below = only_b + np.append(0, np.cumsum(y))[at]
    return float((1 / (above / x + below / y)).sum())


def similar(ha, wa, hb, wb) -> bool:
    return probability_jaccard(ha, wa, hb, wb) >= SIMILARITY - 1e-9


# --- links --------------------------------------------------------------------

def sketch(rows: DataFrame) -> DataFrame:
    """``(doc_id, node, signature)`` of rows ``(doc_id, text)``; no node without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).fill_null("")
                at, hashes, counts = weighted_shingles(texts)
                made = signatures(at, hashes, counts.astype(float), len(texts))
                full = np.zeros(len(texts), bool)
                full[at] = True
                nodes = [hashlib.md5(t.as_buffer(), usedforsecurity=False).digest() if f else None
                         for t, f in zip(texts, full, strict=True)]
                marks = [s.tobytes() if f else None for s, f in zip(made, full, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary())],
                                                 names=["doc_id", "node", "signature"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node binary, signature binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, node)`` of nodes with signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COMPONENTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(band_keys(sig).view(np.int64).ravel()),
                     part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], names=["bucket", "node"])
    return nodes.select("node", "signature").mapInArrow(run, "bucket long, node binary")


def verified(pairs: DataFrame) -> DataFrame:
    """The ``(a, b)`` of rows ``(a, b, text_a, text_b)`` that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                kept = []
                sides = []
                for c in (2, 3):
                    rows, hashes, counts = weighted_shingles(part.column(c))
                    sides.append((np.searchsorted(rows, np.arange(part.num_rows + 1)), hashes, counts))
                (pa_, ha, wa), (pb, hb, wb) = sides
                for i in range(part.num_rows):
                    a, b = slice(pa_[i], pa_[i + 1]), slice(pb[i], pb[i + 1])
                    if similar(ha[a], wa[a], hb[b], wb[b]):
                        kept.append(i)
                yield part.select(["a", "b"]).take(pa.array(kept, pa.int64()))
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def block_links(rows: DataFrame) -> DataFrame:
    """Links within blocks: rows ``(bucket, i, j, side, node, root, signature,
    text)``, all rows of a block of one bucket together. Nodes of side 0 meet
    those of side 1, or each other if the block is met with itself."""
    def links(block: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
        bucket, own = block.column("bucket")[0].as_py(), block.column("i")[0] == block.column("j")[0]
        nodes, side = block.column("node").to_pylist(), block.column("side").to_numpy()
        names: dict[bytes, int] = {}
        root = [names.setdefault(r, len(names)) for r in block.column("root").to_pylist()]
        up = list(range(len(names)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        sig = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint32).reshape(-1, COMPONENTS)
        keys = band_keys(sig)
        band = int(np.flatnonzero((keys.view(np.int64) == bucket).all(axis=0))[0])
        at, hashes, counts = weighted_shingles(block.column("text"))
        first = np.searchsorted(at, np.arange(len(nodes) + 1))
        found = []
        left = np.arange(len(nodes)) if own else np.flatnonzero(side == 0)
        for a in left.tolist():
            others = np.arange(a + 1, len(nodes)) if own else np.flatnonzero(side == 1)
            others = others[(sig[others] == sig[a]).mean(axis=1) >= LIKELY]
            others = others[~(keys[others, :band] == keys[a, :band]).any(axis=1)]  # else tested in an earlier bucket
            for b in others.tolist():
                if find(root[a]) != find(root[b]):
                    x, y = slice(first[a], first[a + 1]), slice(first[b], first[b + 1])
                    if similar(hashes[x], counts[x], hashes[y], counts[y]):
                        up[find(root[a])] = find(root[b])
                        found.append((nodes[a], nodes[b]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "i", "j"]

        def blocks() -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in names]
                cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                bounds = [0, *cut.tolist(), batch.num_rows] if batch.num_rows else []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    part = batch.slice(a, b - a)
                    if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in names):
                        yield pa.concat_batches(held)
                        held = []
                    held.append(part)
            if held:
                yield pa.concat_batches(held)

        for block in blocks():
            found = links(block)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return (rows.select("bucket", "i", "j", "side", "node", "root", "signature", "text")
            .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(run, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame | None:
    """``(node, root)`` of every node in the edges ``(a, b)``, None without any.

    Each round hooks every node to its smallest neighbour, follows the hooks
    twice and keeps only the edges between different results, written as a
    table; the number of rounds grows with the logarithm of the longest path."""
    left, found = stored(edges.where("a <> b").distinct()), None
    while not left.isEmpty():
        both = left.unionByName(left.selectExpr("b AS a", "a AS b"))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        for _ in range(2):
            again = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(again, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hook = stored(hook)
        if found is None:
            found = hook.withColumnRenamed("up", "root")
        else:
            found = found.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select(
                "node", F.coalesce("up", "root").alias("root"))
        left = stored(left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
                      .join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
                      .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return None if found is None else stored(found)


def node_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketched rows ``(doc_id, node)`` and, of nodes with copies or links,
    ``(node, class_id, keeper)`` from rows ``(doc_id, text)``: the class's
    smallest id and the node that has it."""
    sketched = stored(sketch(docs))
    nodes = stored(sketched.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("signature").alias("signature")))
    members = buckets(nodes)
    # aggregates are written before they are joined back: a join of two shuffled
    # tables can be split at a hot bucket, one on top of an aggregate cannot
    shared = stored(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = stored(members.join(shared, "bucket"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    centre = stored(members.join(degree, "node").groupBy("bucket")
                    .agg(F.max(F.struct("degree", "node"))["node"].alias("centre")))
    members = stored(members.join(centre, "bucket"))

    # texts of nodes that share a bucket, from one of each node's rows
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "first_id")
    texts = stored(docs.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
                   .join(wanted.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
                   .select("node", "text").dropDuplicates(["node"]))

    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")))
    roots = components(links)

    rest = members.where("node <> centre AND size > 2").select("bucket", "node")
    rest = rest.withColumn("root", F.col("node")) if roots is None else (
        rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    rest = rest.join(texts.select("node", F.length("text").alias("bytes")), "node")
    # a bucket's largest component needs no comparison within itself: its major
    # blocks meet the minor blocks of all other nodes, which also meet each other
    size = F.struct(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).alias("size")
    sizes = rest.groupBy("bucket", "root").agg(size)
    count = lambda n, size: F.ceil(F.greatest(n / F.lit(BLOCK_ROWS), size / F.lit(BLOCK_BYTES))).cast("int")
    several = sizes.groupBy("bucket").agg(
        F.max(F.struct("size.n", "root", "size.bytes")).alias("top"), F.count("*").alias("roots"),
        F.sum("size.n").alias("n"), F.sum("size.bytes").alias("bytes")).where("roots > 1").select(
        "bucket", F.col("top.root").alias("main"), count(F.col("top.n"), F.col("top.bytes")).alias("majors"),
        count(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("minors"))
    rest = stored(rest.drop("bytes").join(stored(several), "bucket"))
    if not rest.isEmpty():
        is_main, last = F.col("root") == F.col("main"), F.col("minors") + F.col("majors") - 1
        own = F.when(is_main, F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(
            F.pmod(F.xxhash64("node"), F.col("minors")))
        rest = rest.withColumn("own", own.cast("int"))
        rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("minors") - 1).otherwise(last))).alias("other"))
        rest = rest.select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")
        more = stored(block_links(rest.join(nodes.select("node", "signature"), "node").join(texts, "node")))
        if roots is None:
            roots = components(more)
        else:
            # between components: replace linked nodes by their roots, join these, follow
            top = components(more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
                             .join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
                             .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            if top is not None:
                every = roots.unionByName(top.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
                roots = stored(every.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                               .select("node", F.coalesce("top", "root").alias("root")))
    named = nodes.select("node", "first_id", "copies")
    own = [F.col("first_id").alias("class_id"), F.col("node").alias("keeper")]
    if roots is None:
        return sketched, named.where("copies > 1").select("node", *own)
    linked = roots.join(named, "node")
    least = linked.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("least"))
    linked = linked.join(least, "root").select("node", F.col("least.first_id").alias("class_id"), F.col("least.node").alias("keeper"))
    single = named.where("copies > 1").join(roots, "node", "left_anti").select("node", *own)
    return sketched, linked.unionByName(single)


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and its class: the smallest id among its near-duplicates."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched, classes = node_classes(rows)
    return sketched.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id (of two
    texts with this id, one). Rows without an id stay; of rows equal in id and
    text, one stays. Ids may repeat: a row is told by its id and its text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched, classes = node_classes(rows)
    firsts = (sketched.where("node IS NOT NULL").select("doc_id", "node").join(classes, "node", "left")
              .where("keeper IS NULL OR (keeper = node AND class_id = doc_id)"))
    node = free_name(docs, "node")
    firsts = firsts.select(F.col("doc_id").alias(id_col), F.col("node").alias(node))
    named = docs.where(F.col(id_col).isNotNull())
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = (named.where(worded).withColumn(node, F.unhex(F.md5(F.col(text_col).cast("binary"))))
            .join(firsts, [id_col, node], "left_semi").dropDuplicates([id_col, node]).select(docs.columns))
    return (kept.unionByName(named.where(~worded).dropDuplicates([id_col, text_col]))
            .unionByName(docs.where(F.col(id_col).isNull())))
