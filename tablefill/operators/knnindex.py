"""Exact nearest neighbours through an index of balls.

``build`` deals the example vectors to centroids and cuts each centroid's
vectors, by distance from it, into blocks with a centre and a radius of their
own. The score of any vector in a block is at most ``q.c + |q| r`` for a query
``q``. ``search`` takes two rounds: every query first visits the block
with the greatest bound (and the next ones, if that holds fewer than k), which
gives a k-th score; then exactly those blocks whose bound reaches that score.
Blocks that cannot hold a better vector are never shuffled to or read for a query.

Scores are those of ``knn_topk`` bit for bit. Bounds are widened by their
rounding error, so pruning never changes a result; centroids come from a
bounded sample and decide only how much is pruned.

What every task gets is the centres and radii of at most about MAX_BALLS runs
of blocks, at any number of vectors. Neighbouring balls lie in one shard of
about SHARD_BYTES, which a query travels to once, with the list of those it visits. The queries of a shard are split into
parts, so a shard that every query visits is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spark_context
from .knn import BestPairs, id_numbers

CENTROIDS = 64
SAMPLE = 4096
BLOCK_BYTES = 2 << 20
MAX_BALLS = 1 << 14
SHARD_BYTES = 32 << 20
PART_QUERIES = 4096  # of a shard's part, at least
MOST_QUERIES = 1 << 16  # and at most


@dataclass
class KnnIndex:
    """``blocks``: ``(ball, block, ids, vectors)``; ``balls`` and their
    ``sizes``, ``centres`` and ``radii`` (numpy); ``dim`` components a vector."""
    blocks: DataFrame
    balls: np.ndarray
    sizes: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    dim: int


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _centroids(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points of the sample."""
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)].copy()
    for _ in range(rounds):
        owner = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """Rows with an id and a vector of finite components, of length ``dim``."""
    fits = (F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
            & F.forall(vec_col, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    if dim is not None:
        fits = fits & (F.size(vec_col) == dim)
    return df.filter(fits).select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def build(examples: DataFrame, example_id: str = "table_id", example_vec: str = "embedding",
          block_bytes: int = BLOCK_BYTES) -> KnnIndex | None:
    """Index of the examples that have an id and a finite vector; None where
    there are none. All vectors must have one length (that of the longest; others are left out)."""
    usable = _usable(examples, example_id, example_vec)
    rows, dim = usable.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not rows or not dim:
        return None
    usable = _usable(examples, example_id, example_vec, dim)
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, (64 << 20) // (8 * dim)))).toArrow()
    centroids = _centroids(_matrix(sample.column("v").combine_chunks(), dim))
    per_block = max(16, block_bytes // (8 * dim))
    per_ball = max(1, rows // per_block // MAX_BALLS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                cell = _nearest(x, centroids)
                far = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), *batch.columns],
                                                 names=["cell", "far", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, ball, in_ball, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def out() -> pa.RecordBatch:
            nonlocal number, ball, in_ball, held
            if in_ball == 0 or in_ball >= per_ball or held[0][0] != cell_of_ball[0]:
                ball, in_ball, cell_of_ball[0] = number, 0, held[0][0]
            x = np.concatenate([v for _, _, v in held])
            centre = x.mean(axis=0)
            row = [ball, number, len(x), [i for _, ids, _ in held for i in ids], x.tobytes(), x.sum(axis=0).tolist(),
                   centre.tolist(), float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())]
            number, in_ball, held = number + 1, in_ball + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        cell_of_ball, have = [None], 0
        for batch in batches:
            cells, ids = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            x, at = _matrix(batch.column(3), dim), 0
            while at < len(cells):
                if held and (have == per_block or held[0][0] != cells[at]):
                    yield out()
                have = sum(len(i) for _, i, _ in held)
                end = min(int(np.searchsorted(cells, cells[at], side="right")), at + per_block - have)
                held.append((int(cells[at]), ids[at:end], x[at:end]))
                have += end - at
                at = end
        if held:
            yield out()

    names = ["ball", "block", "n", "ids", "vectors", "sums", "centre", "radius"]
    floats = pa.list_(pa.float64())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), floats, floats, pa.float64()]
    parts = max(1, min(rows // per_block, 1 << 14))
    blocks = materialize(
        usable.mapInArrow(keyed, "cell int, far double, id string, v array<double>")
        .repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id")
        .mapInArrow(packed, "ball long, block long, n long, ids array<string>, vectors binary, sums array<double>, "
                            "centre array<double>, radius double"))
    # a ball is a run of blocks: its centre is that of its first block, its radius covers all of them
    first = blocks.groupBy("ball").agg(F.min_by("centre", "block").alias("c"), F.sum("n").alias("n"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    balls = (blocks.select("ball", "centre", "radius").join(first, "ball").groupBy("ball")
             .agg(F.first("c").alias("c"), F.first("n").alias("n"), F.max(away + F.col("radius")).alias("r")).orderBy("ball").toArrow())
    return KnnIndex(blocks.select("ball", "block", "ids", "vectors"), balls.column("ball").to_numpy(), balls.column("n").to_numpy(),
                    _matrix(balls.column("c").combine_chunks(), dim), balls.column("r").to_numpy(), dim)


def _wanted(index: KnnIndex, q: np.ndarray, kth: np.ndarray, k: int, first_round: bool) -> np.ndarray:
    """Which balls each query visits. First round: those of greatest bound that
    hold k vectors and one more together; then all others whose bound reaches ``kth``."""
    sizes, centres, radii = index.sizes, index.centres, index.radii
    norms = np.sqrt((centres * centres).sum(axis=1))
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    bound = q @ centres.T + length * radii + 1e-9 * length * (norms + radii) + 1e-300
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    opening = np.zeros_like(bound, bool)
    np.put_along_axis(opening, order, before <= k, axis=1)
    return opening if first_round else ~opening & (bound >= kth[:, None])


def _doubles(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)


def _shards(index: KnnIndex) -> np.ndarray:
    """The shard of each ball."""
    return (np.cumsum(index.sizes) - index.sizes) * 8 * index.dim // SHARD_BYTES


def _visits(state: DataFrame, index: KnnIndex, k: int, first_round: bool) -> DataFrame:
    """``(qid, qv, kth, shard, balls)``: the shards of the balls that each query
    visits, and which of the shard's balls these are, as bits."""
    plain, shards = _plain(index), _shards(index)
    names, firsts = np.unique(shards, return_index=True)
    step = max(1, min((16 << 20) // (8 * len(shards)), (32 << 20) // (8 * index.dim * len(names))))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                wanted = _wanted(plain, _matrix(batch.column(1), plain.dim), _doubles(batch.column(2)), k, first_round)
                row, shard = np.nonzero(np.logical_or.reduceat(wanted, firsts, axis=1))
                bits = [np.packbits(wanted[i, firsts[s]:firsts[s + 1] if s + 1 < len(firsts) else None]).tobytes()
                        for i, s in zip(row.tolist(), shard.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(names[shard]), pa.array(bits, pa.binary())],
                                                 names=["qid", "qv", "kth", "shard", "balls"])

    return state.mapInArrow(go, "qid string, qv array<double>, kth double, shard long, balls binary")


def _plain(index: KnnIndex) -> KnnIndex:
    """The index without its table, which tasks cannot hold."""
    return replace(index, blocks=None)


def _searched(visits: DataFrame, index: KnnIndex, k: int, exclude_self: bool) -> DataFrame:
    spark = visits.sparkSession
    dim, numbers, shards = index.dim, index.balls, _shards(index)
    sc = spark_context(spark)
    slots = sc.defaultParallelism if sc is not None else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = F.count(F.lit(1))
    parts = F.greatest(F.ceil(n / F.lit(MOST_QUERIES)), F.least(F.ceil(n / F.lit(PART_QUERIES)), F.lit(-(-3 * slots // int(shards[-1] + 1)))))
    plan = materialize(visits.groupBy("shard").agg(parts.cast("int").alias("parts")))
    shard_of = spark.createDataFrame(pa.table({"ball": numbers, "shard": shards}))
    left = visits.join(plan, "shard").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    right = (index.blocks.join(F.broadcast(shard_of), "ball").join(plan, "shard")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))

    def go(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found = [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())]
        if queries.num_rows and blocks.num_rows:
            blocks = blocks.sort_by([("ball", "ascending"), ("block", "ascending")])
            held = blocks.column("ids").combine_chunks()
            ids = held.flatten()
            text = np.array(ids.to_pylist(), str)
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(text, kind="stable")] = np.arange(len(ids))
            e = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for c in blocks.column("vectors").chunks for x in c]).reshape(-1, dim)
            q = _matrix(queries.column("qv").combine_chunks(), dim)
            qid = queries.column("qid").combine_chunks()
            own = id_numbers(np.array(qid.to_pylist(), str), text) if exclude_self else None
            best = BestPairs(q, e, rank, k, own, _doubles(queries.column("kth")))
            bits = queries.column("balls").combine_chunks()
            bits = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(q), -1)
            ends = np.cumsum(held.value_lengths().to_numpy())
            ball, first = np.unique(blocks.column("ball").to_numpy(), return_index=True)
            last = np.append(first[1:], blocks.num_rows) - 1
            for i, (x, y) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                rows = np.flatnonzero(bits[:, i // 8] >> (7 - i % 8) & 1)
                if len(rows):
                    best.add(rows, int(ends[x - 1]) if x else 0, int(ends[y]))
            row, col, score = best.pairs()
            found = [qid.take(pa.array(row)), ids.take(pa.array(col)), pa.array(score)]
        return pa.table(found, ["query_id", "table_id", "score"])

    return (left.select("shard", "part", "qid", "qv", "kth", "balls").groupBy("shard", "part")
            .cogroup(right.drop("parts").groupBy("shard", "part")).applyInArrow(go, "query_id string, table_id string, score double"))


def _scored(visits: DataFrame, index: KnnIndex) -> int:
    """The number of vectors in all balls that are visited."""
    sizes, shards = index.sizes, _shards(index)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = 0
            for shard, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = sizes[shards == shard]
                total += int(of[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(of)).astype(bool)].sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return visits.select("shard", "balls").mapInArrow(go, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def search(index: KnnIndex, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding",
           exclude_self: bool = False, visited: list | None = None) -> DataFrame:
    """``query_id, table_id, score, pos``: what ``knn_topk`` gives. Query ids
    must be unique; queries without a finite vector of the index's length get
    no rows. ``visited`` receives ``(vectors scored, vectors of a full search)``."""
    state = materialize(_usable(queries, query_id, query_vec, index.dim).select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("kth")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "table_id")
    best, scored = None, 0
    for first_round in (True, False):
        visits = materialize(_visits(state, index, k, first_round))
        if visited is not None:
            scored += _scored(visits, index)
        found = _searched(visits, index, k, exclude_self)
        found = found if best is None else best.select("query_id", "table_id", "score").unionByName(found)
        best = found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
        if first_round:
            best = materialize(best)
            kth = best.filter(F.col("pos") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("kth"))
            state = state.drop("kth").join(kth, "qid", "left")
    if visited is not None:
        visited.append((scored, int(index.sizes.sum()) * state.count()))
    return best


def knn_pruned(queries: DataFrame, examples: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding",
               example_id: str = "table_id", example_vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``knn_topk`` through an index built for this one search."""
    index = build(examples, example_id, example_vec)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id string, table_id string, score double, pos int")
    return search(index, queries, k, query_id=query_id, query_vec=query_vec, exclude_self=exclude_self)
