"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, ``floor(256 * x)``. One more coordinate,
``sqrt(M^2 - |x|^2)`` with ``M`` the greatest norm, puts all of them on a
sphere; a query gets 0 there. Then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, so the
greatest inner products are the nearest vectors, and the triangle inequality
holds.

The index keys every vector by its nearest pivot and its distance from it. In
that order vectors are cut into blocks, each a piece of an annulus around one
pivot; runs of blocks are the units a query visits. With ``D`` the query's
distance from the pivot and ``R`` that of its k-th best so far, a vector at
distance ``d`` from the pivot can only be better where ``|D - d| <= R``. A query
expands its annuli by this bound, the nearest first, in rounds of four times as
many, and stops when the next one lies beyond ``R``; inside a block it reads only
the slice within the bound. All scores are exact; the bounds get a margin for
their rounding.

The pivots are k-means centres of SAMPLE vectors (the fit; every vector is
indexed). They decide how much is pruned, never the result. What is sent to all
tasks is the pivots and at most about MAX_RUNS run bounds, at any size. The
queries of one run are dealt out in parts, so a run that all queries visit is many
tasks. Of equal vectors only the ``k + 1`` smallest ids can be among the best of
any query, the rest leave before the index is built.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without an id. Empty vectors score 0. A shorter vector counts as filled
up with zeros. Rows with equal id and vector are one row; rows that share an id but not the
vector are separate candidates and separate queries, and a query never meets a row of
its own id. A score that does not fit in 64 bits raises. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefill.llm.common import stored

SCALE = 256
PIVOTS = 64
SAMPLE = 4096
BLOCK_BYTES = 2 << 20
MAX_RUNS = 1 << 16
PART_QUERIES = 2048
_EXACT = 2.0 ** 52


def integers(df: DataFrame, id_col: str, vec_col: str, query: Column) -> DataFrame:
    """``(id, v, is_query)`` of the rows that take part."""
    x = F.col(vec_col)
    fits = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    return df.where(fits).select(F.col(id_col).alias("id"), whole.alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, filled up with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the coordinate that puts them on the sphere."""
    rest = np.sqrt(np.maximum(square - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(points: np.ndarray, count: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """k-means centres, started from points that are far from each other."""
    chosen = [0]
    far = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen].copy()
    for _ in range(rounds):
        owner = distances(points, centres).argmin(axis=1)
        for k in range(len(centres)):
            if (owner == k).any():
                centres[k] = points[owner == k].mean(axis=0)
    return centres


def build_index(vectors: DataFrame, rows: int, dim: int, square: float, pivots: np.ndarray) -> DataFrame:
    """One row a block: ``(run, block, cell, least, most, ids, far, vectors)``."""
    per_block = max(64, BLOCK_BYTES // (8 * (dim + 1)))
    blocks = max(1, rows // per_block)
    per_run = 1 + blocks // MAX_RUNS

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(batch.column(1), dim), square), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), *batch.columns], names=["cell", "far", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        held, have, cell, made, run = [], 0, None, 0, (None, 0, 0)

        def out() -> pa.RecordBatch:
            nonlocal held, have, made, run
            ids, far, v = (np.concatenate(x) for x in zip(*held, strict=True))
            if run[0] != cell or run[1] == per_run:
                run = (cell, 0, made)
            run = (cell, run[1] + 1, run[2])
            row = [first + run[2], first + made, cell, float(far[0]), float(far[-1]), ids.tobytes(), far.tobytes(), v.tobytes()]
            held, have, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            cells = batch.column(0).to_numpy()
            ids, far, v = batch.column(2).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(3), dim)
            at = 0
            while at < len(cells):
                if have and (cells[at] != cell or have == per_block):
                    yield out()
                cell = int(cells[at])
                end = min(int(np.searchsorted(cells, cell, side="right")), at + per_block - have)
                held.append((ids[at:end], far[at:end], v[at:end]))
                have += end - at
                at = end
        if have:
            yield out()

    names = ["run", "block", "cell", "least", "most", "ids", "far", "vectors"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    near = vectors.mapInArrow(keyed, "cell int, far double, id long, v array<bigint>")
    parts = max(1, min(blocks, 1 << 14))
    return near.repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id").mapInArrow(
        packed, "run long, block long, cell int, least double, most double, ids binary, far binary, vectors binary")


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 where no sum can pass 2^52."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)))
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1) < _EXACT:
        return left @ right.T
    whole = [np.array([[int(x) for x in row] for row in side], object).reshape(side.shape) for side in (left, right)]
    return whole[0] @ whole[1].T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best scores of each row, none below ``floor``; ties to smaller ids."""
    n = scores.shape[1]
    if n > k:
        floor = np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
    row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def search_block(queries: pa.Table, block: dict, dim: int, square: float, pivots: np.ndarray, k: int) -> tuple:
    """``(query row, id, score)`` of the best of one block for each query."""
    ids, far = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["far"], np.float64)
    vectors = np.frombuffer(block["vectors"], np.float64).reshape(len(ids), dim)
    q = matrix(queries.column("qv"), dim)
    own = queries.column("query_id").to_numpy()
    kth = queries.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
    kth = np.where(np.isnan(kth), -np.inf, kth)
    norms = (q * q).sum(axis=1)
    at = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots[block["cell"]][None])[:, 0]
    reach = np.sqrt(np.maximum(norms + square - 2 * kth, 0)) + margin(norms, square)
    low, high = np.searchsorted(far, at - reach, side="left"), np.searchsorted(far, at + reach, side="right")
    order = np.argsort(low, kind="stable")
    found = []
    for part in np.array_split(order, max(1, len(order) // 128)):
        part = part[high[part] > low[part]]
        if len(part):
            a, b = int(low[part].min()), int(high[part].max())
            scores = exact_products(q[part], vectors[a:b])
            scores[own[part][:, None] == ids[None, a:b]] = -np.inf
            row, col = best_of(scores, ids[a:b], k, kth[part])
            found.append((part[row], ids[a:b][col], [int(x) for x in scores[row, col]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), sum((x[2] for x in found), [])


def margin(norms: np.ndarray, square: float) -> np.ndarray:
    """What rounding may add to a distance, with room to spare: an error of
    1e-11 of the squares, as the root of it where the distance is near 0."""
    return 1e-3 + 1e-5 * np.sqrt(norms + square)


def visits(open_queries: DataFrame, runs: pa.Table, begin: int, end: int, dim: int, square: float, pivots: np.ndarray) -> DataFrame:
    """``(query_id, twin, qv, kth, run)``: of each query's runs in order of
    their lower bounds those in places ``[begin, end)`` that may still hold a better vector."""
    run, cell, least, most = (runs.column(c).to_numpy() for c in ("run", "cell", "least", "most"))
    step = max(1, (16 << 20) // (8 * max(len(run), 1)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = matrix(batch.column(2), dim)
                norms = (q * q).sum(axis=1)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, cell]
                bound = np.maximum(np.maximum(least - d, d - most), 0)
                kth = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(norms + square - 2 * np.nan_to_num(kth), 0)) + margin(norms, square))
                order = np.argsort(bound, axis=1, kind="stable")[:, begin:end]
                row, place = np.nonzero(np.take_along_axis(bound, order, axis=1) <= reach[:, None])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(row)) for i in range(4)), pa.array(run[order[row, place]])],
                    names=["query_id", "twin", "qv", "kth", "run"])

    return open_queries.mapInArrow(go, "query_id long, twin long, qv array<bigint>, kth long, run long")


def searched(visit: DataFrame, blocks: DataFrame, dim: int, square: float, pivots: np.ndarray, k: int) -> DataFrame:
    """``(query_id, twin, vec_id, score)``: the best of each visited block."""
    parts = F.ceil(F.count(F.lit(1)) / F.lit(PART_QUERIES)).cast("int").alias("parts")
    plan = stored(visit.groupBy("run").agg(parts).join(blocks.select("run", "block"), "run"))
    left = visit.join(plan, "run").withColumn("part", F.pmod(F.xxhash64("query_id", "twin"), F.col("parts")).cast("int"))
    right = blocks.drop("run", "least", "most").join(plan.select("block", "parts"), "block").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def go(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        row, ids, scores = search_block(queries, block.to_pylist()[0], dim, square, pivots, k)
        at = pa.array(row, pa.int64())
        return pa.table({"query_id": queries.column("query_id").take(at), "twin": queries.column("twin").take(at),
                         "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return (left.select("block", "part", "query_id", "twin", "qv", "kth").groupBy("block", "part")
            .cogroup(right.drop("parts").groupBy("block", "part"))
            .applyInArrow(lambda key, a, b: go(key, a, b) if a.num_rows and b.num_rows else EMPTY,
                          "query_id long, twin long, vec_id long, score long"))


EMPTY = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "twin", "vec_id", "score")})


def top_k(df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row that ``query`` marks,
    the ``k`` rows of other ids with the greatest inner products, by score
    descending, then id."""
    taking = integers(df, id_col, vec_col, query)
    queries = stored(taking.where("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
                     .dropDuplicates(["query_id", "qv"]).withColumn("twin", F.xxhash64("qv")))
    twins = Window.partitionBy("v").orderBy("id")
    vectors = stored(taking.select("id", "v").withColumn("place", F.dense_rank().over(twins)).where(F.col("place") <= k + 1)
                     .drop("place").dropDuplicates(["v", "id"]))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, dim, square = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    best = df.sparkSession.createDataFrame([], "query_id long, twin long, vec_id long, score long")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    if rows:
        bound = max(1, min(SAMPLE, (64 << 20) // (8 * (dim + 1))))
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(bound).toArrow()
        pivots = fit_pivots(lifted(matrix(sample.column("v"), dim), square))
        blocks = stored(build_index(vectors, rows, dim, square, pivots))
        runs = blocks.groupBy("run").agg(F.first("cell").alias("cell"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("run").toArrow()
        begin, width = 0, 2
        while begin < runs.num_rows:
            kth = best.groupBy("query_id", "twin").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            state = queries.join(kth, ["query_id", "twin"], "left").select("query_id", "twin", "qv", "kth")
            visit = stored(visits(state, runs, begin, begin + width, dim, square, pivots))
            if visit.isEmpty():
                break
            found = best.unionByName(searched(visit, blocks, dim, square, pivots, k))
            best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
            begin, width = begin + width, width * 4
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def oracle_sql() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
