"""Exact k-nearest-neighbour join over unit vectors.

The SQL form (queries x examples, dot product, top-k window) emits every
pair. Here both sides are hashed into blocks; each (query block, example
block) pair meets in one cogroup task that does NumPy matrix products of tiles and
keeps only the k best per query (``BestPairs``). A final top-k window over the
``k x example blocks`` candidates per query gives the exact answer.

Shuffle volume: queries are replicated once per example block and examples
once per query block — ``Q*Be + E*Bq`` rows. Larger blocks mean less
replication, so block sizes come from a per-task memory budget and the
vector width (``q_block_bytes``, ``e_block_bytes``), not from fixed row
counts; queries are split further where that keeps every task slot busy to the end
(``block_grid``). Block ids come from a hash of the row
id, so key skew cannot unbalance the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spark_context

def exact_scores(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed in component order: the same bits
    in any block, partitioning or engine that sums in this order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * e[:, j]
    return out


class BestPairs:
    """The ``k`` best columns of each row of ``q @ e.T`` by exact score, ties by ``id_rank``.

    A product in single precision, with room for its rounding, picks the pairs
    that can reach a row's k-th exact score so far (at first that of the first
    columns, or ``floor``); only these get exact scores. Rows of which many
    columns pass, as where most scores are equal, are scored column by column instead of
    pair by pair, so that what is held depends on the tiles and not on the ties.

    ``own`` are the id numbers of rows and columns: pairs with equal ones are
    left out, as are scores that are not finite and those below ``floor``."""

    ROWS, COLUMNS, FIRST = 1024, 8192, 1024

    def __init__(self, q: np.ndarray, e: np.ndarray, id_rank: np.ndarray, k: int,
                 own: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None):
        self.q, self.e, self.id_rank, self.k, self.own = q, e, id_rank, k, own
        self.least = np.full(len(q), -np.inf) if floor is None else floor.copy()
        self.score, self.col = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        self.e_finite = bool(np.isfinite(e).all())
        self.q_scale = self._largest(q)
        self.e_scale = self._largest(e).max(initial=0.0)
        self.q32 = self._scaled(q, self.q_scale, (q.shape[1] + 8) * 1.2e-7)
        self.e32 = self._scaled(e, np.full(len(e), self.e_scale), 1.0)
        size = min(self.ROWS, len(q)) * min(self.COLUMNS, len(e))
        self.held = np.empty(size, np.float32), np.empty(size, bool)  # one tile at a time

    def _largest(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x))
        for at in range(0, len(x), self.COLUMNS):
            y = np.abs(x[at:at + self.COLUMNS])
            out[at:at + self.COLUMNS] = np.where(np.isfinite(y), y, 0.0).max(axis=1, initial=0.0)
        out[out == 0] = 1.0
        return out

    def _scaled(self, x: np.ndarray, scale: np.ndarray, room: float) -> np.ndarray:
        """Rows in single precision and, last, their length: its product is the room for rounding."""
        out = np.empty((len(x), x.shape[1] + 1), np.float32)
        for at in range(0, len(x), self.COLUMNS):
            y = x[at:at + self.COLUMNS] / scale[at:at + self.COLUMNS, None]
            y[~np.isfinite(y)] = 0.0  # their exact scores are not finite
            out[at:at + self.COLUMNS, :-1] = y
            out[at:at + self.COLUMNS, -1] = room * np.sqrt((y * y).sum(axis=1))
        return out

    def add(self, rows: np.ndarray, begin: int, end: int) -> None:
        """Takes the columns ``begin`` to ``end`` into account for these rows."""
        for a in range(0, len(rows), self.ROWS):
            r = rows[a:a + self.ROWS]
            for b in range(begin, end, self.COLUMNS):
                self._tile(r, b, min(end, b + self.COLUMNS))

    def _tile(self, r: np.ndarray, begin: int, end: int) -> None:
        shape = len(r), end - begin
        most, passed = (x[:shape[0] * shape[1]].reshape(shape) for x in self.held)
        np.matmul(self.q32[r], self.e32[begin:end].T, out=most)
        fresh = np.flatnonzero(self.least[r] == -np.inf)
        n = min(end - begin, max(self.FIRST, 2 * self.k))
        if len(fresh) and n >= self.k:
            x = most[fresh, :n]
            if self.own is not None:
                x[self.own[0][r[fresh], None] == self.own[1][None, begin:begin + n]] = -np.inf
            top = np.argpartition(x, n - self.k, axis=1)[:, n - self.k:]
            exact = self._exact(np.repeat(r[fresh], self.k), begin + top.ravel()).reshape(top.shape)
            exact[np.take_along_axis(x, top, 1) == -np.inf] = -np.inf
            self.least[r[fresh]] = np.where(np.isfinite(exact).all(axis=1), exact.min(axis=1), -np.inf)
        with np.errstate(over="ignore"):
            least = (self.least[r] / self.q_scale[r] / self.e_scale - 1e-30).astype(np.float32)
        np.greater_equal(most, np.nextafter(least, np.float32(-np.inf))[:, None], out=passed)
        counts = np.count_nonzero(passed, axis=1)
        many = counts > max(4 * self.k, (end - begin) // 8)
        passed[many] = False
        row, col = np.divmod(np.flatnonzero(passed), end - begin)
        row, col = r[row], col + begin
        self._take(row, col, self._exact(row, col))
        if many.any():
            components = np.ascontiguousarray(self.e[begin:end].T)
            for i in r[many].tolist():
                self._whole_row(i, components, begin, end)

    def _exact(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), 16384):
            some = slice(at, at + 16384)
            out[some] = exact_scores(self.q[row[some]], self.e[col[some]])
        return out

    def _whole_row(self, i: int, components: np.ndarray, begin: int, end: int) -> None:
        exact = np.zeros(end - begin)
        for j in np.flatnonzero(self.q[i]).tolist() if self.e_finite else range(len(components)):  # a zero adds nothing
            exact += self.q[i, j] * components[j]
        if self.own is not None:
            exact[self.own[1][begin:end] == self.own[0][i]] = -np.inf
        exact[~np.isfinite(exact)] = -np.inf
        least = self.least[i]
        above = np.flatnonzero(exact > least)
        if len(above) > self.k:
            least = np.partition(exact[above], len(above) - self.k)[len(above) - self.k]
            above = above[exact[above] > least]
        equal = np.flatnonzero(exact == least) if least > -np.inf else above[:0]
        if len(equal) > self.k:
            equal = equal[np.argpartition(self.id_rank[begin + equal], self.k)[:self.k]]
        col = np.append(above, equal)
        self._take(np.full(len(col), i), begin + col, exact[col])

    def _take(self, row: np.ndarray, col: np.ndarray, exact: np.ndarray) -> None:
        keep = (exact >= self.least[row]) & np.isfinite(exact)
        if self.own is not None:
            keep &= self.own[0][row] != self.own[1][col]
        if not keep.any():
            return
        row, col, exact = row[keep], col[keep], exact[keep]
        rows = np.unique(row)
        old = self.col[rows] >= 0
        row = np.append(row, np.repeat(rows, old.sum(axis=1)))
        col, exact = np.append(col, self.col[rows][old]), np.append(exact, self.score[rows][old])
        order = np.lexsort((self.id_rank[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]], self.col[row[keep], place[keep]] = exact[keep], col[keep]
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores, best first."""
        row, place = np.nonzero(self.col >= 0)
        return row, self.col[row, place], self.score[row, place]


def id_numbers(q_ids: np.ndarray, e_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal ids of queries and examples, -1 for queries that are no example."""
    known, e_number = np.unique(e_ids, return_inverse=True)
    at = np.minimum(np.searchsorted(known, q_ids), len(known) - 1)
    return np.where(known[at] == q_ids, at, -1), e_number


def stacked(column: pd.Series) -> np.ndarray:
    """Vectors as a matrix of doubles."""
    values = column.to_numpy()
    out = np.empty((len(values), len(values[0])))
    for at in range(0, len(values), 8192):
        out[at:at + 8192] = np.stack(values[at:at + 8192])
    return out


def _block_topk(k: int, exclude_self: bool, q_payload: tuple = (), e_payload: tuple = ()):
    def fn(qdf: pd.DataFrame, edf: pd.DataFrame) -> pd.DataFrame:
        extra = [f"q_{c}" for c in q_payload] + [f"e_{c}" for c in e_payload]
        if len(qdf) == 0 or len(edf) == 0:
            return pd.DataFrame({c: [] for c in ["query_id", "table_id", "score", *extra]})
        e_ids = edf["eid"].to_numpy(dtype=object)
        e_mat = stacked(edf["evec"])
        e_str = e_ids.astype(str)
        id_rank = np.empty(len(e_ids), dtype=np.int64)  # rank of each id, for tie-breaks
        id_rank[np.argsort(e_str, kind="stable")] = np.arange(len(e_ids))
        q_ids = qdf["qid"].to_numpy(dtype=object)
        q_mat = stacked(qdf["qvec"])
        own = id_numbers(q_ids.astype(str), e_str) if exclude_self else None
        best = BestPairs(q_mat, e_mat, id_rank, k, own)
        best.add(np.arange(len(q_ids)), 0, len(e_ids))
        row, col, exact = best.pairs()
        out = pd.DataFrame({"query_id": q_ids[row], "table_id": e_ids[col], "score": exact})
        # payload columns ride along, looked up by id inside the block
        for c in q_payload:
            out[f"q_{c}"] = out["query_id"].map(dict(zip(q_ids, qdf[f"q_{c}"])))
        for c in e_payload:
            out[f"e_{c}"] = out["table_id"].map(dict(zip(e_ids, edf[f"e_{c}"])))
        return out
    return fn


def block_grid(nq: int, ne: int, q_block_rows: int, e_block_rows: int, slots: int) -> tuple[int, int]:
    """Numbers of query and example blocks that keep every task slot busy.

    A grid of fewer cells than slots gets more query blocks, down to 256 rows each.
    A larger one is done in turns of ``slots`` cells; it gets the query blocks that
    fit in as many turns, so that the last turn is not run by a few slots alone."""
    bq = max(1, math.ceil(nq / q_block_rows))
    be = max(1, math.ceil(ne / e_block_rows))
    if bq * be < slots:
        return max(bq, min(math.ceil(slots / be), math.ceil(nq / 256))), be
    turns = math.ceil(bq * be / slots)
    return max(bq, min(turns * slots // be, math.ceil(nq / 256))), be


def knn_topk(queries: DataFrame, examples: DataFrame, k: int, *,
             query_id: str = "query_id", query_vec: str = "embedding",
             example_id: str = "table_id", example_vec: str = "embedding",
             exclude_self: bool = False, q_block_rows: int | None = None,
             e_block_rows: int | None = None,
             n_queries: int | None = None, n_examples: int | None = None,
             q_block_bytes: int = 64 << 20, e_block_bytes: int = 128 << 20,
             dim: int | None = None, query_payload: tuple = (), example_payload: tuple = ()) -> DataFrame:
    """Top-k examples per query by dot product (= cosine for unit vectors).

    Returns ``query_id, table_id, score, pos`` with pos 1 = nearest; ties by
    smaller ``table_id``. Ids are compared as strings. A score is the sum of
    products in component order, so equal vectors tie exactly and the id
    decides, whatever the blocks are; nothing is rounded.

    ``n_queries`` / ``n_examples`` (row counts) and ``dim`` size the block
    grid; when not given they are read here — pass them when the vectors are
    computed on the fly, so sizing does not run the embedding twice.

    ``query_payload`` / ``example_payload`` name columns carried through
    from each side (output as ``q_<name>`` / ``e_<name>``), which saves a
    join back to either side after the search.
    """
    q = queries.select(F.col(query_id).cast("string").alias("qid"), F.col(query_vec).alias("qvec"),
                       *[F.col(c).alias(f"q_{c}") for c in query_payload])
    e = examples.select(F.col(example_id).cast("string").alias("eid"), F.col(example_vec).alias("evec"),
                        *[F.col(c).alias(f"e_{c}") for c in example_payload])
    schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("table_id", T.StringType()),
                           T.StructField("score", T.DoubleType())]
                          + [T.StructField(f"q_{c}", queries.schema[c].dataType) for c in query_payload]
                          + [T.StructField(f"e_{c}", examples.schema[c].dataType) for c in example_payload])
    # size check: two count jobs decide the block grid (no data reaches the driver)
    nq = q.count() if n_queries is None else n_queries
    ne = e.count() if n_examples is None else n_examples
    if q_block_rows is None or e_block_rows is None:
        if dim is None:  # the vector width, from one row
            first = e.select(F.size("evec").alias("d")).first()
            dim = max(1, first.d if first is not None else 1)
        row_bytes = 8 * dim + 64  # float64 in the task, plus the id
        q_block_rows = q_block_rows or max(256, q_block_bytes // row_bytes)
        e_block_rows = e_block_rows or max(1024, e_block_bytes // row_bytes)
    sc = spark_context(queries.sparkSession)
    slots = sc.defaultParallelism if sc is not None else int(
        queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bq, be = block_grid(nq, ne, q_block_rows, e_block_rows, slots)
    qb = (q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(bq)))
          .withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(be - 1)).cast("array<long>"))))
    eb = (e.withColumn("eb", F.pmod(F.xxhash64("eid"), F.lit(be)))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)).cast("array<long>"))))
    cand = (qb.groupBy("qb", "eb")
            .cogroup(eb.groupBy("qb", "eb"))
            .applyInPandas(_block_topk(k, exclude_self, tuple(query_payload), tuple(example_payload)),
                           schema))
    # merge the per-block top k (k x Be candidates per query) into the exact top k
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("table_id"))
    return cand.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def order_examples(nearest: DataFrame, order: str = "lowest first", seed: int = 42) -> DataFrame:
    """RK3: prompt order of the k examples.

    'highest first' keeps nearest-first; 'lowest first' (the reference's
    default) puts the nearest last; 'random' orders by md5(seed|query|table).
    Input needs ``query_id, table_id, score, pos``.
    """
    if order == "highest first":
        return nearest
    w = Window.partitionBy("query_id")
    if order == "lowest first":
        return nearest.withColumn("pos", F.row_number().over(w.orderBy(F.col("pos").desc())))
    if order == "random":
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id"), F.col("table_id")))
        return nearest.withColumn("pos", F.row_number().over(w.orderBy(key)))
    raise ValueError(f"Unknown order {order}")


def knn_examples(queries: DataFrame, example_tables: DataFrame, k: int, order: str = "lowest first",
                 seed: int = 42, dim: int = 64, embedder=None) -> DataFrame:
    """JN1: the KNN tutor.

    A query is embedded from ``", ".join`` of its seed values (missing
    cells skipped), an example table from the same join of its subject
    column; the k nearest tables are returned in the requested prompt
    order (RK3). ``embedder(df, text_col, id_col)`` defaults to the hashed
    bag of words; a user's encoder plugs in through ``infer.embed``.
    Returns ``query_id, pos, table_id, score``.
    """
    from .infer import embed_hash
    from .tables import subject
    own = embedder
    embedder = embedder or (lambda df, t, i: embed_hash(df, t, i, dim=dim, float32=False, unique_ids=True))
    q_text = F.array_join(F.filter("seed_values", lambda x: x.isNotNull()), ", ")
    e_text = F.array_join(F.filter(subject("rows"), lambda x: x.isNotNull()), ", ")
    qv = embedder(queries.select("query_id", q_text.alias("text")), "text", "query_id")
    ev = embedder(example_tables.select("table_id", e_text.alias("text")), "text", "table_id")
    # one vector per id: count the (column-pruned) inputs, not the embeddings
    nq, ne = queries.select("query_id").count(), example_tables.select("table_id").count()
    nn = knn_topk(qv, ev, k, query_id="query_id", example_id="table_id",
                  n_queries=nq, n_examples=ne, dim=dim if own is None else None)
    return order_examples(nn, order, seed)
