"""Example samplers.

Python's ``random.Random(seed).sample`` streams depend on call order and
cannot be reproduced set-wise; the contract kept here is the one that
matters: without replacement, exactly k, deterministic in (seed, query),
error if k exceeds the population. Draws come from md5, so DuckDB can
recompute them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES_SCHEMA = "query_id string, pos int, table_id string"


def _passthrough(queries: DataFrame) -> list[str]:
    """query_id, plus the query's N when present: renderers split examples
    at the query's N, and carrying it saves them a join back to the queries."""
    return ["query_id"] + (["seeds"] if "seeds" in queries.columns else [])


def md5_draw(*parts) -> Column:
    """A 60-bit non-negative integer from md5 of the '|'-joined parts."""
    cols = [F.lit(p) if isinstance(p, (str, int)) and not isinstance(p, Column) else p for p in parts]
    cols = [c.cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def md5_key(*parts) -> Column:
    """Order key md5(p1|p2|...) for seeded shuffles."""
    cols = [F.lit(p) if isinstance(p, (str, int)) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


INDEX_BUCKETS = 4096  # fixed: the index of an id depends on the data alone


def dense_index(df: DataFrame, id_col: str) -> DataFrame:
    """Add ``idx`` 0..n-1, a bijection fixed by the data alone.

    Rows are spread over INDEX_BUCKETS md5 buckets, numbered by id inside
    each bucket, and shifted by the cumulative size of the earlier buckets (a
    table of INDEX_BUCKETS rows, whatever the input). No global window over
    the rows.
    """
    b = df.withColumn("_bucket", F.pmod(md5_draw(F.col(id_col)), F.lit(INDEX_BUCKETS)))
    b = b.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col)) - 1)
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    return (b.join(F.broadcast(offsets.select("_bucket", "_off")), "_bucket")
            .withColumn("idx", (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_bucket", "_local", "_off"))


def floyd_sample(n: Column, k: int | Column, seed: int | Column, query: Column) -> Column:
    """Floyd's algorithm as one expression: k distinct indexes in [0, n);
    ``k`` and ``seed`` may be columns.

    for j in n-k .. n-1: t = draw(seed, query, j) mod (j+1);
    add t unless already chosen, else add j.
    """
    def step(acc, j):
        t = F.pmod(md5_draw(F.lit(seed), query, j), j + 1)
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(j))).otherwise(F.concat(acc, F.array(t)))
    seq = F.sequence((n - F.lit(k)).cast("long"), (n - F.lit(1)).cast("long"))
    seq = F.when(F.lit(k) > 0, seq).otherwise(F.array().cast("array<long>"))  # a sequence to n - 1 from n would count down
    return F.aggregate(seq, F.array().cast("array<long>"), step)


def sample_examples(queries: DataFrame, candidates: DataFrame, k: int | Column, seed: int | Column = 42,
                    candidate_id: str = "table_id", most: int | None = None) -> DataFrame:
    """SM1/JN4: k random candidates per query (without replacement).

    Exactly k draws per query, then an equi-join on the candidate's dense
    index — never queries x candidates. ``k`` and ``seed`` may be columns of
    the queries; ``most`` is then the largest k, known from the configurations.
    """
    base = candidates.select(F.col(candidate_id).alias("table_id")).distinct()
    n = base.count()  # population size: one count job
    most = k if most is None else most
    if most > n:
        raise ValueError(f"Sample larger than population or is negative (k={most}, n={n})")
    cand = dense_index(base, "table_id")
    keep = _passthrough(queries)
    drawn = queries.select(*keep, F.posexplode(floyd_sample(F.lit(n), k, seed, F.col("query_id")))
                           .alias("p", "idx"))
    return (drawn.join(cand, "idx")
            .select("query_id", (F.col("p") + 1).cast("int").alias("pos"), "table_id", *keep[1:]))


def fixed_amount(seed: int) -> int:
    """amount=None in the fixed sampler: a number 1..5 fixed by the seed."""
    return 1 + int(hashlib.md5(f"{seed}|amount".encode()).hexdigest()[:7], 16) % 5


def sample_fixed(queries: DataFrame, candidates: DataFrame, k: int | None = None, seed: int = 42,
                 candidate_id: str = "table_id") -> DataFrame:
    """SM2/JN3: one sample of k candidates shared by every query.

    The sample is the k smallest md5(seed|id), a top-k job of its own that
    also finds out whether there are k (else ``ValueError``); its k rows,
    bounded by the caller, are joined to all queries.
    """
    k = fixed_amount(seed) if k is None else k
    ids = [r.table_id for r in (candidates.select(F.col(candidate_id).alias("table_id")).distinct()
                                .orderBy(md5_key(seed, F.col("table_id")), "table_id").limit(k).collect())]
    if len(ids) < k:
        raise ValueError(f"Sample larger than population or is negative (k={k}, n={len(ids)})")
    sample = candidates.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(ids)], "pos int, table_id string")
    keep = _passthrough(queries)
    return (queries.select(*keep)
            .crossJoin(F.broadcast(sample.select("pos", "table_id")))
            .select("query_id", "pos", "table_id", *keep[1:]))


def sample_fixed_each(queries: DataFrame, candidates: DataFrame, settings: Sequence[tuple[int, int]],
                      candidate_id: str = "table_id") -> DataFrame:
    """``sample_fixed`` for queries with ``k`` and ``seed`` columns: the samples
    of all settings ``(k, seed)`` come from one top-k job (a limit per seed
    below its shuffle) and reach the queries in one broadcast of k rows a setting."""
    spark = candidates.sparkSession
    wanted = spark.createDataFrame(sorted(set(settings)), "k int, seed int")
    ids = candidates.select(F.col(candidate_id).alias("table_id")).distinct().crossJoin(F.broadcast(wanted))
    rank = Window.partitionBy("k", "seed").orderBy(md5_key(F.col("seed"), F.col("table_id")), "table_id")
    rows = [(r.k, r.seed, r.pos, r.table_id) for r in
            ids.withColumn("pos", F.row_number().over(rank)).filter(F.col("pos") <= F.col("k")).collect()]
    for k, seed in set(settings):
        found = sum(r[:2] == (k, seed) for r in rows)
        if found < k:
            raise ValueError(f"Sample larger than population or is negative (k={k}, n={found})")
    sample = spark.createDataFrame(rows, "k int, seed int, pos int, table_id string")
    keep = _passthrough(queries)
    return (queries.select(*keep, "k", "seed").join(F.broadcast(sample), ["k", "seed"])
            .select("query_id", "pos", "table_id", *keep[1:]))


def subsample(pool: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """SM3: k members of each query's pool (e.g. a KNN result), chosen by
    md5(seed|query|table); the pool per query is small (another sampler's
    output), and the top-k cut is a WindowGroupLimit. A query whose pool is
    smaller than k stops the job with an error, as a sample larger than its
    population does elsewhere."""
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    enough = F.when(size >= k, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit(f"Sample larger than population or is negative (k={k}, n="), size.cast("string"), F.lit(")"))).cast("boolean"))
    w = Window.partitionBy("query_id").orderBy(md5_key(seed, F.col("query_id"), F.col("table_id")), "table_id")
    return (pool.select("query_id", "table_id")
            .withColumn("pos", F.row_number().over(w)).withColumn("_enough", enough)
            .filter((F.col("pos") <= k) & F.col("_enough"))
            .drop("_enough")
            .withColumn("pos", F.col("pos").cast("int")))


def no_examples(queries: DataFrame) -> DataFrame:
    """JN2: zero-shot — an empty examples frame of the right schema."""
    return queries.sparkSession.createDataFrame([], EXAMPLES_SCHEMA)
