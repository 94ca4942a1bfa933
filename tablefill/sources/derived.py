"""Table corpora, runs and judgments derived from the driver's parquet tables.

The reference reads a folder of small web tables. Here the same shape is
derived from the TPC-H-ish tables so that every registered query reads the
given data and its work grows with it:

* a *table* is the rows of one group (nation x block of 1,000 keys), so the
  number of tables grows with the data while every table stays bounded —
  no per-table array can grow without limit, whatever the key skew;
* runs (FX-RUNS) rank each table's rows three ways, qrels (FX-QREL) judge
  them by market segment, the KNN fixture (FX-KNN) uses ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import rank_score, trec_escape
from ..operators.tables import describe
from ..session import read_table

# Fixed parameters of the derived corpora.
KEY_BLOCK = 1000          # keys per table block: bounds every table's size
RUN_METHODS = ("acctbal", "md5", "custkey")
VALIDATION_REGION = 4     # tables of this region form the validation split


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation/region are fixed-size dimension tables (25 and 5 rows by the
    # TPC-H spec), so broadcasting them is bounded at any scale factor.
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", "n_name", "n_regionkey", "r_name"))


def _tables_from_groups(grouped: DataFrame, headers: list[str]) -> DataFrame:
    meta = F.create_map(F.lit("queryId"), F.col("table_id"),
                        F.lit("pgTitle"), F.col("pg_title"),
                        F.lit("secondTitle"), F.col("second_title"),
                        F.lit("caption"), F.col("caption"))
    return (grouped
            .withColumn("meta", meta)
            .select("table_id",
                    F.concat(F.col("table_id"), F.lit(".csv")).alias("path"),
                    F.col("table_id").alias("query_id"),
                    describe(F.col("pg_title"), F.col("second_title"), F.col("caption")).alias("description"),
                    F.array(*[F.lit(h) for h in headers]).alias("headers"),
                    "rows", "meta"))


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-CUST: one table per (nation, custkey block), rows in custkey order.

    Columns: c_name (subject), c_custkey, c_mktsegment. Description parts:
    region name, nation name, and the nation name again with a leading
    space (dropped as a duplicate after strip).
    """
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    g = (c.withColumn("block", F.floor(F.col("c_custkey") / KEY_BLOCK))
         .groupBy("c_nationkey", "block")
         .agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("cells")))
    g = g.join(_nations(spark, sf_dir), g.c_nationkey == F.col("n_nationkey"))
    g = g.select(
        F.format_string("cust_%d_%d", "c_nationkey", "block").alias("table_id"),
        F.col("r_name").alias("pg_title"),
        F.col("n_name").alias("second_title"),
        F.concat(F.lit(" "), F.col("n_name")).alias("caption"),
        F.transform("cells", lambda x: F.array(x["c_name"], x["c_custkey"].cast("string"),
                                               x["c_mktsegment"])).alias("rows"))
    return _tables_from_groups(g, ["c_name", "c_custkey", "c_mktsegment"])


def supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-SUPP: one table per (nation, suppkey block); many have <= 5 rows."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    g = (s.withColumn("block", F.floor(F.col("s_suppkey") / KEY_BLOCK))
         .groupBy("s_nationkey", "block")
         .agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("cells")))
    g = g.join(_nations(spark, sf_dir), g.s_nationkey == F.col("n_nationkey"))
    g = g.select(
        F.format_string("supp_%d_%d", "s_nationkey", "block").alias("table_id"),
        F.col("n_name").alias("pg_title"),
        F.lit("Suppliers").alias("second_title"),
        F.lit(" ").alias("caption"),
        F.transform("cells", lambda x: F.array(x["s_name"], x["s_suppkey"].cast("string"))).alias("rows"))
    return _tables_from_groups(g, ["s_name", "s_suppkey"])


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-PART: one table per (brand, partkey block); names repeat a lot."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    g = (p.withColumn("block", F.floor(F.col("p_partkey") / KEY_BLOCK))
         .groupBy("p_brand", "block")
         .agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("cells")))
    g = g.select(
        F.format_string("part_%s_%d", F.replace("p_brand", F.lit("#"), F.lit("")), "block").alias("table_id"),
        F.col("p_brand").alias("pg_title"),
        F.lit("").alias("second_title"),
        F.lit("Parts").alias("caption"),
        F.transform("cells", lambda x: F.array(x["p_name"], x["p_type"])).alias("rows"))
    return _tables_from_groups(g, ["p_name", "p_type"])


def _nation_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey -> split: 25 rows by the TPC-H spec."""
    return F.broadcast(_nations(spark, sf_dir).select(
        "n_nationkey", F.when(F.col("n_regionkey") == VALIDATION_REGION, F.lit("validation"))
        .otherwise(F.lit("benchmark")).alias("split")))


def customer_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id -> split ('benchmark' | 'validation') for FX-CUST tables."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    keys = (c.withColumn("block", F.floor(F.col("c_custkey") / KEY_BLOCK))
            .select("c_nationkey", "block").distinct())
    return keys.join(_nation_splits(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.format_string("cust_%d_%d", "c_nationkey", "block").alias("query_id"), "split")


def customer_runs(spark: SparkSession, sf_dir: str, seeds: int = 3) -> DataFrame:
    """FX-RUNS: three runs over the FX-CUST queries.

    For each table the rows after the first ``seeds`` (by custkey) are ranked
    by acctbal desc / md5(name) / custkey, all of them; score 2^-(rank-1).
    The windows are partitioned by table, a group bounded by
    KEY_BLOCK rows.
    """
    c = (read_table(spark, sf_dir, "customer")
         .select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
         .withColumn("query_id", F.format_string("cust_%d_%d", "c_nationkey",
                                                 F.floor(F.col("c_custkey") / KEY_BLOCK))))
    by_table = Window.partitionBy("query_id")
    c = c.withColumn("row_in_table", F.row_number().over(by_table.orderBy("c_custkey")))
    cand = c.filter(F.col("row_in_table") > seeds)
    keys = {
        "acctbal": [F.col("c_acctbal").desc(), F.col("c_custkey")],
        "md5": [F.md5("c_name"), F.col("c_custkey")],
        "custkey": [F.col("c_custkey")],
    }
    # One scan and one shuffle (by table) serve all three rankings.
    for method in RUN_METHODS:
        cand = cand.withColumn(f"rank_{method}", F.row_number().over(by_table.orderBy(*keys[method])))
    per_method = F.array(*[F.struct(F.lit(m).alias("run_id"), F.col(f"rank_{m}").alias("rank"))
                           for m in RUN_METHODS])
    return (cand.select("query_id", "c_name", F.explode(per_method).alias("r"))
            .select(F.col("r.run_id").alias("run_id"), "query_id",
                    trec_escape("c_name").alias("doc_id"),
                    F.col("r.rank").cast("int").alias("rank"),
                    rank_score(F.col("r.rank") - 1).alias("score"),
                    F.col("r.run_id").alias("tag")))


def customer_qrels(spark: SparkSession, sf_dir: str, drop_region: int | None = None) -> DataFrame:
    """FX-QREL: every customer of a table judged 1 if BUILDING segment else 0.

    ``drop_region`` leaves out the tables of one region (the second qrels set,
    for the query-overlap rule)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    if drop_region is not None:
        nat = _nations(spark, sf_dir).filter(F.col("n_regionkey") != drop_region).select("n_nationkey")
        c = c.join(nat, c.c_nationkey == nat.n_nationkey, "left_semi")
    return c.select(
        F.format_string("cust_%d_%d", "c_nationkey", F.floor(F.col("c_custkey") / KEY_BLOCK)).alias("query_id"),
        F.lit("0").alias("iter"),
        trec_escape("c_name").alias("doc_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).cast("int").alias("relevance"))


def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-KNN: (vec_id, embedding, label) — every vector is both a query and
    an example (self matches excluded by the KNN operator)."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def customer_run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs for every (order, split, seeds 1..5): run_id '<order>_<split>_s<n>'.

    Each run covers the tables of one split; the candidates of a query are
    the rows after its first n. One shuffle by table; the seeds grid is a
    5-row broadcast.
    """
    c = (read_table(spark, sf_dir, "customer")
         .select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
         .withColumn("query_id", F.format_string("cust_%d_%d", "c_nationkey",
                                                 F.floor(F.col("c_custkey") / KEY_BLOCK))))
    c = c.join(_nation_splits(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    by_table = Window.partitionBy("query_id")
    c = c.withColumn("row_in_table", F.row_number().over(by_table.orderBy("c_custkey")))
    grid = c.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("seeds"))
    cand = c.crossJoin(F.broadcast(grid)).filter(F.col("row_in_table") > F.col("seeds"))
    w = Window.partitionBy("query_id", "seeds")
    keys = {
        "acctbal": [F.col("c_acctbal").desc(), F.col("c_custkey")],
        "md5": [F.md5("c_name"), F.col("c_custkey")],
        "custkey": [F.col("c_custkey")],
    }
    for method in RUN_METHODS:
        cand = cand.withColumn(f"rank_{method}", F.row_number().over(w.orderBy(*keys[method])))
    per_method = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"rank_{m}").alias("rank"))
                           for m in RUN_METHODS])
    return (cand.select("query_id", "c_name", "split", "seeds", F.explode(per_method).alias("r"))
            .select(F.format_string("%s_%s_s%d", F.col("r.method"), F.col("split"), F.col("seeds")).alias("run_id"),
                    "query_id", trec_escape("c_name").alias("doc_id"),
                    F.col("r.rank").cast("int").alias("rank"),
                    rank_score(F.col("r.rank") - 1).alias("score"),
                    F.col("r.method").alias("tag")))


def grid_run_meta(runs: DataFrame, splits: DataFrame) -> DataFrame:
    """run_meta for the grid runs: folder, seeds, task, and the flags.

    completed: the run answered every query of its split (the reference
    touches keep.flag after the last query); debug: the custkey-order runs
    are the debug baselines; validation: 'validation' in the folder.
    """
    parts = F.split("run_id", "_")
    per_run = (runs.groupBy("run_id")
               .agg(F.countDistinct("query_id").alias("answered")))
    split_sizes = splits.groupBy("split").agg(F.count(F.lit(1)).alias("split_queries"))
    meta = (per_run
            .withColumn("method", parts[0])
            .withColumn("split", parts[1])
            .withColumn("seeds", F.substring(parts[2], 2, 3).cast("int"))
            .join(F.broadcast(split_sizes), "split", "left"))  # one row per split
    folder = F.concat(F.lit("data/"), F.col("split"))
    return meta.select(
        "run_id", folder.alias("folder"), "seeds",
        F.to_json(F.struct(F.lit("suggest").alias("pipeline"),
                           F.col("method").alias("order"))).alias("task"),
        (F.col("answered") == F.col("split_queries")).alias("completed"),
        (F.col("method") == F.lit("custkey")).alias("debug"),
        folder.contains("validation").alias("validation"))


def customer_baseline(spark: SparkSession, sf_dir: str, seeds: int = 3) -> DataFrame:
    """A baseline run (kind 'baseline'): each table's later rows by name,
    descending — a stand-in for the published baseline outputs."""
    c = (read_table(spark, sf_dir, "customer")
         .select("c_custkey", "c_name", "c_nationkey")
         .withColumn("query_id", F.format_string("cust_%d_%d", "c_nationkey",
                                                 F.floor(F.col("c_custkey") / KEY_BLOCK))))
    by_table = Window.partitionBy("query_id")
    c = c.withColumn("row_in_table", F.row_number().over(by_table.orderBy("c_custkey")))
    r = (c.filter(F.col("row_in_table") > seeds)
         .withColumn("rank", F.row_number().over(by_table.orderBy(F.col("c_name").desc()))))
    return r.select(F.lit("baseline_name").alias("run_id"), "query_id",
                    trec_escape("c_name").alias("doc_id"), F.col("rank").cast("int").alias("rank"),
                    rank_score(F.col("rank") - 1).alias("score"), F.lit("baseline").alias("tag"))
