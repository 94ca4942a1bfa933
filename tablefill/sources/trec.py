"""TREC run and qrels files, run metadata, qrels choice, baselines.

SURVEY SRC3-SRC8. Ids are read as strings with quoting off (the reference
lets pandas infer numeric ids and treats a leading '"' as a quote — a
deliberate difference). Many run folders are read in one scan; the run id
comes from the file's folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .listing import list_folders

# The run-folder layout and file names of the original tool.
RUN_FILE = "trec.log"
KEEP_FLAG = "keep.flag"
DEBUG_FLAG = "debug.flag"
BENCHMARK_CONFIG = "benchmark.yaml"
BASELINE_GLOB = "BL3_co*{seeds}.txt"

QRELS_SCHEMA = "query_id string, iter string, doc_id string, relevance int"
RUN_FILE_SCHEMA = "query_id string, q0 string, doc_id string, rank int, score double, tag string"


def _tsv(spark: SparkSession, schema: str):
    # quote/escape off: a doc id may start with '"'
    return (spark.read.schema(schema).option("sep", "\t").option("quote", "")
            .option("escape", "").option("header", "false").option("mode", "FAILFAST"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: 4 columns, no header."""
    return _tsv(spark, QRELS_SCHEMA).csv(path)


def _folder_name(path_col) -> F.Column:
    # .../<run_folder>/trec.log[/part-...]
    return F.regexp_extract(path_col, r"([^/]+)/trec\.log(/[^/]*)?$", 1)


def read_runs(spark: SparkSession, root: str, pattern: str = f"*/{RUN_FILE}", kind: str = "run") -> DataFrame:
    """SRC4 (+SRC8 with ``pattern='BL3_co*3.txt', kind='baseline'``):
    ``run_id, query_id, doc_id, rank, score, tag, kind``.

    For runs the id is the run folder's name; for other files the stem."""
    df = _tsv(spark, RUN_FILE_SCHEMA).csv(f"{root.rstrip('/')}/{pattern}")
    path = F.col("_metadata.file_path")
    run_id = F.when(_folder_name(path) != "", _folder_name(path)).otherwise(
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))
    return df.select(run_id.alias("run_id"), "query_id", "doc_id", "rank", "score", "tag",
                     F.lit(kind).alias("kind"))


def _seeds_of(name: F.Column, seeds: Sequence[int]) -> F.Column:
    """The seed counts a baseline's file name stands for: those it ends with."""
    return F.filter(F.array(*(F.lit(int(n)) for n in seeds)), lambda n: name.endswith(F.concat(n.cast("string"), F.lit(".txt"))))


def baseline_files(spark: SparkSession, folder: str, seeds: int) -> DataFrame:
    """SRC8: baseline outputs ``BL3_co*<seeds>.txt``, largest file first."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", BASELINE_GLOB.format(seeds=seeds)).load(folder)
            .select("path", "length")
            # one row per baseline file: a global window over them is tiny
            .withColumn("size_rank", F.row_number().over(Window.orderBy(F.col("length").desc(), "path"))))


def read_baselines(spark: SparkSession, folder: str, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """SRC8: all baseline outputs of a folder in one scan: the columns of
    ``read_runs`` and ``seeds``, parsed from the file's name. A file whose name
    ends with several of ``seeds`` (3 and 13) counts for each, with the number
    in its run id. A file may be a folder of parts."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.txt)(?:/[^/]*)?$", 1)
    rows = (_tsv(spark, RUN_FILE_SCHEMA).csv(f"{folder.rstrip('/')}/{BASELINE_GLOB.format(seeds='')}")
            .withColumn("name", name).withColumn("all", _seeds_of(F.col("name"), seeds)).withColumn("seeds", F.explode("all")))
    stem = F.regexp_extract("name", r"^(.*)\.txt$", 1)
    run_id = F.when(F.size("all") == 1, stem).otherwise(F.concat(stem, F.lit("_s"), F.col("seeds").cast("string")))
    return rows.select(run_id.alias("run_id"), "query_id", "doc_id", "rank", "score", "tag", F.lit("baseline").alias("kind"), "seeds")


def read_run_meta(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: ``run_id, folder, seeds, task, completed, debug, validation``.

    The run sink appends one row per run to ``<root>/_run_meta`` after the
    run's rows have committed, so ``completed`` is true only for runs whose
    write finished; a run folder without a meta row is not completed.
    """
    meta = spark.read.parquet(f"{root.rstrip('/')}/_run_meta").drop("run")
    return meta.withColumn("validation", F.col("folder").contains("validation"))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC6: run folders that contain a run file (a file, or a folder of
    parts; an empty one counts), in name (= creation time) order, with the run file's time."""
    files = list_folders(spark, root).filter(F.col("name") == RUN_FILE)
    return files.select(F.col("folder").alias("run_id"), F.col("modified").alias("created")).orderBy("run_id")


def qrels_for(run_meta: DataFrame, qrels: DataFrame) -> DataFrame:
    """SRC7: the qrels of each run's (split, seeds) — an equi-join on the
    partition columns of a qrels table written ``partitionBy(split, seeds)``,
    so only the needed partitions are scanned."""
    split = F.when(F.col("validation"), F.lit("validation")).otherwise(F.lit("benchmark"))
    keys = run_meta.select("run_id", split.alias("split"), "seeds")
    # (split, seeds) has ~10 values: a shuffle join would put each in one
    # task, so the run list (one row per run) is broadcast instead
    return qrels.join(F.broadcast(keys), ["split", "seeds"]).drop("split", "seeds")


def read_run_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC5/SRC6 for run folders in the original layout: ``<root>/<run>/``
    with ``benchmark.yaml``, ``trec.log`` and optional ``keep.flag`` /
    ``debug.flag``. Returns the ``run_meta`` schema.

    Flags come from one listing that tasks make (``list_folders``); ``seeds`` and
    ``folder`` are read from the benchmark config with two regular
    expressions (the config is a flat mapping of scalars). Only folders
    with a run file are listed.
    """
    root = root.rstrip("/")
    has = lambda name: F.max((F.col("name") == name).cast("int")) == 1
    flags = (list_folders(spark, root).groupBy(F.col("folder").alias("run_id"))
             .agg(has(RUN_FILE).alias("run"), has(KEEP_FLAG).alias("completed"), has(DEBUG_FLAG).alias("debug"))
             .filter("run").drop("run"))
    # wholetext must be the keyword: text()'s own default would override an option
    conf = (spark.read.text(f"{root}/*/{BENCHMARK_CONFIG}", wholetext=True)
            .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/benchmark\.yaml(?:/[^/]*)?$", 1).alias("run_id"),
                    F.nullif(F.regexp_extract("value", r"(?m)^seeds:\s*(\d+)\s*$", 1), F.lit(""))
                    .cast("int").alias("seeds"),
                    F.regexp_extract("value", r"(?m)^folder:\s*(.*?)\s*$", 1).alias("folder"),
                    F.col("value").alias("benchmark")))
    return (flags.join(conf, "run_id", "left")
            .select("run_id", "folder", "seeds", F.col("benchmark").alias("task"), "completed", "debug",
                    F.coalesce(F.col("folder").contains("validation"), F.lit(False)).alias("validation")))
