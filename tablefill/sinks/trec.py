"""Run, metadata and completion sinks.

Layout under a runs root::

    <root>/<run_id>/trec.log/part-*     TREC lines, one file per task
    <root>/_run_meta/run=<run_id>/      one row per finished run

Rows are written by the executors (no single writer); a finished run that
already exists is an error, as in the reference. The meta row, one per run id, is
published only after the run's rows have committed, which plays the role of the
reference's keep.flag.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trec import RUN_FILE

# The TREC run line's constant second column.
TREC_Q0 = "Q0"

META_SCHEMA = ("run_id string, folder string, seeds int, task string, members string, "
               "completed boolean, debug boolean")


def trec_lines(runs: DataFrame) -> DataFrame:
    """``query_id Q0 doc_id rank score tag``, tab separated. A newline in a
    doc id would break the file, so it raises instead."""
    line = F.concat_ws("\t", "query_id", F.lit(TREC_Q0), "doc_id", F.col("rank").cast("string"),
                       F.col("score").cast("string"), "tag")
    bad = F.col("doc_id").contains("\n") | F.col("doc_id").contains("\r")
    return runs.select(F.when(bad, F.raise_error(F.concat(F.lit("newline in doc id: "), F.col("doc_id"))))
                       .otherwise(line).alias("value"))


def is_finished(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether a run's meta row has been published."""
    try:
        return not spark.read.parquet(f"{root.rstrip('/')}/_run_meta").filter(F.col("run_id") == run_id).isEmpty()
    except Exception as error:  # noqa: BLE001 - only a missing path means no run yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False


def publish_meta(spark: SparkSession, root: str, row: tuple) -> None:
    """One meta row a run: a partition of its own, replaced as a whole, so
    that publishing twice leaves one row."""
    meta = spark.createDataFrame([row], META_SCHEMA).withColumn("run", F.col("run_id"))
    (meta.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run")
     .parquet(f"{root.rstrip('/')}/_run_meta"))


def write_run(runs: DataFrame, root: str, run_id: str, folder: str, seeds: int,
              task: dict | None = None, members: list[str] | None = None, debug: bool = False) -> None:
    """SNK1 + SNK3 + SNK5: write one run and then publish its meta row.

    A finished run is never written again: it raises ``FileExistsError``. Rows
    without a meta row are those of a job that was lost between the two; readers of
    the metadata do not see them, and a repeated job replaces them."""
    root = root.rstrip("/")
    spark = runs.sparkSession
    if is_finished(spark, root, run_id):
        raise FileExistsError(f"run {run_id} already exists under {root}")
    ordered = runs.filter(F.col("run_id") == run_id) if "run_id" in runs.columns else runs
    ordered = ordered.sortWithinPartitions("query_id", "rank")
    trec_lines(ordered).write.mode("overwrite").text(f"{root}/{run_id}/{RUN_FILE}")
    publish_meta(spark, root, (run_id, folder, int(seeds), json.dumps(task or {}, sort_keys=True),
                               json.dumps(members) if members else None, True, bool(debug)))


def write_completions(completions: DataFrame, path: str) -> None:
    """SNK2 + SNK4: completions (with positive ``seconds``) as parquet."""
    completions.write.mode("errorifexists").parquet(path)
