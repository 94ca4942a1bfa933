"""Table corpus reader: a folder tree of ``<stem>.csv`` + ``<stem>_meta.json``.

SURVEY SRC1, SRC2. Every CSV has its own header, so one ``spark.read.csv``
cannot read the corpus. Instead ``binaryFile`` lists (and, when asked,
loads) the files in parallel and a ``mapInPandas`` parses each file with
pandas — one file per row, all cells as strings, pandas' missing-value
rules (``NA``, ``null``, empty cell -> NULL), duplicate headers renamed
``Name.1``. The meta JSON files are read as whole texts and joined back on
the path stem.

A file is one table and one row, so it must fit in a task's memory (the
binary column caps a file at 2 GB); web-table corpora are many small files,
which Spark packs several to a task.
"""

from __future__ import annotations

import io
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import describe_meta
from ..session import spark_context

# The corpus file suffixes (a table and its meta data).
TABLE_GLOB = "*.csv"
META_SUFFIX = "_meta.json"

TABLE_SCHEMA = "path string, headers array<string>, rows array<array<string>>"


def _require_dir(spark: SparkSession, folder: str) -> None:
    if spark_context(spark) is None:  # Spark Connect: the scan reports a missing path itself
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"Path {folder} is not a directory.")


def list_table_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1: every ``*.csv`` below ``folder``: ``path, length, order``.

    ``order`` sorts like the reference's path sort — by path *component*
    (``a/...`` before ``a-b/...``), which an array comparison of the split
    path gives. Only file metadata is read (the content column is pruned).
    """
    _require_dir(spark, folder)
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", TABLE_GLOB)
             .load(folder)
             .select("path", "length"))
    return files.withColumn("parts", F.split(F.col("path"), "/"))


def _parse_csv_batches(batches):
    for pdf in batches:
        headers, rows = [], []
        for content in pdf["content"]:
            frame = pd.read_csv(io.BytesIO(bytes(content)), dtype=str)
            headers.append([str(c) for c in frame.columns])
            values = frame.astype(object).where(frame.notna(), None).values.tolist()
            rows.append(values)
        yield pd.DataFrame({"path": pdf["path"], "headers": headers, "rows": rows})


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """SRC2: the ``tables`` frame — ``table_id, path, query_id, description,
    headers, rows, meta, parts`` (``parts`` orders the corpus like SRC1)."""
    _require_dir(spark, folder)
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", TABLE_GLOB)
           .load(folder)
           .select("path", "content"))
    parsed = raw.mapInPandas(_parse_csv_batches, TABLE_SCHEMA)
    # wholetext must be the keyword: text()'s own default would override an option
    meta = (spark.read
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*" + META_SUFFIX)
            .text(folder, wholetext=True)
            .select(F.regexp_replace(F.col("_metadata.file_path"), re.escape(META_SUFFIX) + "$", "").alias("stem"),
                    F.from_json("value", "map<string,string>").alias("meta")))
    stem = F.regexp_replace(F.col("path"), r"\.csv$", "")
    t = parsed.withColumn("stem", stem).join(meta, "stem", "left")
    # a table without its meta file has no id to be judged by
    missing = F.raise_error(F.concat(F.lit("no meta file with a queryId for "), F.col("path")))
    return t.select(
        F.regexp_extract("stem", r"([^/]+)$", 1).alias("table_id"),
        "path",
        F.coalesce(F.col("meta")["queryId"], missing.cast("string")).alias("query_id"),
        describe_meta("meta").alias("description"),
        "headers", "rows", "meta",
        F.split(F.col("path"), "/").alias("parts"))
