"""Table-level projections: seed split, description, hold-out, qrels from split.

SURVEY PRJ1, PRJ2, PRJ4, EV3. All narrow (row-local) transformations: a
table is one row, its cells an array, so none of these shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, trec_escape


def rest_after(arr: Column, n: Column) -> Column:
    """Elements after the first n. The length is the array's size: a huge
    constant length overflows ``start + length`` when Spark evaluates
    ``slice`` inside a lambda (it then returns an empty array)."""
    return F.slice(arr, n + 1, F.greatest(F.size(arr), F.lit(0)))


def subject(rows) -> Column:
    """Column 0 of every row (the subject column)."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.transform(rows, lambda r: r[0])


def describe(*parts) -> Column:
    """PRJ2: strip each part, drop blanks, keep first occurrences, join ' - '."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    stripped = F.transform(F.array(*cols), lambda x: py_strip(x))
    kept = F.filter(stripped, lambda x: x.isNotNull() & (x != F.lit("")))
    return F.array_join(F.array_distinct(kept), " - ")


def describe_meta(meta="meta") -> Column:
    """PRJ2 over a meta map with keys pgTitle, secondTitle, caption."""
    m = F.col(meta) if isinstance(meta, str) else meta
    return describe(m["pgTitle"], m["secondTitle"], m["caption"])


def split_seeds(tables: DataFrame, seeds) -> DataFrame:
    """PRJ1: keep the first ``seeds`` rows; column 0 of the rest is the ground truth.

    ``seeds`` is an int or a Column (e.g. after a cross join with 1..5).
    Tables with <= seeds rows keep all rows and get an empty ground truth.
    Adds ``seeds``, ``seed_values`` and ``ground_truth``; ``rows`` is cut.
    """
    n = F.lit(seeds) if isinstance(seeds, int) else seeds
    subj = subject("rows")
    return (tables
            .withColumn("seeds", n.cast("int"))
            .withColumn("ground_truth", rest_after(subj, F.col("seeds")))
            .withColumn("rows", F.slice("rows", 1, F.col("seeds")))
            .withColumn("seed_values", subject("rows")))


def hold_out(queries: DataFrame) -> DataFrame:
    """PRJ4: drop the last seed row; its subject is the target.

    ``seeds`` is deliberately *not* reduced (the reference shares the query's
    meta data, so examples are still split at the old N).
    """
    size = F.size("rows")
    return (queries
            .withColumn("target", F.element_at(F.col("seed_values"), -1))
            .withColumn("rows", F.slice("rows", 1, F.greatest(size - 1, F.lit(0))))
            .withColumn("seed_values", subject("rows")))


def qrels_from_split(queries: DataFrame) -> DataFrame:
    """EV3: qrels from the split's own ground truth (escaped, relevance 1)."""
    return (queries
            .select("query_id", F.explode("ground_truth").alias("value"))
            .filter(F.col("value").isNotNull())
            .select("query_id", F.lit("0").alias("iter"),
                    trec_escape("value").alias("doc_id"), F.lit(1).alias("relevance"))
            .dropDuplicates(["query_id", "doc_id"]))
