"""Stored example vectors: a table of embeddings by text digest.

The reference reads vectors of its example tables that were computed once and
saved beside them. Here they live in one parquet table, partitioned by the
encoder's name and keyed by the SHA-256 of the text, so equal texts share a
vector and a text that changed gets a new one. ``ensure_vectors`` embeds only
what an anti-join does not find, and writes that as one more partition folder
named after the job; a repeated or retried job finds its texts stored and adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SCHEMA = "digest string, embedding array<double>, model string, job string"


def text_digest(text: str | Column) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``(digest, embedding)`` stored for one encoder; empty where nothing is stored yet.

    Two jobs that ran at once may both have stored a digest: one of the equal rows is taken."""
    try:
        table = spark.read.schema(SCHEMA).parquet(path)
        table.schema  # a Connect session only now looks for the folder
    except Exception as error:  # noqa: BLE001 - only a missing path means an empty store
        if "PATH_NOT_FOUND" not in str(error):
            raise
        table = spark.createDataFrame([], SCHEMA)
    return table.filter(F.col("model") == model).select("digest", "embedding").dropDuplicates(["digest"])


def ensure_vectors(texts: DataFrame, path: str, model: str, embedder: Callable[[DataFrame, str, str], DataFrame],
                   text_col: str = "text") -> int:
    """Embed and store every distinct text that has no vector of this encoder
    yet; the number of texts embedded. ``embedder(df, text_col, id_col)`` is
    that of ``knn_examples``. Null texts count as the empty text."""
    spark = texts.sparkSession
    wanted = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", text_digest("text")).dropDuplicates(["digest"])
    # written once: the encoder must not run again for the count, nor see a table that this job changes
    missing = materialize(wanted.join(read_vectors(spark, path, model).select("digest"), "digest", "left_anti"))
    fresh = missing.count()
    if fresh:
        made = embedder(missing, "text", "digest")
        (made.select("digest", F.col("embedding").cast("array<double>").alias("embedding"))
         .write.parquet(f"{path.rstrip('/')}/model={model}/job={uuid.uuid4().hex}"))
    return fresh


def with_vectors(df: DataFrame, path: str, model: str, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with the stored vector of each row's text, null where there is none."""
    stored = read_vectors(df.sparkSession, path, model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = "_digest" if "_digest" not in df.columns else f"_digest_{uuid.uuid4().hex[:8]}"
    stored = stored.select(F.col("digest").alias(digest), F.col("embedding").alias(out))
    return df.withColumn(digest, text_digest(text)).join(stored, digest, "left").drop(digest)
