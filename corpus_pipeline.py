"""A training-data pipeline over ``documents``: each stage works on all rows
that the one before kept, is written as Parquet and read again.

Toxic documents go, one document of each group of near-duplicates stays, those
that hold benchmark items go, personal data is replaced in the texts of the
rest, and these are encoded. A table without rows passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefill.llm import bpe, decontam, minhash, pii, toxicity
from tablefill.llm.common import free_name
from tablefill.session import ensure_checkpoint_dir, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    ship_package(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.with_score(docs, model, "text", score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    ship_package(spark)
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    items = free_name(docs, "items")
    return decontam.with_matches(docs, _table(spark, sf_dir, "benchmark"), "text", items).where(F.size(items) == 0).drop(items)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in each text is replaced by its kind; no row goes."""
    ship_package(spark)
    return pii.with_redacted(docs, "text", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: per document its tokens and digests."""
    ship_package(spark)
    return bpe.token_digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("pii", redact), ("byte_bpe", encode)]

#: Fitted models, sketches and tokenizers: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
