"""The registered queries of this package and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and returns the digest columns derived from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefill.llm import bpe, collocations, decontam, htmltext, langid, minhash, passages, pii, prefixtrie, quality, tokenbin, topk, toxicity
from tablefill.llm.common import read_documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: the smallest id among its near-duplicates."""
    return minhash.duplicate_classes(read_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_report(read_documents(spark, sf_dir))


def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that documents share."""
    return passages.shared_passages(read_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base limits and weakly supervised verdict of every document."""
    return quality.judge(read_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.toxicity_scores(read_documents(spark, sf_dir), labels)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.page_texts(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.contaminated(read_documents(spark, sf_dir), items)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokenbin.token_files(read_documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.languages(read_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to."""
    return bpe.token_digests(read_documents(spark, sf_dir))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors with the greatest inner products, for one vector in fifty."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return prefixtrie.grafted_trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return collocations.collocations(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_pii, op3_shared_passages, op4_quality, op5_toxicity, op6_html_text, op7_decontamination, op8_token_files,
    op9_language, op10_byte_bpe, op11_topk, op12_prefix_trie, op13_collocations)}
ORACLE: dict[str, str] = {"op4_quality": quality.oracle_sql(), "op11_topk": topk.oracle_sql(),
                          "op12_prefix_trie": prefixtrie.oracle_sql(), "op13_collocations": collocations.oracle_sql()}
