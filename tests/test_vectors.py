"""Stored vectors: what is embedded, when, and what readers get."""

from tablefill.operators.infer import embed_hash
from tablefill.sources.vectors import ensure_vectors, read_vectors, with_vectors


def embedder(df, text, key):
    return embed_hash(df, text, key, dim=16, float32=False)


def test_a_second_run_embeds_nothing(spark, scratch):
    path = f"{scratch}/vectors"
    texts = spark.createDataFrame([("a", "red green"), ("b", "green red"), ("c", "red green"), ("d", None), ("e", "")], "id string, text string")
    assert read_vectors(spark, path, "hash16").count() == 0
    assert ensure_vectors(texts, path, "hash16", embedder) == 3
    assert ensure_vectors(texts, path, "hash16", embedder) == 0
    more = texts.unionByName(spark.createDataFrame([("f", "blue"), ("g", "blue")], "id string, text string"))
    assert ensure_vectors(more, path, "hash16", embedder) == 1
    assert ensure_vectors(more, path, "other", embedder) == 4  # each encoder has its own
    got = {r.id: r.embedding for r in with_vectors(more, path, "hash16").collect()}
    want = {r.id: r.embedding for r in embedder(more.fillna("", ["text"]), "text", "id").collect()}
    assert got == want


def test_texts_without_a_vector_and_clashing_names(spark, scratch):
    path = f"{scratch}/vectors"
    ensure_vectors(spark.createDataFrame([("x",)], "text string"), path, "m", embedder)
    df = spark.createDataFrame([("x", 1, 2), ("new", 3, 4)], "text string, _digest int, digest int")
    got = {r.text: r for r in with_vectors(df, path, "m", out="vector").collect()}
    assert len(got["x"].vector) == 16 and got["new"].vector is None
    assert (got["x"]._digest, got["x"].digest) == (1, 2)


def test_a_lost_job_is_repeated(spark, scratch):
    """A job that fails while it writes leaves nothing that readers see."""
    path = f"{scratch}/vectors"
    texts = spark.createDataFrame([("x",), ("y",)], "text string")

    def broken(df, text, key):
        from pyspark.sql import functions as F
        return embedder(df, text, key).withColumn("embedding", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("embedding")))

    try:
        ensure_vectors(texts, path, "m", broken)
        raise AssertionError("the encoder must fail")
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert read_vectors(spark, path, "m").count() == 0
    assert ensure_vectors(texts, path, "m", embedder) == 2
    assert read_vectors(spark, path, "m").count() == 2
