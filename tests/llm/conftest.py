"""Small tables with the awkward rows that every operator must take."""

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     # names that operators use for their own columns
                     StructField("score", StringType()), StructField("node", StringType()), StructField("spans", StringType()),
                     StructField("kept", StringType()), StructField("words", StringType()),
                     StructField("_items_0", StringType()), StructField("_items", StringType()), StructField("items", StringType()),
                     StructField("_redacted", StringType()), StructField("redacted_text", StringType()), StructField("_kept_id", StringType()),
                     StructField("_toxicity", StringType()), StructField("toxicity", StringType()), StructField("matches_of_shard", StringType()),
                     StructField("class_id", StringType()), StructField("keeper", StringType())])


def rows(*pairs):
    return [(i, t, None if k % 3 == 0 else "en", None, None, "x", None, "y", None, "z", *"abcdefghijk") for k, (i, t) in enumerate(pairs)]


LONG = " ".join(f"word{k * 7919 % 100003}" for k in range(30_000))
AWKWARD = rows((1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, LONG), (None, "text without an id"),
               (6, "x" * 100_000), (7, "ü" * 3000 + " " * 5000 + "ü"), (8, "!!! ... 123"))


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark):
    def make(pairs):
        return spark.createDataFrame(rows(*pairs), SCHEMA)
    return make


@pytest.fixture(scope="session")
def collect():
    return lambda df: [Row(**r.asDict()) for r in df.collect()]
