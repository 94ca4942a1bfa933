"""Seed split, description, hold-out and qrels from split."""

from pyspark.sql import functions as F

from tablefill.operators.tables import describe, hold_out, qrels_from_split, split_seeds


def test_describe_golden(spark):
    df = spark.createDataFrame([("P", " P ", "Cap"), ("C", "", "Cap"), ("", " ", ""), ("　A\n", "B", "A")],
                               "a string, b string, c string")
    assert [r.d for r in df.select(describe("a", "b", "c").alias("d")).collect()] == [
        "P - Cap", "C - Cap", "", "A - B"]


def _tables(spark):
    return spark.createDataFrame([
        ("t1", "t1", "d", ["h0", "h1"], [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"]]),
        ("t2", "t2", "d", ["h0"], [["z"]]),
    ], "table_id string, query_id string, description string, headers array<string>, rows array<array<string>>")


def test_split_seeds_and_hold_out(spark):
    q = split_seeds(_tables(spark), 3)
    got = {r.query_id: r for r in q.collect()}
    assert got["t1"].seed_values == ["a", "b", "c"] and got["t1"].ground_truth == ["d"]
    assert got["t2"].seed_values == ["z"] and got["t2"].ground_truth == []
    h = {r.query_id: r for r in hold_out(q).collect()}
    assert h["t1"].target == "c" and h["t1"].seed_values == ["a", "b"] and h["t1"].seeds == 3
    assert h["t2"].target == "z" and h["t2"].seed_values == []
    qr = sorted((r.query_id, r.doc_id, r.relevance) for r in qrels_from_split(q).collect())
    assert qr == [("t1", "d", 1)]
