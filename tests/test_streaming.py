"""Micro-batch run logging over a folder of completions."""

import os

from tablefill.streaming.runlog import stream_runs


def test_stream_runs(spark, scratch):
    src = os.path.join(scratch, "completions")
    spark.createDataFrame([("q1", 'a", "b"]'), ("q2", "")], "query_id string, completion string") \
        .write.parquet(src)
    q = stream_runs(spark, src, os.path.join(scratch, "runs"), os.path.join(scratch, "ckpt"), run_id="live")
    q.awaitTermination(120)
    got = sorted((r.query_id, r.doc_id, r.rank) for r in spark.read.parquet(os.path.join(scratch, "runs")).collect())
    # an empty completion with the lead is the single item ["
    assert got == [("q1", "a", 1), ("q1", "b", 2), ("q2", "[\"", 1)]
