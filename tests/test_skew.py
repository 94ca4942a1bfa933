"""Correctness and plan shape when one query holds a third of all rows."""

import pandas as pd
from pyspark.sql import functions as F

from tablefill.operators.evaluate import evaluate
from tablefill.operators.runs import ensemble


def _skewed_runs(spark):
    """Runs a/b (even/odd ids); the 'hot' query holds a third of all rows.
    Docs are unique within a (run, query) and shared by the two runs."""
    hot = spark.range(0, 6000).select(F.lit("hot").alias("query_id"), F.col("id"),
                                      (F.floor(F.col("id") / 2) + 1).alias("rank"))
    cold = spark.range(0, 12000).select(F.format_string("q%03d", F.floor(F.col("id") / 40)).alias("query_id"),
                                        F.col("id"), (F.floor((F.col("id") % 40) / 2) + 1).alias("rank"))
    rows = hot.unionByName(cold).withColumn("run_id", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    return rows.select("run_id", "query_id",
                       F.format_string("d%05d", F.floor(F.col("id") / 2)).alias("doc_id"),
                       F.col("rank").cast("int").alias("rank"),
                       ((F.col("id") * 31) % 97 / 97.0).alias("score"),
                       F.lit("t").alias("tag"))


def _brute(runs: pd.DataFrame, qrels: pd.DataFrame) -> dict:
    rel = {(r.query_id, r.doc_id): r.relevance for r in qrels.itertuples()}
    judged = set(qrels.query_id)
    out = {}
    for (run, q), g in runs.groupby(["run_id", "query_id"]):
        if q not in judged:
            continue
        top = g.sort_values(["score", "doc_id"], ascending=[False, False]).head(5)
        hits = [rel.get((q, d), 0) >= 1 for d in top.doc_id]
        out[(run, q, "success_1")] = float(any(hits[:1]))
        out[(run, q, "success_5")] = float(any(hits))
        out[(run, q, "P_5")] = sum(hits) / 5
    return out


def test_evaluate_with_a_hot_query(spark):
    runs = _skewed_runs(spark)
    qrels = runs.select("query_id", "doc_id").distinct().withColumn(
        "relevance", (F.length(F.regexp_replace("doc_id", "[^7]", "")) > 0).cast("int"))
    got = {(r.run_id, r.query_id, r.metric): r.score for r in evaluate(runs, qrels).collect()}
    assert got == _brute(runs.toPandas(), qrels.toPandas())
    plan = evaluate(runs, qrels)._jdf.queryExecution().executedPlan().toString()
    # the top-5 cut per (run, query) runs map-side, before the shuffle
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ensemble_with_a_hot_query(spark):
    """AQE's coalescing is off so the small hot group really spans several slices."""
    runs = _skewed_runs(spark)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        all_rows = sorted(ensemble(runs, ["a", "b"]).collect())
        slices = (runs.filter(F.col("query_id") == "hot").repartitionByRange("query_id", "doc_id")
                  .select(F.spark_partition_id().alias("p")).distinct().count())
    finally:
        spark.conf.set(key, "true")
    assert slices > 1
    plain = ensemble(runs, ["a", "b"])
    assert all_rows == sorted(plain.collect())
    fused = spark.createDataFrame(all_rows).filter(F.col("query_id") == "hot").toPandas()
    pdf = runs.filter(F.col("query_id") == "hot").toPandas()
    pdf["pos"] = pdf.run_id.map({"a": 0, "b": 1})
    agg = pdf.groupby("doc_id").agg(votes=("score", "size"), total=("score", "sum"),
                                    first=("pos", lambda s: 0)).reset_index()
    first = pdf.sort_values(["pos", "rank"]).groupby("doc_id").head(1).set_index("doc_id")
    agg["first"] = [(first.loc[d, "pos"], first.loc[d, "rank"]) for d in agg.doc_id]
    expected = sorted(agg.itertuples(), key=lambda r: (-r.votes, -r.total, r.first))
    assert list(fused.sort_values("rank").doc_id) == [r.doc_id for r in expected]


def test_fit_messages_hot_conversations_match(spark):
    """Conversations are range-sliced; results must not depend on the slices."""
    from conftest import SF01
    from tablefill.operators.budget import fit_messages
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    plain = sorted(fit_messages(conv, 200).collect())
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        sliced = sorted(fit_messages(conv, 200).collect())
    finally:
        spark.conf.set(key, "true")
    assert sliced == plain
    assert sum(r.kept for r in plain) > 0 and sum(not r.kept for r in plain) > 0


def test_running_within_matches_window(spark):
    from pyspark.sql import Window
    from tablefill.operators.ranking import running_within
    df = _skewed_runs(spark).select("query_id", "doc_id", "run_id", "rank")
    w = Window.partitionBy("query_id").orderBy("doc_id", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    expected = sorted(df.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("rank").over(w)).collect())
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = sorted(running_within(df, "query_id", [F.col("doc_id"), F.col("run_id")],
                                    {"c": F.lit(1).cast("long"), "s": F.col("rank").cast("long")}).collect())
    finally:
        spark.conf.set(key, "true")
    assert got == expected


def test_fit_messages_both_forms_agree(spark):
    from conftest import SF01
    from tablefill.operators.budget import fit_messages
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    for limit in (60, 200, 400):
        assert sorted(fit_messages(conv, limit, bounded=True).collect()) == sorted(fit_messages(conv, limit).collect())


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    """Not only the results: the rows of the hot query lie in several slices,
    none of which holds more than a fair share."""
    from tablefill.operators.ranking import _sliced
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = _skewed_runs(spark)
        sizes = {r._slice: r["count"] for r in _sliced(rows, "query_id", [F.col("doc_id"), F.col("run_id")])
                 .filter(F.col("query_id") == "hot").groupBy("_slice").count().collect()}
    finally:
        spark.conf.set(key, "true")
    assert len(sizes) >= 3 and max(sizes.values()) < 0.5 * sum(sizes.values())
    plan = ensemble(rows, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [query_id" not in plan
