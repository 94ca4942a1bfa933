"""Scoring runs against qrels: success@k and P@k, as trec_eval computes them.

SURVEY EV1 (RK2 + SET3 + JN5 + AG2/AG3 + AG4/AG5), EV2, PRJ7, AG10, AG11.
Many runs are scored in one plan: ``run_id`` is just a group key.

Plan shape: the per-query top-k cut (``row_number() <= max k`` over
``run_id, query_id``) runs as a partial WindowGroupLimit before its shuffle,
so even a query holding a large share of the rows ships at most k rows per
map partition. The relevance lookup joins on (query_id, doc_id) — both
keys, so a hot query's judgments still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# trec_eval's measure names in report order, and the report
# line's pieces (run name right-aligned in 19, query count in 4, one-decimal
# percentages, the two marks).
METRICS_ORDER = ("success_1", "success_5", "P_5")
REPORT_RUN = "name=%19s, seeds=%d, "
REPORT_QUERIES = "queries=%4d"
REPORT_METRIC = ", {}="
REPORT_PERCENT = "%d.%d%%"
DEBUG_MARK = " (debug)"
VALIDATION_MARK = " (validation)"


def _metric_names(success: Sequence[int], precision: Sequence[int]) -> list[tuple[str, str, int]]:
    return ([(f"success_{k}", "success", k) for k in success]
            + [(f"P_{k}", "P", k) for k in precision])


def evaluate(runs: DataFrame, qrels: DataFrame, success: Sequence[int] = (1, 5),
             precision: Sequence[int] = (5,), relevance_level: int = 1) -> DataFrame:
    """Per-query metrics: ``run_id, query_id, metric, score``.

    * only queries present in both the run and the qrels are scored (SET3);
    * docs are ordered by score desc, ties by doc id *descending*; the
      ``rank`` column is ignored (RK2);
    * a doc is relevant when its judgment >= relevance_level (JN5);
    * success@k = 1 if a relevant doc is in the top k; P@k = relevant in
      top k / k, even when fewer than k docs were returned (AG2, AG3).
    """
    kmax = max(list(success) + list(precision))
    judged = qrels.select("query_id").distinct()
    w = Window.partitionBy("run_id", "query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    top = (runs.select("run_id", "query_id", "doc_id", "score")
           .withColumn("pos", F.row_number().over(w))
           .filter(F.col("pos") <= kmax)
           .join(judged, "query_id", "left_semi"))
    # one judgment per (query, doc): a repeated line must not count twice;
    # the aggregate is partitioned like the join, so it adds no shuffle
    rel = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("rel"))
    joined = top.join(rel, ["query_id", "doc_id"], "left")
    hit = F.coalesce(F.col("rel"), F.lit(0)) >= relevance_level
    aggs = []
    for name, kind, k in _metric_names(success, precision):
        in_k = hit & (F.col("pos") <= k)
        if kind == "success":
            aggs.append(F.max(F.when(in_k, 1.0).otherwise(0.0)).alias(name))
        else:
            aggs.append((F.sum(F.when(in_k, 1.0).otherwise(0.0)) / F.lit(float(k))).alias(name))
    per_query = joined.groupBy("run_id", "query_id").agg(*aggs)
    names = [n for n, _, _ in _metric_names(success, precision)]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names]))
    return per_query.select("run_id", "query_id", stacked.alias("m")).select(
        "run_id", "query_id", "m.metric", F.col("m.score").cast("double").alias("score"))


def summarize(metrics: DataFrame, decimals: int = 4) -> DataFrame:
    """AG4/AG5: the ``all`` rows — per (run, metric) the mean over queries
    (rounded as trec_eval prints it) and the number of scored queries.

    ``evaluate`` emits one row per (run, query, metric), so a plain count is
    the number of queries (a distinct count would add an aggregation step)."""
    return (metrics.groupBy("run_id", "metric")
            .agg(F.round(F.avg("score"), decimals).alias("score"),
                 F.count(F.lit(1)).cast("long").alias("queries")))


def covered_queries(metrics: DataFrame) -> DataFrame:
    """PRJ7: per metric, the queries with score > 0 — as rows
    ``run_id, metric, query_id`` (a per-metric list would gather every
    query of a run into one task)."""
    return (metrics.filter(F.col("score") > 0)
            .select("run_id", "metric", "query_id").distinct())


def leaderboard(summary: DataFrame, run_meta: DataFrame | None = None) -> DataFrame:
    """AG10: one row per run — queries, success_1, success_5, P_5 — and the
    report line ``[name=…, seeds=…, ]queries=…, success_1=…%, success_5=…%,
    P_5=…%`` with the (debug)/(validation) marks (name and seeds need
    ``run_meta``). Metrics are in the reference's order (by
    first letter, descending)."""
    # one conditional aggregate: the evaluation below it runs once
    wide = summary.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in METRICS_ORDER],
        F.max("queries").alias("queries"))

    def pct(c):
        # one-decimal percent from integer tenths: the same digits on every
        # engine (printf-style rounding differs between Java and C on ties)
        tenths = F.floor(F.col(c) * 1000.0 + 0.5).cast("long")
        return F.format_string(REPORT_PERCENT, F.floor(tenths / 10).cast("long"), F.pmod(tenths, F.lit(10)))
    line = F.concat(F.format_string(REPORT_QUERIES, F.col("queries")),
                    *[F.concat(F.lit(REPORT_METRIC.format(m)), pct(m)) for m in METRICS_ORDER])
    if run_meta is not None:
        wide = wide.join(run_meta.select("run_id", "seeds", "debug", "validation"), "run_id", "left")
        line = F.concat(F.format_string(REPORT_RUN, F.col("run_id"), F.col("seeds")), line,
                        F.when(F.col("debug"), F.lit(DEBUG_MARK)).otherwise(F.lit("")),
                        F.when(F.col("validation"), F.lit(VALIDATION_MARK)).otherwise(F.lit("")))
    return wide.withColumn("report", line)


def best_config(summary_wide: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """AG11: per group, the run with the best (success_1, success_5, P_5),
    ties to the smallest run id (the offline-optimisation step)."""
    w = Window.partitionBy(*by).orderBy(F.col("success_1").desc(), F.col("success_5").desc(),
                                        F.col("P_5").desc(), F.col("run_id"))
    return (summary_wide.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") == 1).drop("_r"))
