"""Runs: ranked suggestion lists in TREC form, and their fusion.

SURVEY RK1 (to_run), AG1 + SET1 (ensemble), JN7 (ensemble_eligible),
PRJ5 (side_by_side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_RESULT_TOKEN, rank_score, trec_escape, trec_unescape
from .ranking import rank_within


def to_run(suggestions: DataFrame, run_id: str | None = None, tag: str = "trec",
           list_col: str = "suggestions", drop_no_result: bool = False) -> DataFrame:
    """RK1: one row per kept suggestion.

    Position i (0-based) gives rank i+1 and score 2^-i, assigned *before*
    dedupe: a repeated escaped value is skipped, so ranks may have gaps. An
    empty list becomes ``[[:no_result:]]`` at rank 1. Dedupe happens inside
    the array (one query's list is one row), so this is a narrow
    transformation — no shuffle.
    """
    lst = F.col(list_col)
    if drop_no_result:
        filled = F.coalesce(lst, F.array().cast("array<string>"))
    else:
        filled = F.when(lst.isNull() | (F.size(lst) == 0),
                        F.array(F.lit(NO_RESULT_TOKEN))).otherwise(lst)
    escaped = F.transform(filled, lambda x: trec_escape(x))
    run_col = F.lit(run_id) if run_id is not None else F.col("run_id")
    # escape once; every step below reads the staged column
    esc = F.col("_escaped")
    # a missing value is no suggestion
    present = F.filter(F.transform(esc, lambda x, i: F.struct(x.alias("doc_id"), i.alias("pos"))),
                       lambda s: s["doc_id"].isNotNull())
    # O(n log n): sort (value, position), keep an entry when its sorted
    # neighbour holds another value. The sorted array is bound to a column
    # first: a lambda referring to the sorting expression itself would
    # re-sort it for every element.
    staged = (suggestions
              .select(run_col.alias("run_id"), "query_id", escaped.alias("_escaped"))
              .select("run_id", "query_id", F.array_sort(present).alias("_by_value")))
    by_value = F.col("_by_value")
    kept = F.filter(by_value, lambda s, j: (j == 0)
                    | (F.element_at(by_value, j)["doc_id"] != s["doc_id"]))
    return (staged
            .select("run_id", "query_id", F.explode(kept).alias("s"))
            .select("run_id", "query_id", F.col("s.doc_id").alias("doc_id"),
                    (F.col("s.pos") + 1).cast("int").alias("rank"),
                    rank_score("s.pos").alias("score"),
                    F.lit(tag).alias("tag")))


def ensemble(runs: DataFrame, members: Sequence[str] | DataFrame | None = None,
             tag: str = "ensemble", run_id: str = "ensemble") -> DataFrame:
    """AG1: fuse runs by votes.

    Per (query, doc): votes = number of member runs listing it, total = sum
    of their scores. Order by (votes desc, total desc); ties keep first-seen
    order (member order, then rank within the member). New rank 1.., score
    2^-(rank-1).

    ``members`` gives the member order (list of run ids, or a frame
    ``run_id, run_pos``); default: run_id order. The aggregate is shuffled on
    (query, doc) and the ranking on ranges of its order (``rank_within``), so
    a query of any size spreads over many tasks. A total adds the members'
    scores in member order, whatever the partitioning.
    """
    if members is None:
        member_df = runs.select("run_id").distinct().withColumn(
            "run_pos", F.dense_rank().over(Window.orderBy("run_id")))
    elif isinstance(members, DataFrame):
        member_df = members.select("run_id", "run_pos")
    else:
        spark = runs.sparkSession
        member_df = spark.createDataFrame([(m, i) for i, m in enumerate(members)],
                                          "run_id string, run_pos int")
    # the member list has one row per fused run: tiny and bounded by the caller
    r = runs.join(F.broadcast(member_df), "run_id")
    scores = F.array_sort(F.collect_list(F.struct("run_pos", "score")))  # at most one per member
    fused = (r.groupBy("query_id", "doc_id")
             .agg(F.count(F.lit(1)).alias("votes"),
                  F.aggregate(scores, F.lit(0.0), lambda t, s: t + s["score"]).alias("total"),
                  # (member position, rank) packed into one long
                  F.min(F.col("run_pos").cast("long") * F.lit(1 << 32) + F.col("rank").cast("long"))
                  .alias("first_seen")))
    ranked = rank_within(fused, "query_id", [F.col("votes").desc(), F.col("total").desc(), F.col("first_seen")],
                         out="new_rank")
    return ranked.select(F.lit(run_id).alias("run_id"), "query_id", "doc_id",
                         F.col("new_rank").cast("int").alias("rank"),
                         rank_score(F.col("new_rank") - 1).alias("score"),
                         F.lit(tag).alias("tag"))


def ensemble_eligible(run_meta: DataFrame, members: DataFrame) -> DataFrame:
    """JN7: keep member runs whose benchmark equals the first member's.

    ``members``: ``run_id, run_pos``. The benchmark key is (folder, seeds);
    the reference compares the raw config text, which holds exactly those.
    Returns ``run_id, run_pos, eligible``.
    """
    m = members.join(run_meta.select("run_id", "folder", "seeds"), "run_id")
    first = (m.groupBy().agg(F.min_by(F.struct("folder", "seeds"), F.col("run_pos")).alias("b")))
    return (m.crossJoin(F.broadcast(first))  # one-row frame
            .select("run_id", "run_pos",
                    ((F.col("folder") == F.col("b.folder")) & (F.col("seeds") == F.col("b.seeds")))
                    .alias("eligible")))


def side_by_side(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """PRJ5 set-wise: per (run, query) the results by score descending and
    the ground truth by relevance descending, both unescaped, as rows
    ``run_id, query_id, side, pos, value`` (a list per query would grow with
    the query). ``side`` is 'result' or 'truth'; the truth of a query stands
    once, with a null run. Queries without results are left out.

    Ties: results by rank, ground truth by doc id (the reference keeps file
    order, which is not visible in a frame)."""
    key = F.concat_ws("\u0001", "run_id", "query_id")
    res = rank_within(runs.select("run_id", "query_id", "doc_id", "score", F.col("rank").alias("_r"), key.alias("_key")),
                      "_key", [F.col("score").desc(), F.col("_r"), F.col("doc_id")], out="pos")
    gt = rank_within(qrels.select("query_id", "doc_id", "relevance").join(
        runs.select("query_id").distinct(), "query_id", "left_semi"),
        "query_id", [F.col("relevance").desc(), F.col("doc_id")], out="pos")
    value = trec_unescape(F.col("doc_id")).alias("value")
    return (res.select("run_id", "query_id", F.lit("result").alias("side"), "pos", value)
            .unionByName(gt.select(F.lit(None).cast("string").alias("run_id"), "query_id", F.lit("truth").alias("side"),
                                   "pos", value)))
