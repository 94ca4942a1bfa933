"""Scale properties of the registered plans, read from the physical plans:
no pair-emitting joins where the design forbids them, top-k before the
shuffle, and scans that read only the columns a query needs."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF001

QUERIES = entry.queries()


def _plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_topk", "knn_tutor", "sample_per_query", "pick_first_hit",
                                  "ensemble_vote", "eval_all", "suggest_end_to_end"])
def test_no_pairs_of_data_rows(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    # nested-loop joins are only allowed against broadcast frames of bounded size
    # (k-row samples, config grids); none of these queries needs one over data rows
    if name in ("knn_topk", "knn_tutor", "sample_per_query", "ensemble_vote", "eval_all"):
        assert "BroadcastNestedLoopJoin" not in plan


def test_knn_reduces_inside_blocks(spark):
    plan = _plan(spark, "knn_topk")
    assert "FlatMapCoGroupsInPandas" in plan  # per-block top-k in the cogroup


def test_scans_read_only_needed_columns(spark):
    for name, table, most in [("trec_escape", "documents", 2), ("chat_token_count", "conversations", 3),
                              ("eval_all", "customer", 4), ("knn_topk", "embeddings", 2)]:
        plan = _plan(spark, name)
        widths = [len(m.group(1).split(",")) for m in re.finditer(r"FileScan parquet \[([^\]]*)\]", plan)
                  if f"{table}.parquet" in plan[m.start():m.start() + 600]]
        assert widths and max(widths) <= most, (name, widths)


def test_no_python_in_prompt_rendering(spark):
    plan = _plan(spark, "render_few_shot")
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
