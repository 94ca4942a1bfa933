"""Run ranking, escaping and ensemble goldens (FIXTURES C)."""

from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from tablefill.functions.text import trec_escape, trec_unescape
from tablefill.operators.runs import ensemble, to_run


def test_to_run_golden(spark):
    df = spark.createDataFrame([("q1", []), ("q2", ["a b", "", "a b", "c#"])],
                               "query_id string, suggestions array<string>")
    rows = sorted((r.query_id, r.doc_id, r.rank, r.score) for r in to_run(df, run_id="r").collect())
    assert rows == [("q1", "[[:no_result:]]", 1, 1.0),
                    ("q2", "[[:empty:]]", 2, 0.5),
                    ("q2", "a[[:space:]]b", 1, 1.0),
                    ("q2", "c[[:pound:]]", 4, 0.125)]


def _run(spark, run_id, docs):
    return spark.createDataFrame([(run_id, "q", d, i + 1, 2.0 ** -i, "t") for i, d in enumerate(docs)],
                                 "run_id string, query_id string, doc_id string, rank int, score double, tag string")


def test_ensemble_golden(spark):
    r1, r2, r3 = _run(spark, "r1", ["x", "y", "z"]), _run(spark, "r2", ["y", "w"]), _run(spark, "r3", ["q", "w"])
    two = ensemble(r1.unionByName(r2), ["r1", "r2"]).orderBy("rank").collect()
    assert [r.doc_id for r in two] == ["y", "x", "w", "z"]
    assert [r.score for r in two] == [1.0, 0.5, 0.25, 0.125]
    three = ensemble(r1.unionByName(r2).unionByName(r3), ["r1", "r2", "r3"]).orderBy("rank").collect()
    assert [r.doc_id for r in three] == ["y", "w", "x", "q", "z"]


def test_ensemble_of_one_keeps_order(spark):
    r1 = _run(spark, "r1", ["c", "a", "b", "d"])
    assert [r.doc_id for r in ensemble(r1, ["r1"]).orderBy("rank").collect()] == ["c", "a", "b", "d"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_characters="[", blacklist_categories=("Cs",)),
                        min_size=1, max_size=12), min_size=1, max_size=8))
def test_unescape_inverts_escape(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    back = [r.b for r in df.select(trec_unescape(trec_escape("v")).alias("b")).collect()]
    assert back == values


def test_escape_values(spark):
    df = spark.createDataFrame([("a b#\tc\n",), ("",)], "v string")
    assert [r.e for r in df.select(trec_escape("v").alias("e")).collect()] == [
        "a[[:space:]]b[[:pound:]][[:tab:]]c\n", "[[:empty:]]"]


def test_metric_properties(spark):
    import __spark_entry__ as entry
    from conftest import SF01
    m = entry.queries()["eval_per_query"](spark, SF01)
    wide = m.groupBy("run_id", "query_id").pivot("metric", ["success_1", "success_5", "P_5"]).agg(F.first("score"))
    for r in wide.collect():
        assert 0.0 <= r.P_5 <= r.success_5 <= 1.0
        assert r.success_1 <= r.success_5


def test_repeated_judgments_count_once(spark):
    from tablefill.operators.evaluate import evaluate
    run = _run(spark, "r", ["a", "b", "c"])
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "a", 1), ("q", "c", 0), ("q", "c", 1)],
                                  "query_id string, doc_id string, relevance int")
    got = {r.metric: r.score for r in evaluate(run, qrels).collect()}
    assert got == {"success_1": 1.0, "success_5": 1.0, "P_5": 0.4}


def test_to_run_skips_missing_values_and_keeps_gaps(spark):
    df = spark.createDataFrame([("q", ["a", None, "b", "a", None, "c"])], "query_id string, suggestions array<string>")
    rows = sorted((r.doc_id, r.rank) for r in to_run(df, run_id="r").collect())
    assert rows == [("a", 1), ("b", 3), ("c", 6)]


def test_to_run_keeps_first_occurrences(spark):
    lists = [("short", ["", "b c", "d#", None, "", "b c", "e"]), ("long", [f"x{i % 40}" for i in range(300)])]
    df = spark.createDataFrame(lists, "query_id string, suggestions array<string>")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in to_run(df, run_id="r").collect())
    assert got[-4:] == [("short", 1, "[[:empty:]]"), ("short", 2, "b[[:space:]]c"), ("short", 3, "d[[:pound:]]"), ("short", 7, "e")]
    assert got[:-4] == [("long", i + 1, f"x{i}") for i in range(40)]
