"""Byte-exact prompts on a hand-made query, XML round trip, unicode JSON."""

from pyspark.sql import functions as F

from tablefill.functions.jsonlist import json_list
from tablefill.plans.prompts import INSTRUCTION, render_chat, render_instruct


def _frames(spark):
    q = spark.createDataFrame([("q1", 2, "Rivers", ["River", "Len"], [["Nile", "1"], ["Rhine", "2"]])],
                              "query_id string, seeds int, description string, headers array<string>, "
                              "rows array<array<string>>")
    t = spark.createDataFrame([("e1", "A & B", ["City"], [["Rome"], ["Paris"], ["Zürich"]])],
                              "table_id string, description string, headers array<string>, rows array<array<string>>")
    ex = spark.createDataFrame([("q1", 1, "e1")], "query_id string, pos int, table_id string")
    return q, t, ex


def test_instruct_golden(spark):
    q, t, ex = _frames(spark)
    got = render_instruct(q, ex, t).first().prompt
    expected = (
        f"[INST] {INSTRUCTION}\n\nTable description:\nA & B\nAll table headers:\n[\"City\"]\n"
        "Header of column to expand:\nCity\nColumn:\n[\"Rome\", \"Paris\"] [/INST]\n[\"Z\\u00fcrich\"]\n"
        f"[INST] {INSTRUCTION}\n\nTable description:\nRivers\nAll table headers:\n[\"River\", \"Len\"]\n"
        "Header of column to expand:\nRiver\nColumn:\n[\"Nile\", \"Rhine\"] [/INST]\n[\"")
    assert got == expected
    zero = render_instruct(q, None, None).first().prompt
    assert zero == expected[expected.index("[INST]", 10):]


def test_chat_golden(spark):
    q, t, ex = _frames(spark)
    r = render_chat(q, ex, t)
    row = r.first()
    expected = (
        f"<messages>\n<system>{INSTRUCTION}</system>\n"
        "<user>Table description:\nTable description:\nA &amp; B\nAll table headers:\n[\"City\"]\n"
        "Header of column to expand:\nCity\nColumn:\n[\"Rome\", \"Paris\"]</user>\n"
        "<assistant>[\"Z\\u00fcrich\"]</assistant>\n"
        "\n<user>Table description:\nRivers\nAll table headers:\n[\"River\", \"Len\"]\n"
        "Header of column to expand:\nRiver\nColumn:\n[\"Nile\", \"Rhine\"]</user>\n</messages>")
    assert row.prompt == expected
    assert [m.role for m in row.messages] == ["system", "user", "assistant", "user"]
    assert row.messages[2].content == "[\"Z\\u00fcrich\"]" and row.messages[1].content.endswith("[\"Rome\", \"Paris\"]")
    zero = render_chat(q, None, None).first()
    assert zero.prompt.startswith(f"<messages>\n<system>{INSTRUCTION}</system>\n\n<user>")
    assert [m.role for m in zero.messages] == ["system", "user"]


def test_json_list_matches_python(spark):
    df = spark.createDataFrame([(["é", 'q"\\', "tab\t", None, "😀"],)], "a array<string>")
    import json
    assert df.select(json_list("a").alias("j")).first().j == json.dumps(["é", 'q"\\', "tab\t", float("nan"), "😀"])


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=6))
def test_json_list_equals_python_json(spark, values):
    import json
    df = spark.createDataFrame([(values,)], "a array<string>")
    expected = json.dumps([float("nan") if v is None else v for v in values])
    assert df.select(json_list("a").alias("j")).first().j == expected


def test_no_examples_equals_zero_shot(spark):
    from tablefill.operators.sampling import no_examples
    q, t, _ = _frames(spark)
    a = render_instruct(q, no_examples(q), t).first().prompt
    assert a == render_instruct(q, None, None).first().prompt


def test_user_template(spark):
    from tablefill.plans.prompts import render
    q, _, _ = _frames(spark)
    out = render(q, lambda df: F.concat(F.lit("Continue: "), F.array_join(F.transform("rows", lambda r: r[0]), "; ")))
    assert out.first().prompt == "Continue: Nile; Rhine"


def test_ascii_fast_path_equals_exact_path(spark):
    from conftest import SF001
    from tablefill.operators.sampling import sample_fixed
    from tablefill.operators.tables import split_seeds
    from tablefill.sources import derived
    q = split_seeds(derived.customer_tables(spark, SF001), 2)
    parts = derived.part_tables(spark, SF001)
    ex = sample_fixed(q, parts, k=2, seed=3)
    exact = {r.query_id: r.prompt for r in render_instruct(q, ex, parts).collect()}
    fast = {r.query_id: r.prompt for r in render_instruct(q, ex, parts, ascii_only=True).collect()}
    assert exact == fast and len(exact) > 0
