"""List extraction goldens (FIXTURES C) and the other extractors."""

import pytest
from pyspark.sql import functions as F

from tablefill.functions.listparse import extract_list, extract_list_py
from tablefill.operators.extract import extract_csv_token, extract_first_line

CASES = [
    ("", "", []),
    ("", "  \n", []),
    ("", "Rome", ["Rome"]),
    ("", '["a", "b"]', ["a", "b"]),
    ('["', 'a", "b"]', ["a", "b"]),
    ('["', 'a", "b", "c', ["a", "b"]),
    ("", "['a', 'b']", ["a", "b"]),
    ("", "[]", []),
    ("", "[", ["["]),
    ("", '["a", "b"]\nHope this helps', ["a", "b"]),
    ("", "[1, 2.50, True]", ["1", "2.5", "True"]),
    ("", '["a", null]', ["a"]),
    ("", '["a", None]', ["a", "None"]),
    ("", '["a" "b"]', ["ab"]),
    ("", '["a", ["b", 1]]', ["a", "['b', 1]"]),
    ("", '["a"], ["b"]', ["['a']", "['b']"]),
    ("", '["a", "b",]', ["a", "b"]),
    ("", '["O\\"Hara"]', ['O"Hara']),
    ("", '["a", "a"]', ["a", "a"]),
    ("", "[null]", ["[null]"]),
    ("", '["a", "b"', ["a"]),
    ("", '["a"', ['["a"']),
    ("", '["a", "b",', ["a", "b"]),
    ("", "[1, 23", ["1", "2"]),
    ("", '["a"]]', ["a"]),
]


@pytest.mark.parametrize("lead,text,expected", CASES)
def test_extract_list_golden(lead, text, expected):
    assert extract_list_py(text, lead) == expected


def test_extract_list_udf_matches_python(spark):
    rows = [(i, lead, text) for i, (lead, text, _) in enumerate(CASES) if lead == ""]
    df = spark.createDataFrame(rows, "i int, lead string, text string")
    got = {r.i: r.s for r in df.select("i", extract_list("text").alias("s")).collect()}
    for i, _, text in rows:
        assert got[i] == extract_list_py(text), text
    lead_df = spark.createDataFrame([(0, 'a", "b", "c')], "i int, text string")
    assert lead_df.select(extract_list("text", '["').alias("s")).first().s == ["a", "b"]


def test_first_line_and_csv_token(spark):
    df = spark.createDataFrame([
        ("a, b\nc",), ('  "x, y" , z',), ('"unclosed, q',), (" plain ",), ("",)], "t string")
    out = df.select(extract_first_line("t")[0].alias("fl"), extract_csv_token("t")[0].alias("tok")).collect()
    assert [r.fl for r in out] == ["a, b", '  "x, y" , z', '"unclosed, q', " plain ", ""]
    assert [r.tok for r in out] == ["a", "x, y", "", "plain", ""]


@pytest.mark.parametrize("text", ['["a", null, ' + '"bbbb", ' * 12_500, "[" + "null, " * 16_000, "[" * 100_000, "[" + "1 " * 50_000,
                                  '["' + "x" * 100_000])
def test_long_broken_answers_are_repaired_in_one_scan(text):
    import time
    start = time.process_time()
    extract_list_py(text)
    assert time.process_time() - start < 0.5  # a parse per cut character took minutes


@pytest.mark.parametrize(("text", "items"), [
    ('["a", "b", tru', ["a", "b"]), ("[1, 2], [3, 4", ["[1, 2]", "[3]"]), ('["a" "b" null]', ["ab"]), ("[12abc]", ["12"]),
    ('[{"a": 1}, {"b": ', ["{'a': 1}"]), ('["x\\"y", "z', ['x"y']), ("[", ["["]), ("[]x", ["[]x"])])
def test_repaired_lists(text, items):
    assert extract_list_py(text) == items


def plain_rule(text):
    """Every proper prefix, longest first; only for short texts."""
    import warnings
    from ast import literal_eval
    errors = (SyntaxError, ValueError, TypeError, MemoryError, RecursionError)
    text = text.strip()
    if not text.startswith("["):
        return [text] if text else []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for end in range(len(text), 0, -1):
            try:
                found = literal_eval(text if end == len(text) else text[:end] + "]")
                if end == len(text) or len(found):
                    return [str(x) for x in found]
            except errors:
                pass
    return [text]


PIECES = ["[", "]", "(", ")", "{", "}", ",", ",", ",", ",", ":", "'a'", '"b"', "'", '"', '"""', "'''", "b'", "r'", "rb'", "u'", "f'", "\\", "\\x",
          "\\x)", "\\n", "\n", "\r", "\r\n", " ", "\t", "\f", "#", "#:", "1", "0", "12", "0x1f", "0xg", "1.5", ".", "...", "e", "j", "1e5", "2j",
          "+", "-", "_", "None", "True", "False", "null", "set()", "set (", "zz", "é", "=", "a", "\\\n", "0b1", "0o7", "1_0", "007"]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.filterwarnings("ignore")
def test_random_broken_lists_follow_the_plain_rule(seed):
    import random
    rng = random.Random(seed)
    for _ in range(8000):
        text = rng.choice(["[", "[", '["a", ', '["a"], [']) + "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        assert extract_list_py(text) == plain_rule(text), text


@pytest.mark.parametrize("text", ["[" + " " * 100 + "True zz", "[1," + " " * 90 + "None zz", "[0x" + "f" * 100 + "zz", "[1" + "0" * 5000 + " z",
                                  '["""\\x)"""-', "['b'#:None,\n'b'-{", "[], #\n)", "[1], [12abc"])
@pytest.mark.filterwarnings("ignore")
def test_values_of_any_length_and_comments(text):
    assert extract_list_py(text) == plain_rule(text)
