"""Column-level text functions (all JVM-side, codegen friendly).

Covers SURVEY SC1-SC4, SC7, SC9, SC10, PRJ2's strip and the ASCII form of SC6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TREC run-file escape tokens (must equal the reference's).
EMPTY_TOKEN = "[[:empty:]]"
SPACE_TOKEN = "[[:space:]]"
POUND_TOKEN = "[[:pound:]]"
TAB_TOKEN = "[[:tab:]]"
NO_RESULT_TOKEN = "[[:no_result:]]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trec_escape(c) -> Column:
    """SC1: empty -> [[:empty:]]; space, '#', tab -> tokens. Newlines are kept."""
    c = _c(c)
    escaped = F.replace(F.replace(F.replace(c, F.lit(" "), F.lit(SPACE_TOKEN)),
                                  F.lit("#"), F.lit(POUND_TOKEN)),
                        F.lit("\t"), F.lit(TAB_TOKEN))
    return F.when(c == F.lit(""), F.lit(EMPTY_TOKEN)).otherwise(escaped)


def trec_unescape(c) -> Column:
    """SC2: undo the space/pound/tab tokens (not [[:empty:]] nor [[:no_result:]])."""
    c = _c(c)
    return F.replace(F.replace(F.replace(c, F.lit(SPACE_TOKEN), F.lit(" ")),
                               F.lit(POUND_TOKEN), F.lit("#")),
                     F.lit(TAB_TOKEN), F.lit("\t"))


def xml_escape(c) -> Column:
    """SC7: escape & < > ('&' first)."""
    c = _c(c)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


# Unicode whitespace as Python's str.strip() sees it (\s in Java regex with
# UNICODE_CHARACTER_CLASS), used where the reference calls .strip().
# str.isspace() also covers the separators U+001C..U+001F.
_STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def py_strip(c) -> Column:
    """Python-style strip(): Spark's trim() only removes spaces."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def first_line(c) -> Column:
    """SC3 body: text before the first newline (no strip)."""
    return F.substring_index(_c(c), "\n", 1)


def first_csv_token(c) -> Column:
    """SC4 body: strip; quoted -> text up to the next quote ('' if unclosed);
    else the text before the first comma."""
    t = py_strip(c)
    return (F.when(t.startswith('"'), F.regexp_extract(t, r'^"([^"]*)"', 1))
            .otherwise(F.substring_index(t, ",", 1)))


def rank_score(pos0) -> Column:
    """SC10: score 2^-i for 0-based position i."""
    return F.pow(F.lit(2.0), -_c(pos0).cast("double"))


def keep_last(tokens, n) -> Column:
    """SC9: keep the last n elements of an array when it is longer than n."""
    tokens = _c(tokens)
    n = F.lit(n) if isinstance(n, int) else _c(n)
    # slice(x, 1, 0) is an empty array of the same element type
    return (F.when(F.size(tokens) > n,
                   F.when(n > 0, F.slice(tokens, -n, n)).otherwise(F.slice(tokens, 1, 0)))
            .otherwise(tokens))


# a zero-width split before every token that follows whitespace: each piece
# is one token with its trailing whitespace (plus a leading blank piece
# when the text starts with whitespace)
_TOKEN_PIECES = r"(?<=[ \t\n\r\f\x0B])(?=[^ \t\n\r\f\x0B])"


def keep_last_text(c, n) -> Column:
    """SC9 as text: the exact suffix of the text that starts at its n-th
    last whitespace token, when it has more than n tokens; else the text.
    Original spacing and newlines are kept (as decoding kept tokens would)."""
    c = _c(c)
    n = F.lit(n) if isinstance(n, int) else n
    pieces = F.split(c, _TOKEN_PIECES)
    n_tokens = F.size(F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda x: x != F.lit("")))
    return (F.when(n_tokens > n, F.when(n > 0, F.array_join(F.slice(pieces, -n, n), "")).otherwise(F.lit("")))
            .otherwise(c))


def json_string_ascii(c) -> Column:
    """JSON string literal of an ASCII value (quotes and backslashes escaped);
    NULL renders as NaN, as json.dumps does for pandas' missing cells."""
    c = _c(c)
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.isNull(), F.lit("NaN")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_list_ascii(arr) -> Column:
    """SC6 for ASCII data: '["a", "b"]' with ', ' separators."""
    arr = _c(arr)
    return F.concat(F.lit("["), F.array_join(F.transform(arr, json_string_ascii), ", "), F.lit("]"))
