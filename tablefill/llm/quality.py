"""Quality by weak supervision, in DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0) on counts of each text. How often
a rule is right is unknown, so expectation-maximisation estimates it from how
the rules agree: given each rule's accuracy on good and on bad texts, a vote
pattern has a posterior probability of good; given posteriors, an accuracy is
the share of a rule's votes that they confirm. A text is kept if the base
limits hold and its posterior is at least ``MIN_POSTERIOR``: one failed rule
is not enough to lose it, and a rule that fires on good texts loses weight.

The accuracies are those among texts within the base limits, since only those
get a verdict; all of them count. The counts are written once; EM then reads
vote patterns with their numbers of documents (3 ** rules rows at most,
whatever the input). Row-local arrays are as long as one text's words.

Null and empty texts have no words and fail the base limits. Repeated rows
are judged alike and each counts in the statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefill.llm.common import stored

STEPS = 15              # EM iterations
SHARE = 0.8             # to begin with: share of good texts,
ON_GOOD, ON_BAD = 0.97, 0.3  # accuracy of votes on good and on bad texts
PRIOR = 10.0            # votes added to each rule, split by these
GOOD_LIMITS, BAD_LIMITS = (0.9, 0.999), (0.02, 0.99)  # a rule may miss bad texts, but seldom fails good ones
MIN_POSTERIOR = 0.5
FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SIGN = r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\x22()-]"
_LINE_END = r"[.!?:'\x22)][\x20\x09-\x0D]*$"
_UPPER = r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]"

#: name, condition of a good vote, condition of a bad vote (SQL over the counts)
RULES = [
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("repetition", "100 * n_repeat_words <= 15 * n_words", "100 * n_repeat_words > 35 * n_words"),
    ("capitals", "100 * n_upper <= 8 * word_chars", "100 * n_upper > 30 * word_chars"),
    ("shouting", "100 * n_bang <= 2 * n_words", "100 * n_bang > 10 * n_words"),
    ("variety", "100 * n_kinds >= 25 * n_words", "100 * n_kinds < 10 * n_words"),
    ("signs", "100 * n_signs <= word_chars", "100 * n_signs > 3 * word_chars"),
    ("line_ends", "10 * n_line_ends >= 8 * n_lines", "2 * n_line_ends < n_lines"),
]


def without(text: Column, signs: str) -> Column:
    """Number of characters of ``text`` that are not in ``signs``."""
    return F.length(F.translate(text, signs, ""))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every text that rules and base limits look at."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "text",
        F.array_remove(F.split("text", _SPACE, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD)).alias("lines"))
    # each 3-word window as one long: hash above, place in the text below
    rows = rows.withColumn("n_words", F.size("words")).withColumn(
        "bits", F.ceil(F.log2(F.col("n_words") + F.lit(2))).cast("int"))
    rows = rows.withColumn("windows", F.array_sort(F.expr(
        "transform(slice(words, 1, greatest(n_words - 2, 0)),"
        " (w, i) -> shiftleft(xxhash64(w, get(words, i + 1), get(words, i + 2)), bits) | i)")))
    # a repeat has an equal neighbour in hash order, whose words are the same
    same = ("shiftright({a}, bits) = shiftright({b}, bits) AND forall(array(0, 1, 2), k ->"
            " get(words, cast({a} & (shiftleft(1L, bits) - 1) as int) + k) ="
            " get(words, cast({b} & (shiftleft(1L, bits) - 1) as int) + k))")
    left, right = same.format(a="x", b="get(windows, j - 1)"), same.format(a="x", b="get(windows, j + 1)")
    rows = rows.withColumn("repeats", F.expr(
        f"array_sort(transform(filter(windows, (x, j) -> coalesce({left}, false) OR coalesce({right}, false)),"
        " x -> cast(x & (shiftleft(1L, bits) - 1) as int)))"))
    covered = F.expr(
        "aggregate(repeats, named_struct('n', 0, 'upto', 0),"
        " (s, p) -> named_struct('n', s.n + p + 3 - greatest(p, s.upto), 'upto', p + 3), s -> s.n)")
    number = lambda c: c.cast("long")
    return rows.select(
        "doc_id", number(F.col("n_words")).alias("n_words"),
        number(without(text, " \t\n\x0b\x0c\r")).alias("word_chars"),
        number(F.length(text) - without(text, "#*$%&|<>")).alias("n_symbols"),
        number(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        number(covered).alias("n_repeat_words"),
        number(F.size("lines")).alias("n_lines"),
        number(F.length(text) - F.length(F.regexp_replace(text, _UPPER, ""))).alias("n_upper"),
        number(F.length(text) - without(text, "!")).alias("n_bang"),
        number(F.size(F.array_distinct("words"))).alias("n_kinds"),
        number(F.length(text) - F.length(F.regexp_replace(text, _SIGN, ""))).alias("n_signs"),
        number(F.size(F.filter("lines", lambda x: x.rlike(_LINE_END)))).alias("n_line_ends"))


def votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"v_{name}")
            for name, good, bad in RULES]


def posterior(share: float, on_good: list[float], on_bad: list[float]) -> Column:
    """Probability of good, given a row's votes."""
    odds = F.lit(math.log(share / (1 - share)))
    for (name, _, _), g, b in zip(RULES, on_good, on_bad, strict=True):
        vote = F.col(f"v_{name}")
        odds = odds + F.when(vote == 1, math.log(g / (1 - b))).when(vote == -1, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame) -> tuple[float, list[float], list[float]]:
    """Share of good texts and each rule's accuracy on good and on bad ones,
    by EM over vote patterns (columns ``v_<rule>`` and ``n``)."""
    k = len(RULES)
    model = SHARE, [ON_GOOD] * k, [ON_BAD] * k
    for _ in range(STEPS):
        good, n = posterior(*model), F.col("n")
        sums = [F.sum(n * good), F.sum(n)]
        for name, _, _ in RULES:
            vote = F.col(f"v_{name}")
            sums += [F.sum(F.when(vote == 1, n * good).otherwise(0.0)), F.sum(F.when(vote != 0, n * good).otherwise(0.0)),
                     F.sum(F.when(vote == -1, n * (1 - good)).otherwise(0.0)),
                     F.sum(F.when(vote != 0, n * (1 - good)).otherwise(0.0))]
        row = patterns.agg(*sums).first()
        if not row[1]:
            break
        within = lambda x, limits: min(max(x, limits[0]), limits[1])
        model = (within(row[0] / row[1], (0.01, 0.99)),
                 [within((row[2 + 4 * j] + PRIOR * ON_GOOD) / (row[3 + 4 * j] + PRIOR), GOOD_LIMITS) for j in range(k)],
                 [within((row[4 + 4 * j] + PRIOR * ON_BAD) / (row[5 + 4 * j] + PRIOR), BAD_LIMITS) for j in range(k)])
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts, base limits, verdict, posterior probability of good."""
    known = stored(counts(docs, id_col, text_col).select("*", *votes(), F.expr(FAILED).alias("base_failed")))
    patterns = known.where(~F.col("base_failed")).groupBy([f"v_{r}" for r, _, _ in RULES]).agg(F.count("*").alias("n"))
    quality = posterior(*estimate(stored(patterns.coalesce(1))))
    return known.withColumn("quality", quality).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= MIN_POSTERIOR)).alias("kept"),
        F.round("quality", 6).alias("posterior"))


def oracle_sql() -> str:
    """The same in DuckDB: windows as rows, EM as a recursive query."""
    names = [r for r, _, _ in RULES]
    sign, line_end = _SIGN.replace("'", "''"), _LINE_END.replace("'", "''")
    case = ",\n".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, good, bad in RULES)
    group = ", ".join(f"v_{r}" for r in names)
    odds = "ln(m.share / (1 - m.share)) + " + " + ".join(
        f"CASE p.v_{r} WHEN 1 THEN ln(m.g_{r} / (1 - m.b_{r})) WHEN -1 THEN ln((1 - m.g_{r}) / m.b_{r}) ELSE 0 END"
        for r in names)
    q = f"(1 / (1 + exp(-({odds}))))"

    def accuracy(r: str, vote: int, weight: str, start: float, limits: tuple) -> str:
        right, cast = (f"sum(CASE WHEN {cond} THEN p.n * {weight} ELSE 0 END)" for cond in (f"p.v_{r} = {vote}", f"p.v_{r} <> 0"))
        return f"least(greatest(({right} + {PRIOR * start}) / ({cast} + {PRIOR}), {limits[0]}), {limits[1]})"

    step = ",\n".join(f"{accuracy(r, 1, 'q', ON_GOOD, GOOD_LIMITS)} AS g_{r}, "
                      f"{accuracy(r, -1, '(1 - q)', ON_BAD, BAD_LIMITS)} AS b_{r}" for r in names)
    start = ", ".join(f"CAST({ON_GOOD} AS DOUBLE) AS g_{r}, CAST({ON_BAD} AS DOUBLE) AS b_{r}" for r in names)
    carried = ", ".join(f"m.g_{r}, m.b_{r}" for r in names)
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lists AS MATERIALIZED (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
wide AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM lists WHERE len(ws) >= 3),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM wide),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c >= 2),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY rid),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS kinds,
  count(*) FILTER (regexp_matches(line, '{line_end}')) AS line_ends FROM lines GROUP BY rid),
counts AS (SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n - l.kinds, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
  CAST(length(text) - length(regexp_replace(text, '{_UPPER}', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_bang,
  CAST(len(list_distinct(ws)) AS BIGINT) AS n_kinds,
  CAST(length(text) - length(regexp_replace(text, '{sign}', '', 'g')) AS BIGINT) AS n_signs,
  CAST(coalesce(l.line_ends, 0) AS BIGINT) AS n_line_ends
  FROM d JOIN lists USING (rid) LEFT JOIN repeats r USING (rid) LEFT JOIN line_counts l USING (rid)),
known AS MATERIALIZED (SELECT *, {case}, {FAILED} AS base_failed FROM counts),
patterns AS MATERIALIZED (SELECT {group}, count(*) AS n FROM known WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS step, CAST({SHARE} AS DOUBLE) AS share, {start}
  UNION ALL
  SELECT step + 1, least(greatest(sum(p.n * q) / sum(p.n), 0.01), 0.99) AS share, {step}
  FROM (SELECT m.step, m.share, {carried}, p.*, {q} AS q FROM em m, patterns p WHERE m.step < {STEPS}) p GROUP BY step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {q} >= {MIN_POSTERIOR} AS kept, round({q}, 6) AS posterior
FROM known p, em m WHERE m.step = (SELECT max(step) FROM em)
"""
