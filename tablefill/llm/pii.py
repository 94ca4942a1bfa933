"""Personal data: regular expressions propose spans, checksums confirm them,
words nearby adjust the score.

Four base kinds (email, ip, card, phone) follow fixed rules: leftmost
matches that do not overlap within a kind; a match that fails its check is
dropped and not tried again in another length. The method adds
International Bank Account Numbers (mod 97) and national ids of the form
ddd-dd-dddd; these need a score of ``min_score``, made of a base value per
kind plus the weight of context words in the ``CONTEXT_CHARS`` before the
span. Base spans always stay; their scores are reported as well.

Patterns are written so that each is linear in the text: digit runs are
entered only at their first digit, and an address is grown left from its
``@``. Null and empty texts have no spans; repeated rows are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tablefill.llm.common import append_columns, free_name

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
CONTEXT_CHARS = 60
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
CONTEXT_WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "correo"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "transfer"),
    "national_id": ("ssn", "social", "security", "taxpayer", "identity"),
}
CONTEXT_BONUS = 0.4

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(divmod(2 * int(c), 10)[0] + 2 * int(c) % 10 for c in digits[-2::-2])) % 10 == 0


def iban_ok(value: str) -> bool:
    """ISO 13616: the rearranged number, letters as 10 to 35, is 1 mod 97."""
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the four base kinds."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text) is None:
        return out
    # a part of at most 255 may have leading zeros, so the value counts, not its length
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def score(text: str, kind: str, start: int) -> float:
    near = set(_TOKEN.findall(text[max(0, start - CONTEXT_CHARS):start].lower()))
    return min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT_WORDS[kind]))


def find_spans(text: str, min_score: float = 0.65) -> list[tuple[int, int, int, float]]:
    """All spans as ``(start, kind index, end, score)``, by start, then kind."""
    out = [(s, k, e, score(text, KINDS[k], s)) for s, k, e in base_spans(text)]
    if _DIGIT.search(text) is not None:
        more = [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if iban_ok(m.group())]
        more += [(m.start(), 5, m.end()) for m in _NATIONAL.finditer(text)]
        out += [(s, k, e, v) for s, k, e in more if (v := score(text, KINDS[k], s)) >= min_score]
    return sorted(out)


SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("kind", StringType()),
                             StructField("end", IntegerType()), StructField("score", DoubleType())]))


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` plus an array of spans in code points, end exclusive."""
    def make():
        def run(texts: pa.Array) -> list:
            return [[[{"start": s, "kind": KINDS[k], "end": e, "score": v} for s, k, e, v in find_spans(t)]
                     for t in texts.to_pylist()]]
        return run
    return append_columns(docs, text_col, StructType([StructField(out_col, SPAN)]), make)


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of
    overlapping spans the union is replaced, named after the first."""
    out, done = [], 0
    spans = find_spans(text)
    i = 0
    while i < len(spans):
        start, kind, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def with_redacted(docs: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """``docs`` plus the text with its personal data replaced; null stays null."""
    def make():
        return lambda texts: [[redact_text(t) for t in texts.to_pylist()]]
    new = free_name(docs, "redacted_text")
    out = append_columns(docs, text_col, StructType([StructField(new, StringType())]), make)
    return out.withColumn(out_col, F.when(F.col(text_col).isNotNull(), F.col(new))).drop(new)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows)
    base = F.filter("pii", lambda x: x.kind.isin(*KINDS[:4]))
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x.score)), F.lit(0.0)).alias("max_score"))
