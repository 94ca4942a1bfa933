"""Extractors: completion text -> ranked suggestions.

Each returns ``array<string>`` so any extractor plugs into ``to_run``.
SC3/SC4 are JVM expressions; SC5 is the batched list parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.listparse import extract_list
from ..functions.text import first_csv_token, first_line


def extract_first_line(c) -> Column:
    """SC3: the first line, unstripped."""
    return F.array(first_line(F.col(c) if isinstance(c, str) else c))


def extract_csv_token(c) -> Column:
    """SC4: the first CSV token (quoted or up to the first comma)."""
    return F.array(first_csv_token(F.col(c) if isinstance(c, str) else c))


EXTRACTORS = {
    "first_line": lambda c, lead="": extract_first_line(c),
    "csv_token": lambda c, lead="": extract_csv_token(c),
    "list": lambda c, lead="": extract_list(c, lead),
}


def extractor(name: str, lead: str = ""):
    """Column function for an extractor config name."""
    fn = EXTRACTORS[name]
    return lambda c: fn(c, lead)
