"""Token budgets by a real tokenizer.

``budget.py`` takes a tokenizer that is a Column function. One that lives in a
library works on batches: texts go in, lists of ids come out, a list is cut and
decoded again. Here such an *encoder* is a picklable factory ``make() ->
(encode, decode)`` with ``encode(list[str]) -> list[list[int]]`` and
``decode(list[list[int]]) -> list[str]``; it is built once per Python worker and
called once per slice of an Arrow batch. Ids never leave the task.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .budget import TOKENS_PER_MESSAGE, TOKENS_PER_NAME

SLICE = 256  # rows that are encoded at a time

Encode = Callable[[list[str]], list[list[int]]]
Decode = Callable[[list[list[int]]], list[str]]
Encoder = Callable[[], tuple[Encode, Decode]]

_BUILT: dict = {}  # of this worker, by equal factories


@dataclass(frozen=True)
class RankFile:
    """Byte-level BPE by a local rank file (a line of base64 bytes and a rank
    each) and its split pattern, without special tokens: their strings are text."""

    path: str
    pattern: str

    def __call__(self) -> tuple[Encode, Decode]:
        import tiktoken
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding(self.path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: encoding.encode_ordinary_batch(texts, num_threads=1),
                lambda ids: [encoding.decode(x) for x in ids])


def _built(encoder: Encoder) -> tuple[Encode, Decode]:
    if encoder not in _BUILT:
        _BUILT.clear()
        _BUILT[encoder] = encoder()
    return _BUILT[encoder]


def _with(df: DataFrame, fields: list[StructField], make) -> DataFrame:
    """``df`` with more columns; a column of that name is replaced."""
    new = {f.name.lower() for f in fields}
    stay = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    schema = StructType([df.schema.fields[i] for i in stay] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), *make(part)], names=schema.names)

    return df.mapInArrow(run, schema)


def with_token_counts(df: DataFrame, columns: dict[str, str], encoder: Encoder) -> DataFrame:
    """``df`` with the number of ids of each text column (text -> name of the count); null counts 0."""
    at = [df.columns.index(c) for c in columns]

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        encode, _ = _built(encoder)
        return [pa.array([len(x) for x in encode(part.column(i).fill_null("").to_pylist())], pa.int64()) for i in at]

    return _with(df, [StructField(name, LongType()) for name in columns.values()], make)


def with_message_cost(messages: DataFrame, encoder: Encoder, role: str = "role", content: str = "text", name: str | None = None,
                      out: str = "cost") -> DataFrame:
    """AG8: ``messages`` with the tokens of each in the chat format, for the
    ``cost`` of ``count_message_tokens`` and ``fit_messages``."""
    at = [messages.columns.index(c) for c in (role, content, *([name] if name else []))]

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        encode, _ = _built(encoder)
        cost = [TOKENS_PER_MESSAGE] * part.num_rows
        for k, i in enumerate(at):
            for j, ids in enumerate(encode(part.column(i).fill_null("").to_pylist())):
                named = k == 2 and part.column(i)[j].is_valid
                cost[j] += len(ids) + (TOKENS_PER_NAME if named else 0)
        return [pa.array(cost, pa.int64())]

    return _with(messages, [StructField(out, LongType())], make)


def with_last_tokens(df: DataFrame, text_col: str, n: int, encoder: Encoder, out: str = "kept", count: str | None = None) -> DataFrame:
    """SC9: ``df`` with each text, or what its last ``n`` ids decode to where it
    has more, and (``count``) the ids it had. A cut within a character gives
    the replacement character, as the library's own decoding does; ``n`` = 0 keeps nothing; null stays null."""
    at = df.columns.index(text_col)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        encode, decode = _built(encoder)
        texts = part.column(at).to_pylist()
        ids = encode([t or "" for t in texts])
        long = [i for i, x in enumerate(ids) if len(x) > n]
        for i, text in zip(long, decode([ids[i][len(ids[i]) - n:] for i in long]), strict=True):
            texts[i] = text
        return [pa.array(texts, pa.string()), *([pa.array([len(x) for x in ids], pa.int64())] if count else [])]

    return _with(df, [StructField(out, StringType()), *([StructField(count, LongType())] if count else [])], make)
