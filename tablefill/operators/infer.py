"""Batch inference slots.

A *model* is a picklable factory ``make() -> (list[str] -> list[str])``.
``complete`` runs it with ``mapInPandas``: Arrow batches in, the model is
built once per Python worker (workers are reused across tasks) and called
once per batch, never per row. Completions may be non-deterministic, so
callers that read them twice should ``materialize`` them first.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


Model = Callable[[list[str]], list[str]]
Factory = Callable[[], Model]

_MODELS: OrderedDict[str, Model] = OrderedDict()  # of this worker, the last used last
MODELS_KEPT = 2
_WS_RE = re.compile(r"[ \t\n\r\f\x0b]+")
_PIECES_RE = re.compile(r"(?<=[ \t\n\r\f\x0b])(?=[^ \t\n\r\f\x0b])")

# The dummy model's answer.
DUMMY_ANSWER = "Dummy prediction"


class PromptTooLong(Exception):
    """Raised by a model when a prompt exceeds its context."""


def _factory_key(factory: Factory) -> str:
    """Digest of the pickled factory: equal factories share a worker's model,
    others never meet, whatever objects come and go on the driver."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _model(key: str, factory: Factory) -> Model:
    if key not in _MODELS:
        while len(_MODELS) >= MODELS_KEPT:
            _MODELS.popitem(last=False)
        _MODELS[key] = factory()
    _MODELS.move_to_end(key)
    return _MODELS[key]


def _keep_last_text(prompt: str, n: int) -> str:
    """The exact suffix holding the last n whitespace tokens (as the column
    function ``keep_last_text`` computes it)."""
    if len([t for t in _WS_RE.split(prompt) if t]) <= n:
        return prompt
    return "".join(_PIECES_RE.split(prompt)[-n:]) if n > 0 else ""


def complete(prompts: DataFrame, factory: Factory, prompt_col: str = "prompt",
             batch_size: int = 64, on_too_long: str | None = None, keep_last_n: int | None = None,
             model_key: str | None = None,
             retry_on: tuple[type[BaseException], ...] = (Exception,)) -> DataFrame:
    """ML1 (+ ML3): add ``completion``, ``truncated``, ``seconds``.

    ``on_too_long='keep_last'``: a prompt the model refuses with one of
    ``retry_on`` (any exception by default; e.g. ``(PromptTooLong,)`` for a
    backend that only retries validation errors) is retried once with its
    last ``keep_last_n`` tokens (required then) and flagged ``truncated``; a
    second failure, or another exception, raises. A refused batch is halved
    until the refused prompts stand alone, so the others are answered in
    batches still.
    """
    if on_too_long not in (None, "keep_last"):
        raise ValueError(f"Unknown on_too_long {on_too_long}")
    if on_too_long == "keep_last" and not keep_last_n:
        raise ValueError("keep_last needs keep_last_n, the tokens to keep")
    key = model_key or _factory_key(factory)
    schema = T.StructType(prompts.schema.fields + [
        T.StructField("completion", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("seconds", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, factory)
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].copy()
                texts = chunk[prompt_col].tolist()
                t0 = time.perf_counter()
                truncated = [False] * len(texts)

                def answer(at: int, part: list[str]) -> list[str]:
                    try:
                        return list(model(part))
                    except retry_on:
                        if on_too_long is None:
                            raise
                    if len(part) == 1:
                        truncated[at] = True  # noqa: B023 - called in this turn only
                        return list(model([_keep_last_text(part[0], keep_last_n)]))
                    half = len(part) // 2
                    return answer(at, part[:half]) + answer(at + half, part[half:])

                outs = answer(0, texts)
                per_row = (time.perf_counter() - t0) / max(1, len(texts))
                chunk["completion"] = outs
                chunk["truncated"] = truncated
                chunk["seconds"] = per_row
                yield chunk

    return prompts.mapInPandas(run, schema)


@dataclass(frozen=True)
class DigestModel:
    """A model without a model: the MD5 of the prompt it was given; prompts of
    more than ``context`` whitespace tokens are refused. Shows what reached a
    model, and what it was cut to."""

    context: int

    def __call__(self) -> Model:
        def model(prompts: list[str]) -> list[str]:
            for p in prompts:
                if len([t for t in _WS_RE.split(p) if t]) > self.context:
                    raise PromptTooLong(p)
            return [hashlib.md5(p.encode()).hexdigest() for p in prompts]
        return model


def constant_model(prompts: DataFrame, answer: str = DUMMY_ANSWER) -> DataFrame:
    """ML2: the dummy model, as a literal column (no Python at all)."""
    return (prompts.withColumn("completion", F.lit(answer))
            .withColumn("truncated", F.lit(False))
            .withColumn("seconds", F.lit(0.0)))


def replay_model(prompts: DataFrame, recorded: DataFrame, keys=("config_id", "query_id")) -> DataFrame:
    """ML5: recorded completions as the model — a left join on the keys."""
    rec = recorded.select(*keys, "completion")
    return (prompts.join(rec, list(keys), "left")
            .withColumn("truncated", F.lit(False))
            .withColumn("seconds", F.lit(0.0)))


@dataclass(frozen=True)
class Replay:
    """Recorded completions in the place of a model, also per example choice.

    ``recorded`` holds ``query_id, variant, completion``; a query is answered
    with the variant (0 to ``variants`` - 1) drawn from its id and the ids of
    its examples in prompt order, so another choice of examples may get
    another answer. ``id_of`` maps a prompt's query id to the recorded one.
    """

    recorded: DataFrame
    variants: int
    id_of: Callable[[Column], Column] = lambda c: c


def example_keys(examples: DataFrame) -> DataFrame:
    """``query_id, examples_key``: digest of a query's example ids by position
    (a handful per query)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "table_id"))), lambda x: x["table_id"])
    return examples.groupBy("query_id").agg(F.md5(F.array_join(ids, ",")).alias("examples_key"))


def answer(prompts: DataFrame, model: Factory | Replay, examples: DataFrame | None = None,
           batch_size: int = 64) -> DataFrame:
    """Completions of a pipeline's prompts: by a model, or replayed."""
    if not isinstance(model, Replay):
        return complete(prompts, model, batch_size=batch_size)
    keyed = prompts.withColumn("examples_key", F.lit(None).cast("string")) if examples is None else (
        prompts.join(example_keys(examples), "query_id", "left"))
    recorded_id = model.id_of(F.col("query_id"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", recorded_id, F.coalesce("examples_key", F.lit("")))), 1, 15), 16, 10)
    keyed = keyed.withColumn("_id", recorded_id).withColumn("_variant", F.pmod(draw.cast("long"), F.lit(model.variants)))
    recorded = model.recorded.select(F.col("query_id").alias("_id"), F.col("variant").cast("long").alias("_variant"), "completion")
    return (keyed.drop("examples_key").join(recorded, ["_id", "_variant"], "left").drop("_id", "_variant")
            .withColumn("truncated", F.lit(False))
            .withColumn("seconds", F.lit(0.0)))


# ------------------------------------------------------------ embeddings

class _Buckets(dict):
    """Bucket of each token met; a worker hashes a token once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[token] = at = int(hashlib.md5(token.encode()).hexdigest()[:15], 16) % self.dim
        return at


def hash_vectors(df: DataFrame, text_col: str, id_col: str, dim: int, float32: bool) -> DataFrame:
    """``(id, embedding)``, one row a row, in Arrow batches: tokens repeat, so
    most need no hash at all, and nothing is shuffled."""
    kind = T.FloatType() if float32 else T.DoubleType()
    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        flat = pa.float32() if float32 else pa.float64()
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = [buckets[t] for t in _WS_RE.split(text) if t] if text else []
                if at:
                    counts = np.bincount(at, minlength=dim)
                    out[i] = counts / np.sqrt(float((counts * counts).sum()))
            values = pa.array(out.ravel().astype(np.float32) if float32 else out.ravel(), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * dim, values)],
                names=[id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def embed_hash(df: DataFrame, text_col: str, id_col: str, dim: int = 64,
               float32: bool = True, unique_ids: bool = False) -> DataFrame:
    """ML4 offline default: hashed bag of whitespace tokens, L2-normalised.

    token -> bucket md5(token) mod dim. Counting is an aggregation on
    (id, bucket) — partial aggregation before the shuffle — and the vector
    is assembled from at most ``dim`` entries per id. Texts without tokens
    (empty or NULL) get the zero vector. Rows that share an id are one text;
    where ids are declared unique, every vector is made in its row, without a
    shuffle.
    """
    if unique_ids:
        return hash_vectors(df, text_col, id_col, dim, float32)
    # explode, then mark empty tokens rather than dropping them: a text
    # without tokens still yields its (id, null) group and so its zero
    # vector, without a join back to the ids. Stays in whole-stage codegen.
    toks = F.split(F.col(text_col), r"[ \t\n\r\f\x0B]+")
    tok = F.col("tok")
    bucket = F.when(tok != F.lit(""), F.pmod(F.conv(F.substring(F.md5(tok), 1, 15), 16, 10).cast("long"),
                                             F.lit(dim)).cast("int"))
    counts = (df.select(F.col(id_col).alias("id"), F.explode_outer(toks).alias("tok"))
              .withColumn("bucket", bucket)
              .groupBy("id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n")))
    real = F.col("bucket").isNotNull()
    per_id = (counts.groupBy("id")
              .agg(F.map_from_entries(F.collect_list(F.when(real, F.struct("bucket", "n")))).alias("m"),
                   F.sqrt(F.sum(F.when(real, F.col("n") * F.col("n")))).alias("norm")))
    etype = "float" if float32 else "double"
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: (F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("norm")).cast(etype))
    zero = F.array_repeat(F.lit(0.0).cast(etype), dim)
    return per_id.select(F.col("id").alias(id_col),
                         F.when(F.col("norm") > 0, vec).otherwise(zero).alias("embedding"))


def embed(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]],
          batch_size: int = 64, model_key: str | None = None) -> DataFrame:
    """ML4 slot: a user's encoder (texts -> unit vectors), batched per worker."""
    key = model_key or _factory_key(factory)
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        enc = _model(key, factory)
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch_size):
                out.extend(enc(pdf[text_col].iloc[start:start + batch_size].tolist()))
            pdf = pdf.copy()
            pdf["embedding"] = [list(map(float, v)) for v in out]
            yield pdf

    return df.mapInPandas(run, schema)


GROUPS_HELD = 4096  # partial sums a task keeps before it passes them on


def _wider(total: np.ndarray, size: int) -> np.ndarray:
    return total if len(total) >= size else np.append(total, np.zeros(size - len(total)))


def pool_vectors(vectors: DataFrame, group: str, vec: str = "embedding", mask: str | None = None, eps: float = 1e-9) -> DataFrame:
    """AG7: ``(group, embedding)``: sum(v * mask) / max(sum(mask), eps) of each
    group's vectors, then L2-normalised.

    Sums are vectors: each task adds up its own rows per group and passes one row a
    group on, so a group of any size is a row a task in the shuffle, and no
    vector is taken apart. Null vectors are left out; a shorter vector counts
    as filled up with zeros."""
    mass = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = vectors.filter(F.col(vec).isNotNull()).select(F.col(group), mass.alias("mass"), F.col(vec).cast("array<double>").alias("sums"))
    key = vectors.schema[group]
    parts = T.StructType([key, T.StructField("mass", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def out(held: dict, schema: T.StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema
        types = to_arrow_schema(schema).types
        columns = [list(held), *([x[i] for x in held.values()] for i in range(len(types) - 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            lengths = batch.column(2).value_lengths().to_numpy()
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            dim = int(lengths.max(initial=0))
            whole = np.zeros((batch.num_rows, dim))
            row = np.repeat(np.arange(batch.num_rows), lengths)
            whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat * weights[row]
            coded = batch.column(0).dictionary_encode("encode")
            at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            sums, masses = np.zeros((len(names), dim)), np.bincount(at, weights, len(names))
            np.add.at(sums, at, whole)
            for k, name in enumerate(names):
                total = held.get(name)
                held[name] = [masses[k], sums[k]] if total is None else [total[0] + masses[k], _wider(total[1], dim) + _wider(sums[k], len(total[1]))]
            if len(held) >= GROUPS_HELD:
                yield out(held, parts)
                held = {}
        if held:
            yield out(held, parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict = {}
        last, weight, total = None, 0.0, None

        def close() -> None:
            mean = total / max(weight, eps)
            done[last] = [mean / max(float(np.sqrt((mean * mean).sum())), 1e-12)]

        for batch in batches:
            for name, m, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                sums = sums.values.to_numpy(zero_copy_only=False)
                if total is not None and name == last:
                    weight, total = weight + m, _wider(total, len(sums)) + _wider(sums, len(total))
                    continue
                if total is not None:
                    close()
                    if len(done) >= GROUPS_HELD:
                        yield out(done, pooled)
                        done.clear()
                last, weight, total = name, m, sums
        if total is not None:
            close()
        if done:
            yield out(done, pooled)

    pooled = T.StructType([key, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(partial, parts).repartition(group).sortWithinPartitions(group).mapInArrow(merged, pooled)


def mean_pool(vectors: DataFrame, group: str, vec: str = "embedding", mask: str | None = None,
              eps: float = 1e-9) -> DataFrame:
    """``pool_vectors`` as rows ``group, dim, value``."""
    return pool_vectors(vectors, group, vec, mask, eps).select(group, F.posexplode_outer("embedding").alias("dim", "value"))
