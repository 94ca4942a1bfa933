"""Language of a text by a bidirectional gated recurrent network over bytes.

Two networks read windows of ``WINDOW`` bytes, one forwards, one backwards;
at every byte their states give a softmax over the learned languages, and a
document's probability of a language is the mean over all bytes of the whole
text. Windows follow each other without gaps and start from a zero state, so
memory and depth do not depend on a text's length. Training is numpy:
backpropagation through time over windows of labelled documents, Adam.

The network is fitted on at most ``SAMPLE_ROWS`` documents of each language
value (in the order of a hash of the id), ``SAMPLE_CHARS`` characters of each
in one run from a hashed place, ``SAMPLE_WINDOWS`` windows in all,
that are outside the held-out fold; its few thousand weights are what is
broadcast. Language, source and id are never inputs of a prediction.

A null text, or one without a letter, is ``und`` with score 0. Repeated rows
are predicted alike. Without any labelled text there is nothing to learn: every
text is ``und`` with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tablefill.llm.common import append_columns, crc_bucket, held_out, string_parts

WINDOW = 64
HIDDEN = 8
SAMPLE_ROWS = 400
SAMPLE_CHARS = 40 * WINDOW  # characters of each sampled document, in one run from a hashed place
SAMPLE_WINDOWS = 16_000
BATCH = 2048  # windows at a time in prediction: what fits a core's cache


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a slice in windows (padded with spaces), each window's
    row and its number of bytes."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[rows] + number * WINDOW
    length = np.minimum(WINDOW, offsets[rows + 1] - begin)
    at = begin[:, None] + np.arange(WINDOW)
    out = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])[np.minimum(at, len(data))]
    out[np.arange(WINDOW) >= length[:, None]] = 32
    return out, rows, length


class Network:
    """Weights of both directions and of the softmax.

    Per direction: an input table (256 x 3h) for update gate, reset gate and
    candidate, a recurrent matrix (h x 3h) and the candidate's recurrent
    offset. Gates are logistic functions written as tanh of half the sum."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs, self.w = langs, weights

    @classmethod
    def new(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            w[f"c{d}"] = np.zeros(hidden)
        w["v"] = rng.normal(0, 0.3, (2 * hidden, len(langs)))
        w["b"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (window length, batch, h) of one direction over bytes (window length, batch)."""
        table, u, c = self.w[f"x{d}"].copy(), self.w[f"u{d}"].copy(), self.w[f"c{d}"]
        h = len(c)
        table[:, :2 * h] *= 0.5
        u[:, :2 * h] *= 0.5
        steps, n = x.shape
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            inp, rec = table[x[t]], state @ u
            gates = np.tanh(inp[:, :2 * h] + rec[:, :2 * h])
            gates += 1
            gates *= 0.5
            z, r = gates[:, :h], gates[:, h:]
            held = rec[:, 2 * h:] + c
            cand = np.tanh(inp[:, 2 * h:] + r * held)
            if keep is not None:
                keep.append((t, state, z, r, held, cand))
            state = cand + z * (state - cand)
            out[t] = state
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (window length, batch, languages) at every byte."""
        h = self.w["v"].shape[0] // 2
        z = self._run(x, "f") @ self.w["v"][:h] + self._run(x, "b") @ self.w["v"][h:] + self.w["b"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the valid bytes, by backpropagation through time."""
        h = self.w["v"].shape[0] // 2
        kept = {"f": [], "b": []}
        states = {d: self._run(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        z = both @ self.w["v"] + self.w["b"]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= valid[:, :, None] / valid.sum()
        grads = {"v": both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), "b": p.sum((0, 1))}
        back = p @ self.w["v"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u = self.w[f"u{d}"]
            gx, gu, gc = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros(h, np.float32)
            flow = np.zeros((x.shape[1], h), np.float32)
            for t, before, zg, r, held, cand in reversed(kept[d]):
                flow = flow + part[t]
                dn = flow * (1 - zg) * (1 - cand * cand)
                dz = flow * (before - cand) * zg * (1 - zg)
                dr = dn * held * r * (1 - r)
                dheld = dn * r
                np.add.at(gx, x[t], np.concatenate([dz, dr, dn], axis=1))
                drec = np.concatenate([dz, dr, dheld], axis=1)
                gu += before.T @ drec
                gc += dheld.sum(0)
                flow = flow * zg + drec @ u.T
            grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return grads

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Mean over all bytes of each text; zero for empty texts."""
        data, offsets = string_parts(texts)
        x, rows, length = windows(data, offsets)
        total = np.zeros((len(texts), len(self.langs)))
        for i in range(0, len(rows), BATCH):
            p = self.positions(np.ascontiguousarray(x[i:i + BATCH].T))
            p *= (np.arange(WINDOW)[:, None] < length[i:i + BATCH])[:, :, None]
            np.add.at(total, rows[i:i + BATCH], p.sum(0))
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, seed: int = 9, epochs: int = 3,
          max_windows: int = SAMPLE_WINDOWS) -> Network:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    data, offsets = string_parts(pa.array(texts, pa.large_string()))
    x, rows, length = windows(data, offsets)
    y = np.array([names.index(v) for v in langs])[rows]
    # as many windows of each language, spread over its documents
    order = rng.permutation(len(rows))
    each = max(1, max_windows // len(names))
    chosen = np.concatenate([order[y[order] == k][:each] for k in range(len(names))] or [order])
    net, step = Network.new(names, hidden, rng), 0
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    total = max(1, epochs * -(-len(chosen) // 128))
    for _ in range(epochs):
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 128):
            c = chosen[i:i + 128]
            valid = (np.arange(WINDOW)[:, None] < length[c]).astype(np.float32)
            grads = net.gradients(np.ascontiguousarray(x[c].T), y[c], valid)
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                             / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        learn=None, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """Network of the rows whose id ``learn`` accepts (a function of a column;
    default: those outside the held-out fold); None without any labelled text."""
    learn = learn or (lambda c: crc_bucket(c) != 1)
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
            .where(F.col("_lang").isNotNull() & (F.length("_text") > 0) & learn(F.col("_id"))))
    # ids first: those of small hashes, about four times as many as wanted of each language
    # (fewer than wanted has no chance worth naming), so what is ranked does not grow with the rows
    # or tasks; then a run of windows of each, from a hashed place
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not counts:
        return None
    share = F.lit(1.0)
    for name, n in counts.items():
        share = F.when(F.col("_lang") == name, F.lit(min(1.0, 4 * sample_rows / n))).otherwise(share)
    small = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < share * (1 << 40)
    rank = Window.partitionBy("_lang").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)), "_id")
    ids = (rows.where(small).select("_id", "_lang").withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= sample_rows)
           .select("_id", "_lang").distinct().toArrow())
    size = sample_chars
    start = F.pmod(F.xxhash64("_id", F.lit(1)), F.greatest(F.lit(1), F.length("_text") - size)) + 1
    got = rows.limit(0).select("_text", "_lang").toArrow()
    if ids.num_rows:
        wanted = docs.sparkSession.createDataFrame(ids, rows.select("_id", "_lang").schema)
        got = (rows.join(F.broadcast(wanted), ["_id", "_lang"]).groupBy("_id", "_lang")
               .agg(F.min(F.substr("_text", start.cast("int"), F.lit(size))).alias("_text"))
               .select("_text", "_lang").toArrow())
    if got.num_rows == 0:
        return None
    order = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    return train([t for _, t in order], [v for v, _ in order])


def with_language(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang_pred",
                  score_col: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its probability."""
    if net is None:
        return docs.withColumns({lang_col: F.lit("und"), score_col: F.lit(0.0)})

    def make():
        def run(texts: pa.Array) -> list:
            p = net.probabilities(texts)
            best = p.argmax(1)
            letters = np.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            names = np.where(letters, np.array(net.langs, object)[best], "und")
            return [pa.array(names, pa.string()), pa.array(np.where(letters, np.clip(p.max(1), 0, 1), 0.0))]
        return run

    return append_columns(docs, text_col, StructType([
        StructField(lang_col, StringType()), StructField(score_col, DoubleType())]), make)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: fold, predicted language, score."""
    net = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(rows, net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
