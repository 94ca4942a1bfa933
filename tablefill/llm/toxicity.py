"""Toxicity by subword bags: a word is the average of its character n-gram
vectors, a linear softmax over the average gives its probability, and vectors
and softmax are trained jointly (numpy, Adagrad).

Labels belong to whole documents while a few words make one toxic, so fitting
alternates, as in learning from bags: first every word takes the label of the
documents it is in; then only the words that score highest in each toxic
document count as positive, all words of clean documents as negative. A
document's score is a logistic function, fitted on the documents, of its
``TOP`` highest word scores and its length: one insult in 20,000 words is not averaged away, and an
unseen misspelling shares most n-grams with the word it distorts.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows of each class
(``SAMPLE_CHARS`` characters in all, half for each class: whole rows in the order
of a hash, those that do not fit are passed over; the shortest one if none fits) of the
learning folds. It is a table of 2**18 floats, so its broadcast has a fixed
size; scoring covers every character of every text.

Null, empty and wordless texts score 0. Rows without id, label or text are not
learnt from; repeated rows score alike. Without texts of both classes nothing
can be learnt: there is no model and every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablefill.llm.common import alnum_spans, append_columns, crc_bucket, fold, held_out, mix, string_parts

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6_000_000
BUCKET_BITS = 18
WIDTHS = (3, 4, 5)
DIM = 12
TOP = 4
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_grams(data: np.ndarray, offsets: np.ndarray):
    """Words (runs of letters and digits with a letter) of a slice: row of each word, first
    n-gram of each word, n-gram buckets, and a hash of each word."""
    starts, ends, rows = alnum_spans(data, offsets)
    data = fold(data)
    letters = np.append(0, np.cumsum(_LETTER[data]))
    named = letters[ends] > letters[starts]
    starts, ends, rows = starts[named], ends[named], rows[named]
    size = ends - starts + 2
    last = np.cumsum(size)
    first = last - size
    # every word between markers, one after the other
    buf = np.full(int(last[-1]) if len(last) else 0, 1, np.uint32)
    inside = np.arange(len(buf)) - np.repeat(first, size)
    letters = (inside > 0) & (inside < np.repeat(size, size) - 1)
    buf[letters] = data[np.repeat(starts - first - 1, size)[letters] + np.flatnonzero(letters)]
    buf[inside == 0] = 2
    room = np.repeat(last, size) - np.arange(len(buf))
    grams, owners, h = [], [], np.zeros(len(buf), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(WIDTHS) + 1):
            h = h * np.uint32(0x01000193)
            h[:len(buf) - n + 1] ^= buf[n - 1:]
            if n in WIDTHS:
                at = np.flatnonzero(room >= n)
                x = h[at] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B % (1 << 32))
                x ^= x >> np.uint32(15)
                grams.append((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS))
                owners.append(at)
    return starts, ends, rows, first, last, grams, owners


def word_scores(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and score of every word: the mean of its n-grams' scores."""
    _, _, rows, first, last, grams, owners = word_grams(data, offsets)
    if len(rows) == 0:
        return rows, np.zeros(0, np.float32)
    total = np.zeros(int(last[-1]) + 1)
    count = np.zeros(int(last[-1]) + 1, np.int32)
    for g, at in zip(grams, owners, strict=True):
        total[at + 1] += table[g]
        count[at + 1] += 1
    total, count = np.cumsum(total), np.cumsum(count)
    return rows, ((total[last] - total[first]) / np.maximum(count[last] - count[first], 1)).astype(np.float32)


def evidence(rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Per document (row 0 to n-1) its TOP highest word scores, squashed to
    (-1, 1), and the logarithm of its number of words; all zero without words."""
    out = np.zeros((n, TOP + 1))
    if len(rows) == 0:
        return out
    words = words.astype(float)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(first, len(rows)))
    owner = np.repeat(np.arange(len(first)), size)
    for k in range(TOP):
        best = np.maximum.reduceat(words, first)
        out[rows[first], k] = np.tanh(best / 2)  # -inf, too few words, gives -1
        hit = np.flatnonzero(words == best[owner])
        words[hit[np.unique(owner[hit], return_index=True)[1]]] = -np.inf
    out[rows[first], TOP] = np.log1p(size)
    return out


class Model:
    """Score of each n-gram bucket, weights of the document's evidence, and the
    longest length learnt from: longer texts count as that long."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, longest: float):
        self.table, self.weights, self.longest = table, weights, longest

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = string_parts(texts)
        x = evidence(*word_scores(self.table, data, offsets), len(texts))
        x[:, TOP] = np.minimum(x[:, TOP], self.longest)
        out = 1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))
        return np.where(x[:, TOP] > 0, out, 0.0)


def train(texts: list[str], toxic: list[int], seed: int = 5, epochs: int = 4, rounds: int = 3) -> Model | None:
    """Fit on whole documents with labels 0 and 1; None if a class has no words."""
    toxic = np.asarray(toxic, bool)
    rng = np.random.default_rng(seed)
    bags: dict[int, np.ndarray] = {}
    pairs = []
    for at in range(0, len(texts), 64):
        data, offsets = string_parts(pa.array(texts[at:at + 64], pa.large_string()))
        _, _, rows, first, last, grams, owners = word_grams(data, offsets)
        if len(rows) == 0:
            continue
        flat, where = np.concatenate(grams), np.concatenate(owners)
        flat = flat[np.argsort(where, kind="stable")]
        count = np.zeros(int(last[-1]) + 1, np.int64)
        np.add.at(count, where + 1, 1)
        count = np.cumsum(count)
        ends = count[last]
        starts = count[first]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(flat.astype(np.uint64) + np.uint64(1)), starts)
        key = sums.view(np.int64)
        kinds, one = np.unique(key, return_index=True)
        for k, i in zip(kinds.tolist(), one.tolist(), strict=True):
            if k not in bags:
                bags[k] = flat[starts[i]:ends[i]].astype(np.int32)
        pairs.append(np.unique(np.stack([rows + at, key]), axis=1))
    names = np.array(sorted(bags), np.int64)
    doc, key = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    if len({*toxic[doc].tolist()}) < 2:
        return None
    kind = np.searchsorted(names, key)
    sizes = np.array([len(bags[k]) for k in names.tolist()])
    flat = np.concatenate([bags[k] for k in names.tolist()])
    at = np.append(0, np.cumsum(sizes))
    n_toxic, n_clean = max(1, toxic.sum()), max(1, (~toxic).sum())
    clean_in = np.bincount(kind[~toxic[doc]], minlength=len(names)) / n_clean
    toxic_in = np.bincount(kind[toxic[doc]], minlength=len(names)) / n_toxic

    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(1 << BUCKET_BITS, 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)

    def step(chosen, positive, negative, rate):
        nonlocal softmax, bias
        n = sizes[chosen]
        begin = np.append(0, np.cumsum(n)[:-1])
        grams = flat[np.repeat(at[chosen] - begin, n) + np.arange(n.sum())]
        mean = np.add.reduceat(vectors[grams], begin, axis=0) / n[:, None]
        z = mean @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = positive + negative
        g = p * weight[:, None]
        g[:, 0] -= negative
        g[:, 1] -= positive
        g = g.astype(np.float32)
        gs, gb = mean.T @ g, g.sum(0)
        back = (g @ softmax.T / n[:, None]).astype(np.float32)
        rows = np.repeat(back, n, axis=0)
        np.add.at(seen_v, grams, (rows * rows).mean(1))
        np.add.at(vectors, grams, -rate * rows / np.sqrt(seen_v[grams])[:, None])
        seen_s[:] += gs * gs
        seen_b[:] += gb * gb
        softmax -= rate * gs / np.sqrt(seen_s)
        bias -= rate * gb / np.sqrt(seen_b)

    def table():
        side = softmax[:, 1] - softmax[:, 0]
        return (vectors @ side + (bias[1] - bias[0])).astype(np.float32)

    positive, negative = toxic_in, clean_in
    scale = 1000.0
    for turn in range(rounds + 1):
        if turn:  # positives: the best words of each toxic document
            value = np.add.reduceat(table()[flat], at[:-1]) / sizes
            mine = np.flatnonzero(toxic[doc])
            mine = mine[np.lexsort((-value[kind[mine]], doc[mine]))]
            place = np.arange(len(mine)) - np.searchsorted(doc[mine], doc[mine])
            top = mine[place < TOP]
            positive = np.bincount(kind[top], minlength=len(names)) / n_toxic
            # a word of clean documents counts at least as one whole document there
            negative = np.where(clean_in > 0, np.maximum(clean_in, 1 / n_clean), 0)
        live = np.flatnonzero(positive + negative > 0)
        for _ in range(epochs):
            rng.shuffle(live)
            for i in range(0, len(live), 1024):
                c = live[i:i + 1024]
                step(c, scale * positive[c], scale * negative[c], 0.05)
    final = table()
    found = [evidence(*word_scores(final, *string_parts(pa.array(texts[i:i + 64], pa.large_string()))), len(texts[i:i + 64]))
             for i in range(0, len(texts), 64)]
    x = np.concatenate(found)
    known = x[:, TOP] > 0
    return Model(final, _logistic(x[known], toxic[known]), float(x[:, TOP].max()))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a little shrinkage; weights, then offset."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), 0.1)
    shrink[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic", learn=None, sample_rows: int = SAMPLE_ROWS,
        sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Model of the labelled rows whose id ``learn`` accepts (a function of a
    column; default: those outside the held-out fold); None without texts of both classes."""
    learn = learn or (lambda c: crc_bucket(c) != 1)
    marks = (labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
             .where(F.col("_y").isin(0, 1) & learn(F.col("_id"))))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    known = rows.select("_id", F.length("_text").alias("_size")).join(marks, "_id")
    chosen = []
    for y in (0, 1):  # ids and lengths of a bounded number of rows, then only their texts
        room, before, shortest = sample_chars // 2, len(chosen), None
        for i, size in (known.where(F.col("_y") == y).groupBy("_id").agg(F.max("_size"))
                        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).toLocalIterator()):
            if shortest is None or size < shortest[0]:
                shortest = (size, i)
            if size <= room:  # a text that does not fit makes room for later ones
                room -= size
                chosen.append((i, y))
        if len(chosen) == before and shortest is not None:
            chosen.append((shortest[1], y))
    texts, ys = [], []
    if chosen:
        wanted = docs.sparkSession.createDataFrame(chosen, known.select("_id", F.lit(0).alias("_y")).schema)
        got = rows.join(F.broadcast(wanted), "_id").groupBy("_id", "_y").agg(F.min("_text")).orderBy("_id").toArrow()
        ys, texts = got.column(1).to_pylist(), got.column(2).to_pylist()
    return train(texts, ys) if len(set(ys)) == 2 else None


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` plus the score of its text."""
    if model is None:
        return docs.withColumn(out_col, F.lit(0.0))
    return append_columns(docs, text_col, StructType([StructField(out_col, DoubleType())]),
                          lambda: lambda texts: [pa.array(model.score(texts))])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fold, score and decision."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, model, "text", "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
