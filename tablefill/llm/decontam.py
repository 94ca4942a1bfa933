"""Benchmark decontamination: a BM25 inverted index of the test items, asked
with every passage of every training text by block-max WAND, and a check that
both question and answer overlap.

*Passages* are windows of twice the longest item's words, one every that many
words, so any copy of an item lies whole in some passage. Words are runs of
letters and digits in lower case.

*Index*: postings of each word by item, with the word's BM25 weight in the
item, kept in blocks of ``BLOCK`` neighbouring items with the block's largest
weight. An item is retrieved if the passage reaches ``MIN_SCORE`` of the score
the item gives itself.

*Search*: words whose largest weights in a block together stay below half of
the block's threshold cannot decide alone, so the other, essential words must
bring the other half. This is tested for a whole slice of passages, first per
block, then per item; passages that pass go through block-max WAND, which
walks the postings by pivots, skips blocks by their maxima and returns every
item above its threshold.

*Check*: an item is a question and an answer (after a line "Answer:", else the
last sentence of three words or more, else the last third); a hit counts if
the passage has ``MIN_QUESTION`` of the question's three-word runs and
``MIN_ANSWER`` of the answer's.

The index is made of at most ``SHARD_BYTES`` of item text; larger item sets
are split by hash into several. Document counts, frequencies and lengths are those
of all items, counted in Spark, so an item's scores and threshold do not depend
on the split. Each index is asked in a pass of its own over a written table, so
a task holds one index and what is broadcast never grows beyond that. Null and empty items and texts match nothing; equal
items are all reported; repeated rows of a text are reported each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from tablefill.llm.common import (
    alnum_spans, append_columns, dropped, fold, free_name, shingles, slices, span_hashes, stored, string_parts)

K1, B = 1.2, 0.75
BLOCK = 8
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.5, 0.6, 0.5
RUN = 3
SHARD_BYTES = 8 << 20

_ANSWER = re.compile(r"(?im)^\s*(?:answer|a)\s*[:.]\s*")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
_WORDS = re.compile(r"\w+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item."""
    mark = _ANSWER.search(text)
    if mark and mark.start() and text[mark.end():].strip():
        return text[:mark.start()], text[mark.end():]
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    for cut in reversed(cuts):
        if len(_WORDS.findall(text[cut:])) >= RUN and len(_WORDS.findall(text[:cut])) >= RUN:
            return text[:cut], text[cut:]
    words = [*_WORDS.finditer(text)]
    if len(words) < 2:
        return text, text
    cut = words[max(1, len(words) * 2 // 3)].start()
    return text[:cut], text[cut:]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    data, offsets = string_parts(texts)
    starts, ends, rows = alnum_spans(data, offsets)
    return span_hashes(fold(data), starts, ends), rows


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of a text's runs of ``width`` words."""
    return np.unique(shingles(words, np.zeros(len(words), np.int64), width)[0])


def part_runs(text: str) -> tuple[int, np.ndarray]:
    """Width and runs of an item's part: RUN words, or all of a shorter one."""
    words, _ = word_hashes(pa.array([text], pa.large_string()))
    width = max(1, min(RUN, len(words)))
    return width, runs(words, width)


@dataclass
class Statistics:
    """Of all items: how many have words, their words, the longest's words,
    and in how many each of the (sorted) terms stands."""
    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Index of some items; ``known`` are the statistics of the whole table
    (default: of these items alone)."""

    def __init__(self, ids: list, texts: list[str], min_score: float = MIN_SCORE, known: Statistics | None = None):
        found = [(i, t, w) for i, t in zip(ids, texts, strict=True)
                 if len(w := word_hashes(pa.array([t], pa.large_string()))[0])]
        self.ids = [i for i, _, _ in found]
        n = len(found)
        self.words = known.longest if known else max((len(w) for _, _, w in found), default=0)
        if not n:
            return
        sizes = np.array([len(w) for _, _, w in found])
        parts = [np.unique(w, return_counts=True) for _, _, w in found]
        item = np.repeat(np.arange(n), [len(k) for k, _ in parts])
        key, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.terms, term, df = np.unique(key, return_inverse=True, return_counts=True)
        every, all_df, mean = n, df, sizes.mean()
        if known:
            every, all_df, mean = known.items, known.df[np.searchsorted(known.terms, self.terms)], known.words / known.items
        idf = np.log1p((every - all_df + 0.5) / (all_df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / mean))
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.at = np.append(0, np.cumsum(df))
        self.threshold = min_score * np.bincount(item, weight, n)
        self.least = self.threshold.min()
        self.most = np.maximum.reduceat(self.weight, self.at[:-1])
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK))
        self.levels = [self._essential(BLOCK), self._essential(1)]
        self.parts = [[part_runs(x) for x in split_item(text)] for _, text, _ in found]

    def _essential(self, width: int):
        """Per group of ``width`` items: the essential words (as postings by
        word: start, group, weight) and what they must bring together."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.at))
        group = self.item // width
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1])))
        best, term, group = np.maximum.reduceat(self.weight, first), term[first], group[first]
        least = np.minimum.reduceat(self.threshold, np.arange(0, len(self.ids), width))
        order = np.lexsort((best, group))
        total = np.cumsum(best[order])
        begin = np.searchsorted(group[order], np.arange(len(least)))
        before = np.append(0, total)[begin]
        sums = np.empty(len(best))
        sums[order] = total - before[group[order]]
        other = sums < least[group] / 2
        lost = np.zeros(len(least))
        np.maximum.at(lost, group[other], sums[other])
        term, group, best = term[~other], group[~other], best[~other]
        at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        return at, group, best, least - lost, len(least)

    def survivors(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages whose essential words can reach some threshold, of distinct
        ``(passage, term)`` entries."""
        for at, group, best, needed, n in self.levels:
            count = at[term + 1] - at[term]
            flat = np.repeat(at[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
            pair, which = np.unique(np.repeat(passage, count) * n + group[flat], return_inverse=True)
            bound = np.bincount(which, best[flat], len(pair))
            good = np.unique(pair[bound >= needed[pair % n] - 1e-9] // n)
            keep = np.isin(passage, good)
            passage, term = passage[keep], term[keep]
        return np.unique(passage)

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items above their threshold for a passage's distinct terms."""
        lists = []
        for t in terms.tolist():
            a, b = self.at[t], self.at[t + 1]
            items = self.item[a:b].tolist()
            weights = self.weight[a:b].tolist()
            blocks: dict[int, float] = {}
            for i, w in zip(items, weights, strict=True):
                blocks[i // BLOCK] = max(w, blocks.get(i // BLOCK, 0.0))
            lists.append([items[0], 0, items, weights, blocks, self.most[t]])
        found = []

        def seek(x, target):
            x[1] = bisect_left(x[2], target, x[1])
            x[0] = x[2][x[1]] if x[1] < len(x[2]) else len(self.ids)

        while True:
            lists = sorted((x for x in lists if x[0] < len(self.ids)), key=lambda x: x[0])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[5]
                if total >= self.least - 1e-9:
                    pivot = x[0]
                    break
            if pivot < 0:
                return found
            upto = k + 1
            while upto < len(lists) and lists[upto][0] == pivot:
                upto += 1
            block = pivot // BLOCK
            if sum(x[4].get(block, 0.0) for x in lists[:upto]) < self.block_threshold[block] - 1e-9:
                # nothing up to the next list or the block's end can reach its threshold
                target = min((block + 1) * BLOCK, lists[upto][0] if upto < len(lists) else len(self.ids))
                for x in lists[:upto]:
                    seek(x, max(target, pivot + 1))
            elif lists[0][0] == pivot:
                score = sum(x[3][x[1]] for x in lists[:upto])
                if score >= self.threshold[pivot] - 1e-9:
                    found.append((pivot, score))
                for x in lists[:upto]:
                    seek(x, pivot + 1)
            else:
                for x in lists[:upto]:
                    seek(x, pivot)

    def matches(self, texts: pa.Array, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> list[list[dict]]:
        """Per text, the items it holds, each with the best of its passages."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not self.ids:
            return out
        words, rows = word_hashes(texts)
        if len(words) == 0:
            return out
        step = self.words
        first = np.searchsorted(rows, np.arange(len(texts) + 1))
        size = np.diff(first)
        count = np.maximum(1, -(-size // step) - 1) * (size > 0)
        base = np.cumsum(count) - count
        # words by passage: number of the step in its row, and the step before
        where = np.searchsorted(self.terms, words)
        where[where == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[where] == words)
        row, term = rows[known], where[known]
        number = (known - first[row]) // step
        passage = np.concatenate([base[row] + np.minimum(number, count[row] - 1),
                                  (base[row] + number - 1)[(number > 0) & (number < count[row])]])
        term = np.concatenate([term, term[(number > 0) & (number < count[row])]])
        passage, term = np.divmod(np.unique(passage * len(self.terms) + term), len(self.terms))
        owner = np.repeat(np.arange(len(texts)), count)
        for p in self.survivors(passage, term).tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            hits = self.wand(term[a:b])
            if not hits:
                continue
            r = int(owner[p])
            begin = first[r] + (p - base[r]) * step
            last = p == base[r] + count[r] - 1
            text = words[begin:first[r + 1] if last else begin + 2 * step]
            have = {width: runs(text, width) for width in {w for i, _ in hits for w, _ in self.parts[i]}}
            for i, score in hits:
                q, a_ = (np.isin(part, have[width], assume_unique=True).mean() if len(part) else 1.0
                         for width, part in self.parts[i])
                if q >= min_question and a_ >= min_answer:
                    out[r].append({"item_id": self.ids[i], "score": float(score),
                                   "question_overlap": float(q), "answer_overlap": float(a_)})
        for r, found in enumerate(out):
            if len(found) > 1:
                best: dict = {}
                for x in found:
                    old = best.get(x["item_id"])
                    if old is None or (x["question_overlap"] + x["answer_overlap"], x["score"]) > (
                            old["question_overlap"] + old["answer_overlap"], old["score"]):
                        best[x["item_id"]] = x
                out[r] = [best[k] for k in sorted(best, key=lambda k: (k is None, k))]
        return out


def match_type(item_id: DataType) -> ArrayType:
    return ArrayType(StructType([StructField("item_id", item_id), StructField("score", DoubleType()),
                                 StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType())]))


def item_terms(items: DataFrame) -> DataFrame:
    """``(shard, size, term)``: the distinct words of each item of ``(shard,
    item_id, text)``, with the item's number of words in its first row, else null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words, rows = word_hashes(part.column(2))
                order = np.lexsort((words, rows))
                words, rows = words[order], rows[order]
                new = np.append(True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])) if len(words) else np.zeros(0, bool)
                size = np.bincount(rows, minlength=part.num_rows)
                terms, owner = words[new], rows[new]
                first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(size[owner], mask=~first), pa.array(terms.view(np.int64))],
                    names=["shard", "size", "term"])

    return items.mapInArrow(run, "shard int, size long, term long")


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The indexes of an item table, made one at a time, each of about
    ``shard_bytes`` of text. Counts and lengths are those of all items, so an
    item has the same scores and threshold whatever shard it is in."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    rows = rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard"), "item_id", "text")
    terms = stored(item_terms(rows))
    found, words, longest = terms.agg(F.count("size"), F.sum("size"), F.max("size")).first()
    df = stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for k in range(shards if found else 0):
        part = rows.where(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        if part.num_rows:
            mine = df.join(terms.where(F.col("shard") == k).select("term").distinct(), "term").toArrow()
            key = mine.column("term").to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(key)
            known = Statistics(found, words, longest, key[order], mine.column("df").to_numpy()[order])
            yield Index(part.column(0).to_pylist(), part.column(1).to_pylist(), known=known)
    dropped(terms, df)


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", out_col: str = "matches",
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` plus the test items in each text. With several indexes the
    table is written after each one, so a task holds one index and needs one
    Python worker; a column named ``out_col`` is replaced."""
    kind = match_type(items.schema["item_id"].dataType)
    out, found, before = docs, [], None
    for index in build(items, shard_bytes=shard_bytes):
        if found:
            after = stored(out)
            if before is not None:
                dropped(before)
            out = before = after
        found.append(free_name(out, "matches_of_shard"))
        out = append_columns(out, text_col, StructType([StructField(found[-1], kind)]),
                             lambda index=index: lambda texts: [index.matches(texts)])
    matches = F.concat(*found) if found else F.array().cast(kind)
    return out.withColumn(out_col, matches).drop(*found)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document and test item in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_matches(rows, items, shard_bytes=shard_bytes).select("doc_id", F.inline("matches"))
