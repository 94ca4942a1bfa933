"""Phrase collocations from FM-indexes over word ids.

ASCII letters are lower-cased; texts fall into pieces at ``[.,;:!?]`` and line
breaks, pieces into words at spaces and tabs. Each task packs the documents of
a language into shards of bounded size. A shard numbers its words, separates
pieces by 0, and keeps the Burrows-Wheeler transforms of that sequence and of
its reverse, sorted by DEPTH words, which is as deep as any interval is read.

In both indexes a phrase is an interval of as many rows as it has occurrences.
Extending it to the left splits its interval in the forward index by the
symbols of the transform there; the size of each part is the count of the
longer phrase, its place follows from the last-to-first mapping, and its
interval in the reverse index from the parts before it. To the right it is the
same with the indexes exchanged.

Counts are summed across shards, one phrase length after another, so that a
shard only extends what is frequent in its whole language: all words; pairs of
frequent words (to the left); runs of three and four words whose pairs are
frequent (to the right, then to the left). What is frequent goes back to the
shards that hold it as rows of the same window that summed it; nothing is
broadcast, and a word has at most one row a shard. A frequent word is named by
the first shard that holds it and its number there, so all sums are over integers.

Counts cover all words of all texts, overlaps included. Null and empty texts
have no words, a null language is ``und``, ids are not read, repeated rows count again.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefill.llm.common import dropped, slices, stored, string_parts

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
ABSORBED = 80  # per cent of a phrase's occurrences that lie in one longer phrase
SHARD_BYTES = 6 << 20
SCALE = 2_000_000
_SEQUENCE = 14  # bits of a shard's number within its task
_LOCAL = 29  # bits of a word's number within its shard
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts: the bytes of all words, the words' lengths, and
    whether a word begins a piece."""
    inside = ~(_BLANK[data] | _BREAK[data])
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    starts_text = starts_text[:-1]
    begin |= inside & starts_text
    at = np.flatnonzero(begin)
    word = np.cumsum(begin)[inside] - 1
    lengths = np.bincount(word, minlength=len(at)).astype(np.int64)
    pieces = np.cumsum(_BREAK[data] | starts_text)[at]
    return data[inside], lengths, np.append(True, pieces[1:] != pieces[:-1]) if len(at) else np.zeros(0, bool)


def ranks(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Order of the suffixes of ``ids`` by their first ``depth`` symbols
    (a power of two), then by place; what lies past the end sorts first."""
    rank, width = ids.astype(np.int64), 1
    while True:
        step = np.zeros(len(rank), np.int64)
        step[:-width or None] = rank[width:] + 1
        key = rank * (len(rank) + int(rank.max(initial=0)) + 2) + step
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= depth:
            return order
        new = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = np.empty(len(ids), np.int64)
        rank[order] = new


def transform(ids: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, in the order of the suffixes."""
    order = ranks(ids)
    return ids[order - 1].astype(np.int32)  # before the first comes the last, a separator


def build(words: list, lengths: list, begins: list) -> dict:
    """Index of a shard: vocabulary (bytes, offsets) and both transforms."""
    data, size, begin = (np.concatenate(x) for x in (words, lengths, begins))
    ends = np.append(0, np.cumsum(size))
    coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    symbol = coded.indices.to_numpy().astype(np.int64) + 1
    ids = np.zeros(len(symbol) + int(begin.sum()) + 1, np.int64)  # a separator before each piece and at the end
    ids[np.arange(len(symbol)) + np.cumsum(begin)] = symbol
    return {"words": coded.dictionary, "forward": transform(ids), "reverse": transform(ids[::-1])}


class Index:
    """Both transforms of a shard with their last-to-first mappings.

    Phrases are three arrays: begin in the forward index, begin in the
    reverse index, and count."""

    def __init__(self, **transforms: np.ndarray):
        self.bwt = transforms
        self.first = {}
        self.step = {}
        for side, bwt in transforms.items():
            order = np.argsort(bwt, kind="stable")
            self.step[side] = np.empty(len(bwt), np.int64)
            self.step[side][order] = np.arange(len(bwt))

    def counts(self) -> np.ndarray:
        return np.bincount(next(iter(self.bwt.values())))

    def singles(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = self.counts()
        begin = np.cumsum(counts) - counts
        return begin[symbols], begin[symbols], counts[symbols]

    def extend(self, side: str, here: np.ndarray, there: np.ndarray, counts: np.ndarray):
        """All extensions of the phrases on one side (``forward``: to the
        left): parent, symbol, begin in this index, begin in the other one, count."""
        bwt, step = self.bwt[side], self.step[side]
        parent = np.repeat(np.arange(len(counts)), counts)
        rows = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts) + here[parent]
        symbol = bwt[rows].astype(np.int64)
        order = np.argsort(parent * (int(bwt.max(initial=0)) + 1) + symbol, kind="stable")
        parent, symbol, rows = parent[order], symbol[order], rows[order]
        if not len(order):
            return parent, symbol, rows, rows, rows
        new = np.flatnonzero(np.append(True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])))
        size = np.diff(np.append(new, len(order)))
        begin = np.cumsum(counts) - counts  # of the parent's rows among all
        return parent[new], symbol[new], step[rows[new]], there[parent[new]] + new - begin[parent[new]], size


def cut_at_pieces(words: np.ndarray, lengths: np.ndarray, begins: np.ndarray, most: int) -> Iterator[tuple]:
    """A long text's words in parts of about ``most`` bytes that end with a piece."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        want = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        later = np.flatnonzero(begins[want:])
        end = want + int(later[0]) if len(later) else len(lengths)
        yield words[ends[at] - lengths[at]:ends[end - 1]], lengths[at:end], begins[at:end]
        at = end


def shard_rows(docs: DataFrame, lang: Column, text: Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(shard, lang, n_words, words, forward, reverse)``: the indexes of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        made = TaskContext.get().partitionId() << _SEQUENCE
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            size.pop(lang)
            parts = held.pop(lang)
            index = build(*zip(*parts, strict=True))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([made - 1], pa.int64()), pa.array([lang]), pa.array([sum(len(x[1]) for x in parts)], pa.int64()),
                 pa.array([packed_words(index["words"])], pa.binary()),
                 *(pa.array([packed_symbols(index[c])], pa.binary()) for c in ("forward", "reverse"))],
                names=["shard", "lang", "n_words", "words", "forward", "reverse"])

        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(0).dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = np.flatnonzero(langs.indices.to_numpy() == k)
                    data, offsets = string_parts(part.column(1).take(pa.array(mine)))
                    for found in cut_at_pieces(*words_of(_LOWER[data], offsets), shard_bytes):
                        held.setdefault(lang, []).append(found)
                        size[lang] = size.get(lang, 0) + len(found[0])
                        if size[lang] >= shard_bytes:
                            yield out(lang)
                while sum(size.values()) >= 8 * shard_bytes:
                    yield out(max(size, key=size.get))
        for lang in list(held):
            yield out(lang)

    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text")).mapInArrow(
        run, "shard long, lang string, n_words long, words binary, forward binary, reverse binary")


def packed_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", pa.large_string())])) as out:
        out.write(pa.record_batch([words.cast(pa.large_string())], names=["w"]))
    return sink.getvalue().to_pybytes()


def unpacked_words(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def packed_symbols(ids: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte plane, compressed; their count before them."""
    planes = np.ascontiguousarray(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def symbols(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def word_rows(shards: DataFrame) -> DataFrame:
    """``(lang, word, shard, local, n)`` of every word of every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words, forward in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.bincount(symbols(forward))[1:]
                yield from small_batches(
                    lang=constant(lang, len(counts)), word=unpacked_words(words).cast(pa.string()), shard=constant(shard, len(counts)),
                    local=np.arange(1, len(counts) + 1, dtype=np.int32), n=counts)

    return shards.select("shard", "lang", "words", "forward").mapInArrow(run, "lang string, word string, shard long, local int, n long")


def constant(value, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string() if isinstance(value, str) else pa.int64()), n)


def small_batches(**columns) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
    for at in range(0, whole.num_rows, 1 << 15):
        yield whole.slice(at, 1 << 15)


def frequent_words(words: DataFrame) -> DataFrame:
    """``(shard, local, word_id, total, lang, word)`` of the frequent words, in
    every shard that holds them; language and word stand in one of these rows."""
    same = Window.partitionBy("lang", "word")
    here = F.shiftleft("shard", _LOCAL) + F.col("local")
    rows = words.withColumn("total", F.sum("n").over(same)).withColumn("word_id", F.min(here).over(same)).where(F.col("total") >= MIN_COUNT)
    return rows.select("shard", "local", "word_id", "total", *(F.when(F.col("word_id") == here, F.col(c)).alias(c) for c in ("lang", "word")))


def with_shards(shards: DataFrame, kept: DataFrame, run, schema: str) -> DataFrame:
    """``run(index row, kept rows)`` for every shard that has kept rows."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def go(index: pa.Table, kept: pa.Table) -> pa.Table:
        columns = run(index.to_pylist()[0], kept) if kept.num_rows else {c: [] for c in names}
        return pa.table({c: columns[c] for c in names})

    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(StructType.fromDDL(schema))
    return shards.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(lambda a, b: go(a, b).cast(out), schema)


def local_pairs(index: Index, local: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs of the words ``local`` in a fixed order: first and second
    word, begin in both indexes, count."""
    known = np.zeros(len(index.counts()), bool)
    known[local] = True
    local = np.flatnonzero(known)
    second, first, fwd, rev, n = index.extend("forward", *index.singles(local))
    good = known[first]
    return first[good], local[second[good]], fwd[good], rev[good], n[good]


def pair_rows(shards: DataFrame, words: DataFrame) -> DataFrame:
    """``(first, second, name, n)`` of every pair of frequent words of every
    shard: the words' ids, and a name made of the shard and the pair's place in it."""
    def run(row: dict, kept: pa.Table) -> dict:
        local, name = (kept.column(c).to_numpy() for c in ("local", "word_id"))
        index = Index(forward=symbols(row["forward"]))
        names = np.zeros(len(index.counts()), np.int64)
        names[local] = name
        first, second, _, _, n = local_pairs(index, local)
        return {"first": names[first], "second": names[second], "name": (row["shard"] << _LOCAL) + np.arange(len(n)), "n": n}

    return with_shards(shards.select("shard", "forward"), words.select("shard", "local", "word_id"), run,
                       "first long, second long, name long, n long")


def frequent_pairs(pairs: DataFrame) -> DataFrame:
    """``(shard, place, pair_id, total, first, second)`` of the frequent pairs, in
    every shard that holds them; the words stand in one of these rows."""
    same = Window.partitionBy("first", "second")
    rows = pairs.withColumn("total", F.sum("n").over(same)).withColumn("pair_id", F.min("name").over(same)).where(F.col("total") >= MIN_COUNT)
    lead = F.col("pair_id") == F.col("name")
    return rows.select(F.shiftright("name", _LOCAL).alias("shard"), F.col("name").bitwiseAND((1 << _LOCAL) - 1).alias("place"), "pair_id", "total",
                       *(F.when(lead, F.col(c)).alias(c) for c in ("first", "second")))


def longer_rows(shards: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(size, x, y, n)``: counts in each shard of the phrases of three and
    four words whose pairs are frequent, named by their first and last pair."""
    def run(row: dict, kept: pa.Table) -> dict:
        at, name = (kept.column(c).to_numpy() for c in ("at", "name"))
        single = kept.column("single").to_numpy(zero_copy_only=False)
        index = Index(forward=symbols(row["forward"]), reverse=symbols(row["reverse"]))
        places = local_pairs(index, at[single])
        a, b, fwd, rev, n = (x[at[~single]] for x in places)
        order = np.argsort(a << 32 | b)
        a, b, fwd, rev, n, pair = (x[order] for x in (a, b, fwd, rev, n, name[~single]))
        known = a << 32 | b

        def place(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = first << 32 | second
            where = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            return where, (known[where] == key) if len(known) else np.zeros(len(key), bool)

        parent, c, rev, fwd, n = index.extend("reverse", rev, fwd, n)  # to the right
        last, good = place(b[parent], c)
        first, last, fwd, rev, n = (x[good] for x in (parent, last, fwd, rev, n))
        parent, d, _, _, m = index.extend("forward", fwd, rev, n)  # to the left
        before, good = place(d, a[first[parent]])
        parent, before, m = (x[good] for x in (parent, before, m))
        return {"size": np.repeat(np.array([3, 4], np.int32), [len(n), len(m)]), "x": np.append(pair[first], pair[before]),
                "y": np.append(pair[last], pair[last[parent]]), "n": np.append(n, m)}

    kept = (words.select("shard", F.col("local").cast("long").alias("at"), F.col("word_id").alias("name"), F.lit(True).alias("single"))
            .unionByName(pairs.select("shard", F.col("place").alias("at"), F.col("pair_id").alias("name"), F.lit(False).alias("single"))))
    return with_shards(shards.select("shard", "forward", "reverse"), kept, run, "size int, x long, y long, n long")


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a / (left + right))`` in exact decimals."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.floor((big(a) * F.lit(SCALE).cast("decimal(8,0)") - big(a) * F.lit(SCALE).cast("decimal(8,0)") % (big(left) + big(right)))
                   / (big(left) + big(right))).cast("long")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of two to four words, with ``a`` and the lowest cut
    ``(l, r, score)`` of each, and the number of words of each language."""
    shards = stored(shard_rows(docs, F.col(lang_col), F.col(text_col), shard_bytes))
    words = stored(frequent_words(word_rows(shards)))
    pairs = stored(frequent_pairs(pair_rows(shards, words)))
    longer = stored(longer_rows(shards, words, pairs).groupBy("size", "x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= MIN_COUNT))
    sizes = stored(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))
    named = words.where("word IS NOT NULL")
    two = pairs.where("first IS NOT NULL").select("pair_id", "first", "second", "total")
    for at, k in (("first", 1), ("second", 2)):
        two = two.join(named.select(F.col("word_id").alias(at), F.col("word").alias(f"t{k}"), F.col("total").alias(f"f{k}"),
                                    *(["lang"] if k == 1 else [])), at)
    two = stored(two)
    dropped(shards, words, pairs)
    none = F.lit(-1).cast("long")
    key = ["w1", "w2", "w3", "w4"]
    ends = [two.select(F.col("pair_id").alias(p), F.col("first").alias(f"{p}1"), F.col("second").alias(f"{p}2"), F.col("t1").alias(f"{p}t1"),
                       F.col("t2").alias(f"{p}t2"), F.col("f1").alias(f"{p}f1"), F.col("f2").alias(f"{p}f2"), F.col("total").alias(f"{p}n"),
                       *(["lang"] if p == "x" else [])) for p in ("x", "y")]
    longer = longer.join(ends[0], "x").join(ends[1], "y")
    grams = stored(
        two.select(F.col("first").alias("w1"), F.col("second").alias("w2"), none.alias("w3"), none.alias("w4"), F.lit(2).alias("size"), "lang",
                   F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("total").alias("a"), F.col("f1").alias("head"), F.col("f2").alias("tail"),
                   F.col("total").alias("first_pair"), F.col("total").alias("last_pair"))
        .unionByName(longer.select(
            F.col("x1").alias("w1"), F.col("x2").alias("w2"), F.when(F.col("size") == 3, F.col("y2")).otherwise(F.col("y1")).alias("w3"),
            F.when(F.col("size") == 3, none).otherwise(F.col("y2")).alias("w4"), "size", "lang",
            F.concat_ws(" ", "xt1", "xt2", F.when(F.col("size") == 4, F.col("yt1")), "yt2").alias("phrase"), "a",
            F.col("xf1").alias("head"), F.col("yf2").alias("tail"), F.col("xn").alias("first_pair"), F.col("yn").alias("last_pair"))))
    three = grams.where("size = 3").select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("w3").alias("z"), F.col("a").alias("sum"))
    four = grams.where("size = 4")
    for out, at in (("first_three", "w1 w2 w3"), ("last_three", "w2 w3 w4")):
        same = three.withColumnsRenamed(dict(zip("xyz", at.split(), strict=True))).withColumnRenamed("sum", out)
        four = four.join(same, at.split())
    grams = grams.where("size < 4").withColumns({c: F.lit(0).cast("long") for c in ("first_three", "last_three")}).unionByName(four)

    def cut(k: int, left: str, right: str) -> Column:
        return F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                        F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = (F.when(F.col("size") == 2, F.array(cut(1, "head", "tail")))
            .when(F.col("size") == 3, F.array(cut(1, "head", "last_pair"), cut(2, "first_pair", "tail")))
            .otherwise(F.array(cut(1, "head", "last_three"), cut(2, "first_pair", "last_pair"), cut(3, "first_three", "tail"))))
    grams = grams.withColumn("cut", F.array_min(cuts)).select(*key, "size", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return grams, sizes


def absorbed(grams: DataFrame) -> DataFrame:
    """The greatest count of a longer phrase around each shorter one: ``(w1 .. w4, longest)``."""
    none = F.lit(-1).cast("long")
    inner = []
    for size, width in ((3, 2), (4, 2), (4, 3)):
        for k in range(size - width + 1):
            at = [F.col(f"w{k + j + 1}") if j < width else none for j in range(4)]
            inner.append(grams.where(F.col("size") == size).select(*(c.alias(f"w{j + 1}") for j, c in enumerate(at)), "a"))
    return reduce(DataFrame.unionByName, inner).groupBy("w1", "w2", "w3", "w4").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    grams, sizes = phrases(docs, lang_col, text_col, shard_bytes)
    grams = stored(grams)
    key = ["w1", "w2", "w3", "w4"]
    big = lambda c: F.col(c).cast("decimal(19,0)")
    left = (grams.join(absorbed(grams), key, "left")
            .where(F.col("longest").isNull() | (big("longest") * 100 < big("a") * ABSORBED)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k AS size, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, size, g, count(*) AS a FROM grams GROUP BY lang, size, g HAVING count(*) >= {MIN_COUNT}
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.size, c.g, c.a, k, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k)
  JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.size)
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_grams AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS longest
  FROM (SELECT lang, g, a, m, unnest(range(1, size - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < size AND size > 2)
  GROUP BY ALL
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_grams i ON i.lang = l.lang AND i.g = l.g
  WHERE i.longest IS NULL OR 100::HUGEINT * i.longest < {ABSORBED}::HUGEINT * l.a
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}"""
