"""Token ids in binary files with Elias-Fano encoded document boundaries.

Documents are range-partitioned and sorted by id; each task encodes its texts
and writes files of at most ``SHARD_IDS`` ids (one longer text alone) into the
shared folder. Ids of a vocabulary below 65,536 take two bytes.

File layout, little-endian:

    magic "EFID", version, id bytes, number of documents, of those without an
    id (they come first), number of ids, smallest document id, byte lengths of
    the two Elias-Fano sections; then section 1 (document ids less the
    smallest), section 2 (start of each document in the id array, then its
    end), then the id array.

A sequence of n sorted numbers up to u takes about 2 + log2(u / n) bits each:
the low bits packed, the high bits as unary gaps in a bit vector, plus the
bit position of every 64th one, from which ``select`` scans a few words.

The tokenizers library encodes each distinct piece of text once per worker
and the ids are kept in flat arrays under the piece's 64-bit hash. Texts of
ASCII and Latin-1 letters, which normalisation only puts into lower case, are
split by the vocabulary's own pattern (contractions, runs of letters, single
digits, runs of other signs), a slice of texts at a time in numpy; every match
is encoded on its own, so the ids of a text are those of its pieces in a row.
Any other text is cut at white space, which the vocabulary drops and never
joins characters across, and its words go to the library whole. Null and empty texts have the end id
alone; documents with equal ids are ordered by a hash of their texts, null ids
come first. Ids are whole numbers (another type raises ``ValueError``). Reading goes
through ``select``, a block of documents at a time, by a directory of 32 bits a byte.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablefill.llm.common import slices, span_hashes, string_parts

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 16 << 20
CACHE_PIECES = 3_000_000  # of about 25 bytes
SAMPLE = 64
BLOCK = 8192  # values that are packed or selected at a time
_HEAD = struct.Struct("<4sBBIIQqQQ")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")

#: Byte classes of lower-case ASCII and Latin-1 text: 0 white space, 1 letter, 2 digit, 3 other, 4 not plain.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = _CLASS[65:91] = 1
_CLASS[48:58] = 2
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe, of the vocabulary's pattern


# --- Elias-Fano -------------------------------------------------------------

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POPCOUNT = _BITS.sum(axis=1).astype(np.uint8)
_NTH_ONE = np.argsort(1 - _BITS, axis=1, kind="stable")  # place of the k-th one of a byte


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    _meta = struct.Struct("<IBQQ")  # count, low bits, bytes of low part, bytes of high part

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._ones: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            z = np.zeros(0, np.uint8)
            return cls(0, 0, z, z, np.zeros(0, np.uint32))
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            places = np.arange(bits, dtype=np.uint64)  # a block's low parts fill whole bytes
            low = np.concatenate([np.packbits(((v[k:k + BLOCK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
                                  for k in range(0, n, BLOCK)])
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (self._meta.pack(self.n, self.low_bits, len(self.low), len(self.high))
                + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: memoryview | bytes) -> EliasFano:
        n, bits, a, b = cls._meta.unpack_from(data)
        at = cls._meta.size
        return cls(n, bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a),
                   np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first // 8:(first + self.low_bits + 7) // 8]
        return int.from_bytes(part.tobytes(), "little") >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, 64 bits at a time."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = int.from_bytes(self.high[at // 8:at // 8 + 8].tobytes(), "little") >> at % 8 << at % 8
        base = at // 8 * 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            base += 64
            word = int.from_bytes(self.high[base // 8:base // 8 + 8].tobytes(), "little")
        for _ in range(left):
            word &= word - 1
        at = base + (word & -word).bit_length() - 1
        return at - i << self.low_bits | self._low(i)

    def directory(self) -> np.ndarray:
        """Ones up to each byte of the high part, 32 bits a byte: what
        ``select_many`` looks places up in."""
        if self._ones is None:
            self._ones = np.cumsum(_POPCOUNT[self.high], dtype=np.uint32)
        return self._ones

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``: each by its byte in the directory, the
        one within the byte, and its low bits."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("no such place")
        ones = self.directory()
        byte = np.searchsorted(ones, i.astype(np.uint32), side="right")
        left = i - (ones[byte].astype(np.int64) - _POPCOUNT[self.high[byte]])
        at = byte * 8 + _NTH_ONE[self.high[byte], left]
        out = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
            planes = self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            out |= planes.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out


# --- files ------------------------------------------------------------------

def pack_shard(doc_ids: list[int | None], blobs: list[bytes], width: int) -> bytes:
    """One file: ids of documents in ascending order and their encoded ids."""
    nulls = sum(x is None for x in doc_ids)
    known = doc_ids[nulls:]
    least = known[0] if known else 0
    ends = np.cumsum([0] + [len(b) // width for b in blobs]).astype(np.uint64)
    a = EliasFano.encode(np.array([x - least for x in known], np.uint64)).to_bytes()
    b = EliasFano.encode(ends).to_bytes()
    head = _HEAD.pack(b"EFID", 1, width, len(doc_ids), nulls, int(ends[-1]), least, len(a), len(b))
    return b"".join([head, a, b, *blobs])


class Shard:
    """A file read back: ``ids(i)`` finds its document by two selects."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_null, self.n_ids, self.least, a, b = _HEAD.unpack_from(data)
        if magic != b"EFID" or version != 1:
            raise ValueError("not a token file")
        view, at = memoryview(data), _HEAD.size
        self.docs = EliasFano.from_bytes(view[at:at + a])
        self.bounds = EliasFano.from_bytes(view[at + a:at + a + b])
        self.array = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + a + b)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.docs.select(i - self.n_null)

    def documents(self, first: int, end: int) -> tuple[list[int | None], np.ndarray]:
        """Ids and bounds (one more) of documents ``[first, end)``, by selects."""
        bounds = self.bounds.select_many(np.arange(first, end + 1)).astype(np.int64)
        nulls = max(0, min(end, self.n_null) - first)
        known = self.docs.select_many(np.arange(max(first, self.n_null), max(end, self.n_null)) - self.n_null)
        return [None] * nulls + [self.least + int(x) for x in known], bounds

    def ids(self, i: int) -> np.ndarray:
        return self.array[self.bounds.select(i):self.bounds.select(i + 1)]


# --- encoding ---------------------------------------------------------------

def plain_pieces(data: np.ndarray, offsets: np.ndarray):
    """Lower-case bytes of a slice, starts and ends of the pattern's matches
    in it, and which rows hold other characters than ASCII and Latin-1 letters."""
    n = len(data)
    kind, low = _CLASS[data], data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if n > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF)
                              & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = 1
        low[lead + 1] += np.where(data[lead + 1] <= 0x9E, np.uint8(32), np.uint8(0))
    rows_with = np.flatnonzero(kind == 4)
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, rows_with, side="right") - 1] = True
    start, end = np.ones(n, bool), np.ones(n, bool)
    if n > 1:
        cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        bounds = offsets[1:-1]
        cut[bounds[(bounds > 0) & (bounds < n)] - 1] = True
        start[1:], end[:-1] = cut, cut
    # an apostrophe that begins a match takes s, t, re, ... after it
    quote = np.flatnonzero((data == 39) & start & end)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[np.minimum(quote + 1, n - 1)] == 1) & (odd[np.searchsorted(offsets, quote, side="right") - 1]
                  == odd[np.searchsorted(offsets, quote + 1, side="right") - 1])
                  & (np.searchsorted(offsets, quote, side="right") == np.searchsorted(offsets, quote + 1, side="right"))]
    row_end = offsets[np.searchsorted(offsets, quote, side="right")]
    pending = np.ones(len(quote), bool)
    for letters in _CONTRACTIONS:
        at = quote + len(letters)
        fits = pending & (at < row_end)
        for k, c in enumerate(letters.encode()):
            fits &= low[np.minimum(quote + 1 + k, n - 1)] == c
        hit, last = quote[fits], at[fits]
        pending &= ~fits
        end[hit] = start[hit + 1] = False
        end[last] = True
        more = last[(last + 1 < row_end[fits])] + 1
        start[more] = True
    word = kind != 0
    return low, np.flatnonzero(start & word), np.flatnonzero(end & word) + 1, odd


class WordEncoder:
    """Texts to id bytes; each distinct piece is encoded once, in batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = END_ID.to_bytes(self.width, "little")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)      # sorted hashes of known pieces
        self.starts = np.zeros(0, np.int64)     # and where their ids begin and end
        self.stops = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Pieces go to the library a few hundred a call, with spaces between:
        each gives one run of ids, whose last is a token that ends a word."""
        ids = [np.array(self.tokenizer.encode(" ".join(new[i:i + 512]), add_special_tokens=False).ids, self.kind)
               for i in range(0, len(new), 512)]
        flat = np.concatenate(ids)
        stops = np.flatnonzero(self.ends_word[flat]) + 1
        if len(stops) != len(new):
            raise ValueError("the vocabulary splits a piece that its pattern keeps together")
        starts = np.append(0, stops[:-1]) + len(self.ids)
        keys, starts, stops = (np.concatenate(x) for x in (
            (self.keys, keys), (self.starts, starts), (self.stops, stops + len(self.ids))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.stops = keys[order], starts[order], stops[order]
        self.ids = np.concatenate([self.ids, flat])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        data, offsets = string_parts(texts)
        low, starts, ends, odd = plain_pieces(data, offsets)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        plain = ~odd[rows]
        starts, ends, rows = starts[plain], ends[plain], rows[plain]
        if len(self.keys) > CACHE_PIECES:
            self.forget()
        kinds, one, which = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        known = np.zeros(len(kinds), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == kinds[at < len(self.keys)]
        if not known.all():
            raw = low.tobytes()
            new = one[~known]
            self._learn(kinds[~known], [raw[a:b].decode() for a, b in
                                        zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, kinds)
        begin = self.starts[at][which]
        count = self.stops[at][which] - begin
        total = np.append(0, np.cumsum(count))
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(rows, np.arange(len(offsets)))].tolist()
        raw, w = ids.tobytes(), self.width
        out = [raw[a * w:b * w] + self.end for a, b in zip(bounds, bounds[1:], strict=False)]
        if odd.any():
            for i in np.flatnonzero(odd).tolist():
                words = _SPACE.split(texts[i].as_py())
                kinds = [*{*words}]
                got = self.tokenizer.encode_batch_fast(kinds, add_special_tokens=False)
                find = dict(zip(kinds, (np.array(e.ids, self.kind).tobytes() for e in got), strict=True))
                out[i] = b"".join(map(find.__getitem__, words)) + self.end
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _folder(spark: SparkSession) -> str:
    from tablefill.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base}/tokens-{uuid.uuid4().hex}"


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files (named by partition and number, so in document order)
    and return ``(name, n_docs, n_ids)`` of each. A repeated task writes the
    same bytes under the same name, by a rename."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path(VOCABULARY)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("boundaries are kept by document ids, which must be whole numbers")
    # rows of one id are told apart by their texts' hashes, so no id fills a range
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow.fs import FileSystem
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ids: list = []
        blobs: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            name = f"part-{part:06d}-{number:06d}.efid"
            tmp = f"{base}/_{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as out:
                out.write(pack_shard(ids, blobs, encode.width))
            try:
                fs.move(tmp, f"{base}/{name}")
            except OSError:  # another attempt of this task was first, with the same bytes
                if not fs.get_file_info(f"{base}/{name}").is_file:
                    raise
                fs.delete_file(tmp)
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(ids)], "n_ids": [size]})
            ids.clear()
            blobs.clear()
            size, number = 0, number + 1
            return row

        for batch in batches:
            for s in slices(batch, 1):
                got = encode(s.column(1).fill_null(""))
                for i, blob in zip(s.column(0).to_pylist(), got, strict=True):
                    count = len(blob) // encode.width
                    if ids and size + count > shard_ids:
                        yield flush()
                    ids.append(i)
                    blobs.append(blob)
                    size += count
        if ids:
            yield flush()

    return rows.mapInArrow(run, "name string, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, doc_id, local_start, n_tokens, ids_crc32)`` of every document in the files."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.efid").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                for first in range(0, shard.n_docs, BLOCK):
                    docs, bounds = shard.documents(first, min(first + BLOCK, shard.n_docs))
                    crcs = [zlib.crc32(shard.array[a:b].astype("<u4").tobytes())
                            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(bounds[:-1]),
                         pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                        names=["name", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents, read the files back: per document its global
    start, its number of ids and their checksum. An empty table gives no row."""
    spark = docs.sparkSession
    folder = _folder(spark)
    from tablefill.llm.common import stored
    made = stored(write_tokens(docs, folder, id_col, text_col))
    if made.isEmpty():
        return made.selectExpr("n_ids AS doc_id", "n_ids AS start", "n_ids AS n_tokens", "n_ids AS ids_crc32")
    # one row per file, a few million ids each
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    base = made.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return (read_tokens(spark, folder).join(base, "name")
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))
