"""Helpers shared by the operators: Arrow row mapping, vectorised word
hashing, and tables written under the shared checkpoint folder.

Python steps receive whole rows as Arrow batches. They are cut into slices of
a few megabytes of text before any work, so a task's memory depends on the
longest single text, not on the batch or partition size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 19  # temporary arrays are some 70 times that, in each task
SLICE_ROWS = 1024


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def crc_bucket(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; remainder 1 is the held-out fold. A null
    id has no remainder and is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id) == 1, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# --- Arrow row mapping -----------------------------------------------------

def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (first = 0) of a string array; null = empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of at most SLICE_BYTES of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = string_parts(batch.column(text_at))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), i + SLICE_ROWS, n)
        yield batch.slice(i, j - i)
        i = j


def append_columns(df: DataFrame, text_col: str, fields: StructType,
                   make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """``df`` with the columns ``fields`` computed from ``text_col``.

    ``make()`` runs once per task and returns a function from a string array
    to one list or array per new field. All other columns pass through; a column
    that has the name of a new one is replaced, as ``withColumn`` does.
    """
    at = df.columns.index(text_col)
    new_names = {c.lower() for c in fields.names}
    stay = [i for i, c in enumerate(df.columns) if c.lower() not in new_names]
    schema = StructType([df.schema.fields[i] for i in stay] + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        fn, out = make(), to_arrow_schema(schema)
        kept = len(out) - len(fields)
        for batch in batches:
            for part in slices(batch, at):
                new = fn(part.column(at).fill_null(""))
                new = [x if isinstance(x, pa.Array) else pa.array(x, out.field(kept + k).type)
                       for k, x in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), *new], names=out.names)

    return df.mapInArrow(run, schema)


# --- words and shingles, vectorised over a slice ---------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "power"
    table = _powers.get(key)
    if table is None or len(table) < n:
        size = max(n, 2 * SLICE_BYTES)
        base = pow(int(_ODD), -1, 1 << 64) if inverse else int(_ODD)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size <= 16 * SLICE_BYTES:  # one huge text must not stay in the worker
            _powers[key] = table
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and row of every word (run without ASCII white space)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_WHITE[data]
    left, right = np.empty_like(word), np.empty_like(word)
    left[0], right[-1] = True, True
    left[1:], right[:-1] = ~word[:-1], ~word[1:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    left[full] = True
    right[full[full > 0] - 1] = True
    starts = np.flatnonzero(word & left)
    ends = np.flatnonzero(word & right) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a difference of prefix sums of
    byte * odd**position, shifted back to the span's start, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(n, False)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(n + 1, True)[starts])


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word index of every run of ``width`` words of a
    row; a row with fewer words gives one shingle of all of them."""
    n = len(words)
    total = np.zeros(n, np.uint64)
    fits = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        if n >= width:
            m = n - width + 1
            for k in range(width):
                total[:m] += mix(words[k:k + m] + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
            fits[:m] = rows[:m] == rows[width - 1:]
        first = np.ones(n, bool)
        first[1:] = rows[1:] != rows[:-1]
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, n))
        for i, c in zip(at[counts < width], counts[counts < width], strict=True):
            total[i] = sum(int(mix(words[i + k:i + k + 1] + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))[0])
                           for k in range(c)) % (1 << 64)
            fits[i] = True
    at = np.flatnonzero(fits)
    return mix(total[at]), rows[at], at


# --- folded words: letters and digits, lower case ----------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters, byte for byte."""
    out = _FOLD[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def alnum_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and row of every run of letters (any but ASCII signs) and digits."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = _ALNUM[data]
    left, right = word.copy(), word.copy()
    cut = np.zeros(len(data), bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    left[1:] &= ~word[:-1] | cut[1:]
    right[:-1] &= ~word[1:] | cut[1:]
    starts = np.flatnonzero(left)
    return starts, np.flatnonzero(right) + 1, np.searchsorted(offsets, starts, side="right") - 1


# --- shared tables ----------------------------------------------------------

def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder."""
    from tablefill.session import materialize
    return materialize(df)


def dropped(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``stored`` returned and nothing reads any more."""
    from tablefill.session import discard
    discard(*frames)
