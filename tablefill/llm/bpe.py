"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode_decode`` encodes every whole text and decodes the ids again as raw
bytes. Long texts are first cut where a match of the split pattern must end
whatever follows, so the ids are those of the uncut text:

* before white space that follows anything else (no alternative of the
  pattern runs from other characters into white space);
* a very long run of white space before another character is one match
  without its last character (the pattern's look-ahead leaves that one), so
  it is merged as a single piece and never reaches the regex engine, whose
  backtracking stack such a run exhausts.

Null and empty texts have no ids; repeated rows and ids stay as they are.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tablefill.llm.common import append_columns

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 50_000   # texts beyond this are encoded in pieces of about this size
WHITE_RUN = 2_000      # white-space runs from this length are taken out of the regex's way

#: Unicode White_Space (fixed values): what ``\\s`` is to the split pattern.
WHITE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LONG_RUN = re.compile(f"[{WHITE}]{{{WHITE_RUN},}}")
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a rank file, loaded once per Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pieces(text: str, size: int = PIECE_CHARS):
    """``(piece, is_white_run)`` parts of a text, cut only where a match ends."""
    start = 0
    for run in [*_LONG_RUN.finditer(text)] if len(text) >= WHITE_RUN else []:
        # one match: all of the run, or all but the last character before more text
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from _cut(text, start, run.start(), size)
        yield text[run.start():end], True
        start = end
    yield from _cut(text, start, len(text), size)


def _cut(text: str, start: int, end: int, size: int):
    while end - start > size:
        cut = _CUT.search(text, start + size, end)
        if cut is None or cut.start() >= end:
            break
        yield text[start:cut.start()], False
        start = cut.start()
    if end > start:
        yield text[start:end], False


def encode_text(enc, text: str) -> list[int]:
    if len(text) < WHITE_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, white in pieces(text):
        ids += enc._encode_single_piece(part) if white else enc.encode_ordinary(part)
    return ids


def encode_decode(docs: DataFrame, text_col: str = "text", rank_file: str | None = None,
                  ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` plus the ids (little-endian unsigned 32-bit) and the bytes they
    decode to, which are the text's UTF-8 bytes."""
    if rank_file is None:
        import public_tokenizers
        rank_file = public_tokenizers.path(RANK_FILE)

    def make():
        enc = encoder(rank_file)

        def run(texts: pa.Array) -> list:
            ids, out = [], []
            for text in texts.to_pylist():
                x = encode_text(enc, text)
                ids.append(np.array(x, "<u4").tobytes())
                out.append(enc.decode_bytes(x))
            return [ids, out]
        return run

    return append_columns(docs, text_col, StructType([
        StructField(ids_col, BinaryType()), StructField(decoded_col, BinaryType())]), make)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of tokens, SHA-256 of the ids and of the decoded bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return encode_decode(rows).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
