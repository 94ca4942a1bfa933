"""Ids against the library's own, decoding, and texts cut at safe places."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from tablefill.llm import bpe

PATH = public_tokenizers.path(bpe.RANK_FILE)


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH)


TEXTS = ["", " ", "a", "It's we'll 'S don't", "x  y   z \n\n w", "\tmixed \r\n lines\x85\xa0 and　wide", "ein Maß über 12345 №5",
         "日本語のテキスト 123 abc", "emoji 👍🏽 ok", "trailing   ", "\x1c\x1d odd \x1f", "'s's 's"]


@pytest.mark.parametrize("text", TEXTS)
def test_cut_texts_have_the_ids_of_whole_texts(enc, text):
    whole = enc.encode_ordinary(text * 40)
    cut = [i for part, white in bpe.pieces(text * 40, size=7) for i in (enc._encode_single_piece(part) if white else enc.encode_ordinary(part))]
    assert cut == whole
    assert "".join(p for p, _ in bpe.pieces(text * 40, size=7)) == text * 40


@pytest.mark.parametrize("tail", ["", "x", "\n", "1", "!"])
def test_long_white_space(enc, tail):
    for run in (" " * 2500, " \t" * 1300, "\n" * 2100):
        text = "ab" + run + tail
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_endless_white_space_does_not_break(enc):
    text = " \t" * 400_000 + "x"
    assert enc.decode_bytes(bpe.encode_text(enc, text)) == text.encode()


def test_awkward_rows(spark, awkward, nothing, enc):
    got = bpe.token_digests(awkward).collect()
    assert len(got) == awkward.count()
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.token_digests(nothing).count() == 0
