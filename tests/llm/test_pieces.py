import hashlib
import random
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import prose, wide
from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    draw = random.Random(8)
    made = ["".join(draw.choices(" ab▁é\n😀ти\x00", k=draw.randint(0, 30))) for _ in range(500)]
    return ["", " ", "  ", "▁", "▁▁a", "a▁b", " a b ", "a" * 4000, "😀" * 30, "ﬁＡ", prose(1, 3000), *made]


def test_ids_equal_the_library(library):
    own = pieces.Pieces(PATH, checked=False)
    for text, found in zip(texts(), own.encode(texts())):
        assert array("I", found).tolist() == library.encode(text, add_bos=True, add_eos=True), text


def test_decoding_equals_the_library(library):
    own = pieces.Pieces(PATH, checked=False)
    draw = random.Random(2)
    rows = [library.encode(t, add_bos=True, add_eos=True) for t in texts()]
    rows += [[draw.randrange(32000) for _ in range(draw.randint(0, 12))] for _ in range(500)] + [[draw.randrange(3, 259) for _ in range(5)] for _ in range(100)]
    assert own.decode([np.array(r, np.int64) for r in rows]) == library.decode(rows)


def test_a_difference_is_an_error():
    own = pieces.Pieces(PATH)
    own.parts.clear()
    own.codes["▁a"] = own.codes["▁b"]
    with pytest.raises(ValueError, match="library"):
        own.encode(["a"])


def test_remembered_parts_are_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "_REMEMBERED", 10 * pieces._ENTRY)
    own = pieces.Pieces(PATH)
    for text in ("a b c d e", "a b f g h i", "x" * 3000, "k l", "a b m", "k n o p", " ".join("abcdefghijklmnopqrst")):
        assert array("I", own.encode([text])[0]).tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert own.held == sum(len(p) + len(i) + pieces._ENTRY for p, i in own.parts.items()) <= pieces._REMEMBERED // 2
        assert sum(len(p) + len(i) + pieces._ENTRY for p, i in own.older.items()) <= pieces._REMEMBERED


def test_runs_that_end_on_the_limit():
    assert [len(r) for r in pieces._runs(pa.array(["a" * 4, None, "bb", "cc"]), 4)] == [1, 3]
    assert list(pieces._runs(pa.array([], pa.string()))) == []
    own = pieces.Pieces(PATH)
    assert own.encode([]) == [] and own.decode([]) == []


def test_text_as_long_as_a_run(spark, library):
    text = ("word " * (1 << 18))[: 1 << 20]
    found = pieces.round_trip(wide(spark, [(1, text, None)]), PATH).first()
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert found.n_tokens == len(ids) and found.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert found.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_columns(spark, odd, odd_rows, empty, library):
    ids = odd.select("doc_id", "text", pieces.encode(F.col("text"), PATH).alias("ids"))
    back = ids.select("text", "ids", pieces.decode(F.col("ids"), PATH).alias("back")).collect()
    assert len(back) == len(odd_rows)
    for row in back:
        assert row.ids == library.encode(row.text or "", add_bos=True, add_eos=True) and row.back == (row.text or "")
    for row in pieces.round_trip(odd, PATH).collect():
        options = [library.encode(t or "", add_bos=True, add_eos=True) for i, t, _ in odd_rows if i == row.doc_id]
        assert (row.n_tokens, row.ids_sha256) in [(len(o), hashlib.sha256(np.array(o, "<u4").tobytes()).hexdigest()) for o in options]
        assert row.decoded_sha256 in [hashlib.sha256((t or "").encode()).hexdigest() for i, t, _ in odd_rows if i == row.doc_id]
    assert pieces.round_trip(empty, PATH).count() == 0
