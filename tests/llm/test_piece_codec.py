import random

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from quirefold.llm import piece_codec

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return piece_codec.PieceCodec(f.read())


def test_random_texts_as_the_library(codec, library):
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "1", ".", "²", "😀", "漢", "▁", "\x00", "<s>", "<0x0A>", "क", "ि", *codec.pieces[261:1200:7]]
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(30)))
        ids = np.frombuffer(codec.encode(text), "<i4").tolist()
        assert ids == library.encode(text, add_eos=True), text
        assert codec.decode(ids) == library.decode(ids)


def test_random_ids_decode_as_the_library(codec, library):
    draw = random.Random(6)
    for _ in range(4000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32000)]) for _ in range(draw.randrange(9))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_edges(spark, library):
    long = "word " * 40_000 + "x" * 5_000
    rows = [(1, None, "q"), (2, "", "q"), (3, " a ", None), (3, " a ", None), (None, "b", "q"), (4, long, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = piece_codec.decode(piece_codec.encode(df, MODEL), MODEL).collect()
    assert len(got) == 6
    for row in got:
        assert row.ids == library.encode(row.text or "", add_eos=True)
        assert row.decoded == (row.text or "")
    both = piece_codec.encode_and_decode(df, MODEL, keep=["doc_id"])
    assert sorted(map(str, both.collect())) == sorted(map(str, piece_codec.decode(piece_codec.encode(df, MODEL), MODEL, keep=["doc_id", "ids"]).collect()))
    assert piece_codec.encode(df.where(F.lit(False)), MODEL).count() == 0


def test_texts_decoded_together_as_the_library(codec, library, monkeypatch):
    """Ids of many texts are decoded at once; texts were decoded one by one."""
    draw = random.Random(7)
    lists = [[draw.choice([draw.randrange(300), draw.randrange(32000)]) for _ in range(draw.randrange(9))] for _ in range(4000)]
    lists += [library.encode(t, add_eos=True) for t in ("", " a", "é😀漢", "  x", "<s>", "▁")]
    flat, starts = np.array([i for x in lists for i in x], "i4"), np.cumsum([0, *map(len, lists)])
    assert codec.decode_all(flat, starts).to_pylist() == [library.decode(x) for x in lists]
    assert codec.decode_all(np.array([], "i4"), np.array([0, 0])).to_pylist() == [""]
    plain = [library.encode(t, add_eos=True) for t in ("the word", "  two  words", "")]
    monkeypatch.setattr(codec, "decode", None)
    assert codec.decode_all(np.array(sum(plain, []), "i4"), np.cumsum([0, *map(len, plain)])).to_pylist() == ["the word", "  two  words", ""]
