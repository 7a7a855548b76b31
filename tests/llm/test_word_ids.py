"""Ids of words: what a worker keeps, and the projections made of them."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from orbtable.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_plain_pieces_are_kept_once():
    words, library, asked = packing.WordIds(WORD), Tokenizer.from_file(WORD), []
    plain, words._model = words._model, lambda p: asked.append(p) or plain(p)
    text = "harbour, Harbour. HARBOUR's harbour 42 ñandú Ñandú <|endoftext|>harbour ÃŁ"
    assert words(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.count("harbour") == 1 and len(asked) == len(set(asked))
    assert "harbour" in words.chunks and "harbour" not in words.pieces


def test_projection_of_a_long_text_is_the_sum_of_its_signs(spark):
    text = "one two three " * 30_000 + "Ångström 7"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["key"] for r in packing.curve(docs, WORD, 1).collect()}
    words = packing.WordIds(WORD)
    rows = packing.signs(words.size).astype(np.int64)[words(text)].sum(axis=0).astype(np.float32)
    assert got["1"] == packing.place(rows[None])[0] and got["2"] == packing.place(np.zeros((1, 4), np.float32))[0]


def test_a_run_is_looked_up_once_for_all_texts():
    words, library = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    texts = ["x<|endoftext|>y  <|endoftext|>", "harbour, Harbour.\n harbour", "", "  a\x1cb\xa0c\x85 ñandú### l'été don't's",
             "Σίσυφος ΣΑΣ “日本” İ 3²½ ٣", "harbour, <x> a|b >|>", "e\u0301 \x00 \x7f\u2003z ²³"]
    asked, plain = [], words.split.chunks
    words.split.chunks = lambda t: asked.append(t) or plain(t)
    for _ in range(2):
        got = [ids.tolist() for ids in words.many(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("harbour,") == 1
    assert [ids.tolist() for ids in words.many(pa.array(["", ""]))] == [[], []] and not list(words.many(pa.array([], pa.string())))
