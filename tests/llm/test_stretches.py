"""Texts are cut into stretches that are encoded once, and their ids are those of whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from newsloom.llm import token_store

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_whole_texts():
    draw = random.Random(3)
    pieces = ["a", "of", "é", "”", ".", "'s", "'t", "'", " ", " ", "\n", "  ", "\t", "<|endoftext|>", "$$", "1", "²", "ˈ", "日", "\x01", "　", "\r\n", "À", "́"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 9))) for _ in range(3000)] + ["", "\n", " ", "a\n", "\na", " a", None]
    encoder = token_store.Encoder(TOKENIZER, 2)
    want = [encoder.of.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(ids, "<u2").tolist() for ids in encoder.encode(pa.array(texts))] == want
    assert encoder.encode(pa.array([], pa.string())) == []
    assert encoder.encode(pa.array(texts, pa.large_string()).slice(7, 2)) == encoder.encode(pa.array(texts[7:9]))


def test_a_word_with_other_marks_is_not_encoded_again():
    encoder = token_store.Encoder(TOKENIZER, 2)
    encoder.encode(pa.array(["say onward, say onward. say onward!\nsay (onward)"]))
    assert sum("onward" in stretch for stretch in encoder.held) <= 2


def test_a_full_cache_keeps_what_a_slice_needs(monkeypatch):
    monkeypatch.setattr(token_store, "WORDS_KEPT", 5)
    monkeypatch.setattr(token_store, "HANDED", 2)
    encoder = token_store.Encoder(TOKENIZER, 2)
    for text in ("a b c d", "e f g h i j k", "a  b  c  d  e  f  g"):
        assert encoder.encode(pa.array([text])) == [np.array([*encoder.of.encode(text).ids, 2], "<u2").tobytes()]


def test_slices_hold_every_text(monkeypatch):
    monkeypatch.setattr(token_store, "SLICE", 4)
    assert list(token_store._slices(pa.array(["aa", None, "aaa", "aaaaaaaaa", "", "a"]))) == [(0, 3), (3, 4), (4, 6)]
    assert list(token_store._slices(pa.array([], pa.string()))) == []
