"""Ids by arrays: equal to the library's, with no object for a field, and each field asked for once."""

import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilscan.llm import token_files, units

WORDS = ["the", "The", "ofreed,", "erea.\nAnd", "don't", "été", "日本語", "x" * 100, "12,5", "\t", "", "a\n", "\x1c", " b", "<|endoftext|>", "é"]


def field_texts(seed, n=400):
    rng = np.random.default_rng(seed)
    usual, every = WORDS[:9], WORDS
    return ["", " ", "one", *(" ".join(rng.choice(usual if k % 3 else every, rng.integers(1, 40))) + f" w{k % 50}" for k in range(n))]


@pytest.mark.parametrize(("group", "kept"), [(1 << 23, 1_000_000), (500, 30), (1, 0)])
def test_ids_by_arrays_equal_the_library(monkeypatch, group, kept):
    monkeypatch.setattr(units, "GROUP", group)
    monkeypatch.setattr(token_files, "KEPT", kept)
    monkeypatch.setattr(token_files, "_LOADED", {})
    path = public_tokenizers.path(token_files.VOCABULARY)
    library, texts = Tokenizer.from_file(path), field_texts(3)
    found = token_files.tokenizer(path)[0].encode_all(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.dtype == np.dtype("<u4") and ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_field_is_asked_for_once():
    asked = []
    encode = lambda texts: asked.extend(texts) or [list(t.encode()) for t in texts]
    ids = units.IdUnits(encode, np.ones(256, np.int64), True)
    texts = [f"head{k % 2} a b{k % 5} a" for k in range(1000)]
    assert [bytes(x.astype(np.uint8)).decode() for _ in range(2) for x in ids.encode_all(texts)] == texts * 2
    assert collections.Counter(" ".join(asked).split()) == {x: 1 for x in ["head0", "head1", "a", *(f"b{k}" for k in range(5))]}
