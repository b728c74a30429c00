"""Encoding against the tiktoken library, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from logspark.llm import bpe_segment_tree as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tables():
    return B.BytePairs(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tables):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=tables.ranks, special_tokens={})


def test_random_texts(tables, library):
    rng = random.Random(1)
    alphabet = "abcDE  \n\t'sé日本\x1c\x85\xa0​　\x0b\r123,.!🙂́ªⅧ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 150))) for _ in range(600)]
    texts += ["", " ", "a" * 3000, " " * 2500, "ab" * 700, "é" * 999, "<|endoftext|>", "\0"]
    for text, ids in zip(texts, tables.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert tables.decode(ids) == text.encode()


def test_rows_and_lists_agree(tables):
    rng = random.Random(2)
    pieces = [bytes(rng.choices(b"abeht ", k=rng.randint(2, 64))) for _ in range(200)]
    ids, at = tables.encode_rows(pieces)
    for piece, a, b in zip(pieces, at, at[1:]):
        assert np.frombuffer(ids[a:b], "<u4").tolist() == tables.encode_long(piece).tolist()


def test_small_cache(tables, library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 5)
    texts = [f"word{i} and {i * 7}" for i in range(30)]
    for start in range(0, 30, 4):
        for text, ids in zip(texts[start:start + 4], tables.encode(texts[start:start + 4])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_documents(docs_of, odd_rows, library):
    got = B.encode_documents(docs_of(odd_rows), PATH, public_tokenizers.PATTERN)
    expected = []
    for doc, text, *_ in odd_rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        expected.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    rows = got.drop("ids").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert B.encode_documents(empty, PATH, public_tokenizers.PATTERN).collect() == []
