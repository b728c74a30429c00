"""The word code as an exact round trip, and the ids against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logspark.llm import simple8b as S

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("high", [1, 2, 50, 49408, 1 << 20, 1 << 31, 1 << 60, 1 << 63])
@pytest.mark.parametrize("n", [0, 1, 2, 119, 120, 121, 3000])
def test_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64)
    ids[rng.random(n) < 0.4] = 0
    words, escapes, before = S.encode(ids)
    assert S.decode(words, escapes, n).tolist() == ids.tolist()
    for k, start in enumerate(before.tolist()):  # a reader may start at any stride
        part = S.decode(words[k * S.STRIDE:], escapes, n - start)
        assert part.tolist() == ids[start:].tolist()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 100)))
def test_any_ids(ids):
    words, escapes, _ = S.encode(np.array(ids, np.uint64))
    assert S.decode(words, escapes, len(ids)).tolist() == ids


def test_words_are_dense():
    words, _, _ = S.encode(np.random.default_rng(1).integers(0, 1 << 15, 40_000).astype(np.uint64))
    assert len(words) <= 40_000 / 4 * 1.02


def test_ids_of_texts():
    library, own = Tokenizer.from_file(PATH), S.WordIds(PATH)
    rng = random.Random(3)
    alphabet = "abCDE  \n\t'sé日本ßÄ\x1c\x85\xa0​　\x0b\r123,.!<|🙂́ªⅧΣİ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(600)]
    texts += ["", " ", "a" * 3000, "<|endoftext|> x<|endoftext|>. it's. 3. ", "Straße, ÀÉ."]
    for text, ids in zip(texts, own(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_IDS", 100)
    library = Tokenizer.from_file(PATH)
    rows = S.round_trip(docs_of(odd_rows), PATH).collect()
    assert len(rows) == len(odd_rows)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    by_start = sorted(rows, key=lambda r: r["start"])
    for (doc, text, *_), row in zip(ordered, by_start):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, S.END_ID]
        raw = np.array(ids, "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(raw) and row["ids"] == raw
        at += len(ids)


def test_empty_table(docs_of):
    assert S.round_trip(docs_of([(1, "x")]).where("false"), PATH).collect() == []
