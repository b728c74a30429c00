"""Contamination against a brute-force search over words."""

import hashlib
import random
import re

import pytest

from llm_rows import plain
from logspark.llm import wu_manber as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    out = []
    windows = {}
    for item, text in items:
        own = words(text)
        if own:
            n = min(size, len(own))
            for at in range(len(own) - n + 1):
                windows.setdefault(tuple(own[at:at + n]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in windows}
    for doc, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for n in lengths:
            for at in range(len(own) - n + 1):
                names = windows.get(tuple(own[at:at + n]))
                if names:
                    hit.update(range(at, at + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest,
                    len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


@pytest.fixture
def case():
    rng = random.Random(3)
    vocabulary = ["a", "b", "the", "é", "x1", "Zz", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
             + rng.choice(["", "!", "\n", "\0"])) for i in range(150)]
    items = [(i, rng.choice([" ", ", "]).join(
        rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 13, 20])))) for i in range(12)]
    return docs, items + [(77, None), (None, "the the the b"), (3, "é é")]


@pytest.mark.parametrize("size,block_bytes", [(13, 1 << 20), (3, 1 << 20), (4, 120)])
def test_against_brute_force(spark, docs_of, odd_rows, case, size, block_bytes):
    docs, items = case[0] + odd_rows, case[1]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    got = W.contamination(docs_of(docs), bench, size, block_bytes).drop("items")
    assert plain(got.collect()) == brute(docs, items, size)


def test_shifts_skip_and_find_all():
    patterns = W.Patterns([("1", " ".join(f"w{i}" for i in range(30)))])
    text = W.words_of("q " * 5000 + " ".join(f"w{i}" for i in range(5, 20)) + " end" * 3000)
    hits, items = patterns.search([text, b"", text])
    assert W.covered(hits[0]) == 15 == W.covered(hits[2]) and hits[1] == [] and items[0] == {"1"}


def test_keep_clean_keeps_columns(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, text), (2, "clean text"), (3, None), (4, text + " more" * 500)])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = W.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = docs_of([(1, "a b c")])
    assert W.contamination(docs.where("false"), bench).collect() == []
    assert W.contamination(docs, bench.where("false")).first()["contaminated"] is False


def test_repeated_items_fill_no_block(spark, docs_of, monkeypatch):
    """One item a thousand times: it is collected once, and one block holds all."""
    seen, init = [], W.Patterns.__init__
    monkeypatch.setattr(W.Patterns, "__init__",
                        lambda self, items, size: seen.append(items) or init(self, items, size))
    bench = spark.createDataFrame([(1, "a b c d")] * 1000 + [(2, "e f g h")], "item_id long, text string")
    got = W.contamination(docs_of([(1, "x a b c d"), (2, "none")]), bench, 3, 120).collect()
    assert [sorted(items) for items in seen] == [[("1", "a b c d"), ("2", "e f g h")]]
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 4, 2: 0}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_keep_clean_in_blocks(spark, docs_of, case, odd_rows, block_bytes):
    docs, items = case[0] + odd_rows, case[1]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = docs_of(docs).withColumnRenamed("root", "_wm_hits").withColumnRenamed("word", "_digest")
    kept = W.keep_clean(own, bench, 4, block_bytes)
    assert kept.columns == own.columns
    assert {r["_wm_hits"] for r in kept.select("_wm_hits").distinct().collect()} == {"x"}
    expected = [(d, t) for d, t, *_ in docs if not brute([(d, t)], items, 4)[0][-1]]
    assert plain(kept.select("doc_id", "text").collect()) == plain(expected)


def test_a_large_benchmark_still_skips():
    """Shifts of over ten bytes on average with two megabytes of items; before, 3.6 with four."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=100))) for i in range(3300)]
    patterns = W.Patterns(items)
    assert sum(len(t) for _, t in items) > 2_000_000
    text = " ".join(rng.choices(vocabulary, k=20_000)) + " " + items[5][1] + " end"
    words = W.words_of(text)
    eights = W.eights(W.np.frombuffer(words + bytes(16), W.np.uint8))
    for tables in patterns.classes:
        at = W.np.arange(len(words) - tables.m)
        shift = tables.shift[tables.slot(tables.hash(eights, at + tables.m - tables.block))]
        assert shift.astype(float).mean() > 10
    hits, found = patterns.search([words])
    assert W.covered(hits[0]) == 100 and found[0] == {"5"}
