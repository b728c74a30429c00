from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside, as columns of the input: they must neither break nor be used.
CLASHES = ("key", "batch", "n", "x", "root", "word", "_wm_other", "n_lines", "site", "hits", "kind")


@pytest.fixture
def docs_of(spark):
    """Rows (doc_id, text[, source]) as documents with columns that clash with inner names."""
    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0",
                 None if r[1] is None else len(r[1]), *("x" for _ in CLASHES)) for r in rows]
        return spark.createDataFrame(
            full, DOCS + "".join(f", {c} string" for c in CLASHES)).repartition(parts)
    return make


@pytest.fixture
def odd_rows():
    """Nulls in any column, empty and blank texts, a long one, ties and repeated rows."""
    rng = random.Random(4)
    words = ["alpha", "bravo", "été", "日本", "delta", "Echo", "x1", "42"]
    text = " ".join(rng.choices(words, k=60))
    return [(1, text), (2, None), (3, ""), (4, " \t\n"), (None, text), (None, None),
            (5, text), (5, text), (5, text + " more"), (6, "a" * 30_000), (7, "word " * 20_000),
            (8, "one"), (9, "one two"), (10, text, None), (11, "🙂 " * 70)]
