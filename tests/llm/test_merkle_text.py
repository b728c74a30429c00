"""Fingerprints against the same tree built in Python, and neighbours against one sorted list."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from llm_rows import plain
from pyspark.sql import functions as F

from logspark.llm import merkle_text as M


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute_print(text):
    out, sections = "", []
    for section in text.split("\n\n"):
        shown, paragraphs = "", []
        for line in section.split("\n"):
            pieces = re.findall(r"(?: *[^ ]{1,16}){1,4}| +", line)
            paragraphs.append(digest("-" + "".join(map(digest, pieces))))
            shown += f" -{paragraphs[-1][:16]}" + "".join(f" {digest(p)[:8]}{len(p)}" for p in pieces)
        sections.append(digest("/" + "".join(paragraphs)))
        out += f" /{sections[-1][:16]}{shown}"
    return "#" + digest("#" + "".join(sections)) + out


def brute_likeness(a, b):
    if a[:65] == b[:65]:
        return 1.0
    x, y = (Counter(t for t in s.split(" ") if t[0] not in "#/-") for s in (a, b))
    weight = lambda pieces: sum(int(p[8:]) * n for p, n in pieces.items())
    whole = weight(x) + weight(y)
    return 2 * weight(x & y) / whole if whole else 0.0


def brute(rows):
    order = sorted(((-2**63 if i is None else i, digest(t or ""), i, t or "") for i, t in rows),
                   key=lambda r: r[:2])
    out = []
    for k, (_, _, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        quarter = len(text) // 4
        new = text[:len(text) - quarter] + following[:quarter]
        a, b, c = brute_print(text), brute_print(new), brute_print(following)
        out.append((i, len(text), digest(new), a, b, brute_likeness(a, b), brute_likeness(a, c)))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [64 << 20, 4000, 1000])
def test_odd_rows(docs_of, odd_rows, monkeypatch, size):
    monkeypatch.setattr(M, "RANGE_BYTES", size)
    df = docs_of(odd_rows + [(20, "a\n\nb\n\n\nc  d \n"), (21, "\n"), (22, "\n\n"), (-2**63, "least")])
    assert plain(M.compared(df).collect()) == plain(brute(rows_of(df)))


@pytest.mark.parametrize("n", [1, 2, 400])
def test_neighbours_over_many_ranges(docs_of, monkeypatch, n):
    monkeypatch.setattr(M, "RANGE_BYTES", 60)
    rng = random.Random(n)
    ids = [rng.choice([7, 7, 7, rng.randrange(-10**12, 10**12)]) for _ in range(n)]
    df = docs_of([(i, f"text {rng.randrange(10**6)} of some words {k}") for k, i in enumerate(ids)], 6)
    assert plain(M.compared(df).collect()) == plain(brute(rows_of(df)))


def test_equal_texts_and_edits(docs_of):
    line = "words of a paragraph number {} which is not short at all".format
    text = "\n".join(line(i) for i in range(40))
    changed = text.replace(line(17), line(17) + " any more")
    df = docs_of([(1, text), (2, text), (3, changed)], 1)
    got = {r.doc_id: r for r in M.compared(df).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[1].near_next == 1.0 and 0.95 < got[2].near_next < 1.0
    assert 0.6 < got[3].near_edited < 1


def test_repeated_pieces_count_as_often(docs_of):
    df = docs_of([(1, "the same four words\n" * 50), (2, "other text of its own " * 60)])
    got = {r.doc_id: r for r in M.compared(df).collect()}
    assert 0.7 < got[1].near_edited < 0.8 and 0.7 < got[2].near_edited < 0.8 and got[1].near_next == 0
    assert plain(got.values()) == plain(brute(rows_of(df)))


def test_edits_are_located(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    df = spark.createDataFrame([(1, a, a.replace("four", "4")), (2, a, a), (3, None, a)],
                               "doc_id long, a string, b string")
    found = M.edits(df, "a", "b").collect()
    assert plain(found) == [(1, 1, 1, 4), (3, 0, 0, 0)]
    assert {tuple(r) for r in M.edits(df, "b", "a").where("doc_id = 1").collect()} == {(1, 1, 1, 1)}


def test_long_texts_are_linear(spark):
    """A megabyte without spaces, of spaces, of short lines, and of words."""
    texts = ["a" * 1_000_000, " " * 1_000_000, "a\n" * 100_000, "ab " * 300_000, "\n" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.f for r in df.select("doc_id", M.fingerprint(F.col("text")).alias("f")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_print(t) for t in texts]


def test_empty_table(docs_of):
    assert M.compared(docs_of([(1, "x")]).where("false")).collect() == []


def test_plan_is_native_with_one_shuffle_of_texts(docs_of):
    plan = M.compared(docs_of([(i, f"text {i}") for i in range(50)]))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Python" not in text and "Arrow" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(range", text)) == 1
