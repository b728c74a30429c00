"""Pseudonyms against the same network in Python; permutations are checked to be permutations."""

import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.llm import pii_feistel as P

KEY = "k"


def feistel(left, right, a, b, key):
    for i in range(P.ROUNDS):
        half = right if i % 2 == 0 else left
        own = int(hashlib.sha256(f"{key}:{i}:{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + own) % a
        else:
            right = (right + own) % b
    return left, right


def digits(text, key):
    n, low = len(text), len(text) // 2
    left, right = feistel(int(text[:low]), int(text[low:]), 10 ** low, 10 ** (n - low), f"{key}:{n}")
    return f"{left:0{low}d}{right:0{n - low}d}"


def luhn(text):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)
               for i, c in enumerate(reversed(text))) % 10


def with_check(body):
    return body + next(str(d) for d in range(10) if luhn(body + str(d)) == 0)


@pytest.fixture
def texts(spark, docs_of):
    def run(values):
        rows = P.pseudonymise(docs_of(list(enumerate(values))), KEY).orderBy("doc_id").collect()
        return rows
    return run


def test_cards(texts):
    rng = random.Random(1)
    cards = [with_check("".join(rng.choices("0123456789", k=n))) for n in (12, 14, 15, 15, 15, 18)]
    rows = texts([f"pay {c} now" for c in cards])
    for card, row in zip(cards, rows):
        new = row["text"][4:-4]
        assert row["n_card"] == 1 and luhn(new) == 0
        assert new == with_check(digits(card[:-1], f"{KEY}:card"))
    spaced = texts(["4929 3483 8514 6306", "4929-3483-8514-6306", "4929348385146306", "4929348385146307"])
    assert len({r["text"].replace(" ", "").replace("-", "") for r in spaced[:3]}) == 1
    assert spaced[0]["text"][4] == " " and spaced[1]["text"][4] == "-"
    assert spaced[3]["text"] == "4929348385146307" and spaced[3]["n_card"] == 0


def test_other_kinds(texts):
    rows = texts(["+1 (017) 555-7713", "10.0.0.255 300.1.1.1 1.2.3.4.5", "x.y@mail.example.com.",
                  "2001-02-28 28/02/2001 28.02.2001", "2001-02-29 31/04/2001 1899-01-01", "a@b"])
    national = digits("0175557713", f"{KEY}:phone")
    assert rows[0]["text"] == f"+1 ({national[:3]}) {national[3:6]}-{national[6:]}"
    left, right = feistel(10 * 256, 255, 1 << 16, 1 << 16, f"{KEY}:ip")
    assert rows[1]["text"] == f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255} 300.1.1.1 1.2.3.4.5"
    name = hashlib.sha256(f"{KEY}:email:x.y".encode()).hexdigest()[:16]
    assert rows[2]["text"] == f"u{name}@mail.example.com." and rows[2]["n_email"] == 1
    days = (date(2001, 2, 28) - date(1900, 1, 1)).days
    left, right = feistel(days // 270, days % 270, 270, 270, f"{KEY}:date")
    new = date(1900, 1, 1) + timedelta(left * 270 + right)
    assert rows[3]["text"] == f"{new:%Y-%m-%d} {new:%d/%m/%Y} {new:%d.%m.%Y}" and rows[3]["n_date"] == 3
    assert rows[4]["text"] == "2001-02-29 31/04/2001 1899-01-01" and rows[4]["n_date"] == 0
    assert rows[5]["text"] == "a@b"


@pytest.mark.parametrize("size", [2, 3])
def test_digits_are_permuted(spark, size):
    every = spark.range(10 ** size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("d"))
    got = every.select(P.permute_digits(F.col("d"), F.lit("key"))).collect()
    assert len({r[0] for r in got}) == 10 ** size and all(len(r[0]) == size for r in got)


def test_days_are_permuted(spark):
    base = F.lit(P.DATE_BASE).cast("long")
    every = spark.range(P.DATE_BASE ** 2).select(P.feistel(
        F.floor(F.col("id") / P.DATE_BASE), F.col("id") % P.DATE_BASE, base, base, F.lit("key")).alias("p"))
    assert every.distinct().count() == P.DATE_BASE ** 2


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = P.pseudonymise(docs, KEY)
    assert set(out.columns) == {*docs.columns, *(f"n_{k}" for k in P.KINDS)}
    assert sorted((r["doc_id"], r["text"]) for r in out.where("doc_id IS NOT NULL").collect()
                  if r["text"]) == sorted((d, t) for d, t, *_ in odd_rows if t and d is not None)
    assert out.count() == len(odd_rows) and P.pseudonymise(docs.where("false"), KEY).collect() == []


def test_equal_values_stay_linked(texts):
    rows = texts(["4929348385146306", "so 4929348385146306, and", "4929348385146306 4929348385146306"])
    one = rows[0]["text"]
    assert rows[1]["text"] == f"so {one}, and" and rows[2]["text"] == f"{one} {one}"


def test_no_python_in_the_plan(docs_of):
    plan = P.pseudonymise(docs_of([(1, "x")]), KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_long_and_odd_texts_are_harmless(texts):
    """Thousands of labels, a megabyte without spaces, of digits and of address characters."""
    odd = ["a@b" + ".c" * 3000, "x" * 1_000_000, "1" * 1_000_000, "a.b+c" * 200_000, "a@" * 300_000,
           "+1 " * 200_000, "1.2.3." * 100_000, "a@b.cd " * 10_000]
    got = texts(odd)
    assert [r["n_email"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 10_000]
    assert got[0]["text"].endswith("@b" + ".c" * 3000)
    assert [r["text"] for r in got[1:7]] == odd[1:7]


def test_clashing_column(docs_of):
    docs = docs_of([(1, "a@b.cd")]).withColumnRenamed("key", "_pii_found").withColumnRenamed("n", "_PII_FOUND_")
    row = P.pseudonymise(docs, KEY).first()
    assert row["_pii_found"] == "x" == row["_PII_FOUND_"] and row["n_email"] == 1
