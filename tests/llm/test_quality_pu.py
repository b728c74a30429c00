"""The classifier on invented texts: accuracy on rows whose labels it never saw."""

import random
import zlib

import numpy as np
import pytest

from logspark.llm import quality_pu as Q


def texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        own = rng.choices(vocabulary, k=rng.randint(30, 200))
        if i % 5:
            out.append((i, " ".join(own).capitalize() + ".", 1))
        else:
            bad = rng.choice([" ".join(w.upper() + "!!" for w in own), " | ".join(own) + " |",
                              " ".join([own[0]] * 60 + [own[1]] * 60),
                              " ".join(w + rng.choice(["***", "$$$"]) for w in own)])
            out.append((i, bad, 0))
    return out


@pytest.fixture
def tables(spark, docs_of):
    rows = texts(1500)
    labels = spark.createDataFrame([(i, y, 0, "x") for i, _, y in rows if i % 3],
                                   "doc_id long, quality int, toxic int, score string")
    return rows, docs_of([(i, t) for i, t, _ in rows]), labels


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in Q.scores(docs, labels).collect()}
    assert len(got) == len(rows)
    unseen = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in unseen]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_change_nothing(tables):
    _, docs, labels = tables
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(), 1 - Q.F.col("quality"))
                                .otherwise(Q.F.col("quality")))
    one = sorted(map(tuple, Q.scores(docs, labels).collect()))
    assert one == sorted(map(tuple, Q.scores(docs, flipped).collect()))


def test_keep_good(tables):
    rows, docs, labels = tables
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sum(i in ids for i, _, y in rows if y) > 0.97 * sum(y for *_, y in rows)


def test_prior():
    rng = np.random.default_rng(1)
    positives = rng.normal(2, 0.5, 2000)
    mixed = np.concatenate((rng.normal(2, 0.5, 7000), rng.normal(-2, 0.5, 3000)))
    assert abs(Q.estimate_prior(positives, mixed) - 0.7) < 0.05


def test_risk_without_negatives():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (1500, 3)), rng.normal(-2, 1, (500, 3))
    model = Q.train(good[:500], np.concatenate((good[500:], bad)))
    assert (model.score(good) >= 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.9


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (9, 0), (9, 1)],
                                   "doc_id long, quality int")
    got = Q.scores(docs_of(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(r["score"] is not None for r in got)
    nothing = Q.scores(docs_of(odd_rows), labels.where("false")).collect()
    assert all(r["score"] == 1.0 and r["predicted"] == 1 for r in nothing)
    assert Q.scores(docs_of(odd_rows).where("false"), labels).collect() == []
