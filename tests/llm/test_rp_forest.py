"""Links against brute force, and recall where the trees are many."""

import numpy as np
import pytest

from llm_rows import plain
from logspark.llm import rp_forest as R


def brute(rows, cosine=R.COSINE):
    units = [R.unit(v) if label is not None and vec is not None else None for vec, v, label in rows]
    n, links = len(rows), [0] * len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
                    and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (vec, *_) in enumerate(rows):
        if units[i] is not None:
            low[find(i)] = min(low.get(find(i), vec), vec)
    out = []
    for i, (vec, *_) in enumerate(rows):
        root = low[find(i)] if units[i] is not None else vec
        out.append((vec, links[i], root, vec is None or vec == root))
    return sorted(out, key=repr)


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in base[rng.integers(30)]
                 + rng.normal(size=16) * rng.choice([0, .05, .2, .4])], int(rng.integers(3)))
            for i in range(400)]
    first, label = rows[0][1], rows[0][2]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [None] + [1.0] * 15, 1),
             (604, [float("nan")] * 16, 1), (605, first, None), (None, first, label),
             (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (0, first, label), (608, first, label),
             (609, [float("inf")] * 16, 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows],
                                  "vec_id long, embedding array<float>, label int, cls string")
    return rows, table


def test_against_brute_force(vectors):
    rows, table = vectors
    assert plain(R.near_duplicates(table).collect()) == brute(rows)


def test_recall_of_small_leaves(vectors):
    """With leaves of 20: at least nine tenths of the links, none twice, none below the threshold."""
    rows, table = vectors
    found = {r["vec_id"]: r["n_links"] for r in R.near_duplicates(table, leaf=20).collect()}
    true = {r[0]: r[1] for r in brute(rows)}
    assert all(found[v] <= true[v] for v in true)
    assert sum(found.values()) >= 0.9 * sum(true.values())


def test_spill_overlaps():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(2000, 8))
    tree = R.Tree(vectors, 4, 1)
    own, other = tree.leaves(vectors)
    assert (own != other).all() and len(np.unique(own)) == 16
    assert np.unique(own, return_counts=True)[1].max() < 2 * 2000 / 16


def test_empty_table(vectors):
    assert R.near_duplicates(vectors[1].where("false")).collect() == []


def dense_table(spark, parts):
    """One label: groups of near copies, each given by its size and spread, and scattered rows."""
    rng = np.random.default_rng(7)
    groups = [c + rng.normal(size=(n, 64)) * spread * np.linalg.norm(c) / 8
              for n, spread in parts for c in [rng.normal(size=64)]]
    rows = np.concatenate([*groups, rng.normal(size=(500, 64))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)],
                                  "vec_id long, embedding array<float>, label int")
    units = rows.astype(float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    true = np.concatenate([(units[i:i + 500] @ units.T >= R.COSINE).sum(1) - 1
                           for i in range(0, len(units), 500)])
    return table, true


def test_recall_in_a_dense_group(spark):
    """10,000 near copies with cosines of about 0.96, many more than leaves hold: no link is lost."""
    table, true = dense_table(spark, [(10_000, 0.2)])
    got = {r["vec_id"]: r for r in R.near_duplicates(table).collect()}
    assert true[:10_000].mean() > 9_000
    assert [got[i]["n_links"] for i in range(len(true))] == true.tolist()
    assert {got[i]["component_id"] for i in range(10_000) if true[i]} == {0}


def test_blocks_of_dense_groups(spark, monkeypatch):
    """Groups close to their centre, at the threshold and far from it, over many blocks."""
    monkeypatch.setattr(R, "ROWS", 150)
    table, true = dense_table(spark, [(900, 0.05), (900, 0.25), (900, 0.29), (400, 0.1)])
    got = {r["vec_id"]: r["n_links"] for r in R.near_duplicates(table, leaf=64).collect()}
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.999 * true.sum()
    assert [got[i] for i in range(900)] == true[:900].tolist()
