"""Whitening against a dense eigenvalue solver and exact integers in one place."""

import math
import random

import numpy as np
import pytest

from logspark.llm import whitening as H

ROW = "vec_id long, embedding array<float>, label int, n string, packed string, dim string, i string"


@pytest.fixture
def vectors_of(spark):
    """Rows (vec_id, vector) as embeddings with columns that clash with inner names."""
    def make(rows, parts=3, row=ROW):
        return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], row).repartition(parts)
    return make


def brute(rows, wanted=4):
    """vec_id -> (deviation, whitened up to the sign of each component), and what all rows share."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, x = len(fit), np.array(fit, float)
    sums = [sum(col) for col in zip(*fit)]
    centred = x - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    out = {}
    for i, v in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        w = (np.array(v) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out.setdefault(i, []).append((deviation, w))
    return n, out, values[order] / values.sum()


def check(result, rows, wanted=4):
    n, expected, explained = brute(rows, wanted)
    got = result.collect()
    assert len(got) == sum(map(len, expected.values())) * len(explained)
    signs = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        same = [w[k] for d, w in expected[r.vec_id] if d == r.deviation]
        assert same
        close = [w for w in same if abs(abs(w) - abs(r.whitened)) <= 1e-7]
        assert close
        if abs(close[0]) > 1e-3 and len(same) == 1:
            signs.setdefault(k, set()).add(np.sign(close[0]) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


@pytest.mark.parametrize("size,seed", [(1, 0), (2, 1), (5, 2), (40, 3), (90, 4)])
def test_feast_finds_the_largest(size, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((size, 3 * size))
    matrix = a @ a.T
    values, vectors = H.components(matrix, 4)
    expected, exact = np.linalg.eigh(matrix)
    few = min(4, size)
    assert np.allclose(values, expected[::-1][:few], rtol=1e-12)
    assert np.allclose(np.abs(np.sum(vectors * exact[:, ::-1][:, :few], axis=0)), 1, atol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(few), atol=1e-12)


@pytest.mark.parametrize("spectrum,found", [
    ([5, 5, 5, 5, 5, 1], 4), ([9, 1, 1, 1, 1, 1, 1], 4), ([3, 2, 0, 0, 0], 2), ([0, 0], 0), ([7], 1),
    ([1e9, 1e3, 10, 1, 1e-7], 4), ([1] * 30, 4)])
def test_close_equal_and_zero_eigenvalues(spectrum, found):
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
    matrix = turn @ np.diag(np.array(spectrum, float)) @ turn.T
    values, vectors = H.components((matrix + matrix.T) / 2, 4)
    scale = max(spectrum) or 1
    assert np.allclose(values, sorted(spectrum, reverse=True)[:found], atol=1e-12 * scale * len(spectrum))
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-11 * scale)


@pytest.mark.parametrize("seed", range(6))
def test_inertia(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((25, 25))
    matrix = a + a.T
    values = np.linalg.eigvalsh(matrix)
    for shift in rng.uniform(values[0] - 1, values[-1] + 1, 8):
        assert H.inertia_above(matrix, shift) == int((values > shift).sum())
    assert H.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_rows(vectors_of):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 / (k + 1)) for k in range(12)]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [rows[3], rows[3], (None, rows[4][1])]
    odd = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, []),
           (2004, [float("inf")] + [0.0] * 11)]
    check(H.whitened(vectors_of(rows + odd, 5)), [(i, np.float32(v).tolist()) for i, v in rows])


def test_large_values_stay_exact(vectors_of):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2**13, 2**13)) for _ in range(3)]) for i in range(60)]
    check(H.whitened(vectors_of(rows)), rows)


@pytest.mark.parametrize("scale,exact", [(2.0 ** 10, True), (2.0 ** 26, True), (2.0 ** 30, False), (2.0 ** 40, False)])
def test_deviation(scale, exact):
    x = np.array([[int(scale), -int(scale)], [1, 2], [0, 0]])
    fit = H.Fit(7, (3, -5), np.ones(0), np.ones((2, 0)), 1.0)
    whole = [sum((7 * int(a) - s) ** 2 for a, s in zip(row, fit.sums)) for row in x]
    assert fit.deviation(x) == [d if d < 2 ** 63 else None for d in whole]
    assert (whole[0] < 2 ** 63) == exact


def test_few_dimensions_and_ragged(vectors_of):
    rows = [(i, [i / 10, (i * i % 7) / 10]) for i in range(20)]
    check(H.whitened(vectors_of(rows + [(99, [1.0, 2.0, 3.0])])), [(i, np.float32(v).tolist()) for i, v in rows])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(vectors_of, rows):
    result = H.whitened(vectors_of(rows))
    assert result.collect() == [] and result.columns[:3] == ["vec_id", "component", "n"]
