"""Whitening of embeddings by their leading components, found by contour integration.

Spark does what grows with the rows: vectors are put on an integer grid, distinct ones become the fit
list, their sums and their centred products are added up task by task, and every row is projected. The
covariance that comes out has the size of the vectors' dimension squared, whatever the rows; its
eigenvalues are found on the driver by the FEAST method:

* an inertia count (the signs of a pivoted LDL factorisation of the shifted matrix) tells how many
  eigenvalues lie above a shift; bisection on it finds an interval that holds the wanted ones;
* a random block is projected onto the interval's eigenvectors by a quadrature over a contour around
  it, one complex shifted solve a node;
* Rayleigh-Ritz in the projected block gives eigenvalues and vectors, and is the next block, until the
  residuals are down to rounding;
* the number of them inside the interval must equal the inertia count, else the block grows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scalar, written

GRID = 256
NODES = 16          # quadrature nodes of half a contour
MOST_ROUNDS = 60    # of the contour projection for one block size
SLICE = 8           # rows of a batch are taken in pieces of at most this many megabytes

WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


# The components of a covariance, on the driver.

def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of an LDL factorisation of the shifted matrix.

    Pivots are the largest entry left, alone if on the diagonal and as a block of two otherwise; a block
    of two that such a choice leaves has one eigenvalue of each sign.
    """
    left = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(left):
        size = len(left)
        p = int(np.argmax(np.abs(np.diag(left))))
        r, s = divmod(int(np.argmax(np.abs(left))), size)
        if left[r, s] == 0:
            return above
        if abs(left[p, p]) >= 0.64 * abs(left[r, s]):
            chosen = [p]
            above += int(left[p, p] > 0)
        else:
            chosen = [r, s]
            above += 1
        rest = np.setdiff1d(np.arange(size), chosen)
        side = left[np.ix_(rest, chosen)]
        left = left[np.ix_(rest, rest)] - side @ np.linalg.solve(left[np.ix_(chosen, chosen)], side.T)
        left = (left + left.T) / 2
    return above


def _interval(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """An interval of the ``wanted`` largest eigenvalues, and of few others where some are close."""
    top = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    low, high, count = -1e-3 * top, top * (1 + 1e-9), len(matrix)
    for _ in range(60):
        middle = (low + high) / 2
        found = inertia_above(matrix, middle)
        if found < wanted:
            high = middle
        else:
            low, count = middle, found
        if count == wanted or high - low <= 1e-10 * top:
            break
    if count == wanted:
        # The shift goes to the middle of the gap below the wanted ones, as far as it is known.
        under, bottom, peak = -1e-3 * top, low, low
        for _ in range(12):
            middle = (under + bottom) / 2
            if inertia_above(matrix, middle) == wanted:
                bottom = middle
            else:
                under = middle
            middle = (peak + high) / 2
            if inertia_above(matrix, middle) == wanted:
                peak = middle
            else:
                high = middle
        low = (bottom + peak) / 2
    return low, top * (1 + 1e-9), count


def feast(matrix: np.ndarray, low: float, high: float, count: int,
          seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with eigenvalues in (``low``, ``high``), largest first.

    ``count`` is the inertia count of the interval. A block that does not converge, or that holds
    another number of them, is replaced by a larger one; in the end it spans the whole space.
    """
    size = len(matrix)
    scale = max(float(np.abs(matrix).max()), np.finfo(float).tiny)
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (angles + 1) / 2)
    centre, radius = (low + high) / 2, (high - low) / 2
    rng = np.random.default_rng(seed)
    width = min(size, 2 * count + 8)
    while True:
        block = rng.standard_normal((size, width))
        best = np.inf
        for _ in range(MOST_ROUNDS):
            projected = np.zeros((size, width))
            for z, w in zip(turn, weights):
                solved = np.linalg.solve((centre + radius * z) * np.eye(size) - matrix, block + 0j)
                projected += w * radius / 2 * (z * solved).real
            basis, _ = np.linalg.qr(projected)
            values, mixes = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ mixes
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            if len(inside) == count:
                vectors = block[:, inside]
                rest = float(np.abs(matrix @ vectors - vectors * values[inside]).max())
                if rest <= 4e-16 * size * scale or (rest <= 1e-12 * scale and rest >= best / 2):
                    return values[inside], vectors
                best = min(best, rest)
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues above {low}, found {len(inside)}")
        width = min(size, 2 * width)


def components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues and unit eigenvectors; those that are zero are left out.

    Zero is what rounding cannot tell from it. The sign of a vector makes its largest entry positive.
    """
    size = len(covariance)
    if not size or not np.abs(covariance).max() > 0:
        return np.zeros(0), np.zeros((size, 0))
    scale = float(np.abs(covariance).max())
    unit = covariance / scale
    low, high, count = _interval(unit, min(wanted, size))
    values, vectors = feast(unit, low, high, count)
    keep = np.flatnonzero(values > 1e-13 * size)[:wanted]
    values, vectors = values[keep], vectors[:, keep]
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(keep))]
    return values * scale, vectors * np.sign(largest)


# Rows, in tasks.

def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, (SLICE << 20) * max(1, batch.num_rows) // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of usable values as packed integers: two bytes an entry where all fit, else eight."""
    for batch in _pieces(batches):
        ids, vectors = batch.columns
        out_ids, out, dims = [], [], []
        lengths = np.asarray(vectors.value_lengths().fill_null(0))
        known = np.asarray(vectors.is_valid())
        flat = vectors.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
        starts = np.concatenate(([0], np.cumsum(lengths)))
        for i, vec_id in enumerate(ids.to_pylist()):
            part = values[starts[i]:starts[i + 1]]
            if not known[i] or not len(part) or not np.isfinite(part).all():
                continue
            grid = np.floor(GRID * part)
            small = np.abs(grid).max() < 2 ** 15
            whole = np.clip(grid, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype(np.int64)
            out_ids.append(vec_id)
            out.append((whole.astype("<i2") if small else whole.astype("<i8")).tobytes())
            dims.append(len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
            names=["vec_id", "dim", "packed"])


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers."""
    out = np.empty((len(column), dim), np.int64)
    for i, packed in enumerate(column):
        raw = packed.as_buffer()
        out[i] = np.frombuffer(raw, "<i2" if raw.size == 2 * dim else "<i8")
    return out


def _sums(dim: int):
    def run(batches):
        total = [0] * dim
        for batch in _pieces(batches):
            x = _unpack(batch.column(0), dim)
            if not len(x):
                continue
            wide = np.abs(x, dtype=np.float64).max() >= 2.0 ** 62 / len(x)
            part = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()),
                                          "s": pa.array([str(t) for t in total])})
    return run


def _products(mean: np.ndarray):
    """Rows of the sum of centred products; one matrix a task."""
    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in _pieces(batches):
            x = _unpack(batch.column(0), len(mean)) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(mean)), pa.int32()),
                                          "row": pa.array([r.tobytes() for r in total], pa.binary())})
    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """One row of the matrix, added up over tasks."""
    rows = [np.frombuffer(r.as_buffer()) for r in table.column("row").combine_chunks()]
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()),
                     "row": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def _matrix(rows: DataFrame, fn, size: int) -> np.ndarray:
    """The matrix whose rows ``fn`` adds up in tasks; of the size of the dimension squared."""
    parts = rows.mapInArrow(fn, "i int, row binary").groupBy("i").applyInArrow(_added, "i int, row binary")
    out = np.zeros((size, size))
    for i, row in parts.collect():
        out[i] = np.frombuffer(bytes(row))
    return out


@dataclass(frozen=True)
class Fit:
    """What was fitted on the distinct vectors: ``sums`` are exact, vectors are columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact squared distance of ``n * x`` from the sums; null where no long can hold it."""
        sums = np.array(self.sums, dtype=object)
        bound = float(self.n) * float(np.abs(x, dtype=np.float64).max(initial=0)) + max(
            (abs(float(s)) for s in self.sums), default=0.0)
        if bound < 2.0 ** 31 and bound * bound * max(1, x.shape[1]) < 2.0 ** 62:
            return ((self.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        if bound < 2.0 ** 62:
            # Squares in two halves of the digits, so that sums stay exact in 64 bits.
            away = np.abs(self.n * x - sums.astype(np.int64))
            high, low = away >> 24, away & 0xFFFFFF
            if high.max(initial=0) < 2 ** 24:
                parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
                exact = [(int(h) << 48) + (int(m) << 25) + int(lo) for h, m, lo in zip(*parts)]
                return [d if d < 1 << 63 else None for d in exact]
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def _moments(fit: Fit):
    """Products of whitened vectors."""
    def run(batches):
        size = len(fit.values)
        total = np.zeros((size, size))
        for batch in _pieces(batches):
            w = fit.whiten(_unpack(batch.column(0), len(fit.sums)))
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()),
                                          "row": pa.array([r.tobytes() for r in total], pa.binary())})
    return run


def _rows(fit: Fit, error: float):
    """A row for each vector and component."""
    size = len(fit.values)
    explained = fit.values / fit.trace if size else fit.values

    def run(batches):
        for batch in _pieces(batches):
            ids, column = batch.columns
            x = _unpack(column, len(fit.sums))
            each = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), fit.n, np.int64)),
                pa.array(fit.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(fit.whiten(x).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ], names=[c.split()[0] for c in WHITENED.split(", ")])
    return run


def fitted(distinct: DataFrame, dim: int, wanted: int) -> Fit | None:
    """The fit on ``distinct`` (one column, ``packed``); none where it has no rows."""
    n = distinct.count()
    if not n:
        return None
    sums = distinct.mapInArrow(_sums(dim), "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = tuple(int(r.s) for r in sorted(sums, key=lambda r: r.i))
    mean = np.array([s / n for s in sums])
    covariance = _matrix(distinct, _products(mean), dim) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(covariance, wanted)
    return Fit(n, sums, values, vectors, float(np.trace(covariance)))


def whitened(vectors: DataFrame, wanted: int = 4) -> DataFrame:
    """Every usable vector's whitened coordinates along the ``wanted`` leading components.

    Vectors that are null, empty, or hold a null or non-finite entry are left out. All others should
    have one dimension; where they do not, the dimension of most distinct vectors counts (the smaller
    one of two equally frequent) and the others are left out too. Equal vectors count once in the fit
    and have a row each for every component. Components whose variance is zero are left out, so a table
    of one distinct vector, or an empty one, gives no rows. A null ``vec_id`` stays null, and other
    columns are not read. A deviation above the largest long is null.
    """
    spark = vectors.sparkSession
    packed = written(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(_encode, "vec_id long, dim int, packed binary"), "packed")
    distinct = written(packed.select("dim", "packed").distinct(), "distinct")
    common = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    none = spark.createDataFrame([], WHITENED)
    if common is None:
        return none
    distinct = distinct.where(F.col("dim") == common.dim).select("packed")
    fit = fitted(distinct, common.dim, wanted)
    size = len(fit.values)
    if not size:
        return none
    error = np.abs(_matrix(distinct, _moments(fit), size) / fit.n - np.eye(size)).max()
    return (packed.where(F.col("dim") == common.dim).select("vec_id", "packed")
            .mapInArrow(_rows(fit, float(error)), WHITENED))


def identity_error(result: DataFrame) -> float | None:
    """The one value of the column, null where there are no rows."""
    return scalar(result.agg(F.max("identity_error")))
