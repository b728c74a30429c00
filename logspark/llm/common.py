"""What the operators share: table readers, hand-over tables, byte hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["documents", "fresh", "partitions_for", "read_table", "rows_of", "scalar", "small_batches",
           "written"]

written = materialize

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2**64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` under fixed types; other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def scalar(df: DataFrame):
    """The single value of an aggregate without keys."""
    return df.first()[0]


def partitions_for(spark: SparkSession, total: int, each: int) -> int:
    """Partitions of about ``each`` units, at least as many as the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // each))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """For each of ``stems`` a column name that ``df`` has not got, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Batches of about ``size`` bytes go to Python from what is run inside, where rows may be wide."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_of(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[list[tuple]]:
    """Rows as tuples in lists of about ``limit`` units of their last column; a longer row is alone."""
    rows, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 128):  # few rows at a time become Python objects
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns)):
                size = len(row[-1] or ())
                if rows and held + size > limit:
                    yield rows
                    rows, held = [], 0
                rows.append(row)
                held += size
        if rows:
            yield rows
            rows, held = [], 0


KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = MULTIPLIER) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; up to :data:`KEPT_POWERS` of them are kept."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    if n <= KEPT_POWERS:
        _powers[base] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of byte spans of one array: equal bytes, equal hash, wherever they stand."""

    inverse = pow(MULTIPLIER, -1, 1 << 64)

    def __init__(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[:len(data)]
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=self.sums[1:])
        self.back = powers(len(data) + 1, self.inverse)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[end] - self.sums[start]) * self.back[start]
            return mix(value + np.asarray(end - start).astype(np.uint64) * np.uint64(MULTIPLIER))
