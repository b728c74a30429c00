"""Greedy packing of ordered lines into token-bounded chunks.

A chunk is closed before the line that would take it over the limit; a line is never split, and a
line above the limit is a chunk of its own. Where a chunk starts depends on where the one before it
ended, which looks sequential. It is split over the cluster like this:

1. Per segment, in parallel: how many tokens are open at its end, and how many chunks it starts, as
   a step function of the tokens open at its start.
2. Per container, over one row per segment: apply the functions in order, which gives each
   segment's true entry.
3. Per segment, in parallel: with the entry known, find the first line of each chunk.

Only (container, segment, seq, tokens, limit) goes through Python, in Arrow batches, and steps 1 and
3 read one shuffle. Texts stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..model import SOURCE


class Segment(NamedTuple):
    container: str
    segment: object
    columns: dict


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Cut batches sorted by (container, segment) into segments, across batch borders."""
    key, parts = None, []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        owner, segment = batch.column(0), batch.column(1)
        changed = np.zeros(n, dtype=bool)
        changed[0] = True
        if n > 1:
            differs = pc.or_(pc.not_equal(owner.slice(1), owner.slice(0, n - 1)),
                             pc.not_equal(segment.slice(1), segment.slice(0, n - 1)))
            changed[1:] = differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(changed).tolist()
        data = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if i > 1}
        arrays = {k: v.to_numpy(zero_copy_only=False) for k, v in data.items()}
        for lo, hi in zip(starts, starts[1:] + [n]):
            here = owner[lo].as_py(), segment[lo].as_py()
            if key is not None and here != key:
                yield _joined(key, parts)
                parts = []
            key = here
            parts.append({k: v[lo:hi] for k, v in arrays.items()})
    if key is not None:
        yield _joined(key, parts)


def _joined(key: tuple, parts: list[dict]) -> Segment:
    columns = parts[0] if len(parts) == 1 else {
        k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    return Segment(*key, columns)


def _prefix(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(tokens, dtype=np.int64)])


def exit_steps(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment as a step function ``(lows, exits, cuts)`` of the tokens open at its start.

    An entry with ``open + sum(tokens) <= limit`` passes uncut. Otherwise the first step with
    ``low < open`` tells the tokens open at the end and the number of chunks started.
    """
    prefix = _prefix(tokens)
    n, sums = len(tokens), prefix.tolist()
    # Lines where the first cut can fall: up to the one reached with nothing open.
    reach = min(int(np.searchsorted(prefix[1:], limit, side="right")), n - 1)
    # Follow the chunks from each of them until they meet a line already followed; every line is
    # passed at most once.
    exits, cuts = [0] * n, [0] * n
    for first in range(reach, -1, -1):
        path = _walk(sums, first, limit, cuts)
        after = _next_start(sums, path[-1], limit) if path else n
        rest, count = (exits[after], cuts[after]) if after < n else (0, 0)
        if path and after >= n:
            rest = sums[n] - sums[path[-1]]
        for at in reversed(path):
            count += 1
            exits[at], cuts[at] = rest, count
    lows = limit - prefix[1:reach + 2]
    ends = np.array(exits[:reach + 1], dtype=np.int64)
    counts = np.array(cuts[:reach + 1], dtype=np.int64)
    keep = np.ones(reach + 1, dtype=bool)    # the last of equal neighbours
    keep[:-1] = (ends[:-1] != ends[1:]) | (counts[:-1] != counts[1:])
    return lows[keep], ends[keep], counts[keep]


def chunk_starts(tokens: np.ndarray, limit: int, entry: int | None) -> list[int]:
    """Lines that start a chunk, given the tokens open at the start (``None``: no chunk open)."""
    prefix = _prefix(tokens)
    first = 0 if entry is None else int(np.searchsorted(prefix[1:], limit - entry, side="right"))
    return _walk(prefix.tolist(), first, limit)


def _next_start(sums: list[int], at: int, limit: int) -> int:
    """The first line of the chunk after the one starting at line ``at`` (or the line count)."""
    return max(bisect_right(sums, sums[at] + limit, at) - 1, at + 1)


def _walk(sums: list[int], at: int, limit: int, seen: list[int] | None = None) -> list[int]:
    """The chunk starts from line ``at`` on, up to the end or the first one already seen."""
    n, starts = len(sums) - 1, []
    while at < n and not (seen and seen[at]):
        starts.append(at)
        at = _next_start(sums, at, limit)
    return starts


def _summarise(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for container, segment, cols in _segments(batches):
            limit = int(cols["chunk_limit"][0])
            steps = exit_steps(cols["tokens"], limit)
            rows.append((container, segment, limit, int(cols["tokens"].sum()),
                         *[s.tolist() for s in steps]))
            if len(rows) >= 512:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)
    return run


def _entries(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entry, chunk = None, None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row[SOURCE] != current:
                    current, entry, chunk = row[SOURCE], None, 0
                rows.append((current, row["segment"], entry, chunk))
                lows, exits, cuts = row["lows"], row["exits"], row["cuts"]
                if entry is None:
                    entry, chunk = exits[0], cuts[0] - 1
                elif entry + row["total"] <= row["chunk_limit"]:
                    entry += row["total"]
                else:
                    step = int(np.searchsorted(-np.asarray(lows), -entry, side="right"))
                    entry, chunk = exits[step], chunk + cuts[step]
                rows[-1] += (chunk,)
            if rows:
                yield _batch(rows, schema)
    return run


def _starts(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for container, segment, cols in _segments(batches):
            entry = cols["entry"][0]
            open_ = not (entry is None or np.isnan(entry))
            chunk, total = int(cols["first_chunk"][0]), int(cols["chunk_total"][0])
            seqs = cols["seq"]
            starts = chunk_starts(cols["tokens"], int(cols["chunk_limit"][0]),
                                  int(entry) if open_ else None)
            if not starts or starts[0] > 0:  # the segment begins inside a chunk
                rows.append((container, segment, int(seqs[0]), chunk, total))
            for i, at in enumerate(starts):
                rows.append((container, segment, int(seqs[at]), chunk + i + open_, total))
            while len(rows) >= 8192:
                yield _batch(rows[:8192], schema)
                rows = rows[8192:]
        if rows:
            yield _batch(rows, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schemas(segment: T.DataType, *fields: tuple[str, T.DataType]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = T.StructType([T.StructField(SOURCE, T.StringType()), T.StructField("segment", segment)]
                         + [T.StructField(n, t) for n, t in fields])
    return spark, to_arrow_schema(spark)


def chunk_marks(lines: DataFrame) -> DataFrame:
    """(container, segment, seq, chunk_index, chunk_total): from this line on, this chunk.

    ``lines`` needs ``tokens`` and ``chunk_limit``, the latter constant per container; rows with a
    NULL limit are left out. Each segment begins with a mark, so marks apply per segment.
    """
    longs = T.LongType()
    segment = lines.schema["segment"].dataType
    # The null checks are those Catalyst infers for the join below; stated for both uses, they leave
    # one shuffle to be read twice.
    given = [F.col(c).isNotNull() for c in (SOURCE, "segment", "chunk_limit")]
    slim = (lines.filter(given[0] & given[1] & given[2])
            .select(SOURCE, "segment", "seq", "tokens", "chunk_limit")
            .repartition(SOURCE, "segment"))
    order = (SOURCE, "segment", "seq")

    steps, steps_pa = _schemas(segment, ("chunk_limit", longs), ("total", longs),
                               ("lows", T.ArrayType(longs)), ("exits", T.ArrayType(longs)),
                               ("cuts", T.ArrayType(longs)))
    functions = slim.sortWithinPartitions(*order).mapInArrow(_summarise(steps_pa), steps)

    entry, entry_pa = _schemas(segment, ("entry", longs), ("first_chunk", longs),
                               ("last_chunk", longs))
    entries = (functions.repartition(SOURCE).sortWithinPartitions(SOURCE, "segment")
               .mapInArrow(_entries(entry_pa), entry))
    total = F.max("last_chunk").over(W.partitionBy(SOURCE)) + 1
    entries = entries.withColumn("chunk_total", total).drop("last_chunk")

    start, start_pa = _schemas(segment, ("seq", longs), ("chunk_index", longs),
                               ("chunk_total", longs))
    return (slim.join(entries, [SOURCE, "segment"]).sortWithinPartitions(*order)
            .mapInArrow(_starts(start_pa), start))


def assign_chunks(lines: DataFrame) -> DataFrame:
    """Add ``chunk_index`` (from 0) and ``chunk_total`` to each line.

    Lines with a NULL ``chunk_limit`` form one chunk per container. ``lines`` is read twice; hand in
    a written table when it is costly to compute.
    """
    marks = chunk_marks(lines)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema
             if f.name not in (SOURCE, "segment", "seq")]
    both = (lines.withColumns({"chunk_index": F.lit(None).cast("long"),
                               "chunk_total": F.lit(None).cast("long"), "_line": F.lit(True)})
            .unionByName(marks.select("*", *blank, F.lit(False).alias("_line"))))
    up_to = (W.partitionBy(SOURCE, "segment").orderBy("seq", "_line")
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (both.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(up_to), F.lit(default))
        for c, default in (("chunk_index", 0), ("chunk_total", 1))})
        .filter("_line").drop("_line"))


def chunk_texts(assigned: DataFrame, line: str = "line") -> DataFrame:
    """One row per chunk: its text, token count and line count.

    Lines are joined inside each segment first, where they already are; only pieces are shuffled.
    """
    pieces = assigned.groupBy(SOURCE, "segment", "chunk_index", "chunk_total", "name").agg(
        F.expr(f"listagg({line}, '') WITHIN GROUP (ORDER BY seq)").alias("_text"),
        F.sum("tokens").alias("_tokens"), F.count(F.lit(1)).alias("_lines"))
    return pieces.groupBy(SOURCE, "name", "chunk_index", "chunk_total").agg(
        F.sum("_tokens").alias("token_count"),
        F.sum("_lines").alias("n_logs"),
        F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY segment)").alias("text"))
