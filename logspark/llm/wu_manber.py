"""Benchmark decontamination by Wu-Manber search for many strings at once.

A text becomes bytes in which every word stands between single spaces. A benchmark item gives one
pattern per window of 13 words (a shorter item gives one), with the spaces around it, so that an
occurrence of a pattern is an occurrence of its words. Patterns fall into classes by length, and each
class has the tables of Wu and Manber over its shortest length ``m``: for the hash of a block of
bytes, how far the search can move on when a window of ``m`` bytes ends in it; where that is 0, the
bucket of patterns with that block there; and a direct comparison of the pattern's bytes.

The search itself is done in numpy, on many lanes at once: a lane is a stretch of the texts of a
batch, and each step moves every lane by its own shift. Most blocks occur in no pattern, so a lane
moves by nearly ``m`` bytes a step.

Texts are never shuffled: hits of a document are found in its own row. The benchmark's patterns go to
the tasks in blocks of a bounded number of bytes, one map over all documents each. With several blocks
each writes its hits alone, by the digest of the text they are in, and the hits are brought together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, documents, fresh, rows_of, scalar, written

WINDOW = 13
BLOCK_BYTES = 16 << 20  # of benchmark text in the tables of one pass, which take about ten times that
LANE = 2048
SMALL_BITS, MOST_BITS = 20, 26  # of the place in a table of shifts, by the size of the benchmark

# Letters and digits stay, capitals become small, bytes beyond ASCII are parts of words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def words_of(text: str | None) -> bytes:
    """``text`` as its words, each between single spaces; empty without words."""
    words = (text or "").encode().translate(WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def eights(raw: np.ndarray) -> np.ndarray:
    """For each byte of ``raw`` but the last eight, the eight bytes from there on as one number."""
    out = np.empty(max(0, len(raw) - 8), np.uint64)
    for k in range(min(8, len(out))):
        n = (len(out) - k + 7) // 8
        out[k::8] = raw[k:k + 8 * n].view("<u8")
    return out


class Class:
    """The tables for patterns of at least ``m`` bytes, which start at ``starts`` of some bytes."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, numbers: np.ndarray, m: int,
                 bits: int) -> None:
        """``words``: the :func:`eights` of the bytes; ``numbers``: of the patterns."""
        self.m = m
        # Blocks of 16 bytes in a large benchmark, as those of 8 recur in any text.
        self.block = 16 if bits > SMALL_BITS and m >= 24 else min(8, m)
        self.bits = bits
        reach = self.m - self.block
        self.shift = np.full(1 << bits, min(reach + 1, 255), np.uint8)
        for at in range(reach + 1):
            self.shift[self.slot(self.hash(words, starts + at))] = min(reach - at, 255)
        last = self.hash(words, starts + reach)
        order = np.argsort(last, kind="stable")
        self.numbers, self.suffixes = numbers[order], last[order]

    def hash(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64 bits of the block that starts at each place."""
        with np.errstate(over="ignore"):
            if self.block <= 8:
                mask = np.uint64((1 << 8 * self.block) - 1)
                return (words[at] & mask) * np.uint64(0x9E3779B97F4A7C15)
            two = words[at + 8]
            two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            both = words[at] * np.uint64(0x94D049BB133111EB) + two
            return (both ^ (both >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)

    def slot(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Places among ``size`` bytes where buckets are to be compared, with the buckets' ends.

        ``words`` holds the :func:`eights` of those bytes and of eight more.
        """
        end = size - self.m + 1
        at = np.arange(0, max(end, 0), LANE)
        stop = np.minimum(at + LANE, end)
        while len(at):
            key = self.hash(words, at + (self.m - self.block))
            shift = self.shift[self.slot(key)].astype(np.int64)
            found = np.flatnonzero(shift == 0)
            if len(found):
                low = np.searchsorted(self.suffixes, key[found], "left")
                high = np.searchsorted(self.suffixes, key[found], "right")
                yield at[found], low, high
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]


class Patterns:
    """All windows of a set of items, as places in the items' bytes, in classes by their length.

    The bytes of an item are held once; a window costs about 30 bytes more, and the table of shifts
    sixteen entries of a byte for each byte of the items, up to ``2 ** MOST_BITS``.
    """

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW) -> None:
        names, parts, total = [], [], 0
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            raw = np.frombuffer(words, np.uint8)
            spaces = np.flatnonzero(raw == 32)
            k = min(size, len(spaces) - 1)
            start, end = spaces[:len(spaces) - k], spaces[k:] + 1
            hashed = SpanHash(raw)(start, end)
            for column, values in zip(columns, (start + total, end - start, np.full(len(start), k),
                                                hashed, np.full(len(start), len(names)))):
                column.append(values)
            names.append(item)
            parts.append(words)
            total += len(words)
        self.names, self.data = names, b"".join(parts)
        if not names:
            self.classes = []
            return
        starts, sizes, lengths, hashed, owners = (np.concatenate(c) for c in columns)
        order = np.lexsort((starts, hashed, sizes))
        starts, sizes, lengths, hashed, owners = (
            c[order] for c in (starts, sizes, lengths, hashed, owners))
        same = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (sizes[1:] == sizes[:-1])))
        for i in np.flatnonzero(same).tolist():  # equal by hash: equal by bytes as well?
            a, b, n = int(starts[i - 1]), int(starts[i]), int(sizes[i])
            same[i] = self.data[a:a + n] == self.data[b:b + n]
        first = np.flatnonzero(~same)
        self.owners = owners.astype(np.int32)
        self.owned = np.append(first, len(owners))
        self.starts, self.sizes = starts[first], sizes[first].astype(np.int32)
        self.lengths = lengths[first].astype(np.int32)
        bits = min(MOST_BITS, max(SMALL_BITS, (16 * total).bit_length()))
        words = eights(np.frombuffer(self.data + bytes(16), np.uint8))
        kinds = np.minimum(6, np.ceil(np.log2(self.sizes + 1)).astype(np.int64))
        self.classes = []
        for kind in np.unique(kinds):
            numbers = np.flatnonzero(kinds == kind)
            self.classes.append(Class(words, self.starts[numbers], numbers,
                                      int(self.sizes[numbers].min()), bits))

    def search(self, texts: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each text of words, the ranges of words hit and the items with a window in it."""
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        data = b"\0".join(texts) + b"\0"  # in no pattern, so no match crosses texts
        raw = np.frombuffer(data + bytes(16), np.uint8)
        spaces = np.flatnonzero(raw == 32)
        words = eights(raw)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        for tables in self.classes:
            for places, lows, highs in tables.search(words, len(data)):
                for at, low, high in zip(places.tolist(), lows.tolist(), highs.tolist()):
                    for number in tables.numbers[low:high].tolist():
                        start = int(self.starts[number])
                        if not data.startswith(self.data[start:start + int(self.sizes[number])], at):
                            continue
                        own = int(np.searchsorted(starts, at, "right")) - 1
                        word = int(np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[own]))
                        hits[own].append((word, word + int(self.lengths[number])))
                        first, last = self.owned[number], self.owned[number + 1]
                        items[own].update(self.names[i] for i in self.owners[first:last])
        return hits, items


def covered(ranges: list[tuple[int, int]]) -> int:
    total, reached = 0, 0
    for start, end in sorted(ranges):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


VERDICT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
           "items array<string>")
HITS = "digest binary, hits array<long>, items array<string>"


def _blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's patterns, in blocks of about ``block_bytes`` of text, as broadcast values."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                             F.col("text").cast("string").alias("item_text"))
    items = written(items.distinct(), "benchmark-items")  # a repeated item is one of one block
    total = scalar(items.agg(F.sum(F.octet_length("item_text")))) or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == block)
        patterns = Patterns([tuple(row) for row in own.collect()], size)  # of block_bytes or so
        yield benchmark.sparkSession.sparkContext.broadcast(patterns)


def _judge(n_words: int, n_hit: int, items: list[str]) -> tuple:
    return (n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
            n_hit > 0 and 20 * n_hit >= n_words, items)


def _judged(tables: Patterns, texts: list[str | None]) -> list[tuple]:
    """The verdict on each text, where one block holds all patterns."""
    words = [words_of(text) for text in texts]
    hits, items = tables.search(words)
    return [_judge(max(0, w.count(b" ") - 1), covered(h), sorted(i))
            for w, h, i in zip(words, hits, items)]


def _found(block: Broadcast):
    """The hits of one block in the texts that have any, by the digest of the text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            texts = [words_of(text) for text, in rows]
            hits, items = block.value.search(texts)
            out = [(hashlib.sha256(text.encode()).digest(), [x for pair in h for x in pair], sorted(i))
                   for (text,), h, i in zip(rows, hits, items) if h]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    list(zip(*out)) or [(), (), ()],
                    (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())))],
                names=["digest", "hits", "items"])
    return work


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was hit in a text by all blocks."""
    for batch in batches:
        hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        out = [_judge(0, covered(list(zip(h[::2], h[1::2]))), sorted(set(i))) for h, i in zip(hits, items)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string()),
             pa.array([o[5] for o in out], pa.list_(pa.string()))],
            names=["digest", "n_hit", "n_items", "items_sha256", "items"])


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _merged(docs: DataFrame, first: Broadcast, others: Iterator[Broadcast]) -> DataFrame:
    """``n_hit`` and items of every text that a block hits. Of a block only the hits are written."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = None
    for block in itertools.chain((first,), others):
        own = written(texts.mapInArrow(_found(block), HITS).dropDuplicates(["digest"]),
                      "decontamination")
        found = own if found is None else found.unionByName(own)
        block.unpersist()
    merged = found.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"),
                                         F.flatten(F.collect_list("items")).alias("items"))
    return merged.mapInArrow(_summed, "digest binary, n_hit long, n_items long, items_sha256 string, "
                                      "items array<string>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of every text; its digest stays."""
    for rows in rows_of(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc for doc, _, _ in rows], pa.int64()),
             pa.array([digest for _, digest, _ in rows], pa.binary()),
             pa.array([max(0, words_of(text).count(b" ") - 1) for *_, text in rows], pa.int64())],
            names=["doc_id", "digest", "n_words"])


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs`` its words, the words hit by windows of items, and the items.

    A row is contaminated if at least a twentieth of its words is hit. Null and empty texts have no
    words and hit nothing; items without words have no windows, items without an id count as one
    named ``null``, an item that occurs twice as one. Repeated rows are judged each on its own.
    Extra columns of either table are ignored. With an empty benchmark nothing is hit.
    """
    rows = documents(docs)
    blocks = _blocks(benchmark, size, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in rows_of(batches):
                columns = zip(*_judged(first.value, [text for _, text in part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc for doc, _ in part], pa.int64()),
                     *(pa.array(c, kind) for c, kind in zip(columns, (
                         pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
                         pa.list_(pa.string()))))],
                    names=["doc_id", *(c.split()[0] for c in VERDICT.split(", "))])

        return rows.mapInArrow(work, f"doc_id long, {VERDICT}")
    merged = _merged(rows, first, itertools.chain((second,), blocks))
    counted = rows.select("doc_id", _digest("text").alias("digest"), "text").mapInArrow(
        _counted, "doc_id long, digest binary, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(merged, "digest", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`contamination` finds clean."""
    blocks = _blocks(benchmark, size, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in rows_of([batch.select(["text"])]):
                    clean = [not v[4] for v in _judged(first.value, [text for text, in part])]
                    yield batch.slice(at, len(part)).filter(pa.array(clean, pa.bool_()))
                    at += len(part)

        return docs.mapInArrow(work, docs.schema)
    merged = _merged(docs, first, itertools.chain((second,), blocks)).select("digest", "n_hit")
    (own,) = fresh(docs, "_digest")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            bad = [(digest,) for digest, hit, text in part
                   if 20 * hit >= max(0, words_of(text).count(b" ") - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, in bad], pa.binary())], names=[own])

    texts = docs.select(_digest("text").alias("digest"), F.col("text").cast("string").alias("text"))
    bad = (texts.join(merged, "digest").select("digest", "n_hit", "text")
           .mapInArrow(judged, f"{own} binary").distinct())
    return docs.join(bad, _digest("text") == F.col(own), "left_anti")
