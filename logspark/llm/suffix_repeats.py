"""Removal of byte strings that also stand in an earlier document, by run-length indexes.

Every string of ``WIDTH`` bytes has a core: the ``GRAM`` bytes in it with the smallest hash. Its anchor
is the core with the ``SIDE`` bytes after it or, where the string ends before them, those before it.
Equal strings have equal anchors, so a document falls into fragments, each the strings of one anchor
in a row, and only fragments of equal anchors have to meet. Cores alone recur by chance, the more often
the larger the corpus is; anchors of twice their length hardly do. No window is compared with all
others, and no text moves as a whole.

0. Documents are packed into batches of a few megabytes, compressed, and written down.
1. Each batch sends the hashes of its anchors, each once, to buckets, which answer which of them other
   fragments have too.
2. Each batch sends its distinct fragments with such anchors, each once under its smallest ``doc_id``.
   Copies of a fragment meet by its hash and are compared: the document with the smallest id keeps
   it. Different
   fragments of one anchor go into a run-length index (:mod:`.run_index`); all are streamed through it,
   and where the matching statistic reaches ``WIDTH`` the index tells the smallest document among the
   places of the match. The answer is one bit a string.
3. Each batch turns the answers into removed bytes.

An anchor of very many fragments, such as the end of a passage that a third of all documents hold,
is not gathered: its strings are sent one by one as fragments of their own, keyed by their own bytes,
so that they spread over all buckets and copies again meet by hash. What a batch holds several times
it sends once. Hand-over tables are written to the shared folder. Messages go from each batch to each
bucket, so buckets grow with the square root of the corpus and batches, of which a task needs more
memory, with the fourth root: the number of messages then grows little faster than the corpus does, not
with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, documents, mix, partitions_for, rows_of, scalar, written
from .run_index import RunIndex

WIDTH = 50
GRAM = 16  # two words of eight bytes
SIDE = (WIDTH - GRAM + 1) // 2
LONGEST = WIDTH + SIDE  # bytes of a fragment at the most
BATCH_BYTES = 3 << 19
CROWD = 2048  # fragments of one anchor, from which on its strings go one by one
SHARD_BYTES = 1 << 18
BUCKET_ANCHORS = 1 << 19
BUCKET_BYTES = 4 << 20
CHUNK = 1 << 16
TASK_BYTES = 8 << 20  # of text whose messages meet in a task, on average
STEADY = 1 << 30  # bytes of text up to which batches, buckets and tasks have these sizes
MOST = 4.0  # times larger buckets are at the most, as one is held in memory; batches half of it

BATCHES = ("batch long, n_bytes long, doc_ids array<long>, lengths array<long>, texts binary")
ALONE, SHARED, CROWDED = 0, 1, 2


def _pack(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Batches of whole documents; a longer document is a batch of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            raw = b"".join(texts)
            row = (number, len(raw), ids, [len(t) for t in texts],
                   pa.compress(raw, "zstd", asbytes=True))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=["batch", "n_bytes", "doc_ids", "lengths", "texts"])

        for rows in rows_of(batches):
            for doc, text in rows:
                raw = (text or "").encode()
                if texts and held + len(raw) > batch_bytes:
                    yield flush()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield flush()

    return docs.mapInArrow(work, BATCHES)


def distinct(data: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray,
             content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fragment its number among the distinct ones; for each of these an occurrence in its
    smallest document, and that document. Distinct ones are in order of anchors.

    Fragments of one anchor and content hash are compared byte by byte; where a hash should have lied,
    the bytes themselves tell contents apart.
    """
    own, kept, low = _distinct(anchor, content, doc)
    first = kept[own]
    copies = np.flatnonzero(first != np.arange(len(own)))
    for a in range(0, len(copies), 1 << 12):
        part = copies[a:a + (1 << 12)]
        if not _alike(data, at[part], size[part], at[first[part]], size[first[part]]):
            seen: dict[bytes, int] = {}
            content = np.array([seen.setdefault(data[x:x + m].tobytes(), len(seen))
                                for x, m in zip(at.tolist(), size.tolist())], np.uint64)
            return _distinct(anchor, content, doc)
    return own, kept, low


def _alike(data, at, size, other, other_size) -> bool:
    """Whether all spans are those at the other places, byte by byte or in words that overlap."""
    if (size != other_size).any():
        return False
    least = int(size.min(initial=WIDTH))
    unit = 8 if least >= 8 else 1
    words = np.ndarray(len(data) - unit + 1, f"<u{unit}", data, 0, (1,))
    for k in range(0, int(size.max(initial=0)), unit):
        step = np.minimum(k, size - unit)
        if (words[at + step] != words[other + step]).any():
            return False
    return True


def by_key(keys: np.ndarray) -> np.ndarray:
    """Positions in the order of the keys' upper bits, all but as many as number the positions.

    Numbers that end in their position are sorted, which is faster than sorting positions.
    """
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    packed = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _distinct(anchor, content, doc):
    order = by_key(anchor)
    upper = anchor[order] >> np.uint64(max(1, len(order) - 1).bit_length())
    tied = np.zeros(len(order), bool)
    tied[1:] = upper[1:] == upper[:-1]
    tied[:-1] |= tied[1:]
    spots = np.flatnonzero(tied)
    few = order[spots]
    order[spots] = few[np.lexsort((doc[few], content[few], anchor[few]))]
    new = np.ones(len(order), bool)
    new[1:] = ((anchor[order[1:]] != anchor[order[:-1]])
               | (content[order[1:]] != content[order[:-1]]))
    own = np.zeros(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    kept = order[new]
    return own, kept, doc[kept]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place of data that holds so many."""
    words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,)) * np.uint64(MULTIPLIER)
    words ^= words >> np.uint64(32)
    out = words[:-8] * np.uint64(0xD6E8FEB86659FD93)
    out += words[8:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)  # upper bits are the best mixed
    return out


def _spans(grams: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of spans of ``GRAM`` to ``longest`` bytes, from grams that cover them."""
    out = (end - start).astype(np.uint64)
    for k in range(0, longest, GRAM):
        out ^= grams[np.minimum(start + k, end - GRAM)]
        out *= np.uint64(MULTIPLIER)
        out ^= out >> np.uint64(31)
    return mix(out)


def _string_hash(grid: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a table of bytes, ``WIDTH`` each."""
    out = np.full(len(grid), 0x5EED, np.uint64)
    for k in (*range(0, WIDTH - 7, 8), WIDTH - 8):
        out ^= np.ndarray(len(grid), "<u8", grid, k, (WIDTH,))
        out *= np.uint64(MULTIPLIER)
        out ^= out >> np.uint64(31)
    return mix(out)


class Fragments:
    """The fragments of a batch, its distinct ones, and what it sends of them."""

    def __init__(self, row: dict, chunk: int = CHUNK) -> None:
        self.chunk = chunk
        raw = pa.decompress(row["texts"], row["n_bytes"], "zstd", asbytes=True) if row["n_bytes"] else b""
        self.raw, self.data = raw, np.frombuffer(raw, np.uint8)
        self.ids = row["doc_ids"]
        lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        known = np.array([i is not None for i in self.ids], bool)
        self.numbers = np.array([i or 0 for i in self.ids], np.int64)
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        parts = [(none, none, no_hash, no_hash)]
        parts += [self._anchors(a, b) for a, b in zip(*self._stretches(known))]
        at, count, anchor, content = map(np.concatenate, zip(*parts))
        del parts
        self.doc = self.numbers[np.searchsorted(self.ends, at, "right")]
        own, kept, self.low = distinct(self.data, at, count + WIDTH - 1, anchor, content, self.doc)
        # no batch has 2 ** 31 bytes
        self.at, self.count, self.own, self.kept = (x.astype(np.int32) for x in (at, count, own, kept))
        self.anchor = anchor[kept]  # of the distinct ones

    def _stretches(self, known: np.ndarray) -> tuple[list[int], list[int]]:
        """Byte ranges to look at together: neighbouring documents, or parts of a very long one."""
        a, b = [], []
        for start, end, good in zip(self.starts.tolist(), self.ends.tolist(), known.tolist()):
            if not good or end - start < WIDTH:
                continue
            if a and b[-1] == start and end - a[-1] <= self.chunk:
                b[-1] = end
                continue
            for cut in range(start, end - WIDTH + 1, self.chunk):
                a.append(cut)
                b.append(min(end, cut + self.chunk + WIDTH - 1))
        return a, b

    def _anchors(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        data = self.data[a:b]
        grams = _grams(data)
        reach = WIDTH - GRAM + 1
        low = np.uint64((1 << 24) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        where = (least & low).astype(np.int64)
        inside = np.searchsorted(self.ends, np.array([a, b - 1]), "right")
        for edge in self.ends[inside[0]:inside[1]].tolist():  # strings stay inside a document
            where[max(0, edge - a - WIDTH + 1):edge - a] = -1
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        end, core = np.append(first[1:], len(where)), where[first]
        first, end, core = first[core >= 0], end[core >= 0], core[core >= 0]
        turn = np.clip(core - SIDE + 1, first, end)  # from here on the bytes after the core are inside
        first, end = np.stack((first, turn), 1).ravel(), np.stack((turn, end), 1).ravel()
        real = first < end
        first, count, core = first[real], (end - first)[real], np.repeat(core, 2)[real]
        after = core - first < SIDE
        # hashes of cores are least ones, so most are low: an anchor's spread over all buckets alike
        anchor = _spans(grams, core - np.where(after, 0, SIDE), core + GRAM + np.where(after, SIDE, 0),
                        GRAM + SIDE) ^ after
        return (first + a, count, mix(anchor), _spans(grams, first, first + count + WIDTH - 1, LONGEST))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, the distinct fragments of each, and each fragment's anchor."""
        own = self.anchor
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        first = np.flatnonzero(new)
        return own[first], np.diff(np.append(first, len(own))), np.cumsum(new) - 1

    def sent(self, flags: np.ndarray, buckets: int) -> dict:
        """The fragments to send, given a flag for each distinct anchor.

        A dictionary of arrays in order of buckets: ``at``, ``count``, ``key`` and ``doc`` of each
        distinct fragment sent. ``whole`` gives each fragment's place in it, or -1; ``strings`` those
        of the strings of crowded anchors with the positions they stand for.
        """
        flag = flags[self.anchors()[2]]
        one = np.flatnonzero(flag == SHARED)
        crowd = np.flatnonzero(flag[self.own] == CROWDED)
        at = np.repeat(self.at[crowd], self.count[crowd])
        shift = np.arange(len(at)) - np.repeat(np.cumsum(self.count[crowd]) - self.count[crowd],
                                               self.count[crowd])
        at = at + shift
        doc = np.repeat(self.doc[crowd], self.count[crowd])
        key = np.zeros(len(at), np.uint64)
        for a in range(0, len(at), 1 << 13):  # hashed from their bytes, piece by piece
            key[a:a + (1 << 13)] = _string_hash(self.data[at[a:a + (1 << 13), None] + np.arange(WIDTH)])
        own, kept, low = distinct(self.data, at, np.full(len(at), WIDTH), key, key, doc)
        all_at = np.concatenate((self.at[self.kept[one]], at[kept]))
        all_count = np.concatenate((self.count[self.kept[one]], np.ones(len(kept), np.int64)))
        all_key = np.concatenate((self.anchor[one], key[kept]))
        all_doc = np.concatenate((self.low[one], low))
        order = by_key(all_key)
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        whole = np.full(len(self.kept), -1)
        whole[one] = place[:len(one)]
        return {"at": all_at[order], "count": all_count[order], "key": all_key[order],
                "doc": all_doc[order], "bucket": bucket_of(all_key[order], buckets),
                "whole": whole, "strings": (at, doc, place[len(one):][own], low[own])}

    def removed(self, sent: dict, answers: np.ndarray) -> np.ndarray:
        """Which bytes go, given for each fragment sent the strings that stand in earlier documents."""
        gone = np.zeros(len(self.data), bool)
        place = sent["whole"][self.own]
        bits = np.where(place >= 0, answers[np.maximum(place, 0)] if len(answers) else 0, 0)
        bits = bits.astype(np.uint64)
        bits[self.doc > self.low[self.own]] = ~np.uint64(0)
        hit = np.flatnonzero(bits)
        for k in range(int(self.count[hit].max(initial=0))):
            own = hit[(self.count[hit] > k) & ((bits[hit] >> np.uint64(k)) & np.uint64(1)
                                               ).astype(bool)]
            gone[self.at[own] + k] = True
        at, doc, place, low = sent["strings"]
        if len(at):
            late = (doc > low) | ((answers[place] & np.uint64(1)) > 0)
            gone[at[late]] = True
        begun = np.flatnonzero(gone)
        apart = np.flatnonzero(np.diff(begun) > WIDTH)
        edges = np.stack((begun[np.append(0, apart + 1)], begun[np.append(apart, -1)] + WIDTH), 1).ravel() \
            if len(begun) else begun
        sizes = np.diff(np.concatenate(([0], edges, [len(self.data)])))
        return np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of keys."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def rest_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What tells keys of a bucket apart, 32 bits in their order. Keys that meet by chance do no harm:
    more is sent, or strings of different anchors are compared."""
    with np.errstate(over="ignore"):
        return (keys * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones and so on, which compress better."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(body: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(rest: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as their differences."""
    return _planes(np.diff(rest, prepend=np.uint32(0)))


def _unstepped(body: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(_unplaned(body, "<u4", n, at), dtype=np.uint32)


def _slices(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(sorted_buckets)) + 1
    cuts = [0, *edges.tolist(), len(sorted_buckets)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(sorted_buckets[a]), a, b


MESSAGE = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("size", pa.int64()),
                     ("body", pa.binary())])
MESSAGE_SQL = "bucket long, batch long, size long, body binary"


def _message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows],
            [pa.compress(r[2], "zstd", asbytes=True) for r in rows])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MESSAGE)],
                                      schema=MESSAGE)


def _body(row: dict) -> bytes:
    return pa.decompress(row["body"], row["size"], "zstd", asbytes=True) if row["size"] else b""


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each holds a batch of documents."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _send_anchors(buckets: int, chunk: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                values, counts, _ = Fragments(row, chunk).anchors()
                if not len(values):
                    continue
                rest = rest_of(values, buckets)
                many = np.minimum(counts, 255).astype(np.uint8)
                yield _message([
                    (bucket, row["batch"], _steps(rest[a:b]) + many[a:b].tobytes())
                    for bucket, a, b in _slices(bucket_of(values, buckets))])

    return work


def _flag_anchors(table: pa.Table, crowd: int) -> pa.Table:
    """One bucket: a flag for each anchor that each batch has sent."""
    rows = table.to_pylist()
    lows, counts = [], []
    for row in rows:
        body = _body(row)
        n = len(body) // 5
        lows.append(_unstepped(body, n, 0))
        counts.append(np.frombuffer(body, np.uint8, n, 4 * n))
    low, count = np.concatenate(lows), np.concatenate(counts)
    packed = np.sort((low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
    order, low = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), packed >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = count[order]
    total = np.add.reduceat(count, first, dtype=np.int64)
    full = np.maximum.reduceat(count, first) >= 255
    flag = np.where(full | (total >= crowd), CROWDED, np.where(total > 1, SHARED, ALONE))
    flags = np.zeros(len(order), np.uint8)
    flags[order] = np.repeat(flag, np.diff(np.append(first, len(order))))
    ends = np.cumsum([len(x) for x in lows])
    out = _message([(row["bucket"], row["batch"], flags[end - len(x):end].tobytes())
                    for row, x, end in zip(rows, lows, ends.tolist())])
    return pa.Table.from_batches([out])


def _answers(parts: list[dict] | None) -> bytes:
    """What came back to a batch, in the order in which it was sent."""
    return b"".join(_body(part) for part in sorted(parts or (), key=lambda p: p["bucket"]))


def _send_fragments(buckets: int, chunk: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = Fragments(row, chunk)
                sent = own.sent(np.frombuffer(_answers(row["flags"]), np.uint8), buckets)
                if not len(sent["at"]):
                    continue
                rows, rest = [], rest_of(sent["key"], buckets)
                for bucket, a, b in _slices(sent["bucket"]):
                    at, count = sent["at"][a:b], sent["count"][a:b]
                    rows.append((bucket, row["batch"], b"".join((
                        np.int64(b - a).tobytes(), _steps(rest[a:b]), _planes(sent["doc"][a:b]),
                        count.astype(np.uint8).tobytes(),
                        *(own.raw[x:y] for x, y in zip(at.tolist(), (at + count + WIDTH - 1).tolist()))))))
                yield _message(rows)

    return work


def _match(table: pa.Table, shard_bytes: int) -> pa.Table:
    """One bucket: for each fragment sent, a bit for each string that stands in an earlier document."""
    rows = table.to_pylist()
    keys, docs, counts, texts = [], [], [], []
    for row in rows:
        body = _body(row)
        n = int(np.frombuffer(body, "<i8", 1)[0])
        keys.append(_unstepped(body, n, 8))
        docs.append(_unplaned(body, "<i8", n, 8 + 4 * n))
        counts.append(np.frombuffer(body, np.uint8, n, 8 + 12 * n))
        texts.append(np.frombuffer(body, np.uint8, offset=8 + 13 * n))
    sizes = [len(k) for k in keys]
    key, doc = np.concatenate(keys).astype(np.uint64) << np.uint64(32), np.concatenate(docs)
    count, text = np.concatenate(counts).astype(np.int64), np.concatenate(texts)
    rows = [(row["bucket"], row["batch"]) for row in rows]
    del keys, docs, counts, texts, body
    stop = np.cumsum(count + WIDTH - 1)
    start = stop - count - WIDTH + 1
    content = np.zeros(len(start), np.uint64)
    for a in range(0, len(start), 1 << 12):  # piece by piece, for the memory of it
        first, last = start[a:a + (1 << 12)], stop[a:a + (1 << 12)]
        content[a:a + (1 << 12)] = _spans(_grams(text[first[0]:last[-1]]), first - first[0],
                                          last - first[0], LONGEST)
    own, kept, low = distinct(text, start, stop - start, key, content, doc)
    bits = np.zeros(len(kept), np.uint64)
    # distinct fragments are in order of anchors: those of one anchor alone have nothing to match
    group = np.cumsum(np.concatenate(([0], key[kept[1:]] != key[kept[:-1]])))
    mixed = np.flatnonzero(np.bincount(group)[group] > 1)
    first_of = np.minimum.reduceat(low, np.searchsorted(group, np.arange(group[-1] + 1)))
    weight = np.cumsum(count[kept[mixed]] + WIDTH)
    shard = weight // shard_bytes
    if len(mixed):  # whole anchors to a shard
        head = np.searchsorted(group[mixed], group[mixed], "left")
        shard = shard[head]
    for number in np.unique(shard).tolist():
        part = mixed[shard == number]
        strings = [text[start[k]:stop[k]] + np.uint8(1) for k in kept[part]]  # no byte of UTF-8 is 255
        lengths = np.array([len(s) + 1 for s in strings])
        mark = np.zeros(1, np.uint8)
        index = RunIndex(np.concatenate([x for s in strings for x in (s, mark)]),
                         np.repeat(low[part], lengths), WIDTH)
        # the smallest document of an anchor has nothing earlier to match: it is only looked up in
        later = np.flatnonzero(low[part] > first_of[group[part]])
        for which, at, matched, places in index.statistics([strings[k] for k in later]):
            long = matched >= WIDTH
            if long.any():
                which, at = later[which[long]], at[long]
                early = index.lowest_owner(places[long]) < low[part[which]]
                bits[part[which[early]]] |= np.uint64(1) << at[early].astype(np.uint64)
    answer = bits[own]
    answer[doc > low[own]] = ~np.uint64(0)
    ends = np.cumsum(sizes)
    out = _message([(bucket, batch, answer[e - n:e].astype("<u8").tobytes())
                    for (bucket, batch), e, n in zip(rows, ends.tolist(), sizes)])
    return pa.Table.from_batches([out])


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
OUT_SQL = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
           "kept binary")


def _remove(buckets: int, chunk: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = Fragments(row, chunk)
                sent = own.sent(np.frombuffer(_answers(row["flags"]), np.uint8), buckets)
                gone = own.removed(sent, np.frombuffer(_answers(row["answers"]), "<u8"))
                out = []
                for doc, a, b in zip(own.ids, own.starts.tolist(), own.ends.tolist()):
                    cut, data = gone[a:b], own.data[a:b]
                    n = int(cut.sum())
                    spans = int((cut[1:] & ~cut[:-1]).sum()) + int(cut[0]) if n else 0
                    kept = (data[~cut] if n else data).tobytes()
                    out.append((doc, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = (*[pa.int64()] * 4, pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=OUT)

    return work


def _by_batch(messages: DataFrame, name: str) -> DataFrame:
    """All messages to a batch in its row; they are about as large as what it sent."""
    return messages.groupBy("batch").agg(
        F.collect_list(F.struct("bucket", "size", "body")).alias(name))


def scale_of(total: int) -> float:
    """Times which buckets and tasks are larger over ``total`` bytes of text; its root is that of batches."""
    return min(MOST, max(1.0, (total / STEADY) ** 0.5))


def remove_repeats(docs: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Each row's text, as UTF-8, without the bytes of 50-byte strings of smaller ``doc_id``.

    Overlapping strings all count, and the input is judged, not what is left of it. Matches never
    cross documents. A null text is empty; texts of fewer than 50 bytes lose nothing. Rows that share
    an id do not remove from each other; rows without an id neither lose nor cause anything. Extra
    columns are ignored. Texts of any length are worked on whole. Without ``batch_bytes`` the texts'
    lengths are summed up first, and batches sized by it.
    """
    spark, docs = docs.sparkSession, documents(docs)
    if batch_bytes is None:
        size = scalar(docs.agg(F.sum(F.octet_length("text").cast("long")))) or 0
        batch_bytes = int(BATCH_BYTES * scale_of(size) ** 0.5)
    packed = written(_pack(docs, batch_bytes), "batches")
    total = scalar(packed.agg(F.sum("n_bytes"))) or 0
    scale = scale_of(total)
    # an anchor comes about every (WIDTH - GRAM + 2) / 3 bytes
    few = partitions_for(spark, 3 * total // (WIDTH - GRAM + 2), int(BUCKET_ANCHORS * scale))
    many = partitions_for(spark, 2 * total, int(BUCKET_BYTES * scale))
    # A fixed number of partitions: merged by their bytes, some would get many of the buckets.
    tasks = partitions_for(spark, total, int(TASK_BYTES * scale))
    crowd, shard_bytes, chunk = CROWD, SHARD_BYTES, CHUNK
    flags = (packed.mapInArrow(_send_anchors(few, chunk), MESSAGE_SQL).repartition(tasks, "bucket")
             .groupBy("bucket").applyInArrow(lambda t: _flag_anchors(t, crowd), MESSAGE_SQL))
    asked = packed.join(written(_by_batch(flags, "flags"), "anchor-flags"), "batch", "left")
    answers = (asked.mapInArrow(_send_fragments(many, chunk), MESSAGE_SQL).repartition(tasks, "bucket")
               .groupBy("bucket").applyInArrow(lambda t: _match(t, shard_bytes), MESSAGE_SQL))
    # Not written: in one plan with the answers the batches are shuffled once, not twice.
    judged = asked.join(_by_batch(answers, "answers"), "batch", "left")
    return judged.mapInArrow(_remove(many, chunk), OUT_SQL)
