"""Byte-level BPE encoding by segment trees, and decoding.

A piece of text is an array of bytes; leaf ``i`` of its tree holds the rank of the pair that starts
at byte position ``i``, with the position in the low bits, so the root is the leftmost minimum. A
merge joins the root's pair, drops the right neighbour from a linked list of live positions, and
makes three point updates, each logarithmic: the merged position, its left neighbour and the dropped
one. Short pieces are worked on together, one tree per row of a matrix; long ones one at a time.

Texts are never shuffled: a document's row is all its result needs, so one map stage does it all and
a lost executor costs its tasks. Pieces recur, so each worker keeps the ids of those it has seen, up
to ``CACHE`` of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, rows_of

CACHE = 600_000
LONG = 64
CELLS = 1 << 20
SHIFT = 32
NONE = np.int64(1) << 62

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


class BytePairs:
    """The ranks of a vocabulary file, and the pairs that merge into each of them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.array(list(self.pairs.values()), np.int64)[order]
        self.seen: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, :data:`NONE` where there is none (a token of -1 has none)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.merged[at], NONE)

    def encode_rows(self, pieces: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of pieces of 2 to :data:`LONG` bytes, all trees in one matrix, and where each starts."""
        n, size = len(pieces), max(map(len, pieces))
        leaves = 1 << (size - 1).bit_length()
        width = leaves + 2  # a position past the end, and one before the start
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8)
        live = np.arange(leaves) < lengths[:, None]
        token = np.full((n, width), -1, np.int64)
        token[:, :leaves] = np.where(live, self.single[raw.reshape(n, leaves)], -1)
        following = np.tile(np.minimum(np.arange(1, width + 1), leaves), (n, 1))
        before = np.tile(np.concatenate(([leaves + 1], np.arange(width - 1))), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        ranks = self.rank_of(token[:, :leaves].ravel(), token[:, 1:leaves + 1].ravel())
        keys = np.where(ranks < NONE, (ranks << SHIFT) | np.tile(np.arange(leaves), n), NONE)
        tree[:, leaves:] = keys.reshape(n, leaves)
        step = leaves
        while step > 1:
            half = step >> 1
            tree[:, half:step] = np.minimum(tree[:, step:2 * step:2], tree[:, step + 1:2 * step:2])
            step = half
        flat, tok, nxt, prv = tree.ravel(), token.ravel(), following.ravel(), before.ravel()

        rows = np.arange(n)
        while len(rows):
            root = flat[rows * 2 * leaves + 1]
            going = root < NONE
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            base, top = rows * width, rows * 2 * leaves
            at = root & ((1 << SHIFT) - 1)
            gone = nxt[base + at]
            after, left = nxt[base + gone], prv[base + at]
            tok[base + at], tok[base + gone] = root >> SHIFT, -1
            nxt[base + at] = after
            prv[base + after] = at
            rank = self.rank_of(tok[base + at], tok[base + after])
            flat[top + leaves + at] = np.where(rank < NONE, (rank << SHIFT) | at, NONE)
            flat[top + leaves + gone] = NONE
            has = left <= leaves - 1
            spot = np.where(has, left, at)
            rank = self.rank_of(tok[base + left], tok[base + at])
            value = np.where(rank < NONE, (rank << SHIFT) | spot, NONE)
            flat[top + leaves + spot] = np.where(has, value, flat[top + leaves + spot])
            nodes = [leaves + at, leaves + gone, leaves + spot]
            while nodes[0][0] > 1:
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    flat[top + node] = np.minimum(flat[top + 2 * node], flat[top + 2 * node + 1])
        alive = token >= 0
        ends = np.concatenate(([0], np.cumsum(alive.sum(1)) * 4))
        return token[alive].astype("<u4").tobytes(), ends.tolist()

    def encode_long(self, piece: bytes) -> np.ndarray:
        """One piece of any length: the same tree in lists."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none = int(NONE)
        token = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.rank_of(token[:-1], token[1:])
        tree = np.full(2 * leaves, NONE, np.int64)
        tree[leaves:leaves + n - 1] = np.where(
            ranks < NONE, (ranks << SHIFT) | np.arange(n - 1), NONE)
        step = leaves
        while step > 1:
            half = step >> 1
            tree[half:step] = np.minimum(tree[step:2 * step:2], tree[step + 1:2 * step:2])
            step = half
        tree, token = tree.tolist(), token.tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pairs.get

        def put(at: int, left: int, right: int) -> None:
            rank = pair((left, right)) if right >= 0 else None
            node = leaves + at
            tree[node] = none if rank is None else (rank << SHIFT) | at
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            at, rank = tree[1] & ((1 << SHIFT) - 1), tree[1] >> SHIFT
            gone = following[at]
            after = following[gone]
            token[at], token[gone] = rank, -1
            following[at] = after
            if after < n:
                before[after] = at
            put(gone, -1, -1)
            put(at, rank, token[after] if after < n else -1)
            if before[at] >= 0:
                put(before[at], token[before[at]], rank)
        return np.array([t for t in token if t >= 0], np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of ``pieces`` into the cache, as little-endian unsigned 32-bit integers."""
        if len(self.seen) + len(pieces) > CACHE:
            self.seen.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.seen[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.seen[piece] = self.encode_long(raw).astype("<u4").tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in by_size.items():
            each = max(1, CELLS >> bits)
            for start in range(0, len(group), each):
                part = group[start:start + each]
                ids, at = self.encode_rows([raw for _, raw in part])
                self.seen.update((piece, ids[a:b]) for (piece, _), a, b in zip(part, at, at[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(text) for text in texts]
        missing = set().union(*pieces).difference(self.seen) if pieces else set()
        if missing:
            kept = len(self.seen) + len(missing) <= CACHE
            if not kept:  # the cache starts again from these texts
                missing = set().union(*pieces)
            self.learn(missing)
        get = self.seen.__getitem__
        return [b"".join(map(get, own)) for own in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each document's ids, as bytes, with the checksums of them and of what they decode to.

    A null or empty text has no ids. Repeated rows and null ids are rows like others. Very long texts
    and pieces are encoded whole. Columns other than ``doc_id`` and ``text`` are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = load(path, pattern)
        for rows in rows_of(batches):
            ids = tables.encode([text or "" for _, text in rows])
            yield pa.RecordBatch.from_arrays([
                pa.array([doc for doc, _ in rows], pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(tables.decode(x)).hexdigest() for x in ids], pa.string()),
                pa.array(ids, pa.binary()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return documents(docs).mapInArrow(work, SCHEMA)
