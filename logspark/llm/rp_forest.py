"""Near-duplicate vectors by a forest of random projections.

Vectors of one label that are equal are one class. A tree splits the classes of a label again and
again by a random direction at the median of a sample, so dense regions get as many leaves as they
have members. In each tree a class goes to its own leaf and, as spill, to the leaf it would reach if its
closest decision went the other way. Classes of a leaf are compared all with all, by cosine in
double precision, so no pair below the threshold is ever linked; a pair is lost only if all trees
part it, and neither of the two is in a dense region.

Where the sample shows far more neighbours of a class than a leaf holds, random splits would part most
pairs, so dense regions stay out of the trees and are compared exactly. Their centres cover every dense
class of the sample by balls of the threshold's angle; centres whose balls may share links are one
region. Each class in a ball is compared with all classes that may link to it, in salted pairs of
blocks; classes within half the angle of one centre all link, which needs no comparison.

Leaves send no pairs. Each class carries the leaves it is in, so a leaf can tell whether two classes
meet in another leaf first, and counts a link only where they meet first. It sends, for each class
with links, their number and the smallest class its links reach within the leaf; numbers are summed
and the local roots joined to components.

The trees are fitted on at most ``sample`` classes, chosen by hash; all classes are in all trees. Leaves
hold about ``leaf`` classes of a label, or more where the sample is too small for that many splits
(``MIN_SAMPLE`` sampled classes a leaf).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

COSINE = 0.93
TREES = 12
LEAF = 192
SAMPLE = 50_000
MIN_SAMPLE = 8
BLOCK = 1 << 20  # pairs worked on at once
DENSE = 3  # leaves that the neighbours of a class would fill, from which on they are compared exactly
ROWS = 8_192  # classes in a block of a dense region

CLASSES = "cls binary, label long, vector binary"


class Tree:
    """Directions and medians of one label's tree, its nodes numbered as in a heap."""

    def __init__(self, vectors: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.normal(size=((1 << depth) - 1, vectors.shape[1])).astype(np.float32)
        self.medians = np.zeros((1 << depth) - 1)
        self.spreads = np.ones((1 << depth) - 1)
        node = np.zeros(len(vectors), np.int64)
        for _ in range(depth):
            own = np.einsum("ij,ij->i", vectors, self.directions[node])
            for number in np.unique(node):
                values = own[node == number]
                self.medians[number] = np.median(values)
                self.spreads[number] = values.std() or 1.0
            node = 2 * node + 1 + (own > self.medians[node])

    def descend(self, vectors: np.ndarray, node: np.ndarray, level: np.ndarray):
        """Leaves reached from ``node``, and the closest decision on the way: its node and margin."""
        close, at, turn = np.full(len(node), np.inf), node.copy(), np.zeros(len(node), np.int64)
        for depth in range(self.depth):
            going = level <= depth
            here = np.where(going, node, 0)
            own = np.einsum("ij,ij->i", vectors, self.directions[here]) - self.medians[here]
            right = own > 0
            margin = np.where(going, np.abs(own) / self.spreads[here], np.inf)
            closer = margin < close
            close = np.where(closer, margin, close)
            at = np.where(closer, 2 * node + 1 + ~right, at)
            turn = np.where(closer, depth + 1, turn)
            node = np.where(going, 2 * node + 1 + right, node)
        return node, at, turn

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        if not self.depth:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        start = np.zeros(n, np.int64)
        own, other, level = self.descend(vectors, start, start)
        return own, self.descend(vectors, other, level)[0]


class Forest:
    """The trees of each label in the sample; a label outside it is a single leaf."""

    def __init__(self, labels: np.ndarray, vectors: np.ndarray, total: int, trees: int, leaf: int,
                 seed: int = 5) -> None:
        self.count = trees
        self.trees: dict[int, list[Tree]] = {}
        scale = total / max(1, len(labels))
        for label in np.unique(labels).tolist():
            own = vectors[labels == label]
            leaves = min(len(own) * scale / leaf, len(own) / MIN_SAMPLE)
            depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
            if depth:
                self.trees[label] = [Tree(own, depth, seed * 1000 + t) for t in range(trees)]

    def places(self, label: int, vectors: np.ndarray) -> np.ndarray:
        """For each vector its leaves, two for each tree, as ``tree << 40 | leaf``."""
        trees = self.trees.get(label)
        if trees is None:
            return np.zeros((len(vectors), 1), np.int64)
        return np.stack([(t << 40) | leaf for t, tree in enumerate(trees)
                         for leaf in tree.leaves(vectors)], 1)


class Dense:
    """The dense regions of one label: centres from the sample, and the region of each."""

    def __init__(self, vectors: np.ndarray, least: float, cosine: float) -> None:
        angle = float(np.arccos(np.clip(cosine, -1, 1)))
        self.cosine, self.tight = cosine, float(np.cos(angle / 2)) + 1e-9
        self.reach = float(np.cos(2 * angle + 1e-6)) if 2 * angle + 1e-6 < np.pi else -2.0
        counts, small = np.zeros(len(vectors), np.int64), vectors.astype(np.float32)
        step = max(1, BLOCK // max(1, len(small)))
        for start in range(0, len(small), step):
            counts[start:start + step] = (small[start:start + step] @ small.T >= cosine).sum(1)
        rest = np.flatnonzero(counts >= least)
        rest, chosen = rest[np.argsort(-counts[rest], kind="stable")], []
        while len(rest):
            chosen.append(rest[0])
            rest = rest[1:][vectors[rest[1:]] @ vectors[rest[0]] < cosine]
        self.centres = vectors[chosen]
        apart = float(np.cos(3 * angle + 1e-6)) if 3 * angle + 1e-6 < np.pi else -2.0
        near = self.centres @ self.centres.T >= apart  # their balls may share links
        self.region, before = np.arange(len(chosen)), None
        while before is None or (before != self.region).any():
            before = self.region
            self.region = np.array([before[row].min() for row in near | np.eye(len(near), dtype=bool)],
                                   np.int64)

    def regions(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The region whose balls hold a vector and the centre it is within half the angle of, or -1;
        and the cosine to all centres."""
        cosines = vectors @ self.centres.T
        nearest = cosines.argmax(1)
        best = cosines[np.arange(len(vectors)), nearest]
        return (np.where(best >= self.cosine, self.region[nearest], -1),
                np.where(best >= max(self.tight, self.cosine), nearest, -1), cosines)


def dense_regions(labels: np.ndarray, vectors: np.ndarray, total: int, leaf: int,
                  cosine: float) -> dict[int, Dense]:
    """By label, where the sample has classes of so many neighbours that leaves cannot hold them."""
    out = {}
    least = DENSE * max(leaf * len(labels) / max(1, total), MIN_SAMPLE)
    for label in np.unique(labels).tolist():
        own = vectors[labels == label]
        if len(own) >= least and len((dense := Dense(own, least, cosine)).centres):
            out[label] = dense
    return out


def unit(raw: list | None) -> np.ndarray | None:
    """The vector at length one; None for what links with nothing."""
    if raw is None or not raw or any(x is None for x in raw):
        return None
    vector = np.array(raw, np.float64)
    if not np.isfinite(vector).all():
        return None
    largest = np.abs(vector).max()
    if not largest > 0:
        return None
    vector /= largest  # so that squares neither vanish nor overflow
    return vector / np.sqrt((vector ** 2).sum())


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for vec, raw, label in zip(*(c.to_pylist() for c in batch.columns)):
            vector = unit(raw) if label is not None and vec is not None else None
            key = None
            if vector is not None:
                content = np.array(raw, np.float64).tobytes()
                key = hashlib.blake2b(content + b"%d" % label, digest_size=16).digest()
            rows.append((vec, label, key, vector.tobytes() if key else None))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (
                pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
            names=["vec_id", "label", "cls", "vector"])


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Label, rows and vectors of each label and dimension."""
    labels = np.array(batch.column("label").to_pylist(), np.int64)
    raw = np.array(batch.column("vector").to_pylist(), object)
    sizes = np.array([len(v) for v in raw])
    for label, size in sorted(set(zip(labels.tolist(), sizes.tolist()))):
        chosen = np.flatnonzero((labels == label) & (sizes == size))
        yield label, chosen, np.frombuffer(b"".join(raw[chosen]), np.float64).reshape(len(chosen), -1)


def _in_dense(dense: dict[int, Dense], label: int, vectors: np.ndarray) -> Dense | None:
    own = dense.get(label)
    return own if own is not None and own.centres.shape[1] == vectors.shape[1] else None


def _spread(shared) -> callable:
    """Each class outside dense regions once for every distinct leaf it is in, with all its leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, dense = shared.value
        for batch in batches:
            for label, chosen, vectors in _vectors(batch):
                own = _in_dense(dense, label, vectors)
                if own is not None:
                    free = own.regions(vectors)[0] < 0
                    chosen, vectors = chosen[free], vectors[free]
                trees = forest.trees.get(label)
                if trees is not None and trees[0].directions.shape[1] != vectors.shape[1]:
                    # another dimension: one leaf
                    places = np.full((len(chosen), 1), -8 * vectors.shape[1])
                else:
                    places = forest.places(label, vectors)
                for column in range(places.shape[1]):
                    fresh = (places[:, :column] != places[:, column, None]).all(1)
                    part = batch.take(pa.array(chosen[fresh]))
                    yield pa.RecordBatch.from_arrays([
                        part.column("cls"), part.column("label"), part.column("vector"),
                        part.column("size"), pa.array(places[fresh, column]),
                        pa.array([p.tobytes() for p in places[fresh]], pa.binary())], names=LEAF_ROWS)

    return work


LOOSE, HALO = -1, -2  # kinds of classes in a region; others are the centre that is close by
REGION_SQL = "cls binary, label long, vector binary, size long, region long, kind long"
PAIR_SQL = "cls binary, vector binary, size long, label long, region long, low long, high long, own long"


def _regions(shared) -> callable:
    """Each class once for every region it is in, or may have links into."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value[1]
        for batch in batches:
            for label, chosen, vectors in _vectors(batch):
                own = _in_dense(dense, label, vectors)
                if own is None:
                    continue
                region, centre, cosines = own.regions(vectors)
                for number in np.unique(own.region):
                    inside = region == number
                    near = (cosines[:, own.region == number] >= own.reach).any(1)
                    some = np.flatnonzero(inside | (near & (region < 0)))
                    part = batch.take(pa.array(chosen[some]))
                    kind = np.where(inside[some], centre[some], HALO)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("cls", "label", "vector", "size")),
                         pa.array(np.full(len(some), number)), pa.array(kind)],
                        names=["cls", "label", "vector", "size", "region", "kind"])

    return work


def _blocks(layout: dict[tuple[int, int], dict[int, tuple[int, int]]]) -> callable:
    """Each class once for every pair of blocks its own is in; ``layout``: first block and number of
    blocks by label and region, and kind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("label", "region", "kind")], 1)
            salts = np.array([int.from_bytes(c[:4], "little") for c in batch.column("cls").to_pylist()])
            for label, region, kind in np.unique(keys, axis=0).tolist():
                rows = np.flatnonzero((keys == (label, region, kind)).all(1))
                part = batch.take(pa.array(rows))
                first, count = layout[label, region][kind]
                block = first + salts[rows] % count
                for other, (start, n) in layout[label, region].items():
                    if other == kind and kind != LOOSE:
                        continue  # linked for certain, or not of this region
                    for against in range(start, start + n):
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(c) for c in ("cls", "vector", "size", "label", "region")),
                             pa.array(np.minimum(block, against)),
                             pa.array(np.maximum(block, against)), pa.array(block)],
                            names=[c.split()[0] for c in PAIR_SQL.split(", ")])

    return work


def _block_pair(cosine: float):
    """Two blocks of a region, or one with itself: numbers of links, and local roots."""

    def work(table: pa.Table) -> pa.Table:
        n = table.num_rows
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(n, -1)
        weights, own = table.column("size").to_numpy().astype(float), table.column("own").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, root = np.zeros(n), np.arange(n)
        across = vectors[right].T
        step = max(1, BLOCK // max(1, len(right)))
        for start in range(0, len(left) if len(right) else 0, step):
            rows = left[start:start + step]
            near = vectors[rows] @ across >= cosine
            if low == high:
                near[np.arange(len(rows)), start + np.arange(len(rows))] = False
            counted = near.astype(float)
            links[rows] += counted @ weights[right]
            if low != high:
                links[right] += weights[rows] @ counted
            while (near & (root[rows][:, None] != root[right])).any():
                i, j = np.nonzero(near & (root[rows][:, None] != root[right]))
                i, j = root[rows[i]], root[right[j]]
                smaller = np.minimum(i, j)
                np.minimum.at(root, i, smaller)
                np.minimum.at(root, j, smaller)
                while (root != root[root]).any():
                    root = root[root]
        some = np.flatnonzero((links > 0) | (root != np.arange(n)))
        cls = table.column("cls").combine_chunks()
        return pa.table({"a": cls.take(pa.array(some)), "b": cls.take(pa.array(root[some])),
                         "links": pa.array(links[some].astype(np.int64))})

    return work


def _dense_links(classes: DataFrame, shared, cosine: float) -> DataFrame:
    """Links of which one end or both are in dense regions, as leaves send them."""
    found = written(classes.select("cls", "label", "vector", "size")
                    .mapInArrow(_regions(shared), REGION_SQL), "dense-classes")
    kinds = found.groupBy("label", "region", "kind").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("cls").alias("lowest"))
    layout: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for label, region, kind, n in kinds.select("label", "region", "kind", "n").collect():
        own = layout.setdefault((label, region), {})  # a row a centre and two a region at most
        own[kind] = (sum(count for _, count in own.values()), -(-n // ROWS))
    compared = (found.mapInArrow(_blocks(layout), PAIR_SQL)
                .groupBy("label", "region", "low", "high").applyInArrow(_block_pair(cosine), LINK_SQL))
    close = found.where(F.col("kind") >= 0).join(kinds.where("kind >= 0"), ["label", "region", "kind"])
    return written(compared.unionByName(close.select(
        F.col("cls").alias("a"), F.col("lowest").alias("b"), (F.col("total") - F.col("size"))
        .alias("links"))), "dense-links")


LEAF_ROWS = ["cls", "label", "vector", "size", "leaf", "places"]
LEAF_SQL = "cls binary, label long, vector binary, size long, leaf long, places binary"
LINK_SQL = "a binary, b binary, links long"


def _compare(cosine: float):
    """The classes of one leaf: numbers of links first seen here, and local roots."""

    def work(table: pa.Table) -> pa.Table:
        raw = table.column("vector").to_pylist()
        sizes = np.array([len(v) for v in raw])
        out = []
        for size in np.unique(sizes).tolist():  # vectors of different dimensions are never alike
            out.append(_leaf(table.take(pa.array(np.flatnonzero(sizes == size))), cosine))
        return pa.concat_tables(out)

    return work


def _leaf(table: pa.Table, cosine: float) -> pa.Table:
    n = table.num_rows
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(n, -1)
    places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int64).reshape(n, -1)
    weights = table.column("size").to_numpy()
    here = table.column("leaf")[0].as_py()
    links, root = np.zeros(n, np.int64), np.arange(n)
    step = max(1, BLOCK // n)
    for start in range(0, n, step):
        near = vectors[start:start + step] @ vectors.T >= cosine
        i, j = np.nonzero(near)
        i = i + start
        i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        first = np.full(len(i), np.iinfo(np.int64).max)
        for column in range(places.shape[1]):
            # the first leaf that both are in: a tree's two leaves each against each
            other = column ^ 1 if places.shape[1] > 1 else column
            both = ((places[i, column] == places[j, column]) | (places[i, column] == places[j, other]))
            first = np.where(both, np.minimum(first, places[i, column]), first)
        own = first == here
        np.add.at(links, i[own], weights[j[own]])
        np.add.at(links, j[own], weights[i[own]])
        while True:  # smallest row that links reach, over the pairs so far
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            np.minimum.at(root, before, root)
            root = root[root]
            if (root == before).all():
                break
    some = np.flatnonzero((links > 0) | (root != np.arange(n)))
    cls = table.column("cls").combine_chunks()
    return pa.table({"a": cls.take(pa.array(some)), "b": cls.take(pa.array(root[some])),
                     "links": pa.array(links[some])})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF,
                    sample: int = SAMPLE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors link when labels are equal and not null and their cosine is at least ``cosine``. A null
    or empty vector, one of zeros, or with a null or non-finite component links with nothing, as does
    a row without an id, whose component is null and which is kept. Vectors of different dimensions
    never link. Equal rows, also of one id, count as different vectors. ``n_links`` counts vectors
    linked directly, ``component_id`` is the smallest id that links reach. Extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("long").alias("label"))
    rows = written(rows.mapInArrow(
        _classes, "vec_id long, label long, cls binary, vector binary"), "vectors")
    classes = written(rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.count("*").alias("size"), F.min("vec_id").alias("low")), "vector-classes")
    total = classes.count()
    chosen = (classes.select("label", "vector", F.xxhash64("cls").alias("h"), "cls")
              .orderBy("h", "cls").limit(sample).select("label", "vector").collect())
    widths = sorted({len(r[1]) for r in chosen}, key=lambda w: -sum(len(r[1]) == w for r in chosen))
    fitted = [r for r in chosen if len(r[1]) == widths[0]] if chosen else []
    labels = np.array([r[0] for r in fitted], np.int64)
    sampled = np.array([np.frombuffer(r[1], np.float64) for r in fitted])
    dense = dense_regions(labels, sampled, total, leaf, cosine)
    free = np.ones(len(labels), bool)
    for label, own in dense.items():
        free[labels == label] = own.regions(sampled[labels == label])[0] < 0
    forest = Forest(labels[free], sampled[free], total * free.mean() if len(free) else 0, trees, leaf)
    # at most sample / MIN_SAMPLE nodes, and centres that are classes of the sample
    shared = vectors.sparkSession.sparkContext.broadcast((forest, dense))
    found = written(
        classes.select("cls", "label", "vector", "size").mapInArrow(_spread(shared), LEAF_SQL)
        .groupBy("label", "leaf").applyInArrow(_compare(cosine), LINK_SQL), "leaf-links")
    if dense:
        found = found.unionByName(_dense_links(classes, shared, cosine))
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).select(F.col("node").alias("cls"), "root")
    placed = (classes.select("cls", "size", "low").join(links, "cls", "left")
              .join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    placed = written(placed, "vector-links")
    lowest = placed.groupBy("root").agg(F.min("low").alias("lowest"))
    known = placed.join(lowest, "root").select(
        "cls", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "lowest")
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
