"""Merkle manifest of a dataset: a subroot per source, a root over all, and a proof for every row.

Rows become leaves in Spark expressions. Leaves are ranked within their source over ranges, and every
4,096 consecutive ones form a superblock. Superblocks are reduced to one node each, and the nodes to
nodes, until a source has one, its subroot; the subroots form a tree of the same kind. Then the outer
nodes go back down: at each level what is below is cogrouped with the path of the superblock it belongs
to, reduced again there, and its proofs are joined to that path. At the leaves the same step folds
every row, as it is found now, up to the root.

Several superblocks share one group of a cogroup (a bundle), so that many small sources cost no more
than one large one. No task holds more than its bundle, whatever the size of a source.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, scalar, written

RUN = 16        # children of a node
LEVELS = 3      # levels that one superblock spans
BLOCK = RUN ** LEVELS
BUNDLE = 4 * BLOCK          # leaves in a group of a cogroup, on average
RANGE_ROWS = 250_000        # leaves ranked in one task, on average

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL = ""  # the one key of the tree over sources

NODES = "key string, pos long, total long, node binary"
OUTER = "key string, pos long, path binary, subroot binary, root binary"
PROVEN = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def leaf(*values: Column) -> Column:
    """The digest of a row: each value with its byte count, ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (value.cast("string") for value in values)]
    return F.sha2(F.concat(*parts), 256)


def verified(docs: DataFrame, found_text: Column, changed: Column) -> DataFrame:
    """Each row's leaf, proof and the root that its proof leads to now.

    The manifest is made of ``docs``; where ``changed`` holds, the row is found with ``found_text``
    instead of its text, and ``verified`` tells whether it still folds to the root. Both are columns
    over ``doc_id`` and ``text``.

    Any value may be null: a null source is a source of its own, before all others; rows without
    ``doc_id`` come first in theirs. Rows of equal ``doc_id`` within a source are ordered by their leaf,
    so equal rows are neighbours with equal leaves. An empty table gives no rows. Only the five columns
    of ``documents`` are read, whatever others there are.
    """
    rows = docs.select(*(F.col(c) for c in FIELDS))
    others = [F.col(c) for c in FIELDS[:-1]]
    leaves = written(rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(ALL)).alias("key"),
        F.unhex(leaf(*others, F.col("text"))).alias("node"),
        F.when(changed, F.unhex(leaf(*others, found_text))).alias("found")), "leaves")
    tree = _tree(written(_ranked(leaves, "doc_id", "node"), "ranked"))
    subroots = _tree(written(_ranked(
        tree.top.select("key", F.col("node").alias("subroot")), "key", single=True), "subroots"),
        node="subroot")
    outer = written(_sources(subroots), "outer")
    for below, above in zip(tree.levels[:0:-1], tree.counts[:0:-1]):
        outer = written(_cogrouped(below, outer, above, _paths, OUTER), "outer")
    proven = _cogrouped(tree.levels[0].select("key", "pos", "total", "node", "found",
                                              F.col("doc_id").cast("string").alias("doc_id")),
                        outer, tree.counts[0], _proofs, PROVEN)
    return proven.withColumn("doc_id", F.col("doc_id").cast("long"))


def _ranked(rows: DataFrame, *order: str, single: bool = False) -> DataFrame:
    """Add ``pos``, the place within ``key`` (of all rows if ``single``), and ``total``, its rows.

    Rows are dealt into ranges of the whole order, written, numbered within their range, and moved on
    by what earlier ranges hold of the same key: one row for each key and range.
    """
    spark = rows.sparkSession
    parts = partitions_for(spark, rows.count(), RANGE_ROWS)
    by = order if single else ("key", *order)
    dealt = written(rows.repartitionByRange(parts, *by)
                    .withColumn("bucket", F.spark_partition_id()), "ranges")
    group = F.lit(ALL) if single else F.col("key")
    dealt = dealt.withColumn("group", group)
    held = dealt.groupBy("group", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("group", "bucket",
                       F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
                       F.sum("n").over(W.partitionBy("group")).alias("total"))
    here = F.row_number().over(W.partitionBy("group", "bucket").orderBy(*order))
    return (dealt.withColumn("here", here).join(held, ["group", "bucket"])
            .withColumn("pos", F.col("ahead") + F.col("here") - 1)
            .drop("group", "bucket", "here", "ahead"))


@dataclass
class _Tree:
    """The levels of a forest of superblocks, from its leaves up; ``top`` has one node a key."""

    levels: list[DataFrame]
    counts: list[int]
    top: DataFrame


def _bundle(level: DataFrame, block: Column, count: int) -> DataFrame:
    """Add the bundle of the superblock numbered ``block``."""
    return level.withColumn("bundle", F.pmod(F.xxhash64("key", block), F.lit(count)))


def _tree(leaves: DataFrame, node: str = "node") -> _Tree:
    """Reduce superblocks to nodes, level by level; a level has a 4,096th of the rows below it."""
    spark = leaves.sparkSession
    if node != "node":
        leaves = leaves.select(F.lit(ALL).alias("key"), F.col("key").alias("member"), "pos", "total",
                               F.col(node).alias("node"))
    levels, counts, level = [], [], leaves
    while True:
        rows, most = level.agg(F.count(F.lit(1)), F.max("total")).first()
        if levels and (most or 0) <= 1:
            return _Tree(levels, counts, level)
        levels.append(level)
        counts.append(partitions_for(spark, rows, BUNDLE))
        narrow = level.select("key", "pos", "total", "node")
        level = written(_bundle(narrow, F.expr(f"pos div {BLOCK}"), counts[-1])
                        .groupBy("bundle").applyInPandas(_reduce, NODES), "nodes")


def _sources(tree: _Tree) -> DataFrame:
    """The path of every subroot to the root, as the outer nodes of its source's tree."""
    outer = tree.top.select("key", "pos", F.unhex(F.lit("")).alias("path"),
                            F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
    for below, count in zip(tree.levels[:0:-1], tree.counts[:0:-1]):
        outer = written(_cogrouped(below, outer, count, _paths, OUTER), "outer")
    return _cogrouped(tree.levels[0], outer, tree.counts[0], _member_paths, OUTER)


def _cogrouped(below: DataFrame, outer: DataFrame, count: int, fn, schema: str) -> DataFrame:
    """``fn`` over bundles of superblocks of ``below`` and the outer row of each of them."""
    left = _bundle(below, F.expr(f"pos div {BLOCK}"), count)
    right = _bundle(outer, F.col("pos"), count)
    return left.groupBy("bundle").cogroup(right.groupBy("bundle")).applyInPandas(fn, schema)


# Inside tasks.

def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _steps(total: int) -> int:
    """Levels that a superblock of a tree over ``total`` nodes is reduced by."""
    steps = 0
    while total > 1 and steps < LEVELS:
        total = -(-total // RUN)
        steps += 1
    return steps


def _local(nodes: list[str], total: int) -> list[list[str]]:
    """The nodes of a superblock level by level, the last one alone."""
    levels = [nodes]
    for _ in range(_steps(total)):
        level = levels[-1]
        levels.append([_digest("".join(level[i:i + RUN])) for i in range(0, len(level), RUN)])
    return levels


def _blocks(rows: pd.DataFrame):
    """The superblocks of a bundle: key, number, rows in order and the nodes of all levels."""
    rows = rows.sort_values(["key", "pos"], kind="stable")
    for (key, block), part in rows.groupby(["key", rows["pos"] // BLOCK], sort=False):
        levels = _local([bytes(n).hex() for n in part["node"]], int(part["total"].iloc[0]))
        yield key, int(block), part, levels


def _run(levels: list[list[str]], i: int, level: int) -> tuple[int, list[str]]:
    """The place of leaf ``i``'s ancestor in its run at ``level``, and that run."""
    at = i // RUN ** level
    first = at - at % RUN
    return at - first, levels[level][first:first + RUN]


def _path(levels: list[list[str]], i: int) -> bytes:
    """The runs from leaf ``i`` up: for each its place, its length and its digests."""
    out = bytearray()
    for level in range(len(levels) - 1):
        at, run = _run(levels, i, level)
        out += bytes((at, len(run))) + bytes.fromhex("".join(run))
    return bytes(out)


def _runs(path: bytes) -> list[tuple[int, str]]:
    """The place and the joined digests of each run of a path."""
    out, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        out.append((at, path[i + 2:i + 2 + 32 * n].hex()))
        i += 2 + 32 * n
    return out


def _without(at: int, run: str) -> str:
    return run[:64 * at] + run[64 * at + 64:]


def _with(at: int, run: str, digest: str) -> str:
    return run[:64 * at] + digest + run[64 * at + 64:]


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    out = [(key, block, max(1, -(-int(part["total"].iloc[0]) // BLOCK)), bytes.fromhex(levels[-1][0]))
           for key, block, part, levels in _blocks(rows)]
    return pd.DataFrame(out, columns=["key", "pos", "total", "node"])


def _by_place(outer: pd.DataFrame) -> dict:
    return {(o.key, int(o.pos)): o for o in outer.itertuples(index=False)}


def _outer_rows(rows: pd.DataFrame, outer: pd.DataFrame, members: bool) -> pd.DataFrame:
    above, out = _by_place(outer), []
    for key, block, part, levels in _blocks(rows):
        parent = above[key, block]
        for i, row in enumerate(part.itertuples(index=False)):
            path = _path(levels, i) + bytes(parent.path)
            out.append((row.member, 0, path, row.node, parent.root) if members else
                       (key, int(row.pos), path, parent.subroot, parent.root))
    return pd.DataFrame(out, columns=["key", "pos", "path", "subroot", "root"])


def _paths(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Outer rows of the superblocks below those that ``outer`` tells of."""
    return _outer_rows(rows, outer, members=False)


def _member_paths(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The same where what is below are the subroots of sources."""
    return _outer_rows(rows, outer, members=True)


def _proofs(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The proof of every leaf, and the root that the leaf as found folds to."""
    above, out = _by_place(outer), []
    for key, block, part, levels in _blocks(rows):
        parent = above[key, block]
        subroot, root = bytes(parent.subroot).hex(), bytes(parent.root).hex()
        outside = _runs(bytes(parent.path))
        siblings = "".join(_without(at, run) for at, run in outside).encode()
        inside = [["".join(level[i:i + RUN]) for i in range(0, len(level), RUN)]
                  for level in levels[:-1]]
        for i, (doc_id, found) in enumerate(zip(part["doc_id"], part["found"])):
            own = levels[0][i]
            now = own if found is None else bytes(found).hex()
            proof, at = sha256(), i
            for runs in inside:
                run = runs[at // RUN]
                proof.update(_without(at % RUN, run).encode())
                now = _digest(_with(at % RUN, run, now))
                at //= RUN
            proof.update(siblings)
            for place, run in outside:
                now = _digest(_with(place, run, now))
            out.append((doc_id, own, subroot, root, proof.hexdigest(), now, now == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256",
                                      "folded_root", "verified"])


def count_unverified(proven: DataFrame) -> int:
    """Rows that no longer fold to the root."""
    return scalar(proven.agg(F.count_if(~F.col("verified"))))
