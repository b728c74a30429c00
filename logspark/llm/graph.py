"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (columns ``a``, ``b``).

    ``root`` is the smallest node of the component. In each round every node takes its smallest
    neighbour as parent if that is smaller, parents are followed to their ends, and edges are
    rewritten between the ends; at least half of the nodes that still have edges go. A node of very
    many edges is only ever aggregated and joined with, never collected.
    """
    rest = edges.select("a", "b").where("a <> b")
    rest = written(rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "edges")
    levels = []
    while not rest.isEmpty():
        parents = rest.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("root"))
        levels.append(_ends(written(parents, "parents")))
        up = levels[-1]
        one = rest.join(up.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        two = one.join(up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        rest = written(two.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
                       .distinct(), "edges")
    if not levels:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        higher = level.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(higher, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root"))
    return written(out, "components")


def _ends(parents: DataFrame) -> DataFrame:
    """Follow parents to nodes that are their own, doubling the distance each time."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        ahead = written(parents.join(up, "root").select("node", F.col("root").alias("was"),
                                                        F.col("next").alias("root")), "parents")
        if ahead.where("root <> was").isEmpty():
            return ahead.select("node", "root")
        parents = ahead.select("node", "root")
