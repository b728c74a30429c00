import random

import pytest

from logspark.llm.graph import components


@pytest.mark.parametrize("case", ["chain", "star", "random", "none"])
def test_components(spark, case):
    rng = random.Random(1)
    edges = {"chain": [(i + 1, i) for i in range(200)], "none": [],
             "star": [(0 if i % 2 else 500, i) for i in range(1, 300)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]}[case]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for x in parent}
