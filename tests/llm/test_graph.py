"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from quillspan.llm.graph import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


RANDOM = random.Random(1)
CASES = {
    "none": [],
    "nulls_and_self_links": [(1, 1), (None, 2), (3, None)],
    "zigzag": [(i // 2, 1000 - (i + 1) // 2) for i in range(60)],
    "star_at_the_largest": [(999, i) for i in range(100)] * 2,
    "random": [(RANDOM.randrange(200), RANDOM.randrange(200)) for _ in range(120)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = spark.createDataFrame(CASES[name], "a long, b long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == union_find(CASES[name])
