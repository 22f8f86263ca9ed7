import random

import pytest

from tessera.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


CASES = {
    "none": [],
    "loops": [(1, 1), (None, 2), (3, None)],
    "chain": [(i, i + 1) for i in range(200)],
    "star": [(i, 500) for i in range(300)] + [(500, 3), (500, 3)],
    "random": [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(250)],
    "negative": [(-5, 7), (7, 2**60)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    edges = CASES[case]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))
