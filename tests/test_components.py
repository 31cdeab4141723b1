"""Connected components against union-find."""

import random

from frameloom.operators.components import connected_components


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5, 2000 + i) for i in range(300)]
    edges = chain + star + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)] + [(7, 7), (None, 3), *chain[:5]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
