import random

import numpy as np

from metrolith.operators.components import connected_components, union_find
from metrolith.operators.spanning import kruskal, spanning_forest
from metrolith.session import Workspace


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def test_components_local_and_distributed_agree(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1030)]
    star = [(5, i) for i in range(2000, 2060)]
    rows = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + chain + star + [(-3, 7), (-3, -3), (5, 2000)]
    want = brute(rows)
    for limit in (400_000, 0, 25):
        got = {r.node: r.component for r in connected_components(edges(spark, rows + [(None, 1), (2, None)]), Workspace(spark, "t"), limit).collect()}
        assert got == want, limit


def test_components_empty(spark):
    for limit in (0, 10):
        assert connected_components(edges(spark, []), Workspace(spark, "t"), limit).count() == 0
        assert connected_components(edges(spark, [(1, 1)]), Workspace(spark, "t"), limit).count() == 0


def test_union_find():
    n, c = union_find(np.array([5, 1, 9]), np.array([1, 0, 8]))
    assert dict(zip(n.tolist(), c.tolist())) == {0: 0, 1: 0, 5: 0, 8: 8, 9: 8}


def test_spanning_forest_matches_kruskal(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randrange(9))) for _ in range(300)] + [(100, 101, 1.0), (101, 100, 0.5), (7, 7, 0.0), (None, 1, 1.0), (1, 2, None)]
    best = {}
    for a, b, w in rows:
        if None not in (a, b, w) and a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, w))
    a, b, w = (np.array(x) for x in zip(*[(i, j, v) for (i, j), v in best.items()]))
    want = {(int(a[i]), int(b[i]), float(w[i])) for i in kruskal(a, b, w, a, b)}
    for limit in (400_000, 0, 40):
        got = {tuple(r) for r in spanning_forest(spark.createDataFrame(rows, "a long, b long, w double"), Workspace(spark, "t"), limit).select("a", "b", "w").collect()}
        assert got == want, limit


def test_spanning_forest_empty(spark):
    assert spanning_forest(spark.createDataFrame([], "a long, b long, w double"), Workspace(spark, "t")).count() == 0
