import numpy as np

from metrolith.llm.clusters import TOLERANCE, balls, between, block_tree, cluster_bars, density_clusters, describe_clusters, distances, levels_of, may_meet, profile
from metrolith.operators.components import union_find
from metrolith.session import Workspace

BARS = "bar_id long, bar2file long, bar_no int, bar2cluster int, features_per_bar array<double>, w double, cluster string"


def bars(spark, rows):
    return spark.createDataFrame([(i, 1, 1, k, None if c is None else [None if x is None else float(x) for x in c], 0.0, "x") for i, k, c in rows], BARS)


def made(seed=0, sizes=(40, 25, 12, 2), dim=32, noise=0.08, lonely=5):
    rnd = np.random.default_rng(seed)
    rows, truth, i = [], {}, 1
    for g, n in enumerate(sizes):
        base = rnd.normal(0, 0.9, dim)
        first = i
        for _ in range(n):
            c = np.exp(base + rnd.normal(0, noise, dim) + rnd.normal(0, 0.7))
            cells = c.tolist()
            if rnd.random() < 0.2:
                for j in rnd.choice(dim, 4, replace=False):
                    cells[j] = rnd.choice([np.nan, None])
            rows.append((i, g + 1, cells))
            truth[i] = first
            i += 1
    for _ in range(lonely):
        rows.append((i, None, np.exp(rnd.normal(0, 0.9, dim)).tolist()))
        i += 1
    return rows, truth


def test_distances_match_brute_force():
    rnd = np.random.default_rng(1)
    x = np.exp(rnd.normal(size=(12, 10)))
    x[3, :3] = np.nan
    x[4, 5] = 0.0
    x[5, :8] = np.nan
    z = profile(x)
    d = distances(z)
    for a in range(12):
        for b in range(12):
            ok = np.isfinite(z[a]) & np.isfinite(z[b])
            if a == b or ok.sum() < 5:
                assert np.isinf(d[a, b])
            else:
                e = (z[a] - z[b])[ok]
                assert abs(d[a, b] - max(np.sqrt((e**2).mean() - e.mean() ** 2), 1e-3)) < 1e-9


def test_block_tree_is_a_minimum_spanning_tree():
    from metrolith.operators.spanning import kruskal

    rnd = np.random.default_rng(2)
    z = profile(np.exp(rnd.normal(size=(3, 16))[rnd.integers(0, 3, 30)] + rnd.normal(0, 0.15, (30, 16))))
    a, b, w, core = block_tree(z, 3)
    d = distances(z)
    for i in range(30):
        near = np.sort(d[i][d[i] <= TOLERANCE])
        assert core[i] == (near[min(2, len(near) - 1)] if len(near) else 0.0)
    i, j = np.triu_indices(30, 1)
    reach = np.maximum(d[i, j], np.maximum(core[i], core[j]))
    got = np.maximum(w, np.maximum(core[a], core[b]))
    assert abs(got.sum() - reach[kruskal(i, j, reach, i, j)].sum()) < 1e-9 and len(w) == 29


def plain(tree, tolerance, split, least):
    """The condensed tree and its selection over single levels, set by set, from the top."""
    levels = levels_of(tolerance, max([w for _, _, w in tree], default=0.0))
    nodes = sorted({v for a, b, _ in tree for v in (a, b)})

    def parts(members, level):
        root = {v: v for v in members}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b, w in tree:
            if a in root and w <= levels[level]:
                root[find(a)] = find(b)
        out = {}
        for v in members:
            out.setdefault(find(v), set()).add(v)
        return list(out.values())

    def cluster(members, level, end):
        """(stability or best choice below, selected sets) of a cluster that is whole on a level and meets another at 1 / end."""
        lam, own, now = {}, 0.0, members
        while True:
            big = [p for p in (parts(now, level - 1) if level else []) if len(p) >= least]
            for v in now - set().union(*big):
                lam[v] = 1 / levels[level]
            if len(big) != 1:
                break
            now, level = big[0], level - 1
        below, chosen = 0.0, []
        for p in big:
            for v in p:
                lam[v] = 1 / levels[level]
            value, sets = cluster(p, level - 1, 1 / levels[level])
            below, chosen = below + value, chosen + sets
        if levels[level] <= split:
            below, chosen = 0.0, []
        own = sum(x - end for x in lam.values())
        return (own, [(members, lam)]) if own >= below else (below, chosen)

    label, joins = {}, {}
    for p in parts(set(nodes), len(levels) - 1):
        if len(p) >= least:
            for members, _ in cluster(p, len(levels) - 1, 0.0)[1]:
                label.update(dict.fromkeys(members, min(members)))
    for level in range(len(levels)):
        for p in parts(set(nodes), level):
            for v in p if len(p) >= least else ():
                joins.setdefault(v, levels[level])
    kept = {v: c for v, c in label.items() if joins.get(v, np.inf) <= tolerance}
    names = {}
    for v, c in kept.items():
        names[c] = min(names.get(c, v), v)
    return {v: names[c] for v, c in kept.items()}


def test_condensed_tree_matches_plain_recursion(spark):
    for seed in range(3):
        rnd = np.random.default_rng(seed)
        tree = [(int(rnd.integers(max(0, i - 6), i)) + 1, i + 1, float(np.exp(rnd.normal(-1.4, 0.7)))) for i in range(1, 120)]
        tree = [e for e in tree if rnd.random() < 0.95]
        df = spark.createDataFrame(tree, "a long, b long, w double")
        for split, least, limit in ((0.4, 2, 10**6), (0.0, 5, 10**6), *(((0.1, 3, 40),) if seed == 0 else ())):
            got = {r.bar_id: r.cluster for r in density_clusters(df, Workspace(spark, "t"), 0.4, split, least, limit).collect()}
            assert got == plain(tree, 0.4, split, least), (seed, split, least, limit)


def line(points):
    """A path through points on a line: its links."""
    p = sorted((x, i) for i, x in enumerate(points, 1))
    return [(i, j, max(abs(y - x), 1e-3)) for (x, i), (y, j) in zip(p, p[1:])]


def test_stability_cuts_a_bridge_and_a_parent_wins(spark):
    # Two dense sets and a thin bridge between them: below the tolerance splits are none, without that rule they stay apart.
    tree = line([0.05 * i for i in range(20)] + [1.0 + 0.3 * i for i in range(1, 4)] + [2.2 + 0.05 * i for i in range(20)])
    df = spark.createDataFrame(tree, "a long, b long, w double")
    got = {r.bar_id: r.cluster for r in density_clusters(df, Workspace(spark, "t"), 0.4, 0.0, 5).collect()}
    assert {got[i] for i in range(1, 21)} == {1} and len({got[i] for i in range(24, 44)}) == 1 and got[24] != 1
    assert {r.cluster for r in density_clusters(df, Workspace(spark, "t"), 0.4).collect()} == {1}
    # Two sets that are hardly denser than the way between them are one cluster.
    tree = line([0.25 * i for i in range(10)] + [2.55 + 0.25 * i for i in range(10)])
    got = density_clusters(spark.createDataFrame(tree, "a long, b long, w double"), Workspace(spark, "t"), 0.4, 0.0, 5).collect()
    assert {r.cluster for r in got} == {1} and len(got) == 20


def test_bridges_and_loose_groups_whatever_the_delegates(spark):
    rnd = np.random.default_rng(11)
    base, way = rnd.normal(0, 0.9, 64), rnd.normal(0, 1, 64)
    way = (way - way.mean()) / np.sqrt(((way - way.mean()) ** 2).mean())
    x = [base + rnd.normal(0, 0.05, 64) for _ in range(300)] + [base + way * 2.0 + rnd.normal(0, 0.05, 64) for _ in range(300)]
    x += [base + way * 2.0 * k / 11 + rnd.normal(0, 0.02, 64) for k in range(1, 11)]
    loose = [b + rnd.normal(0, 0.26, 64) for b in rnd.normal(0, 0.9, (3, 64)) for _ in range(200)]
    rows = [(i + 1, None, np.exp(v).tolist()) for i, v in enumerate(x + loose)]
    z = profile(np.exp(np.array(x + loose))).astype(np.float16).astype(float)
    d = distances(z)
    i, j = np.nonzero(d <= TOLERANCE)
    nodes, root = union_find(i + 1, j + 1)
    want = dict(zip(nodes.tolist(), root.tolist()))
    assert len({want[k] for k in range(1, 611)}) == 1 and len(set(want.values())) < 20
    for most in (1, 8, 384):
        got = {r.bar_id: r.cluster_bar_id for r in cluster_bars(bars(spark, rows), Workspace(spark, "t"), most=most).collect()}
        assert got == want, most


def test_clusters(spark):
    rows, truth = made()
    other, t2 = made(seed=9, sizes=(6,), dim=48, lonely=1)
    rows += [(i + 500, k, c) for i, k, c in other]
    truth.update({i + 500: f + 500 for i, f in t2.items()})
    odd = [(900, 1, None), (901, 1, []), (902, 1, [None] * 32), (903, 1, [0.0] * 32), (904, 1, [np.nan] * 20 + [1.0] * 12), (None, 1, rows[0][2]), (906, 1, [float("inf")] * 32)]
    df = bars(spark, rows + rows[:7] + odd)
    for kw in ({}, {"block": 8}, {"local_limit": 0, "rounds": 4}):
        got = {r.bar_id: r.cluster_bar_id for r in cluster_bars(df, Workspace(spark, "t"), **kw).select("bar_id", "cluster_bar_id").collect()}
        assert got == truth, kw


def test_hot_group_of_copies(spark):
    rows, truth = made(sizes=(3,), lonely=0)
    same = rows[0][2]
    rows += [(100 + i, 1, same) for i in range(60)]
    got = {r.bar_id: r.cluster_bar_id for r in cluster_bars(bars(spark, rows), Workspace(spark, "t"), block=8).collect()}
    assert got == {r[0]: 1 for r in rows}


def test_no_link_within_the_tolerance_is_missed(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for g in range(150):
        base = rnd.normal(0, 0.9, 32)
        for _ in range(2 if g < 140 else 20):
            c = np.exp(base + rnd.normal(0, 0.2, 32))
            c[rnd.random(32) < 0.3 * (g % 2)] = np.nan
            rows.append((len(rows) + 1, None, c.tolist()))
    d = distances(profile(np.array([r[2] for r in rows])).astype(np.float16).astype(float))
    a, b = np.nonzero(d <= TOLERANCE)
    for kw in ({"block": 4, "rounds": 1}, {}):
        got = {r.bar_id: r.cluster_bar_id for r in cluster_bars(bars(spark, rows), Workspace(spark, "t"), **kw).collect()}
        assert set(got) == {int(i) + 1 for i in a}
        assert all(got[i + 1] == got[j + 1] for i, j in zip(a.tolist(), b.tolist()))


def test_bound_parts_no_near_bars():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        x, y = (np.exp(rnd.normal(0, 0.3, 24) + rnd.normal(0, 0.1, (9, 24))) for _ in "xy")
        for v in (x, y):
            v[rnd.random(v.shape) < 0.2] = np.nan
        x, y = profile(x), profile(y)
        assert np.allclose(between(x, y), distances(np.vstack([x, y]))[:9, 9:], atol=1e-6)
        for rx, cx, r, k in balls(x, 0.3):
            for ry, cy, s, m in balls(y, 0.3):
                near = between(x[rx], y[ry]).min() <= TOLERANCE
                assert not near or may_meet((cx - cy)[None], np.array([k + m]), np.array([r + s]), TOLERANCE)[0]


def test_description(spark):
    rows, truth = made(sizes=(10, 4), lonely=2)
    df = bars(spark, rows)
    rh = spark.createDataFrame([(1, "r", 4, 4), (2, "s", 3, 4)], "rhythm_id int, rhythm_name string, num int, den int")
    got = {r.cluster_bar_id: r for r in describe_clusters(cluster_bars(df, Workspace(spark, "t")), df, rh).collect()}
    assert {k: (r["size"], r.rhythm_id, r.num) for k, r in got.items()} == {1: (10, 1, 4), 11: (4, 2, 3)}
    assert all(len(r.exemplars) == 3 and all(truth[x] == k for x in r.exemplars) for k, r in got.items())


def test_empty(spark):
    assert cluster_bars(bars(spark, []), Workspace(spark, "t")).count() == 0
    assert cluster_bars(bars(spark, [(1, 1, [1.0, 2.0, 3.0, 4.0])]), Workspace(spark, "t")).count() == 0
