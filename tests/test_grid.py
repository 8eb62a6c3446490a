import math
import random

from metrolith.operators.grid import regular_grid, source_extent, clean_readings

SCHEMA = "file_id long, feat_type string, frame_length double, t double, act double, fl string, value string"


def frames(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, max_gap=5):
    groups = {}
    for f, ty, fl, t, a in rows:
        if f is None or ty is None:
            continue
        groups.setdefault((f, ty.strip(" ").lower()), []).append((fl, t, a))
    out = {}
    for key, g in groups.items():
        ls = {}
        for fl, _, _ in g:
            if fl is not None:
                s = fl / 1000.0 if fl > 0.1 else fl
                if 0 < s <= 0.1:
                    ls[s] = ls.get(s, 0) + 1
        ts = [t for _, t, _ in g if t is not None and math.isfinite(t)]
        if not ls or not ts:
            continue
        fl = min(ls, key=lambda s: (-ls[s], s))
        at = lambda t: math.floor(t / fl) + 1
        vals = {}
        for _, t, a in g:
            if t is not None and math.isfinite(t) and a is not None and math.isfinite(a):
                vals.setdefault(at(t), []).append(a)
        lo, hi = at(min(ts)), at(max(ts))
        for n in range(lo, hi + 1):
            if n in vals:
                out[(*key, n)] = ("observed", sum(vals[n]) / len(vals[n]))
                continue
            p = max((k for k in vals if k < n), default=None)
            q = min((k for k in vals if k > n), default=None)
            if p is None or q is None:
                out[(*key, n)] = ("edge", None)
            elif q - p - 1 <= max_gap:
                a, b = (sum(vals[k]) / len(vals[k]) for k in (p, q))
                out[(*key, n)] = ("interpolated", a + (b - a) * (n - p) / (q - p))
            else:
                out[(*key, n)] = ("gap", None)
    return out


def check(spark, rows, **kw):
    got = {(r.file_id, r.feat_type, r.frame): (r.status, r.value) for r in regular_grid(frames(spark, rows), **kw).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, (s, v) in want.items():
        assert got[k][0] == s and (v is None and got[k][1] is None or abs(got[k][1] - v) < 1e-9), (k, got[k], want[k])
    missing = {(r.file_id, r.feat_type, r.frame) for r in regular_grid(frames(spark, rows), observed=False, **{k: v for k, v in kw.items()}).collect()}
    assert missing == {k for k, (s, _) in want.items() if s != "observed"}


def test_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "A", 0.02, 0.01, 1.0), (1, " a ", 20.0, 0.05, 3.0), (1, "a", 0.02, 0.05, 3.0), (1, "a", 0.02, 0.5, 2.0), (1, "a", None, None, 9.0), (1, "a", 0.05, 0.7, nan),
        (2, "a", 0.01, 0.2, inf), (2, "a", 0.01, 0.1, None),
        (3, "b", None, 0.1, 1.0), (None, "b", 0.01, 0.1, 1.0), (4, None, 0.01, 0.1, 1.0),
        (5, "c", 0.01, 0.03, 1.0), (5, "c", 0.02, 0.07, 2.0), (6, "d", 0.01, 0.0, 1.0), (7, "e", -1.0, 0.0, 1.0), (8, "f", 0.01, nan, 1.0),
    ]
    check(spark, rows)
    check(spark, rows, block=2)


def test_blocks_do_not_matter(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2]), "x", 0.01, rnd.random() * 6, rnd.choice([None, 1.0, 2.0])) for _ in range(120)]
    check(spark, rows, block=7)
    check(spark, rows, block=64)
    check(spark, rows)


def test_empty(spark):
    assert regular_grid(frames(spark, [])).count() == 0


def test_tie_takes_the_shorter_frame(spark):
    rows = [(1, "a", 0.02, 0.0, 1.0), (1, "a", 0.01, 0.1, 1.0)]
    assert source_extent(clean_readings(frames(spark, rows))).first().fl == 0.01
