import random

import pytest

from metrolith.llm.splits import assign_splits, bar_splits, performer_key, related_files, session_key, stratify
from metrolith.session import Workspace

FILES = "file_id long, path string, dataset string, lab_fln string, performer string, session_id string, component long, split string"
BARS = "bar_id long, bar2file long, value string"
METERS = "file_id long, section_no int, num int, den int"


def files(spark, rows):
    return spark.createDataFrame([(f, "p", d, "l", p, s, 0, "q") for f, d, p, s in rows], FILES)


@pytest.mark.parametrize("a, b", [("Vaha Míbezéx", "VAHA  MIBEZEX"), ("Megafols, Zuso", "zuso megafols"), ("Rare_Difomíll.", "Difomill-Rare")])
def test_performers(a, b):
    assert performer_key(a) == performer_key(b) is not None


def test_nobody():
    for x in (None, "", "-", "???", "N/A", "n.a.", "Unknown", "V.A.", "Various Artists", "various", "anon.", " TBD "):
        assert performer_key(x) is None
    for x in (None, "", "0", "none", "N/A", "tbd", " - "):
        assert session_key(x) is None
    assert session_key(" SES-01 ") == session_key("ses-01") == "ses-01"


def test_related(spark):
    f = files(spark, [(1, "d", "Ann Lee", None), (2, "d", "lee, ann", "s1"), (3, "d", "unknown", "S1 "), (4, "d", "unknown", "0"), (5, "d", None, "0"), (6, "d", None, None), (7, "d", None, None), (7, "d", None, None), (None, "d", "Ann Lee", "s1"), (8, "d", "Solo", "x")])
    b = spark.createDataFrame([(10, 6, ""), (10, 7, ""), (10, 7, ""), (11, None, ""), (None, 6, ""), (None, 8, ""), (12, 8, ""), (12, 99, ""), (13, 99, ""), (13, 4, "")], BARS)
    for limit in (0, 1000):
        got = {tuple(r) for r in related_files(f, b, Workspace(spark, "t"), limit).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}


def test_splits(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), f"name{i // 3}x" if i < 900 else f"solo{i}", None) for i in range(1500)]
    # One performer holds a third of all files.
    rows += [(2000 + i, "a", "Hot One", None) for i in range(750)]
    f = files(spark, rows)
    b = spark.createDataFrame([(i, rnd.choice([None, rnd.randrange(1500), 2000]), "") for i in range(3000)], BARS)
    m = spark.createDataFrame([(i, 1, rnd.choice([3, 4]), 4) for i in range(0, 1500, 2)], METERS)
    s = assign_splits(f, b, m, Workspace(spark, "t"))
    got = s.collect()
    assert sorted(r.file_id for r in got) == sorted(r[0] for r in rows)
    of = {}
    for r in got:
        assert of.setdefault(r.component, r.split) == r.split
    share = {x: sum(r.split == x for r in got) / len(got) for x in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.08) < 0.015 and abs(share["test"] - 0.12) < 0.015
    split = {r.file_id: r.split for r in got}
    for r in bar_splits(b, s).collect():
        assert r.split == split.get(r.bar2file)


def test_rare_meters_keep_their_proportions(spark):
    f = files(spark, [(i, "a", f"solo{i}", None) for i in range(6000)])
    # Each of these meters has ten files, fewer than 1/512 of all; one of them stands in second sections only.
    rare = {n: list(range(k * 100, k * 100 + 10)) for k, n in enumerate((5, 7, 10, 13), 1)}
    rows = [(i, 1, 4, 4) for i in range(0, 6000, 2) if i not in rare[7]] + [(i, 2, 7, 4) for i in rare[7]] + [(i, 1, 4, 4) for i in rare[7]]
    rows = [r for r in rows if r[0] not in {*rare[5], *rare[10], *rare[13]}] + [(i, 1, n, 8) for n in (5, 10, 13) for i in rare[n]]
    split = {r.file_id: r.split for r in assign_splits(f, spark.createDataFrame([], BARS), spark.createDataFrame(rows, METERS), Workspace(spark, "t")).collect()}
    for n, ids in rare.items():
        got = [sum(split[i] == s for i in ids) for s in ("train", "val", "test")]
        assert got == [8, 1, 1], (n, got)


def test_rarest_outstanding_label_goes_first():
    # b's ten items lie in components of a (4) and alone (6): once a is placed, b is judged by what is left.
    vectors = {i: {"a": 1, "b": 1} for i in range(4)} | {10 + i: {"b": 1} for i in range(6)} | {20 + i: {"c": 1} for i in range(8)}
    even = {k: [0.5, 0.5] for k in "abc"}
    got = stratify(vectors, even, [0.5, 0.5])
    assert set(got) == set(vectors)
    for k in "abc":
        own = [got[c] for c, x in vectors.items() if k in x]
        assert own.count(0) == own.count(1)
    # The larger component first, and none where there is no room for it.
    got = stratify({1: {"a": 6}, 2: {"a": 2}, 3: {"a": 2}}, {"a": [0.6, 0.4]}, [0.6, 0.4])
    assert got == {1: 0, 2: 1, 3: 1}


def test_every_label_keeps_its_proportions_however_the_buckets_are_cut(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "a", "b", "c"]) if i % 300 else "rare", f"name{i // rnd.choice([1, 1, 2, 5])}x", None) for i in range(6000)]
    f = files(spark, rows)
    m = spark.createDataFrame([(i, 1, rnd.choice([3, 4, 4, 4, 5]), 4) for i in range(0, 6000, 2)], METERS)
    for kw in ({}, {"bucket": 100, "fine": 20, "fan": 4}):
        split = {r.file_id: r.split for r in assign_splits(f, spark.createDataFrame([], BARS), m, Workspace(spark, "t"), **kw).collect()}
        assert len(split) == 6000
        by_label = {}
        for i, d, _, _ in rows:
            by_label.setdefault(d, []).append(i)
        for r in m.collect():
            by_label.setdefault(r.num, []).append(r.file_id)
        for k, ids in by_label.items():
            for s, p in (("train", 0.8), ("val", 0.08), ("test", 0.12)):
                assert abs(sum(split[i] == s for i in ids) - p * len(ids)) <= max(2, 0.1 * p * len(ids)), (kw, k, s)


def test_empty(spark):
    f, b, m = files(spark, []), spark.createDataFrame([], BARS), spark.createDataFrame([], METERS)
    assert related_files(f, b, Workspace(spark, "t")).count() == 0
    assert assign_splits(f, b, m, Workspace(spark, "t")).count() == 0
    assert bar_splits(b, assign_splits(f, b, m, Workspace(spark, "t"))).count() == 0
