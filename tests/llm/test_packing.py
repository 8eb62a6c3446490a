import random

from hypothesis import given, settings
from hypothesis import strategies as st

from metrolith.llm.packing import FULL, best_fit, pack, pieces
from metrolith.session import Workspace

SCHEMA = "doc_id long, tokens long, container string, piece string"


def sized(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "c", "p") for d, t in rows], SCHEMA).repartition(parts)


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(max_examples=200, deadline=None)
def test_best_fit(sizes):
    bins = best_fit(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    # The same as looking through all open containers for the fullest that fits.
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(20 - s)
    assert sorted(rooms) == sorted(20 - sum(sizes[i] for i in b) for b in bins)


def test_pieces():
    assert pieces(0, 10) == [] and pieces(10, 10) == [(0, 0, 10)] and pieces(25, 10) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


def check(rows, got, capacity):
    used, texts = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
        texts.setdefault(r.doc_id, []).append((r.piece, r.start, r.tokens))
    assert max(used.values()) <= capacity
    for d, t in dict(rows).items():
        if t:
            n = sum(x == (d, t) for x in rows)
            assert sorted(texts.pop(d)) == sorted(pieces(t, capacity) * n)
    assert not texts
    # No two containers that are not nearly full could be combined.
    assert sum(sorted(u for u in used.values() if u < FULL * capacity)[:2]) > capacity or sum(u < FULL * capacity for u in used.values()) < 2
    return len(used)


def test_pack(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, None, 5, 40, 99, 100, 101, 250, rnd.randrange(1, 100)])) for i in range(600)] + [(1000, 12_345), (1001, 7), (1001, 7)]
    total = sum(t or 0 for _, t in rows)
    for kw in ({}, {"batch": 10, "fan_in": 4}, {"batch": 10, "fan_in": 1}):
        n = check(rows, pack(sized(spark, rows), Workspace(spark, "t"), 100, **kw).collect(), 100)
        if not kw:
            assert n <= -(-total // 100) * 1.02 + 1


def test_items_that_find_no_partner(spark):
    rows = [(i, 60) for i in range(300)]
    assert check(rows, pack(sized(spark, rows), Workspace(spark, "t"), 100, batch=20, fan_in=16).collect(), 100) == 300


def test_rounds_go_on_until_no_two_fit(spark):
    # Every partition is left with one small container; they only meet when few partitions are left.
    rows = [(i, 61) for i in range(120)] + [(200 + i, 40) for i in range(20)]
    n = check(rows, pack(sized(spark, rows, 20), Workspace(spark, "t"), 100, batch=7, fan_in=2).collect(), 100)
    assert n == 120 + 10


def test_empty(spark):
    assert pack(sized(spark, []), Workspace(spark, "t")).count() == 0
    assert pack(sized(spark, [(1, None), (2, 0)]), Workspace(spark, "t")).count() == 0
