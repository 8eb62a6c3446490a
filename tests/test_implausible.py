import numpy as np

from metrolith.operators.implausible import _filter, implausible, implausible_meters, implausible_numbers, implausible_times, stray_beats

BEATS = "file_id long, beat_idx int, t double, bar int, beat_no int, reason string, chunk string"


def beats(spark, rows):
    return spark.createDataFrame([(f, i, t, None, n, "x", "y") for f, i, t, n in rows], BEATS)


def times(ts, idx=None):
    t = np.array([np.nan if x is None else x for x in ts], float)
    s, _ = stray_beats(np.zeros(len(t), int), np.arange(1, len(t) + 1) if idx is None else np.array(idx), t)
    return [i for i in range(len(t)) if s[i]]


def steady(n=30, p=0.5, t0=1.0, noise=0.01, seed=0):
    return list(t0 + p * np.arange(n) + np.random.RandomState(seed).randn(n) * noise * p)


def test_stray_spike_and_neighbours():
    for k in (1, 2, 10, 27, 28, 29):
        for off in (0.2, -0.2, 3600.0):
            t = steady()
            t[k] += off
            assert times(t) == [k], (k, off)


def test_pause_missing_and_tempo_change_are_no_case():
    t = steady()
    assert times(t[:10] + [x + 4.3 for x in t[10:]]) == []
    assert times(t[:10] + t[11:], [*range(1, 11), *range(12, 31)]) == []
    assert times(t[:10] + t[11:]) == []
    assert times(t[:15] + [t[14] + 0.8 * (i + 1) for i in range(15)]) == []
    assert times(t[:15] + [t[14] + 0.25 * (i + 1) for i in range(15)]) == []
    t[7] = None
    assert times(t) == []


def test_stuck_run_without_its_first():
    t = steady()
    t[11] = t[12] = t[13] = t[10]
    assert times(t) == [11, 12, 13]
    t = steady()
    t[28] = t[29] = t[27] + 0.001
    assert times(t) == [28, 29]


def test_stray_beside_a_pause():
    t = steady()
    t = t[:10] + [x + 4.3 for x in t[10:]]
    t[11] += 0.2
    assert times(t) == [11]


def test_surprise_is_measured_by_the_forecast_deviation():
    # After ten missing beats 0.3 of a period is within what the forecast allows; after none it is not.
    t = steady(noise=0.002)
    gap = t[:10] + t[20:]
    gap[10] += 0.3 * 0.5
    fwd = _filter(np.array([gap[:11]]), np.array([[*range(1, 11), 21]], float))[0][0]
    assert not fwd.any()
    near = t[:11]
    near[10] += 0.3 * 0.5
    assert _filter(np.array([near]), np.arange(1.0, 12.0)[None])[0][0].tolist() == [False] * 10 + [True]


def test_vanishing_variance_of_the_level():
    t = np.array([steady(12, noise=0.0)])
    t[0, 6:9] = t[0, 5] + [0.01, 0.0, 0.02]
    assert _filter(t, np.arange(1.0, 13.0)[None])[2][0].tolist() == [6 <= j < 9 for j in range(12)]


def test_too_short_for_a_forecast():
    assert times([]) == [] and times([1.0]) == [] and times([1.0, 900.0]) == [] and times([None, None]) == []


def test_chunks_do_not_matter(spark):
    rows = []
    for f in (1, 2):
        t = steady(300, seed=f)
        for k in (5, 97, 99, 103, 250):
            t[k] += 0.2
        rows += [(f, i + 1, float(x), 1) for i, x in enumerate(t)]
    rows += [(3, 1, -2.0, 1), (3, 1, -2.0, 1), (3, 2, None, 1), (None, 1, 1.0, 1), (3, None, 1.0, 1), (4, 1, float("nan"), 1), (4, 2, float("inf"), 1)]
    df = beats(spark, rows)
    want = {(f, k + 1) for f in (1, 2) for k in (5, 97, 99, 103, 250)} | {(3, 1)}
    assert {(r.file_id, r.beat_idx) for r in implausible_times(df).collect()} == want
    assert sorted((r.file_id, r.beat_idx) for r in implausible_times(df, chunk=50, overlap=20).collect()) == sorted(want)


def test_numbers(spark):
    rows = [(1, i, i * 0.5, i % 4 + 1) for i in range(1, 20)] + [(1, 30, 15.0, 99), (1, 31, 15.5, 99), (1, 32, 16.0, 0), (1, 33, 16.5, 8), (1, 34, 17.0, 9), (1, 35, 17.5, None), (1, 36, 18.0, -1)]
    rows += [(2, i, i * 0.5, i) for i in range(1, 13)]
    got = {(r.file_id, r.beat_idx) for r in implausible_numbers(beats(spark, rows)).collect()}
    # 9 follows 8, so both are usual numbers of file 1.
    assert got == {(1, 30), (1, 31), (1, 32), (1, 36)}


def test_meters(spark):
    s = "file_id long, section_no int, num int, den int, n string"
    rows = [(1, 1, 4, 4), (1, 2, 4, None), (1, 2, 4, None), (1, 3, 13, 4), (1, 4, 3, 7), (1, 5, 1, 8), (2, 1, 4, 4), (2, 2, 13, 4), (3, 1, 0, 4), (4, 1, 33, 4), (5, 1, None, 4), (5, 2, None, 3), (6, 1, 4, 4), (6, 2, 13, 4), (6, 3, 1, 1), (None, 1, 99, 4), (7, None, 99, 4)]
    got = {(r.file_id, r.section_no, r.reason) for r in implausible_meters(spark.createDataFrame([(*r, "z") for r in rows], s)).collect()}
    assert got == {(1, 3, "num_unlike"), (1, 4, "den"), (1, 5, "num_unlike"), (3, 1, "num_range"), (4, 1, "num_range"), (5, 2, "den")}


def test_empty(spark):
    m = spark.createDataFrame([], "file_id long, section_no int, num int, den int")
    assert implausible(beats(spark, []), m).count() == 0
