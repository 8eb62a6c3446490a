from metrolith.operators import bars as br
from metrolith.operators import patterns as pt
from metrolith.operators import tempo as tm


def beats(spark, *files):
    rows = [(f, i + 1, float(t), n) for f, b in enumerate(files, 1) for i, (t, n) in enumerate(b)]
    return spark.createDataFrame(rows, "file_id long, beat_idx long, t double, beat_no long")


def test_bars(spark):
    waltz = [(i * 0.5, i % 3 + 1) for i in range(11)]
    hole = [x for i, x in enumerate(waltz) if i != 4]
    pause = [(t + (2.0 if i >= 5 else 0.0), n) for i, (t, n) in enumerate(waltz)]
    ends = waltz[:7]  # ends on a downbeat, so the second bar is not followed by a beat
    b = beats(spark, waltz, hole, pause, ends, [(0.0, 1), (0.5, 1)])
    got = {}
    for r in br.full_bars(b).collect():
        got.setdefault(r.file_id, []).append(r.beat_idx)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 4, 7], 2: [6], 3: [7], 4: [1]}
    assert {r.file_id: r.meter for r in br.predominant_meter(b).collect()} == {1: 3, 2: 3, 3: 3, 4: 3}


def test_bars_of_many_beats(spark):
    b = beats(spark, [(i * 0.5, i % 100 + 1) for i in range(302)], [(i * 0.5, i % 64 + 1) for i in range(200)])
    assert sorted((r.file_id, r.beat_idx, r.meter) for r in br.full_bars(b).collect()) == [(1, 1, 100), (1, 101, 100), (1, 201, 100), (2, 1, 64), (2, 65, 64), (2, 129, 64)]


def test_predominant_meter_needs_half_the_frequency(spark):
    b = beats(spark, [(0, n) for n in [1, 2] * 6 + [1, 2, 3, 4] * 2], [(0, n) for n in [1, 2, 3] * 4 + [1, 2, 3, 4] * 3])
    assert {r.file_id: r.meter for r in br.predominant_meter(b).collect()} == {1: 2, 2: 3}


def test_cells_at_the_edges(spark):
    b = beats(spark, [(0.05 + i * 0.4, i % 2 + 1) for i in range(6)])
    full = br.full_bars(b)
    grid = spark.createDataFrame([(1, 8)], "file_id long, cells int")
    frames = spark.createDataFrame([(1, k, 1, float(k)) for k in range(1, 25)], "file_id long, frame long, dim int, value double")
    cells = br.bar_cells(b, full, frames, grid, 0.1).where("beat_idx = 1").orderBy("value").collect()
    # The bar runs from 0.05 to 0.85 s: frames 1 to 9, one a cell; the last belongs to the next bar.
    assert [(r.value, r.cell) for r in cells] == [(float(k), k) for k in range(1, 9)]


def test_imputation(spark):
    m = spark.createDataFrame([(1, 1, 2, 1, 10.0), (1, 1, 4, 1, 14.0), (1, 2, 3, 1, 5.0)], "file_id long, beat_idx long, cell int, dim int, value double")
    got = {(r.beat_idx, r.cell): r.value for r in br.impute_cells(m, spark.createDataFrame([(1, 6)], "file_id long, cells int")).collect()}
    assert [got[1, c] for c in range(1, 7)] == [8.0, 10.0, 12.0, 14.0, 16.0, 18.0] and {got[2, c] for c in range(1, 7)} == {5.0}


def test_tempo_range_of_short_files(spark):
    b = beats(spark, [(0, 1), (1, 2), (3, 1)], [(0, 1)], [(0, 1), (0.5, 2)])
    got = {r.file_id: (r.min_bpm, r.max_bpm) for r in tm.tempo_range(b, 5.0).collect()}
    assert got == {1: (30.0, 30.0), 3: (120.0, 120.0)}


def test_budget():
    assert pt.cluster_budget({(3, 4): 10, (4, 4): 30}, 4) == {(3, 4): 1, (4, 4): 3}
    assert pt.cluster_budget({(3, 4): 1, (4, 4): 99, (6, 8): 1}, 2) == {(3, 4): 1, (4, 4): 1, (6, 8): 1}
    assert pt.cluster_budget({(3, 4): 10, (4, 4): 30}, 5, "equal") == {(3, 4): 2, (4, 4): 3}
    assert pt.cluster_budget({}, 3) == {}
