"""A click track with known beats goes through training, decoding, particle filter and sinks."""

import numpy as np
import pytest

from metrolith.config import Params
from metrolith.operators import bars as br
from metrolith.operators import particles as pf
from metrolith.operators import results as rs
from metrolith.plans import tracker
from metrolith.sources import sinks

FL = 0.05
P = Params(frame_length=FL, whole_note_div=16, min_tempo=60.0, max_tempo=140.0, tempo_lambda=100.0)


@pytest.fixture(scope="module")
def clicks(spark):
    rng = np.random.default_rng(1)
    frames, beats, meters = [], [], []
    for f, (num, period) in enumerate(((3, 0.6), (4, 0.5), (3, 0.62), (4, 0.52)), 1):
        n = 40
        x = 0.05 + 0.02 * rng.random(int((n + 1) * period / FL))
        for k in range(n):
            t = 0.3 + k * period
            beats.append((f, k + 1, t, k % num + 1))
            x[int(t / FL)] = 1.0 if k % num == 0 else 0.5
        frames += [(f, i + 1, 1, float(v)) for i, v in enumerate(x)]
        meters.append((f, num, 4))
    return (
        spark.createDataFrame(frames, "file_id long, frame long, dim int, value double").cache(),
        spark.createDataFrame(beats, "file_id long, beat_idx long, t double, beat_no long").cache(),
        spark.createDataFrame(meters, "file_id long, num int, den int").cache(),
    )


@pytest.fixture(scope="module")
def trained(spark, clicks):
    t = tracker.train(*clicks, P)
    t.patterns, t.pr, t.gmm = t.patterns.cache(), t.pr.cache(), t.gmm.cache()
    return t


@pytest.mark.parametrize("scope", ["bar", "song"])
def test_training_by_kmeans(clicks, scope):
    from dataclasses import replace

    from pyspark.sql import functions as F

    frames, beats, meters = clicks
    turned = frames.withColumn("value", F.when(F.col("file_id") > 2, 1.05 - F.col("value")).otherwise(F.col("value")))
    t = tracker.train(turned, beats, meters, replace(P, cluster_type="kmeans", n_clusters=4, dist_cluster="equal", pattern_scope=scope))
    rows = t.patterns.orderBy("pattern").collect()
    assert [(r.pattern, r.num, r.n_beats, r.name) for r in rows] == [(1, 3, 3, "set-3-4_1"), (2, 3, 3, "set-3-4_2"), (3, 4, 4, "set-4-4_1"), (4, 4, 4, "set-4-4_2")]
    assert {(r.i, r.j): r.p for r in t.pr.collect()} == {(i, i): 1.0 for i in range(1, 5)}
    assert t.gmm.select("pattern").distinct().count() == 4


def test_kmeans_of_several_starts(spark):
    from metrolith.operators import patterns as pt

    rng = np.random.default_rng(9)
    rows, truth = [], {}
    for i in range(400):
        meter, c = i % 2, i % 2 + 2 * (i % 3)
        x = np.array([(0, 0), (0, 9), (4, 0), (4, 9), (9, 5), (5, 5)][c]) + rng.normal(0, 0.3, 2)
        rows.append((i, 3 + meter, 4, float(x[0]), None if i in (10, 40) else float(x[1])))
        truth[i] = (meter, c, i in (10, 40))
    df = spark.createDataFrame(rows, "id long, num int, den int, a double, b double")
    got = {r.id: (r.pattern, r.name) for r in pt.kmeans_per_meter(df, ["a", "b"], 7, "equal").collect()}
    assert len(got) == 400
    of = {}
    for i, g in got.items():
        of.setdefault(g, set()).add(truth[i][::2])
    # A meter's patterns are its own, and bars that lack a cell are not with those that have it.
    assert all(len(v) == 1 for v in of.values()) and {p for p, _ in of} == set(range(1, 8))
    again = {r.id: (r.pattern, r.name) for r in pt.kmeans_per_meter(df.repartition(5), ["a", "b"], 7, "equal").collect()}
    assert got == again


def test_training_by_rhythm(spark, clicks):
    from dataclasses import replace

    rhythms = spark.createDataFrame([(1, 3, 4, "waltz"), (2, 4, 4, "samba"), (3, 3, 4, "minuet"), (4, 4, 4, "samba")], "file_id long, num int, den int, rhythm string")
    q = replace(P, cluster_type="rhythm")
    t = tracker.train(clicks[0], clicks[1], rhythms, q)
    assert [(r.num, r.name) for r in t.patterns.orderBy("pattern").collect()] == [(3, "set-minuet"), (4, "set-samba"), (3, "set-waltz")]
    with pytest.raises(ValueError):
        tracker.train(*clicks, q)
    with pytest.raises(ValueError):
        replace(P, max_shift=-1)


def check(beats, truth, share):
    got = {}
    for r in beats.collect():
        got.setdefault(r.file_id, []).append((r.t, r.beat_no))
    for f in range(1, 5):
        want = [(r.t, r.beat_no) for r in truth if r.file_id == f][4:-4]
        hit = sum(any(abs(t - u) < 0.11 and b == c for u, c in got.get(f, [])) for t, b in want)
        assert hit >= share * len(want), (f, hit, len(want))


def test_training(trained):
    p = {r.pattern: r for r in trained.patterns.collect()}
    assert {k: (r.num, r.n_beats, r.name) for k, r in p.items()} == {1: (3, 3, "set-3-4_1"), 2: (4, 4, "set-4-4_1")}
    assert abs(p[1].min_bpm - 60 / 0.62) < 0.01 and abs(p[2].max_bpm - 120) < 0.01
    assert {(r.i, r.j): r.p for r in trained.pr.collect()} == {(1, 1): 1.0, (2, 2): 1.0}


@pytest.mark.parametrize("kind", ["2015", "2006"])
def test_decoding_finds_the_beats(clicks, trained, kind):
    from dataclasses import replace

    beats, path = tracker.decode(clicks[0], trained, replace(P, transition_model_type=kind, max_positions=240, pn=0.05))
    check(beats, clicks[1].collect(), 0.95 if kind == "2015" else 0.8)
    meters = {r.file_id: (r.num, r.den) for r in rs.first_meter(path).collect()}
    assert meters == {1: (3, 4), 2: (4, 4), 3: (3, 4), 4: (4, 4)}


def test_particle_filters_find_the_tempo(clicks, trained):
    from dataclasses import replace

    for scheme in (0, 1, 2, 3):
        q = replace(P, inference_method="PF", n_particles=800, resampling_scheme=scheme, res_int=10, ratio_neff=0.3, seed=5)
        _, path = tracker.decode(clicks[0], trained, q)
        rows = path.select("file_id", "frame", "position", "bpm", "pattern").collect()
        again = tracker.decode(clicks[0].repartition(7), trained, q)[1].select("file_id", "frame", "position", "bpm", "pattern").collect()
        assert sorted(rows) == sorted(again)
        bpm = {f: np.median([r.bpm for r in rows if r.file_id == f]) for f in range(1, 5)}
        assert all(90 < b < 125 for b in bpm.values()), (scheme, bpm)


def test_refinement_keeps_the_beats(clicks, trained):
    check(tracker.decode(clicks[0], tracker.refine(clicks[0], trained, P), P)[0], clicks[1].collect(), 0.9)


def test_correction_and_sinks(spark, clicks, trained, tmp_path):
    from dataclasses import replace

    beats, path = tracker.decode(clicks[0], trained, replace(P, correct_beats=True))
    check(beats, clicks[1].collect(), 0.9)
    names = trained.patterns.select("pattern", "name")
    kinds = frozenset({"beats", "downbeats", "median_tempo", "tempo", "meter", "rhythm"})
    sinks.save_results(beats, path, names, FL, str(tmp_path), kinds)
    read = lambda k: spark.read.text(f"{tmp_path}/{k}/file_id=1").collect()
    assert [r.value for r in read("meter")] == ["3/4"]
    line = read("beats")[0].value.split("\t")
    assert len(line) == 2 and len(line[0].split(".")[1]) == 3
    assert all("\t" not in r.value for r in read("downbeats")) and read("rhythm")[0].value.endswith("set-3-4_1") and "," in read("tempo")[0].value and read("median_tempo")
    with pytest.raises(ValueError):
        sinks.save_results(beats, path, names, FL, str(tmp_path), frozenset({"x"}))
    sinks.save_tables({"patterns": trained.patterns}, str(tmp_path / "m"))
    assert sinks.load_tables(spark, str(tmp_path / "m"), ["patterns"])["patterns"].count() == 2


def test_silence(spark, clicks):
    from dataclasses import replace

    from pyspark.sql import functions as F

    quiet = spark.createDataFrame([(1, 0.1 + 0.05 * (i % 9)) for i in range(200)], "dim int, value double")
    t = tracker.train(*clicks, P, silent=quiet)
    q = replace(P, use_silence_state=True, p2s=1e-3, pfs=1e-3)
    before = spark.range(1, 101).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("frame"), F.lit(1).alias("dim"), (0.1 + 0.05 * (F.col("id") % 9)).alias("value"))
    late = before.unionByName(clicks[0].where("file_id = 1").withColumn("frame", F.col("frame") + 100))
    beats, path = tracker.decode(late, t, q)
    assert path.agg(F.min("frame")).first()[0] > 90
    first = beats.agg(F.min("t"), F.count("*")).first()
    assert first[0] > 4.5 and first[1] >= 34
    seen, columns, most = tracker.observe(late, t, q)
    model, _ = tracker.hidden_model(t, q, most)
    from metrolith.operators.decode import model_faults

    from metrolith.operators.observation import likelihood_arrays

    assert model_faults(model, len(likelihood_arrays(seen, columns).first().lik)) == [] and "likelihood columns that do not exist" in model_faults(model, 3)
    with pytest.raises(ValueError):
        tracker.observe(late, tracker.Tables(t.patterns, t.pr, t.gmm), q)


def test_systematic_draws():
    rng = np.random.default_rng(2)
    for _ in range(50):
        w = rng.random(20)
        n = np.bincount(pf.draw(w, 100, rng.random()), minlength=20)
        e = 100 * w / w.sum()
        assert ((n >= np.floor(e) - 1e-9) & (n <= np.ceil(e) + 1e-9)).all()
    assert len(pf.draw(np.zeros(5), 5, 0.5)) == 5


def test_particles_do_not_depend_on_company_or_pruning():
    from metrolith.functions.streams import Series

    b = pf.BarPointer(np.array([0.75, 1.0]), np.array([3, 4]), np.array([0.01, 0.01]), np.array([0.02, 0.03]), np.array([12, 16]), np.full((2, 2), 0.5), 0.02)
    rng = np.random.default_rng(3)
    series = [Series(f, np.arange(1, t + 1), rng.random((t, 32)) ** 4) for f, t in ((7, 300), (3, 120), (9, 40), (1, 1))]
    for scheme in range(4):
        q = Params(n_particles=60, resampling_scheme=scheme, res_int=7, ratio_neff=0.5)
        together = pf.particle_lines(b, series, q)
        for s, got in zip(series, together):
            (alone,) = pf.particle_lines(b, [s], q, kept=28 * 60 * 40)
            for x, y in zip(got, alone):
                assert np.array_equal(x, y) and len(x) == len(s)
        m, v, r = together[0]
        assert (v >= b.slow[r]).all() and (v <= b.fast[r]).all() and (m >= 1).all() and (m <= 1 + b.bar[r]).all()


def test_groups_are_drawn_by_their_shares():
    rng = np.random.default_rng(4)
    g, w = rng.integers(0, 5, 400), np.log(rng.random(400))
    w[g == 2] = -np.inf
    q = Params(n_particles=400, n_max_clusters=3)
    index, new = pf.resample_groups(g, w - np.log(np.exp(w).sum()), q, None, rng.random(3))
    kept = np.unique(g[index])
    heavy = sorted(range(5), key=lambda i: -np.exp(w[g == i]).sum())[:3]
    assert kept.tolist() == sorted(heavy) and all(abs((g[index] == k).sum() - 400 / 3) < 1 for k in kept)
    for k in kept:
        share = np.exp(w[g == k]).sum() / np.exp(w).sum()
        assert abs(np.exp(new[g[index] == k]).sum() - share) < 1e-9
        own = np.flatnonzero(g == k)
        n, e = np.bincount(index, minlength=400)[own], np.exp(w[own]) / np.exp(w[own]).sum() * (g[index] == k).sum()
        assert (np.abs(n - e) <= 1 + 1e-9).all()


def test_start_particles():
    b = pf.BarPointer(np.array([0.75, 1.0]), np.array([3, 4]), np.array([0.01, 0.01]), np.array([0.02, 0.03]), np.array([12, 16]), np.eye(2), 0.02)
    m, v, r = pf.start_particles(b, 1000, np.random.default_rng(1))
    assert len(m) == len(v) == len(r) == 1000 and (m >= 1).all() and (m <= 1 + b.bar[r] + 0.1).all() and (v >= b.slow[r]).all() and (v <= b.fast[r]).all()
    g = pf.start_groups(b, m, v, r, 16)
    assert g.min() == 0 and len(np.unique(g)) == g.max() + 1


def test_files_with_too_few_bars(spark):
    b = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 1.0, 2), (2, 1, 0.5, 1), (2, 2, 1.0, 1)], "file_id long, beat_idx long, t double, beat_no long")
    assert [r.file_id for r in br.files_with_bars(b).collect()] == [2]
    f = spark.createDataFrame([(2, 20, 1, 0.0)], "file_id long, frame long, dim int, value double")
    assert {(r.file_id, r.beat_idx) for r in br.beats_within(b, f, 0.05).collect()} == {(1, 1), (1, 2), (2, 1)}
