import itertools

import numpy as np
import pytest

from metrolith.config import Params
from metrolith.operators import decode as dc
from metrolith.plans import statespace as ss
from metrolith.plans import transitions as tr
from metrolith.queries.models import FL, LAM, M, TOY, TOY_PR


@pytest.fixture(scope="module")
def toy(spark):
    return ss.make_patterns(spark, TOY), spark.createDataFrame(TOY_PR, "i int, j int, p double")


def test_known_counts_of_the_toy_model(spark, toy):
    s = ss.states_2015(toy[0], FL)
    e = tr.transitions_2015(s, toy[1], LAM).toPandas()
    assert s.count() == 8309 and len(e) == 13735
    of = e[e.i == 4002]
    assert of.j.sum() == 258559 and len(of) == 47 and abs((of.p**2).sum() - 0.5557951693111098) < 1e-12
    assert tr.check_transitions(tr.transitions_2015(s, toy[1], LAM), s).count() == 0


def test_rows_sum_to_one(spark, toy):
    for e, n in ((tr.transitions_2006(*toy, FL, M), ss.states_2006(toy[0], FL, M).count()), (tr.transitions_2015(ss.states_2015(toy[0], FL), toy[1], LAM, 1e-3, 1e-2, True), 8310)):
        t = e.toPandas().groupby("i").p.sum()
        assert len(t) == n and np.allclose(t, 1)


def test_check_finds_faults(spark, toy):
    s = ss.states_2015(toy[0], FL)
    bad = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0), (3, 99999, 1.0)], "i int, j int, p double")
    assert sorted((r.i, r.total) for r in tr.check_transitions(bad, s).collect() if r.total) == [(1, 0.5)]
    assert {r.i for r in tr.check_transitions(bad, s).collect()} == {1, 3}


def test_log_grid():
    g = ss.tempo_grid(50.0, 100.0, 0.02, 10)
    assert g[0] == 60 and g[-1] == 30 and len(g) >= 10 and g == sorted(set(g), reverse=True)
    assert ss.tempo_grid(50.0, 100.0, 0.02) == list(range(60, 29, -1))
    assert len(ss.tempo_grid(50.0, 100.0, 0.02, 500)) == 31


def test_initial_distribution(spark, toy):
    s = ss.states_2015(toy[0], FL)
    p = ss.initial_distribution(s).toPandas().p
    assert np.allclose(p, 1 / 8309)
    q = ss.initial_distribution(s, silence=True).toPandas()
    assert q.p.sum() == 1.0 and q[q.p > 0].state.tolist() == [8310]


def test_neighbours(spark, toy):
    s = ss.states_2015(toy[0], FL)
    n = ss.neighbours_2015(s).toPandas().set_index("state")
    assert n.loc[1, "right"] == 2 and n.loc[1, "left"] == 180 and n.loc[1, "faster"] == 181 and np.isnan(n.loc[1, "slower"])
    assert n.loc[181, "slower"] == 1 and n.loc[180, "right"] == 1


def random_model(rng, n):
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.7)
    a[np.arange(n), (np.arange(n) + 1) % n] += 0.1
    a /= a.sum(1, keepdims=True)
    i, j = np.nonzero(a)
    init = rng.random(n)
    return a, dc.Model(i, j, a[i, j], init / init.sum(), np.arange(n))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(25):
        n, t = rng.integers(2, 5), rng.integers(1, 7)
        a, m = random_model(rng, n)
        lik = rng.random((t, n))
        best, path = -1.0, None
        for seq in itertools.product(range(n), repeat=int(t)):
            for s0 in range(n):
                p = m.init[s0]
                for k, s in enumerate(seq):
                    p *= a[s0 if k == 0 else seq[k - 1], s] * lik[k, s]
                if p > best + 1e-15:
                    best, path = p, seq
        assert dc.viterbi(m, lik).tolist() == list(path)
        # Decoding in blocks gives the same path.
        assert dc.viterbi(m, lik, limit=n * 4).tolist() == list(path)
        assert [p.tolist() for p in dc.viterbi_together(m, [lik, lik[:1], lik[:1]])][0] == list(path)


def test_forward_against_matrix_product():
    rng = np.random.default_rng(4)
    a, m = random_model(rng, 4)
    lik = rng.random((9, 4))
    x = m.init
    for i, row in enumerate(dc.forward(m, lik)):
        x = (x @ a) * lik[i]
        x = x / x.sum()
        assert np.allclose(row, x)


def test_lockstep_is_the_same_as_one_by_one():
    rng = np.random.default_rng(6)
    _, m = random_model(rng, 6)
    series = sorted((rng.random((int(t), 6)) for t in rng.integers(0, 40, 30)), key=lambda x: -len(x))
    series[3][2] = 0.0
    held = [{int(i): rng.choice(6, 2, replace=False) for i in rng.integers(0, 40, 3) if i < len(x)} for x in series]
    for x, h, got in zip(series, held, dc.viterbi_together(m, series, held)):
        assert got.tolist() == dc.viterbi(m, x, h).tolist() == dc.viterbi(m, x, h, limit=48).tolist()


def test_long_series_lie_in_files_and_decode_in_blocks(spark):
    from metrolith.functions.streams import read_series

    rng = np.random.default_rng(7)
    _, m = random_model(rng, 3)
    x = rng.random((5000, 3))
    df = spark.createDataFrame([(1, i + 1, v.tolist()) for i, v in enumerate(x)] + [(2, 1, [0.2, 0.3, 0.4])], "file_id long, frame long, lik array<double>")
    want = dc.viterbi(m, x) + 1
    for kw in ({}, {"limit": 3 * 2 * 97}):
        got = {(r.file_id, r.frame): r.state for r in dc.viterbi_paths(df.repartition(5), m, **kw).collect()}
        assert len(got) == 5001 and [got[1, i + 1] for i in range(5000)] == want.tolist()
    batches = df.where("file_id = 1").orderBy("frame").toArrow().to_batches(700)
    (s,) = read_series(iter(batches), "lik", held=100)
    assert isinstance(s.x, np.memmap) and np.array_equal(s.x, x) and s.frames[-1] == 5000


def test_beats_reach_the_kernel_as_beats(spark):
    p = ss.make_patterns(spark, [(1, 3, 4, 3, 0.75, 60.0, 120.0), (2, 4, 4, 4, 1.0, 60.0, 120.0)])
    states = ss.states_2015(p, 0.1)
    pr = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 1, 0.1), (2, 2, 0.9)], "i int, j int, p double")
    model = dc.model_from_tables(tr.transitions_2015(states, pr), ss.initial_distribution(states), ss.state_cells(states, 16, 16))
    rng = np.random.default_rng(8)
    frames = spark.createDataFrame([(f, i + 1, rng.random(32).tolist()) for f in (1, 2) for i in range(80)], "file_id long, frame long, lik array<double>")
    beats = spark.createDataFrame([(f, k + 1, 0.35 + 0.7 * k, k % 4 + 1) for f in (1, 2) for k in range(11)], "file_id long, beat_idx long, t double, beat_no long")
    for kind in ("beats", "downbeats"):
        a = dc.constrained_paths(frames, model, dc.constraint_states(beats, states, 0.1, kind)).orderBy("file_id", "frame").collect()
        assert a == dc.beat_constrained_paths(frames, model, states, beats, 0.1, kind).orderBy("file_id", "frame").collect()


def test_viterbi_edge_cases():
    rng = np.random.default_rng(5)
    _, m = random_model(rng, 3)
    assert dc.viterbi(m, np.zeros((0, 3))).tolist() == []
    assert len(dc.viterbi(m, np.zeros((4, 3)))) == 4
    assert dc.viterbi(m, rng.random((4, 3)), {2: np.array([2])})[2] == 2
    four = dc.Model(np.array([0, 1, 2, 3]), np.array([1, 0, 3, 2]), np.ones(4), np.array([0.5, 0, 0.5, 0]), np.array([0, 0, 1, 1]))
    lik = np.array([[0.7, 0.3], [0.2, 0.8], [0.7, 0.3], [0.9, 0.1]])
    assert dc.viterbi(four, lik).tolist() == [1, 0, 1, 0]


def test_params():
    assert Params().max_tempo == 220.0
    for kw in ({"pattern_size": "x"}, {"min_tempo": 0.0}, {"resampling_scheme": 7}, {"frame_length": 0.0}):
        with pytest.raises(ValueError):
            Params(**kw)
