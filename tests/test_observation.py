"""Mixtures of feature vectors."""

import time

import numpy as np

from metrolith.operators import observation as ob


def test_joint_mixtures_keep_the_correlation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    root = np.linalg.cholesky(np.array([[1.0, 0.9], [0.9, 1.0]]))
    x = np.concatenate([rng.standard_normal((300, 2)) @ root.T, rng.standard_normal((200, 2)) @ root.T * 0.5 + [6, -6]])
    rows = [(1, 1, v.tolist()) for v in x] + [(1, 2, [1.0, 2.0])] * 3 + [(1, 2, None)]
    df = spark.createDataFrame(rows, "pattern int, cell int, x array<double>")
    fit = ob.fit_joint_mixtures(df, ["pattern", "cell"], [1, 2])
    got = sorted((r for r in fit.collect() if r.cell == 1), key=lambda r: -r.weight)
    for r, part in zip(got, (x[:300], x[300:])):
        assert abs(r.weight - len(part) / 500) < 0.01 and np.allclose(r["mean"], part.mean(0), atol=0.02) and np.allclose(np.reshape(r["cov"], (2, 2)), np.cov(part.T, bias=True), atol=0.03)
    # Off the line on which the features agree the density is far lower, though each value alone is as likely.
    frames = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 2, 2, -1.0), (1, 3, 1, 1.0)], "file_id int, frame int, dim int, value double")
    lik = {r.frame: r.lik for r in ob.joint_likelihood(frames, fit.where("cell = 1")).collect()}
    assert lik[1] > 100 * lik[2] > 0 and lik[3] == 0
    monkeypatch.setattr(ob, "CHUNK", 64)
    w, m, c, _ = ob.fit_vectors(x[np.lexsort(x.T[::-1])])
    assert np.allclose(sorted(w), sorted(r.weight for r in got), atol=1e-6)


def test_counted_vectors_fit_as_repeated_ones(monkeypatch):
    rng = np.random.default_rng(7)
    x, times = rng.integers(0, 9, (150, 2)) * [1.0, 0.5], rng.integers(1, 6, 150)
    whole = ob.fit_vectors(np.repeat(x, times, axis=0))
    for chunk in (ob.CHUNK, 64):
        monkeypatch.setattr(ob, "CHUNK", chunk)
        for got, want in zip(ob.fit_vectors(x, times=times), whole):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_a_step_costs_by_distinct_vectors(spark):
    """Row by row five starts over four million rows take many minutes."""
    n, t = 4_000_000, time.time()
    df = spark.range(n).selectExpr("1 as k", "array(double(id % 50), double(id % 11) / 10 + (id % 50) / 100) as x")
    fit = ob.fit_joint_mixtures(df, ["k"], [1, 2]).collect()
    assert time.time() - t < 60
    i = np.arange(n)
    v = np.stack([i % 50, (i % 11) / 10 + (i % 50) / 100]).astype(float)
    w, mean = np.array([r["weight"] for r in fit]), np.array([r["mean"] for r in fit])
    second = sum(r["weight"] * (np.reshape(r["cov"], (2, 2)) + np.outer(r["mean"], r["mean"])) for r in fit)
    assert abs(w.sum() - 1) < 1e-9 and np.allclose(w @ mean, v.mean(1)) and np.allclose(second - np.outer(w @ mean, w @ mean), np.cov(v, bias=True))
