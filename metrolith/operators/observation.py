"""Observation models: Gaussian mixtures per pattern and cell, and activation likelihoods."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.session import Workspace

REGULARISATION = 1e-10
#: Starts of a fit, steps of each at most, and the relative gain of the log likelihood below which it has converged.
STARTS, STEPS, GAIN = 5, 200, 1e-6
#: Rows of one mixture read at a time, and from which on they are held in a file.
CHUNK = 1 << 18


def gaussian(x: Column, mu: Column, var: Column) -> Column:
    return F.exp(-((x - mu) * (x - mu)) / (2.0 * var)) / F.sqrt(F.lit(2 * math.pi) * var)


def gaussian2(x: Column, y: Column, mx: Column, my: Column, a: Column, b: Column, c: Column) -> Column:
    """Density of a 2-D normal distribution with covariance (a b; b c)."""
    det = a * c - b * b
    dx, dy = x - mx, y - my
    return F.exp(-0.5 * (c * dx * dx - 2.0 * b * dx * dy + a * dy * dy) / det) / (F.lit(2 * math.pi) * F.sqrt(det))


def mixture_density(x: Column, comps: list[tuple[float, float, float]]) -> Column:
    """Density of a 1-D mixture of (weight, mean, variance); 0 for null and NaN."""
    d = sum(F.lit(w) * gaussian(x, F.lit(m), F.lit(v)) for w, m, v in comps)
    return F.coalesce(F.when(~F.isnan(x), d), F.lit(0.0))


def mixture_means(gmm: DataFrame, key: tuple[str, ...] = ("pattern", "cell")) -> DataFrame:
    """Mean of each mixture (weight, mean)."""
    return gmm.groupBy(*key).agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"))


def fit_mixtures(values: DataFrame, key: list[str], steps: int = 20, floor: float = REGULARISATION) -> DataFrame:
    """key, comp (1, 2), weight, mean, var: two-component EM of x within each key, all keys at once.

    A step is one aggregation of sums, so a key may hold any share of the rows; the parameters
    are as many as the keys (patterns times cells), which the model bounds. They start a
    deviation below and above the mean. Null and NaN values are left out.
    """
    spark = values.sparkSession
    ws = Workspace(spark, "em")
    data = ws.keep(values.select(*key, F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x)"))  # read once a step
    s = data.groupBy(*key).agg(F.avg("x").alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v"))
    sd = F.sqrt("v")
    par = s.select(*key, F.lit(0.5).alias("w1"), (F.col("m") - sd).alias("m1"), (F.col("v") + floor).alias("v1"), F.lit(0.5).alias("w2"), (F.col("m") + sd).alias("m2"), (F.col("v") + floor).alias("v2"))
    rows = [tuple(r) for r in par.collect()]
    for _ in range(steps):
        now = spark.createDataFrame(rows, par.schema)
        p1, p2 = (F.col(f"w{i}") * gaussian(F.col("x"), F.col(f"m{i}"), F.col(f"v{i}")) for i in (1, 2))
        both = p1 + p2
        # Far from both components the nearer mean takes the value whole.
        near = (F.abs(F.col("x") - F.col("m1")) <= F.abs(F.col("x") - F.col("m2"))).cast("double")
        step = (
            data.join(F.broadcast(now), key)
            .withColumn("r", F.when(both > 0, p1 / both).otherwise(near))
            .groupBy(*key)
            .agg(F.count("*").alias("n"), F.sum("r").alias("s0"), F.sum(F.col("r") * F.col("x")).alias("s1"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("s2"), F.sum("x").alias("t1"), F.sum(F.col("x") * F.col("x")).alias("t2"))
        )
        before = {r[: len(key)]: r[len(key) :] for r in rows}
        rows = []
        for r in step.collect():
            k = tuple(r[c] for c in key)
            new = []
            for i, (n, a, b) in enumerate(((r.s0, r.s1, r.s2), (r.n - r.s0, r.t1 - r.s1, r.t2 - r.s2))):
                if n <= 1e-12:
                    new += [0.0, *before[k][3 * i + 1 : 3 * i + 3]]
                else:
                    new += [n / r.n, a / n, max(b / n - (a / n) ** 2, 0.0) + floor]
            rows.append((*k, *new))
    ws.drop(data)
    out = spark.createDataFrame(rows, par.schema)
    return out.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("comp"), F.col(f"w{i}").alias("weight"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")) for i in (1, 2)])).alias("c")).select(*key, "c.*")


def mixture_likelihood(frames: DataFrame, gmm: DataFrame) -> DataFrame:
    """file_id, frame, pattern, cell, lik of (file_id, frame, dim, value) under mixtures (pattern, cell, dim, comp, weight, mean, var).

    The likelihood is computed per cell, not per state: states share their cell's mixture.
    Features count as independent; it is 0 where one is missing or NaN. The mixtures are a model's, a few thousand rows, and
    become one row a cell, so that a frame meets each of them once and nothing is shuffled or summed up afterwards.
    """
    parts: dict[tuple, dict[int, list]] = {}
    for r in gmm.collect():
        parts.setdefault((r.pattern, r.cell), {}).setdefault(r.dim, []).append((float(r.weight), float(r.mean), float(r["var"])))
    dims = sorted({d for x in parts.values() for d in x})
    most = max((len(c) for x in parts.values() for c in x.values()), default=0)
    rows = [(p, c, [k for d in dims for k in (x.get(d, []) + [(0.0, 0.0, 1.0)] * most)[:most]]) for (p, c), x in sorted(parts.items())]
    table = frames.sparkSession.createDataFrame(rows, "pattern int, cell int, m array<struct<w: double, m: double, v: double>>")
    lik = F.lit(1.0)
    for i in range(len(dims)):
        each = [F.col("m")[i * most + k] for k in range(most)]
        lik = lik * sum((gaussian(F.col("x")[i], e["m"], e["v"]) * e["w"] for e in each), F.lit(0.0))
    return feature_vectors(frames, dims).crossJoin(F.broadcast(table)).select("file_id", "frame", "pattern", "cell", F.coalesce(lik, F.lit(0.0)).alias("lik"))


def feature_vectors(frames: DataFrame, dims: list[int]) -> DataFrame:
    """file_id, frame, x: the values of the features in order; null where one is missing or NaN."""
    one = lambda d: F.max(F.when((F.col("dim") == d) & ~F.isnan("value"), F.col("value").cast("double")))
    v = frames.groupBy("file_id", "frame").agg(*[one(d).alias(f"_{d}") for d in dims])
    whole = F.lit(True)
    for d in dims:
        whole = whole & F.col(f"_{d}").isNotNull()
    return v.select("file_id", "frame", F.when(whole, F.array(*[F.col(f"_{d}") for d in dims])).alias("x"))


def _log_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.full((len(x), len(weight)), -np.inf)
    for k in np.flatnonzero(weight > 0):
        root = np.linalg.cholesky(cov[k])
        e = np.linalg.solve(root, (x - mean[k]).T)
        out[:, k] = math.log(weight[k]) - 0.5 * (e * e).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def fit_vectors(x: np.ndarray, seed: int = 1, starts: int = STARTS, steps: int = STEPS, floor: float = REGULARISATION, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, full covariances and log likelihood of the best two-component mixture of the rows of x (EM to convergence).

    A row counts as often as ``times`` says (once without it), and the fit is that of the rows so repeated. The first start lies a
    deviation to both sides of the mean, the others at two rows drawn; all with the deviations of the features.
    """
    d = x.shape[1]
    parts = range(0, len(x), CHUNK)
    often = (lambda i: np.ones((len(x[i : i + CHUNK]), 1))) if times is None else (lambda i: times[i : i + CHUNK, None].astype(float))
    ends = np.cumsum([often(i).sum() for i in parts]).astype(np.int64)
    n = int(ends[-1])

    def row(at: int) -> np.ndarray:
        p = int(np.searchsorted(ends, at, "right"))
        inside = np.cumsum(often(p * CHUNK)) + (ends[p - 1] if p else 0)
        return x[p * CHUNK + np.searchsorted(inside, at, "right")]

    mid = sum((often(i) * x[i : i + CHUNK]).sum(0) for i in parts) / n
    var = sum((often(i) * (x[i : i + CHUNK] - mid) ** 2).sum(0) for i in parts) / n
    rng, best = np.random.default_rng(seed), None
    for start in range(starts):
        mean = np.stack([mid - np.sqrt(var), mid + np.sqrt(var)]) if start == 0 else np.stack([row(at) for at in np.sort(rng.choice(n, 2, replace=n < 2))])
        weight, cov, before = np.full(2, 0.5), np.stack([np.diag(var + floor)] * 2), -np.inf
        for _ in range(steps):
            total, s0, s1, s2 = 0.0, np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
            for i in parts:
                y = x[i : i + CHUNK]
                p = _log_densities(y, weight, mean, cov)
                top = p.max(1, keepdims=True)
                r = np.exp(p - top)
                both = r.sum(1, keepdims=True)
                total += float((often(i) * (top + np.log(both))).sum())
                r *= often(i) / both
                y = y - mid
                s0, s1, s2 = s0 + r.sum(0), s1 + r.T @ y, s2 + np.einsum("nk,ni,nj->kij", r, y, y)
            if best is None or total > best[3]:
                best = (weight, mean, cov, total)
            if total - before < GAIN * abs(total):
                break
            before, weight, mean, cov = total, s0 / n, mean.copy(), cov.copy()
            for k in np.flatnonzero(s0 > 1e-12):
                m = s1[k] / s0[k]
                c = s2[k] / s0[k] - np.outer(m, m)
                low, axes = np.linalg.eigh((c + c.T) / 2)  # rounding may leave a variance below zero
                mean[k], cov[k] = m + mid, (axes * np.maximum(low, 1e-12 * max(low[-1], 0.0))) @ axes.T + floor * np.eye(d)
            weight = np.where(s0 > 1e-12, weight, 0.0)
    return best


def fit_joint_mixtures(vectors: DataFrame, key: list[str], dims: list[int]) -> DataFrame:
    """key, comp (1, 2), weight, mean (array), cov (array, row by row), dims: two-component mixtures of the vectors x of each key.

    Equal vectors of a key are counted first and weigh in the fit as often as they occur, so that steps take as long as there are distinct ones.
    Those of a key reach one task in order; above a limit they are held in a file, so a key may be of any size. Null vectors are left out.
    """
    d = len(dims)
    fields = [f for f in vectors.select(*key).schema.fields]
    names = [f"k{i}" for i in range(len(key))]
    out = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)) + ", comp int, weight double, mean array<double>, cov array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, file, count = None, [], None, 0

        def emit(types):
            x = np.concatenate(held) if file is None else np.memmap(file, np.float64, "r", shape=(count, d + 1))
            w, m, c, _ = fit_vectors(x[:, :d], times=x[:, d])
            return pa.RecordBatch.from_arrays([*(pa.array([v] * 2, t) for v, t in zip(now, types)), pa.array([1, 2], pa.int32()), pa.array(w), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array(c.reshape(2, -1).tolist(), pa.list_(pa.float64()))], names=[*names, "comp", "weight", "mean", "cov"])

        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.column(n).type for n in names]
            keys = list(zip(*(b.column(n).to_pylist() for n in names)))
            x = np.column_stack([b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), b.column("times").to_numpy()])
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if now is not None and keys[lo] != now:
                    yield emit(types)
                    held, file, count = [], None, 0
                now = keys[lo]
                count += hi - lo
                held.append(np.array(x[lo:hi]))
                if file is not None or count > CHUNK:
                    file = file or tempfile.TemporaryFile()
                    for part in held:
                        file.write(part.tobytes())
                    file.flush()
                    held = []
        if now is not None:
            yield emit(types)

    rows = vectors.where("x is not null").select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("x").cast("array<double>").alias("x"))
    distinct = rows.groupBy(*names, "x").agg(F.count("*").alias("times"))
    fitted = distinct.repartition(*names).sortWithinPartitions(*names, "x").mapInArrow(run, out)
    named = fitted.select(*[F.col(n).alias(k) for k, n in zip(key, names)], "comp", "weight", "mean", "cov", F.array(*[F.lit(int(v)) for v in dims]).alias("dims"))
    return vectors.sparkSession.createDataFrame(named.collect(), named.schema)


@dataclass
class Mixtures:
    """Likelihood columns of vectors under mixtures with full covariance: of component k, mean, inverse covariance, scale and column; 0 for vectors with NaN."""

    mean: np.ndarray
    inv: np.ndarray
    scale: np.ndarray
    column: np.ndarray
    width: int

    @classmethod
    def of(cls, gmm: DataFrame, column: Callable[[int, int], int], width: int) -> Mixtures:
        """From the table of ``fit_joint_mixtures``; ``column(pattern, cell)`` counts from 0."""
        rows = [r for r in gmm.collect() if r.weight > 0]
        rows.sort(key=lambda r: column(r.pattern, r.cell))
        d = len(rows[0].mean) if rows else 1
        cov = np.array([r.cov for r in rows]).reshape(-1, d, d)
        scale = np.log([r.weight for r in rows]) - 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
        return cls(np.array([r.mean for r in rows]).reshape(-1, d), np.linalg.inv(cov), scale, np.array([column(r.pattern, r.cell) for r in rows], int), width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if len(self.column):
            e = np.nan_to_num(x)[:, None, :] - self.mean
            p = np.exp(self.scale - 0.5 * np.einsum("mki,kij,mkj->mk", e, self.inv, e))
            first = np.flatnonzero(np.r_[True, self.column[1:] != self.column[:-1]])
            out[:, self.column[first]] = np.add.reduceat(p, first, axis=1)
            out[np.isnan(x).any(axis=1)] = 0.0
        return out


@dataclass
class Activations:
    """Likelihood columns of activations in 0 to 1: the value for a pattern's first cell, the rest shared by its others; ``width`` columns, 0 for cells that a pattern has not."""

    first: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, cells: list[int], most: int, extra: int = 0) -> Activations:
        first, share = np.zeros(len(cells) * most + extra), np.zeros(len(cells) * most + extra)
        for i, n in enumerate(cells):
            first[i * most] = 1.0
            share[i * most + 1 : i * most + n] = 1.0 / max(n - 1, 1)
        return cls(first, share)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        v = np.nan_to_num(x[:, :1])
        return np.where(np.isnan(x[:, :1]), 0.0, v * self.first + (1.0 - v) * self.share)


@dataclass
class Floored:
    """Likelihood columns of which none is below a floor, so that data unlike any seen rule nothing out."""

    columns: Callable[[np.ndarray], np.ndarray]
    floor: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.columns(x), self.floor)


def likelihood_arrays(vectors: DataFrame, columns) -> DataFrame:
    """file_id, frame, lik: all likelihood columns of (file_id, frame, x), row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for lo in range(0, len(x), 4096):
                lik = columns(x[lo : lo + 4096])
                at = pa.array(np.arange(len(lik) + 1, dtype=np.int32) * lik.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("file_id").slice(lo, len(lik)), b.column("frame").slice(lo, len(lik)), pa.ListArray.from_arrays(at, pa.array(lik.ravel()))], names=["file_id", "frame", "lik"])

    return vectors.select(F.col("file_id").cast("long").alias("file_id"), F.col("frame").cast("long").alias("frame"), "x").mapInArrow(run, "file_id long, frame long, lik array<double>")


def joint_likelihood(frames: DataFrame, gmm: DataFrame) -> DataFrame:
    """file_id, frame, pattern, cell, lik of (file_id, frame, dim, value) under the mixtures of ``fit_joint_mixtures``; 0 where a feature is missing or NaN.

    A cell's mixture is one row of a model table; a frame meets each of them once.
    """
    parts: dict[tuple, list] = {}
    dims: list[int] = []
    for r in gmm.collect():
        dims, d = list(r.dims), len(r.dims)
        if r.weight > 0:
            cov = np.array(r.cov).reshape(d, d)
            scale = math.log(r.weight) - 0.5 * (d * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1]))
            parts.setdefault((r.pattern, r.cell), []).append((list(r.mean), np.linalg.inv(cov).ravel().tolist(), scale))
    most, d = max(map(len, parts.values()), default=0), len(dims)
    rows = [(p, c, k + [([0.0] * d, [0.0] * d * d, float("-inf"))] * (most - len(k))) for (p, c), k in sorted(parts.items())]
    table = frames.sparkSession.createDataFrame(rows, "pattern int, cell int, m array<struct<mean: array<double>, inv: array<double>, scale: double>>")
    lik = F.lit(0.0)
    for k in range(most):
        e = [F.col("x")[i] - F.col("m")[k]["mean"][i] for i in range(d)]
        form = sum((e[i] * F.col("m")[k]["inv"][i * d + j] * e[j] for i in range(d) for j in range(d)), F.lit(0.0))
        lik = lik + F.exp(F.col("m")[k]["scale"] - 0.5 * form)
    return feature_vectors(frames, dims).crossJoin(F.broadcast(table)).select("file_id", "frame", "pattern", "cell", F.coalesce(lik, F.lit(0.0)).alias("lik"))


def activation_likelihood(frames: DataFrame, cells: DataFrame) -> DataFrame:
    """file_id, frame, pattern, cell, lik of activations x in 0 to 1: x for a pattern's first cell, the rest shared by its others (pattern, cells)."""
    grid = cells.select("pattern", "cells", F.explode(F.sequence(F.lit(1), F.col("cells"))).alias("cell"))
    lik = F.when(F.col("cell") == 1, F.col("x")).otherwise((1.0 - F.col("x")) / (F.col("cells") - 1))
    return frames.select("file_id", "frame", "x").crossJoin(F.broadcast(grid)).select("file_id", "frame", "pattern", "cell", lik.alias("lik"))


def beats_in_cells(patterns: DataFrame, div: int) -> DataFrame:
    """pattern, cells: cells of each pattern (bar in whole notes times the division of one)."""
    return patterns.select("pattern", F.ceil(F.col("bar") * div - 1e-9).cast("int").alias("cells"))


def log_weights(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows (key, logw) with ``logsum`` of their key and ``w``, the normalised weight."""
    peak = df.groupBy(key).agg(F.max("logw").alias("_m"))
    total = df.join(peak, key).groupBy(key).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col("logw") - F.col("_m"))).alias("_s")).select(key, (F.col("_m") + F.log("_s")).alias("logsum"))
    return df.join(total, key).withColumn("w", F.exp(F.col("logw") - F.col("logsum")))


def effective_size(df: DataFrame, key: str = "file_id") -> DataFrame:
    """key, ess: 1 / sum of squared normalised weights w."""
    return df.groupBy(key).agg((F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def systematic_resample(df: DataFrame, u: float = 0.5, key: str = "file_id", order: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Rows with ``copies``: how many of n evenly spaced points, n the rows of a key, fall into each weight's part of the running sum."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.groupBy(key).agg(F.sum("w").alias("_t"), F.count("*").alias("_n"))
    q = df.withColumn("_q", F.sum("w").over(w)).join(s, key)
    hi, lo = F.col("_q") / F.col("_t"), (F.col("_q") - F.col("w")) / F.col("_t")
    # Points (k + u) / n, k from 0, in [lo, hi): ceil(hi n - u) - ceil(lo n - u).
    upto = lambda x: F.least(F.greatest(F.ceil(x * F.col("_n") - u - 1e-9), F.lit(0)), F.col("_n"))
    return q.withColumn("copies", upto(hi) - upto(lo)).drop("_q", "_t", "_n")


def heaviest_groups(df: DataFrame, k: int, key: str = "file_id", group: str = "group") -> DataFrame:
    """key, group, weight of the k heaviest groups of each key (the smaller group on a tie)."""
    s = df.groupBy(key, group).agg(F.sum("w").alias("weight"))
    return s.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), group))).where(F.col("_k") <= k).drop("_k")
