"""Rhythmic patterns: clusters of bars, their names, transitions and priors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.session import Workspace


#: What a missing value of a point counts as: so far off that no cluster holds points with and without it.
MISSING = -99_999_999.0


def transition_counts(bars: DataFrame, order: tuple[str, ...] = ("bar_no",)) -> DataFrame:
    """i, j, n: how often a bar of pattern j follows one of pattern i in a file (file_id, pattern and the order's columns)."""
    w = Window.partitionBy("file_id").orderBy(*order)
    return bars.select(F.col("pattern").alias("i"), F.lead("pattern").over(w).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count("*").alias("n"))


def transition_matrix(bars: DataFrame, order: tuple[str, ...] = ("bar_no",)) -> DataFrame:
    """i, j, p: row-normalised counts. A pattern that nothing follows has no row."""
    return transition_counts(bars, order).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i"))).select("i", "j", "p")


def pattern_prior(bars: DataFrame) -> DataFrame:
    """pattern, p: share of the bars."""
    n = bars.groupBy("pattern").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("pattern", (F.col("n") / F.col("_t")).alias("p"))


def complete_matrix(matrix: DataFrame, prior: DataFrame) -> DataFrame:
    """The matrix with the prior as the row of every pattern that nothing follows."""
    lacking = prior.select(F.col("pattern").alias("i")).join(matrix.select("i").distinct(), "i", "left_anti")
    return matrix.unionByName(lacking.crossJoin(prior.select(F.col("pattern").alias("j"), "p")))


def pattern_name(dataset: Column, num: Column, den: Column, i: Column) -> Column:
    return F.concat(dataset, F.lit("-"), num.cast("string"), F.lit("-"), den.cast("string"), F.lit("_"), i.cast("string"))


def label_clusters(items: DataFrame, kind: str = "meter", dataset: str = "set") -> DataFrame:
    """Items with ``pattern`` (from 1) and ``name``: the rank of the item's meter (num, den), the rank of its rhythm, or one pattern for all.

    The distinct meters or rhythms are few and ranked at one place; the items are not sorted.
    """
    if kind == "none":
        return items.withColumn("pattern", F.lit(1)).withColumn("name", F.lit(dataset))
    by = ["num", "den"] if kind == "meter" else ["rhythm"]
    distinct = items.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct().withColumn("pattern", F.dense_rank().over(Window.orderBy(*[f"_{c}" for c in by])))
    name = pattern_name(F.lit(dataset), F.col("num"), F.col("den"), F.lit(1)) if kind == "meter" else F.concat(F.lit(dataset + "-"), F.col("rhythm"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return items.join(distinct, on[0] if len(on) == 1 else on[0] & on[1]).drop(*[f"_{c}" for c in by]).withColumn("name", name)


def cluster_budget(counts: dict, k: int, mode: str = "data") -> dict:
    """Clusters per meter, at least one each: shares of ``k`` by number of items (*data*) or alike (*equal*), rounded up,
    then lowered by one where the rounding gave most, until they sum to k (or to the number of meters if that is more).
    """
    if not counts:
        return {}
    k = max(k, len(counts))
    total = sum(counts.values())
    share = {m: counts[m] * k / total if mode == "data" else k / len(counts) for m in sorted(counts)}
    n = {m: max(1, math.ceil(s)) for m, s in share.items()}
    while sum(n.values()) > k:
        m = min((m for m in n if n[m] > 1), key=lambda m: (share[m] - n[m] + 1, m))
        n[m] -= 1
    return n


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING))


def _nearest(dims: list[str], centres: list[list[float]]) -> Column:
    """Index (from 0) of the nearest centre, the first of equals; missing values count as ``MISSING``."""
    d = [sum((_filled(c) - F.lit(float(x))) ** 2 for c, x in zip(dims, centre)) for centre in centres]
    best, at = d[0], F.lit(0)
    for i, x in enumerate(d[1:], 1):
        at = F.when(x < best, i).otherwise(at)
        best = F.least(best, x)
    return at


def lloyd(points: DataFrame, dims: list[str], centres: list[list[float]], steps: int) -> list[list[float]]:
    """Centres after so many steps of k-means. A step is one aggregation; only k centres reach the driver. An empty cluster keeps its centre."""
    for _ in range(steps):
        new = points.groupBy(_nearest(dims, centres).alias("c")).agg(*[F.avg(_filled(d)).alias(d) for d in dims]).collect()
        moved = {r.c: [r[d] for d in dims] for r in new}
        centres = [moved.get(i, c) for i, c in enumerate(centres)]
    return centres


def assign_nearest(points: DataFrame, dims: list[str], centres: list[list[float]], out: str = "cluster") -> DataFrame:
    return points.withColumn(out, _nearest(dims, centres) + 1)


def _starts(points: DataFrame, groups: int, k: list[int], starts: int, width: int, seed: int) -> np.ndarray:
    """Centres of every start: of each group a point drawn from each of k parts by a hash of its values (NaN where a part has none)."""
    most = max(k)
    rows = points.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("h", F.xxhash64("x", "s", F.lit(seed)))
    sizes = F.element_at(F.array(*[F.lit(n) for n in k]), F.col("g") + 1)
    drawn = rows.groupBy("g", "s", F.pmod(F.xxhash64("x", F.lit(seed + 1), "s"), sizes).cast("int").alias("c")).agg(F.min_by("x", "h").alias("x"))
    out = np.full((groups, starts, most, width), np.nan)
    for r in drawn.collect():
        out[r.g, r.s, r.c] = r.x
    return out


def _step(centres: np.ndarray):
    """Sums of the points nearest to each centre (g, s, c, n, off, x), of every start at once, per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, starts, most, width = centres.shape
        n, off, total = np.zeros((groups, starts, most)), np.zeros((groups, starts, most)), np.zeros(centres.shape)
        far = np.isnan(centres).any(-1)
        c = np.where(far[..., None], 0.0, centres)
        for b in batches:
            g, x = b.column("g").to_numpy(), b.column("x").flatten().to_numpy().reshape(-1, width)
            for k in np.unique(g).tolist():
                y = x[g == k]
                for s in range(starts):
                    d = np.stack([((y - c[k, s, i]) ** 2).sum(1) if not far[k, s, i] else np.full(len(y), np.inf) for i in range(most)], 1)
                    at = d.argmin(1)
                    n[k, s] += np.bincount(at, minlength=most)
                    off[k, s] += np.bincount(at, d[np.arange(len(y)), at], most)
                    np.add.at(total[k, s], at, y)
        g, s, i = np.nonzero(n)
        at = np.arange(len(g) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (g, s, i)), pa.array(n[g, s, i]), pa.array(off[g, s, i]), pa.ListArray.from_arrays(at, pa.array(total[g, s, i].ravel()))], names=["g", "s", "c", "n", "off", "x"])

    return run


def kmeans(points: DataFrame, k: list[int], steps: int = 200, starts: int = 5, seed: int = 1) -> list[list[list[float]]]:
    """Centres of each group's best start (least sum of squares), groups g from 0 of (g, x) with k centres each.

    A step is one pass over the points for all groups and starts; the driver sees sums a centre. A start is over when its centres
    no longer move, and the whole after so many steps. An empty cluster keeps its centre.
    """
    width = len(points.first()["x"])
    centres = _starts(points, len(k), k, starts, width, seed)
    off = np.full(centres.shape[:2], np.inf)
    for _ in range(steps):
        part = points.mapInArrow(_step(centres), "g int, s int, c int, n double, off double, x array<double>")
        sums = part.groupBy("g", "s", "c").agg(F.sum("n").alias("n"), F.sum("off").alias("off"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(width)]).collect()
        new, off = centres.copy(), np.zeros(off.shape)
        for r in sums:
            new[r.g, r.s, r.c] = [r[f"x{i}"] / r.n for i in range(width)]
            off[r.g, r.s] += r.off
        still = np.allclose(new, centres, rtol=1e-9, atol=1e-12, equal_nan=True)
        centres = new
        if still:
            break
    best = off.argmin(axis=1)
    return [[c.tolist() for c in centres[g, best[g], : k[g]] if not np.isnan(c).any()] for g in range(len(k))]


def kmeans_per_meter(points: DataFrame, dims: list[str], k: int, mode: str = "data", steps: int = 200, dataset: str = "set", starts: int = 5) -> DataFrame:
    """Points (with num, den) with pattern and name: k-means within each meter, the clusters shared out by ``cluster_budget``.

    Missing values count as ``MISSING``, so that bars with different cells do not come together.
    """
    ws = Workspace(points.sparkSession, "kmeans")
    points = ws.keep(points)  # read once a step
    counts = {(r.num, r.den): r.n for r in points.groupBy("num", "den").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return points.withColumn("pattern", F.lit(1)).withColumn("name", F.lit(dataset))
    budget = cluster_budget(counts, k, mode)
    meters = sorted(budget)
    is_meter = [(F.col("num").eqNullSafe(F.lit(a))) & (F.col("den").eqNullSafe(F.lit(b))) for a, b in meters]
    group = F.coalesce(*[F.when(m, F.lit(i)) for i, m in enumerate(is_meter)])
    vectors = ws.keep(points.select(group.alias("g"), F.array(*[_filled(d).cast("double") for d in dims]).alias("x")))
    found = kmeans(vectors, [budget[m] for m in meters], steps, starts)
    ws.drop(vectors)
    first, own = 0, []
    for m, is_m, centres in zip(meters, is_meter, found):
        own.append(F.when(is_m, F.struct((_nearest(dims, centres) + 1).alias("c"), F.lit(first).alias("first"))))
        first += budget[m]
    return points.withColumn("_c", F.coalesce(*own)).withColumn("pattern", F.col("_c.c") + F.col("_c.first")).withColumn("name", pattern_name(F.lit(dataset), F.col("num"), F.col("den"), F.col("_c.c"))).drop("_c")


def song_clusters_to_bars(bars: DataFrame, songs: DataFrame) -> DataFrame:
    """Bars with their file's pattern."""
    return bars.join(songs.select("file_id", "pattern"), "file_id")


def pattern_profiles(means: DataFrame, bar_patterns: DataFrame) -> DataFrame:
    """pattern, dim, cell, value in 0 to 1: each pattern's mean profile, scaled per feature; what a plot of the patterns shows."""
    m = means.join(bar_patterns, ["file_id", "beat_idx"]).groupBy("pattern", "dim", "cell").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("pattern", "dim")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return m.select("pattern", "dim", "cell", F.coalesce((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)).alias("value"))
