"""Particle filters over (position, tempo, pattern), many series in lockstep in an Arrow kernel.

Random numbers come from a generator seeded by the seed and the file, so results depend neither
on how the data are partitioned nor on which files go together. Of a long series only the lines
of ancestors that are still alive are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metrolith.config import Params
from metrolith.functions.streams import by_length, in_series, read_series
from metrolith.operators.decode import ROWS, Columns, _plain, _rows, _value

#: Frames for which random numbers are drawn at once, bytes of particles kept of a lot of series, and particles advanced together.
DRAWN, KEPT_BYTES, TOGETHER = 32, 1 << 27, 1 << 16


@dataclass
class BarPointer:
    """Per pattern: bar length, beats, tempo range in positions a frame, cells of a bar; ``pr`` the pattern transitions."""

    bar: np.ndarray
    beats: np.ndarray
    slow: np.ndarray
    fast: np.ndarray
    cells: np.ndarray
    pr: np.ndarray
    frame_length: float

    @classmethod
    def of(cls, patterns: list, pr: list[list[float]], div: int, frame_length: float) -> BarPointer:
        """From rows with bar, n_beats, min_bpm, max_bpm."""
        bar, beats = np.array([p.bar for p in patterns]), np.array([p.n_beats for p in patterns])
        tempo = lambda x: np.array(x) * bar / beats * frame_length / 60.0
        return cls(bar, beats, tempo([p.min_bpm for p in patterns]), tempo([p.max_bpm for p in patterns]), np.ceil(bar * div - 1e-9).astype(int), np.array(pr, float), frame_length)


def draw(weights: np.ndarray, n: int, u: float) -> np.ndarray:
    """n indices at even steps through the running sum of the weights; u in 0 to 1 is the first step's share."""
    q = np.cumsum(weights)
    if q[-1] <= 0 or not np.isfinite(q[-1]):
        q = np.arange(1, len(weights) + 1, dtype=float)
    return np.minimum(np.searchsorted(q / q[-1], (np.arange(n) + u) / n, side="right"), len(weights) - 1)


def start_particles(b: BarPointer, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, tempi and patterns: a jittered grid that gives every part of the space its share, and random ones for the rest."""
    k = len(b.bar)
    rows = max(1, int(np.sqrt(n / k)))
    cell = b.bar.sum() / max(1, n // rows)
    widest = max(float((b.fast - b.slow).max()), 1e-12)
    m, v, r = [], [], []
    for i in range(k):
        pos = np.arange(cell / 2, b.bar[i] - cell / 2 + 1e-12, cell)
        lines = int(max(1, np.floor(rows * (b.fast[i] - b.slow[i]) / widest + 0.5)))
        tempi = np.linspace(b.slow[i], b.fast[i], lines)
        pp, tt = np.meshgrid(pos, tempi, indexing="ij")
        m.append(pp.ravel() + (rng.random(pp.size) - 0.5) * cell + 1)
        v.append(tt.ravel() + (rng.random(pp.size) - 0.5) * widest / rows)
        r.append(np.full(pp.size, i))
    m, v, r = (np.concatenate(x)[:n] for x in (m, v, r))
    rest = n - len(m)
    if rest:
        extra = rng.integers(0, k, rest)
        r = np.r_[r, extra]
        v = np.r_[v, b.slow[extra] + rng.random(rest) * (b.fast - b.slow)[extra]]
        m = np.r_[m, 1 + rng.random(rest) * b.bar[extra]]
    return np.clip(m, 1, None), np.clip(v, b.slow[r], b.fast[r]), r


def start_groups(b: BarPointer, m: np.ndarray, v: np.ndarray, r: np.ndarray, n_groups: int) -> np.ndarray:
    """Groups by equal bins of position and tempo within each pattern."""
    k = len(b.bar)
    tempi = max(1, int(np.sqrt(n_groups / k)))
    places = max(1, int(n_groups / (tempi * k)))
    i = np.clip(((m - 1) / b.bar.max() * places).astype(int), 0, places - 1)
    span = max(float(b.fast.max() - b.slow.min()), 1e-12)
    j = np.clip(((v - b.slow.min()) / span * tempi).astype(int), 0, tempi - 1)
    return np.unique((r * tempi + j) * places + i, return_inverse=True)[1]


def _means(x: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of n groups."""
    size = np.bincount(g, minlength=n)
    return np.stack([np.bincount(g, x[:, k], n) for k in range(x.shape[1])], 1) / np.maximum(size, 1)[:, None], size


def _lloyd_once(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centres, numbered without the empty ones."""
    d = np.zeros((len(x), len(c)))
    for k in range(x.shape[1]):
        d += (x[:, k, None] - c[None, :, k]) ** 2
    return np.unique(d.argmin(1), return_inverse=True)[1]


def regroup(b: BarPointer, m: np.ndarray, v: np.ndarray, r: np.ndarray, g: np.ndarray, p: Params) -> np.ndarray:
    """Groups after one step of k-means over (place on the bar's circle, tempo, pattern), with near groups merged and wide ones split."""
    wm, wn, wr = p.state_distance
    angle, long = m * 2 * np.pi / b.bar[r], b.bar[r] / max(b.bar.max(), 1e-12)
    x = np.stack([(np.sin(angle) + 1) * wm * long, (np.cos(angle) + 1) * wm * long, v * wn, r * wr + 1.0], 1)
    g = np.unique(g, return_inverse=True)[1]
    g = _lloyd_once(x, _means(x, g, int(g.max()) + 1)[0])
    c, size = _means(x, g, int(g.max()) + 1)
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    d[np.tril_indices(len(c))] = np.inf
    into, changed = np.arange(len(c)), False
    while len(c) > 1:
        i, j = divmod(int(d.argmin()), len(c))
        if not d[i, j] <= p.merge_threshold:
            break
        into[into == j] = i
        c[i] = (c[i] * size[i] + c[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[j], d[:, j] = np.inf, np.inf
        far = np.sqrt(((c - c[i]) ** 2).sum(1))
        rest = np.isin(np.arange(len(c)), into)
        d[i, i + 1 :] = np.where(rest, far, np.inf)[i + 1 :]
        d[:i, i] = np.where(rest, far, np.inf)[:i]
        changed = True
    g = np.unique(into[g], return_inverse=True)[1]
    n = int(g.max()) + 1
    c, size = _means(x, g, n)
    wide = (size > 1) & (np.bincount(g, ((x - c[g]) ** 2).sum(1), n) / size > p.split_threshold)
    if wide.any():
        # The later half of a wide group is a group of its own.
        order = np.argsort(g, kind="stable")
        rank = np.empty(len(g), int)
        rank[order] = np.arange(len(g)) - (np.cumsum(size) - size)[g[order]]
        g = np.where(wide[g] & (rank >= size[g] // 2), n + (np.cumsum(wide) - 1)[g], g)
        changed = True
    return _lloyd_once(x, _means(x, g, int(g.max()) + 1)[0]) if changed else g


def resample_groups(g: np.ndarray, w: np.ndarray, p: Params, warp: float | None, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and log weights after drawing about as many particles from each group; only the heaviest groups stay.

    ``u`` has a number in 0 to 1 for each of them. With a warp exponent particles are drawn by a power of their weight and weighted back.
    """
    n, k = len(w), int(g.max()) + 1
    order = np.argsort(g, kind="stable")
    start = np.searchsorted(g[order], np.arange(k))
    top = np.maximum.reduceat(w[order], start)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(np.isfinite(top), top + np.log(np.bincount(g, np.exp(w - top[g]), k)), -np.inf)
    keep = np.flatnonzero(np.isfinite(total))
    if not len(keep):
        return np.arange(n), np.full(n, -np.log(n))
    keep = np.sort(keep[np.lexsort((keep, -total[keep]))][: p.n_max_clusters])
    share = np.diff(np.floor(np.linspace(0, n, len(keep) + 1) + 0.5).astype(int))
    place = np.full(k, -1)
    place[keep] = np.arange(len(keep))
    own = order[place[g[order]] >= 0]
    of = place[g[own]]
    norm = np.exp(w[own] - total[g[own]])
    bent = norm**warp if warp else norm
    mass = np.cumsum(bent)
    ends = np.searchsorted(of, np.arange(len(keep)), side="right")
    before = np.r_[0.0, mass[ends - 1]]
    at = of + (mass - before[of]) / (before[of + 1] - before[of])
    to = np.repeat(np.arange(len(keep)), share)
    points = to + (np.arange(n) - np.repeat(np.cumsum(share) - share, share) + u[to]) / share[to]
    drawn = np.minimum(np.searchsorted(at, points, side="right"), ends[to] - 1)
    if not warp:
        return own[drawn], total[keep][to] - np.log(share[to])
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.where(bent > 0, norm / bent, 0.0)[drawn]
        return own[drawn], np.log(back) + total[keep][to] - np.log(np.bincount(to, back, len(keep)))[to]


class _Lines:
    """Particles of the frames so far and who descends from whom; frames with one ancestor left are settled."""

    def __init__(self):
        self.hist: list[tuple[np.ndarray, ...]] = []
        self.parents: list[np.ndarray] = []
        self.settled: list[tuple[np.ndarray, ...]] = []

    def add(self, particles: tuple[np.ndarray, ...], parents: np.ndarray) -> None:
        self.hist.append(particles)
        self.parents.append(parents)

    def prune(self) -> None:
        """Drops what none of the last particles (of a single series) descends from."""
        alive = np.arange(self.parents[-1].shape[-1])
        for i in range(len(self.hist) - 1, -1, -1):
            parents = self.parents[i][:, alive]
            alive = np.unique(parents)
            whole = len(alive) == self.hist[i][0].shape[-1]
            self.hist[i] = tuple(x[:, alive] for x in self.hist[i])
            self.parents[i] = np.searchsorted(alive, parents)
            if whole and i < len(self.hist) - 1:
                break
        n = next((i for i, h in enumerate(self.hist) if h[0].shape[-1] > 1), len(self.hist) - 1)
        if n:
            self.settled.append(tuple(np.concatenate([h[k][:, 0] for h in self.hist[:n]]) for k in range(3)))
            self.hist, self.parents = self.hist[n:], self.parents[n:]

    def path(self, last: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Lines of ancestors of one last particle of each series, which end after so many frames."""
        done = sum(len(x[0]) for x in self.settled)
        out = [tuple(np.zeros(n - done, h.dtype) for h in self.hist[0]) for n in sizes]
        at = np.zeros(len(sizes), np.int64)
        for i in range(len(self.hist) - 1, -1, -1):
            k = len(self.parents[i])
            ended = sizes[:k] == done + i + 1
            at[:k] = np.where(ended, last[:k], at[:k])
            at[:k] = self.parents[i][np.arange(k), at[:k]]
            values = [h[np.arange(k), at[:k]] for h in self.hist[i]]
            for j in range(k):
                for o, v in zip(out[j], values):
                    o[i] = v[j]
        return [tuple(np.concatenate([*(x[k] for x in self.settled), o[k]]) for k in range(3)) for o in out]


def particle_lines(b: BarPointer, series: list, p: Params, columns: Columns = _plain, kept: int = KEPT_BYTES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, tempi and patterns of the line of ancestors of the heaviest last particle of each series (file_id and values x; the longest first), a frame each.

    ``columns`` makes likelihoods of all patterns' cells of a frame's values. Each frame moves positions, draws patterns where
    bars end, weighs, resamples (not after the last) and varies tempi.
    """
    n, most = p.n_particles, int(b.cells.max())
    sizes = np.array([len(s.x) for s in series])
    rngs = [np.random.default_rng([p.seed, s.file_id & 0xFFFFFFFF]) for s in series]
    grouped = p.resampling_scheme >= 2
    warp = p.warp_exponent if p.resampling_scheme in (1, 3) else None
    start = [start_particles(b, n, rng) for rng in rngs]
    m, v, r = (np.stack([x[i] for x in start]) for i in range(3))
    r = r.astype(np.int16)
    groups = p.n_initial_clusters * (1 if p.n_initial_clusters > len(b.bar) else len(b.bar))
    g = np.stack([start_groups(b, *x, groups) for x in start]) if grouped else None
    w = np.full(m.shape, -np.log(n))
    cum = np.cumsum(b.pr / b.pr.sum(1, keepdims=True), axis=1)
    width = b.bar[0] / b.cells[0]
    rows, lines = np.arange(len(series))[:, None], _Lines()
    last = np.zeros(len(series), np.int64)
    after = max(DRAWN, kept // (28 * n))
    for i in range(int(sizes.max(initial=0))):
        k = int((sizes > i).sum())
        m, v, r, w = m[:k], v[:k], r[:k], w[:k]
        if i % DRAWN == 0:
            patterns, noise, steps = (np.stack(x) for x in zip(*((rng.random((DRAWN, n)), rng.standard_normal((DRAWN, n)), rng.random((DRAWN, max(p.n_max_clusters, 1)))) for rng in rngs[:k])))
            held = np.zeros((k, DRAWN, series[0].x.shape[1]))
            for j in range(k):
                part = series[j].x[i : i + DRAWN]
                held[j, : len(part)] = part
        at = i % DRAWN
        moved = np.mod(m + v - 1, b.bar[r]) + 1
        ended = moved < m
        new = np.minimum((patterns[:k, at, :, None] > cum[r]).sum(-1), len(b.bar) - 1)
        fits = (v >= b.slow[new]) & (v <= b.fast[new])
        r = np.where(ended & fits, new, r).astype(np.int16)
        m = np.minimum(moved, 1 + b.bar[r] * (1 - 1e-12))
        lik = columns(held[:k, at])
        cell = np.clip(((m - 1) / width).astype(int), 0, most - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = w + np.log(lik[rows[:k], r.astype(int) * most + cell])
            top = w.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(w - top).sum(axis=1, keepdims=True))
            w = np.where(np.isfinite(total), w - total, -np.log(n))
        parent = np.tile(np.arange(n), (k, 1))
        going = sizes[:k] > i + 1
        for j in np.flatnonzero(~going):
            last[j] = int(np.argmax(w[j]))
        seen = (m, v, r)
        if grouped and (i + 1) % p.res_int == 0:
            for j in np.flatnonzero(going):
                own = regroup(b, m[j], v[j], r[j], g[j], p)
                parent[j], w[j] = resample_groups(own, w[j], p, warp, steps[j, at])
                g[j] = own[parent[j]]
        elif not grouped:
            for j in np.flatnonzero(going & (1 / np.exp(2 * w).sum(axis=1) <= p.ratio_neff * n)):
                x = np.exp(w[j])
                bent = x**warp if warp else x
                parent[j] = draw(bent, n, steps[j, at, 0])
                back = (x / np.where(bent > 0, bent, 1.0))[parent[j]] if warp else np.ones(n)
                with np.errstate(divide="ignore"):
                    w[j] = np.log(back / back.sum())
        lines.add(seen, parent)
        m, r, old = np.take_along_axis(m, parent, 1), np.take_along_axis(r, parent, 1), np.take_along_axis(v, parent, 1)
        v = np.clip(old + noise[:k, at] * p.tempo_std * old, b.slow[r], b.fast[r])
        if len(series) == 1 and len(lines.hist) % after == 0:
            lines.prune()
    return lines.path(last, sizes) if lines.hist else [(np.zeros(0), np.zeros(0), np.zeros(0, np.int16))] * len(series)


def particle_paths(frames: DataFrame, b: BarPointer, p: Params, columns: Columns = _plain, kept: int = KEPT_BYTES) -> DataFrame:
    """file_id, frame, position, bpm, pattern (from 1) of (file_id, frame, lik), lik the likelihoods of all patterns' cells, pattern by pattern; or of (file_id, frame, x) with ``columns`` of x."""
    value, names = _value(frames), ["file_id", "frame", "position", "bpm", "pattern"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for lot in by_length(read_series(batches, value), 28 * p.n_particles, kept):
            most = max(1, TOGETHER // p.n_particles)
            for first in range(0, len(lot), most):
                some = lot[first : first + most]
                for s, (m, v, r) in zip(some, particle_lines(b, some, p, columns, kept)):
                    bpm = 60.0 * v / (b.bar[r] / b.beats[r] * b.frame_length)
                    for lo in range(0, len(m), ROWS):
                        z = slice(lo, lo + ROWS)
                        yield np.full(len(m[z]), s.file_id, np.int64), np.asarray(s.frames[z]), m[z], bpm[z], (r[z] + 1).astype(np.int32)

    return in_series(frames, value).mapInArrow(lambda batches: _rows(names, solved(batches)), "file_id long, frame long, position double, bpm double, pattern int")
