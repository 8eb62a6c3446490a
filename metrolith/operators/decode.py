"""Decoding of series under a hidden Markov model.

The recurrence runs along time and is independent between series, so files are the unit of an
Arrow kernel, which advances many of them in lockstep. Likelihoods are computed in the kernel,
frame by frame, from a frame's few values. A model is a few thousand states, gathered once and
sent with the kernel; its size depends on tempi and patterns, never on the data. What a kernel
holds is bounded but for a file's values, which lie in a temporary file where they are many.
Small models can also be run as a fold inside the engine, without Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions.streams import Series, by_length, in_series, read_series

#: Bytes of back-pointers kept at once; longer series are decoded again block by block from kept chances.
BACKPOINTER_BYTES = 1 << 28
#: Chances of states that are advanced together, and rows of a result handed over at once.
TOGETHER, ROWS = 1 << 17, 50_000

#: Likelihood columns of frames (frames x values).
Columns = Callable[[np.ndarray], np.ndarray]


@dataclass
class Model:
    """States 0..n-1, edges sorted by target and source, chances at time 0, and the likelihood column of each state."""

    src: np.ndarray
    dst: np.ndarray
    p: np.ndarray
    init: np.ndarray
    obs: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.src, self.dst))
        self.src, self.dst, self.p = self.src[order].astype(np.int64), self.dst[order].astype(np.int64), self.p[order].astype(float)
        self.first = np.flatnonzero(np.r_[True, self.dst[1:] != self.dst[:-1]]) if len(self.dst) else np.zeros(0, int)
        self.target = self.dst[self.first] if len(self.dst) else self.first
        self.slot = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(self.dst)])) if len(self.dst) else self.first
        self.n = len(self.init)
        self.from_source = np.argsort(self.src, kind="stable")
        self.by_source = self.src[self.from_source]

    def best(self, d: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Best predecessor's chance of each state (last axis), and which it is (the lowest of equals)."""
        v = d[..., self.src] * self.p
        top = np.maximum.reduceat(v, self.first, axis=-1)
        new = np.zeros(d.shape)
        new[..., self.target] = top
        if not back:
            return new, None
        at = np.minimum.reduceat(np.where(v == top[..., self.slot], np.arange(len(self.p)), len(self.p)), self.first, axis=-1)
        psi = np.zeros(d.shape, self.pointer)
        psi[..., self.target] = self.src[at]
        return new, psi

    @property
    def pointer(self):
        return np.uint16 if self.n <= 65535 else np.uint32

    def total(self, a: np.ndarray) -> np.ndarray:
        new = np.zeros(a.shape)
        new[..., self.target] = np.add.reduceat(a[..., self.src] * self.p, self.first, axis=-1)
        return new


def model_from_tables(edges: DataFrame, init: DataFrame, cells: DataFrame) -> Model:
    """A model of edges (i, j, p), chances (state, p) and likelihood columns (state, gmm), states from 1."""
    e, i, c = edges.toPandas(), init.toPandas().sort_values("state"), cells.toPandas().sort_values("state")
    return Model(e.i.to_numpy() - 1, e.j.to_numpy() - 1, e.p.to_numpy(), i.p.to_numpy(), c.gmm.to_numpy() - 1)


def model_faults(model: Model, columns: int, tolerance: float = 1e-4) -> list[str]:
    """What does not fit together in a model whose frames have so many likelihood columns; nothing for a sound one."""
    out = []
    if not len(model.p):
        return ["no transitions"]
    if max(model.src.max(), model.dst.max()) >= model.n or min(model.src.min(), model.dst.min()) < 0:
        out.append("transitions of states that do not exist")
    else:
        total = np.bincount(model.src, model.p, model.n)
        if (np.abs(total[total > tolerance] - 1) > tolerance).any():
            out.append("chances that do not sum to 1")
    if len(model.obs) != model.n:
        out.append("not one likelihood column a state")
    elif model.obs.max() >= columns or model.obs.min() < 0:
        out.append("likelihood columns that do not exist")
    if abs(model.init.sum() - 1) > tolerance:
        out.append("initial chances that do not sum to 1")
    return out


def _scaled(d: np.ndarray) -> np.ndarray:
    s = d.sum(axis=-1, keepdims=True)
    # Where no state can explain the frame, all are alike again.
    return np.where(s > 0, d / np.where(s > 0, s, 1.0), 1.0 / d.shape[-1])


def _plain(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x)


def _last(d: np.ndarray) -> int:
    ends = np.flatnonzero(d == d.max())
    return int(ends[(len(ends) - 1) // 2])


def _restrict(d: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Chances of the allowed states only, unless none of them has any."""
    y = np.zeros_like(d)
    y[allowed] = d[allowed]
    return y if y.sum() > 0 else d


def viterbi(model: Model, x: np.ndarray, allowed: dict[int, np.ndarray] | None = None, limit: int = BACKPOINTER_BYTES, columns: Columns = _plain) -> np.ndarray:
    """States (from 0) of the best path of one series; ``columns`` makes likelihood columns of its frames, ``allowed`` has the states that some frames are held to.

    The chances at time 0 move on before the first frame; each frame's chances are scaled to
    sum to 1. Of states tied at the end the median one ends the path. Back-pointers beyond the
    limit are computed again, block by block from the last one on.
    """
    t, allowed = len(x), allowed or {}
    path = np.zeros(t, np.int32)
    if not t:
        return path
    step = max(1, min(t, limit // max(model.n * np.dtype(model.pointer).itemsize, 1)))

    def advance(d: np.ndarray, lo: int, hi: int, back: bool) -> tuple[np.ndarray, list]:
        pointers = []
        for a in range(lo, hi, 256):
            lik = columns(np.asarray(x[a : min(a + 256, hi)]))
            for i in range(a, min(a + 256, hi)):
                d, psi = model.best(d, back)
                if back:
                    pointers.append(psi)
                d = d * lik[i - a][model.obs]
                if i in allowed:
                    d = _restrict(d, allowed[i])
                d = _scaled(d)
        return d, pointers

    d, kept = model.init.astype(float), []
    for lo in range(0, t, step):
        kept.append(d)
        d, pointers = advance(d, lo, min(lo + step, t), lo + step >= t)
    path[-1] = _last(d)
    for k in range(len(kept) - 1, -1, -1):
        lo, hi = k * step, min((k + 1) * step, t)
        if hi < t:
            pointers = advance(kept[k], lo, hi, True)[1]
        for i in range(hi - 1, max(lo, 1) - 1, -1):
            path[i - 1] = pointers[i - lo][path[i]]
    return path


def viterbi_together(model: Model, series: list[np.ndarray], allowed: list[dict[int, np.ndarray]] | None = None, columns: Columns = _plain) -> list[np.ndarray]:
    """``viterbi`` of several series, the longest first, advanced in lockstep."""
    sizes = np.array([len(x) for x in series])
    paths = [np.zeros(n, np.int32) for n in sizes]
    if not len(series) or not sizes[0]:
        return paths
    x = np.zeros((sizes[0], len(series), series[0].shape[1]))
    for k, v in enumerate(series):
        x[: len(v), k] = v
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, a in enumerate(allowed or []):
        for i, states in a.items():
            held.setdefault(i, []).append((k, states))
    d = np.tile(model.init.astype(float), (len(series), 1))
    pointers, ends = [], np.zeros(len(series), np.int64)
    running = [int((sizes > i).sum()) for i in range(sizes[0])]
    for i, k in enumerate(running):
        new, psi = model.best(d[:k], True)
        pointers.append(psi)
        new = new * columns(x[i, :k])[:, model.obs]
        for j, states in held.get(i, ()):
            new[j] = _restrict(new[j], states)
        d = _scaled(new)
        for j in np.flatnonzero(sizes[:k] == i + 1):
            ends[j] = _last(d[j])
    at = np.zeros(len(series), np.int64)
    for i in range(sizes[0] - 1, -1, -1):
        k = running[i]
        here = sizes[:k] == i + 1
        at[:k][here] = ends[:k][here]
        for j in range(k):
            paths[j][i] = at[j]
        at[:k] = pointers[i][np.arange(k), at[:k]]
    return paths


def forward(model: Model, lik: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Chances of every state given the frames so far, a frame a row."""
    a = model.init.astype(float) if start is None else start
    out = np.zeros((len(lik), model.n))
    for i in range(len(lik)):
        a = _scaled(model.total(a) * lik[i][model.obs])
        out[i] = a
    return out


def _together(model: Model, series: Iterator[Series], limit: int) -> Iterator[list[Series]]:
    """Lots of series whose back-pointers fit the limit, of not too many at once; ones that are beyond it alone."""
    for lot in by_length(series, model.n * np.dtype(model.pointer).itemsize, limit):
        most = max(1, TOGETHER // max(len(model.p), 1))
        for lo in range(0, len(lot), most):
            yield lot[lo : lo + most]


def _rows(names: list[str], parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Columns of many series as batches of about ``ROWS`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def _value(frames: DataFrame) -> str:
    return "x" if "x" in frames.columns else "lik"


def _paths(frames: DataFrame, model: Model, columns: Columns, limit: int, marks: tuple[str, ...] = (), states=None) -> DataFrame:
    value, names = _value(frames), ["file_id", "frame", "state"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for lot in _together(model, read_series(batches, value, marks), limit):
            held = [{i: states(m) for i, m in s.marks} for s in lot]
            held = [{i: a for i, a in h.items() if a is not None} for h in held]
            size = len(lot[0]) * model.n * np.dtype(model.pointer).itemsize
            paths = viterbi_together(model, [s.x for s in lot], held, columns) if size <= limit else [viterbi(model, s.x, h, limit, columns) for s, h in zip(lot, held)]
            for s, p in zip(lot, paths):
                for lo in range(0, len(p), ROWS):
                    part = p[lo : lo + ROWS]
                    yield np.full(len(part), s.file_id, np.int64), np.asarray(s.frames[lo : lo + ROWS]), part + np.int32(1)

    return in_series(frames, value, *marks).mapInArrow(lambda batches: _rows(names, solved(batches)), "file_id long, frame long, state int")


def viterbi_paths(frames: DataFrame, model: Model, columns: Columns = _plain, limit: int = BACKPOINTER_BYTES) -> DataFrame:
    """file_id, frame, state (from 1) of (file_id, frame, lik), or of (file_id, frame, x) with ``columns`` of x; no array may be null."""
    return _paths(frames, model, columns, limit)


def _filtered(frames: DataFrame, model: Model, columns: Columns, schema: str, emit) -> DataFrame:
    """``emit(file_id, frame numbers, chances)``, columns, of blocks of every series, which are advanced in lockstep."""
    value, names = _value(frames), ["file_id", "frame", "state", "p"]
    width = max(1, TOGETHER // max(model.n, 1))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for lot in by_length(read_series(batches, value), 1, 1 << 18):
            most = max(1, TOGETHER // max(len(model.p), 1))
            for first in range(0, len(lot), most):
                some = lot[first : first + most]
                sizes = np.array([len(s) for s in some])
                a = np.tile(model.init.astype(float), (len(some), 1))
                for lo in range(0, int(sizes[0]), width):
                    k = int((sizes > lo).sum())
                    out = np.zeros((k, min(width, int(sizes[0]) - lo), model.n))
                    x = np.zeros((k, out.shape[1], some[0].x.shape[1]))
                    for j in range(k):
                        part = some[j].x[lo : lo + width]
                        x[j, : len(part)] = part
                    for i in range(out.shape[1]):
                        k = int((sizes > lo + i).sum())
                        a = _scaled(model.total(a[:k]) * columns(x[:k, i])[:, model.obs])
                        out[:k, i] = a
                    for j in range(len(out)):
                        n = min(width, int(sizes[j]) - lo)
                        yield emit(some[j].file_id, np.asarray(some[j].frames[lo : lo + n]), out[j, :n])

    return in_series(frames, value).mapInArrow(lambda batches: _rows(names, solved(batches)), schema)


def forward_chances(frames: DataFrame, model: Model, columns: Columns = _plain) -> DataFrame:
    """file_id, frame, state, p: the filtered chance of every state of a small model."""

    def emit(file_id, f, a):
        return np.full(a.size, file_id, np.int64), np.repeat(f, model.n), np.tile(np.arange(1, model.n + 1, dtype=np.int32), len(f)), a.ravel()

    return _filtered(frames, model, columns, "file_id long, frame long, state int, p double", emit)


def forward_best(frames: DataFrame, model: Model, columns: Columns = _plain) -> DataFrame:
    """file_id, frame, state, p: the likeliest state given the frames so far (the lowest of equals)."""

    def emit(file_id, f, a):
        s = a.argmax(axis=1)
        return np.full(len(f), file_id, np.int64), f, (s + 1).astype(np.int32), a[np.arange(len(s)), s]

    return _filtered(frames, model, columns, "file_id long, frame long, state int, p double", emit)


def constrained_paths(frames: DataFrame, model: Model, allowed: DataFrame, columns: Columns = _plain, limit: int = BACKPOINTER_BYTES) -> DataFrame:
    """Like ``viterbi_paths``, with the states of some frames restricted to those of (file_id, frame, state).

    A restriction that no state can meet is ignored at its frame.
    """
    sets = allowed.groupBy("file_id", "frame").agg(F.collect_set("state").alias("states"))
    joined = frames.select("file_id", "frame", _value(frames)).join(sets, ["file_id", "frame"], "left")
    return _paths(joined, model, columns, limit, ("states",), lambda m: np.array(m["states"], np.int64) - 1)


def beat_constrained_paths(frames: DataFrame, model: Model, states: DataFrame, beats: DataFrame, frame_length: float, kind: str = "beats", columns: Columns = _plain, limit: int = BACKPOINTER_BYTES) -> DataFrame:
    """Like ``constrained_paths`` under the states that ``constraint_states`` gives for annotated beats.

    A row a beat goes to the kernel, which finds the states itself. Of several beats in one frame the first counts.
    """
    s = states.orderBy("state").select("pos_idx", "frames_per_beat", "n_beats").toPandas()
    at = s.pos_idx.to_numpy() / s.frames_per_beat.to_numpy()
    nearest = np.floor(at + 0.5)
    near = np.abs(at - nearest) <= WIDTH[kind]
    number = nearest % s.n_beats.to_numpy() + 1
    period = s.frames_per_beat.to_numpy() * frame_length

    def allowed(m: dict) -> np.ndarray | None:
        b = m["beat"]
        if kind == "downbeats" and b["beat_no"] != 1:
            return None
        ok = near & (number == b["beat_no"])
        if kind == "beats" and b["ibi"] is not None:
            ok &= np.abs(b["ibi"] / period - 1) <= TEMPO_WIDTH
        found = np.flatnonzero(ok)
        return found if len(found) else None

    rows = beat_intervals(beats, frame_length).where("beat_no is not null").groupBy("file_id", "frame").agg(F.min(F.struct("t", "beat_no", "ibi")).alias("beat"))
    joined = frames.select("file_id", "frame", _value(frames)).join(rows, ["file_id", "frame"], "left")
    return _paths(joined, model, columns, limit, ("beat",), allowed)


def native_scores(frames: DataFrame, trans: list[list[float]], init: list[float]) -> DataFrame:
    """file_id, scores: log chances of the best path to each state after the last frame, as a fold in the engine.

    For models of at most 16 states and series short enough for one row; ``lik`` as above.
    """
    n = len(init)
    if n > 16:
        raise ValueError("the fold is for at most 16 states")
    log = lambda v: F.lit(math.log(v) if v > 0 else float("-inf"))
    rows = frames.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("frame", "lik"))).alias("z"))

    def step(d: Column, x: Column) -> Column:
        new = []
        for j in range(n):
            came = [d[i] + log(trans[i][j]) for i in range(n)]
            new.append((F.greatest(*came) if n > 1 else came[0]) + F.when(x["lik"][j] > 0, F.log(x["lik"][j])).otherwise(F.lit(float("-inf"))))
        return F.array(*new)

    return rows.select("file_id", F.aggregate("z", F.array(*[log(v) for v in init]), step).alias("scores"))


#: Share of a beat within which states are at an annotated (down)beat, and of the tempo between the beats around it.
WIDTH, TEMPO_WIDTH = {"downbeats": 0.05, "beats": 0.1}, 0.4


def beat_intervals(beats: DataFrame, frame_length: float) -> DataFrame:
    """file_id, frame, t, beat_no, ibi: beats with the mean interval to the beats around them."""
    w = Window.partitionBy("file_id").orderBy("beat_idx")
    ibi = beats.withColumn("_p", F.col("t") - F.lag("t").over(w)).withColumn("_n", F.lead("t").over(w) - F.col("t"))
    mean = (F.coalesce("_p", "_n") + F.coalesce("_n", "_p")) / 2
    return ibi.select("file_id", (F.floor(F.col("t") / frame_length) + 1).alias("frame"), "t", F.col("beat_no").cast("long").alias("beat_no"), mean.alias("ibi"))


def constraint_states(beats: DataFrame, states: DataFrame, frame_length: float, kind: str = "beats", width: float | None = None, tempo_width: float = TEMPO_WIDTH) -> DataFrame:
    """file_id, frame, state that annotated beats (file_id, beat_idx, t, beat_no) allow.

    *downbeats*: within 0.05 beat of the start of the bar, at first beats. *beats*: within 0.1 beat
    of a beat's place and 40 % of the tempo between the beats around it. States are matched by the
    beat they are nearest to, so the join is on a key and not on a range. Decoding does not need this
    table of beats times states: see ``beat_constrained_paths``.
    """
    width = width if width is not None else WIDTH[kind]
    per_beat = F.col("pos_idx") / F.col("frames_per_beat")
    near = states.withColumn("_b", F.floor(per_beat + 0.5)).where(F.abs(per_beat - F.col("_b")) <= width)
    near = near.select("state", "pattern", (F.col("_b") % F.col("n_beats") + 1).cast("long").alias("beat_no"), (F.col("frames_per_beat") * frame_length).alias("period"))
    rows = beat_intervals(beats, frame_length)
    if kind == "downbeats":
        return rows.where("beat_no = 1").join(F.broadcast(near), "beat_no").select("file_id", "frame", "state")
    tempo = F.abs(F.col("ibi") / F.col("period") - 1) <= tempo_width
    return rows.join(F.broadcast(near), "beat_no").where(F.col("ibi").isNull() | tempo).select("file_id", "frame", "state")


def meter_states(allowed: DataFrame, states: DataFrame, patterns: DataFrame, meters: DataFrame) -> DataFrame:
    """The allowed states whose pattern has their file's meter (file_id, num, den)."""
    meter = states.select("state", "pattern").join(F.broadcast(patterns.select("pattern", "num", "den")), "pattern").drop("pattern")
    return allowed.join(F.broadcast(meter), "state").join(meters, ["file_id", "num", "den"], "left_semi").select("file_id", "frame", "state")
