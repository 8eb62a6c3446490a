"""Implausible beat times, beat numbers and meters, against what is normal for their file.

Beat times are forecast by a Kalman filter over (time, period), once forwards and once
backwards over each file. An innovation is standardised by its forecast deviation; one above the
threshold, and in fact more than a quarter of the period off, is withheld from the state. A beat
is stray when both filters withhold it (or the only one that has a forecast does): after a pause
or a lasting change of tempo only the filter coming from the other side is surprised. Beside it
runs the filter of a level that does not move; where the variance of its innovations since the
last advance vanishes against the period's, the beats are stuck.

Files are cut into chunks of beat indices with an overlap on either side that the filters need
to settle, so that one file may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Standardised innovation above which a beat is surprising, and the share of the local period beyond which it is off its place.
SURPRISE, OFF_PLACE = 4.0, 0.25
#: Share of the period within which two withheld beats agree with each other.
AGREE = 0.15
#: The level's innovations have vanished when their deviation is under this share of the period.
STUCK = 0.1
CHUNK, OVERLAP = 4096, 64

_R, _QX, _QP = 0.02**2, 0.01**2, 0.015**2


def _periods(t: np.ndarray, idx: np.ndarray, n_first: int = 9) -> np.ndarray:
    """A starting period for each row: the median advance a beat over its first beats, of those near the row's own median."""
    g, n = t.shape
    # Last finite predecessor of each cell.
    ok = np.isfinite(t)
    pos = np.where(ok, np.arange(n), -1)
    before = np.maximum.accumulate(np.concatenate([np.full((g, 1), -1), pos[:, :-1]], axis=1), axis=1) if n else pos
    rows = np.arange(g)[:, None]
    safe = np.maximum(before, 0)
    steps = idx - idx[rows, safe]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(ok & (before >= 0) & (steps > 0), (t - t[rows, safe]) / steps, np.nan)
    d[~(d > 1e-6)] = np.nan
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            mid = np.nanmedian(d, axis=1) if n else np.full(g, np.nan)
            near = np.where((d > 0.3 * mid[:, None]) & (d < 3 * mid[:, None]), d, np.nan)
            count = np.cumsum(np.isfinite(near), axis=1)
            first = np.nanmedian(np.where(count <= n_first, near, np.nan), axis=1)
    return np.where(np.isfinite(first), first, mid)


def _filter(t: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filters in lockstep, a series a row (times ascend with idx; NaN: no time).

    Returns whether each beat was withheld, whether it had a forecast, and whether the level stood still.
    """
    g, n = t.shape
    out, has, still = (np.zeros((g, n), bool) for _ in range(3))
    level, var, run = np.full(g, np.nan), np.zeros(g), np.zeros(g)
    p = _periods(t, idx)
    x, k = np.full(g, np.nan), np.zeros(g)
    pxx, pxp, ppp = np.zeros(g), np.zeros(g), np.zeros(g)
    h1t, h1k, h2t, h2k = (np.full(g, np.nan) for _ in range(4))

    def settle(m: np.ndarray, at: np.ndarray, ki: np.ndarray, period: np.ndarray) -> None:
        x[m], k[m], p[m] = at[m], ki[m], period[m]
        pp = p[m] ** 2
        pxx[m], pxp[m], ppp[m] = _R * pp, 0.0, 4 * _QP * pp
        h1t[m] = h2t[m] = np.nan

    for j in range(n):
        z, ki = t[:, j], idx[:, j]
        live = np.isfinite(z) & np.isfinite(p)
        fresh = live & ~np.isfinite(x)
        settle(fresh, z, ki, p)
        # Innovations of the level since it last moved, and their variance.
        u2 = (z - level) ** 2
        longer = np.where(np.isfinite(u2), (var * run + u2) / (run + 1), var)
        stays = np.isfinite(u2) & (longer <= (STUCK * p) ** 2)
        still[:, j] = stays
        var, run = np.where(np.isfinite(z), np.where(stays, longer, 0.0), var), np.where(np.isfinite(z), np.where(stays, run + 1, 0.0), run)
        level = np.where(np.isfinite(z), z, level)
        m = live & ~fresh
        if not m.any():
            continue
        with np.errstate(all="ignore"):
            steps = np.maximum(ki - k, 0)
            v = z - (x + steps * p)
            pp = p**2
            axx = pxx + 2 * steps * pxp + steps**2 * ppp + _QX * pp * steps
            axp = pxp + steps * ppp
            app = ppp + _QP * pp * steps
            s = axx + _R * pp
            off = m & (np.abs(v) > SURPRISE * np.sqrt(s)) & (np.abs(v) > OFF_PLACE * p)
            good = m & ~off
            gx, gp = axx / s, axp / s
            has[m, j] = True
            x[good] = (x + steps * p + gx * v)[good]
            p[good] = np.maximum(p + gp * v, 1e-9)[good]
            pxx[good], pxp[good], ppp[good] = ((1 - gx) * axx)[good], ((1 - gx) * axp)[good], (app - gp * axp)[good]
            k[good] = ki[good]
            h1t[good] = np.nan
            h2t[good] = np.nan
            # Withheld beats that agree with one another set the state anew: a pause, or another tempo.
            d1, d2 = (z - h1t) / (ki - h1k), (z - h2t) / (ki - h2k)
            d12 = (h1t - h2t) / (h1k - h2k)
            same = off & (np.abs(d1 - p) <= AGREE * p)
            over = off & ~same & (np.abs(d2 - p) <= AGREE * p)
            tempo = off & ~same & ~over & (d1 > 0.2 * p) & (d1 < 5 * p) & (np.abs(d1 - d12) <= AGREE * np.minimum(d1, d12))
            back = same | over | tempo
            held = off & ~back
            out[held, j] = True
            h2t[held], h2k[held] = h1t[held], h1k[held]
            h1t[held], h1k[held] = z[held], ki[held]
            settle(back, z, ki, np.where(tempo, (d1 + d12) / 2, p))
    return out, has, still


def stray_beats(group: np.ndarray, idx: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of beats sorted by (group, idx): stray (or stuck), and stuck.

    Beats without a finite, non-negative time are never stray, and forecast nothing.
    """
    n = len(t)
    stray, stuck = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return stray, stuck
    t = np.where(np.isfinite(t) & (t >= 0), t, np.nan)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):  # series of like length side by side
        hi = lo + 1
        limit = max(16, int(sizes[order[lo]] * 1.3))
        while hi < len(order) and sizes[order[hi]] <= limit and hi - lo < 4096:
            hi += 1
        rows = order[lo:hi]
        width = int(sizes[rows].max())
        cell = starts[rows][:, None] + np.arange(width)
        inside = np.arange(width) < sizes[rows][:, None]
        cell = np.where(inside, cell, 0)
        tt = np.where(inside, t[cell], np.nan)
        ii = idx[cell].astype(float)
        fwd, has_f, still = _filter(tt, ii)
        bwd, has_b, _ = _filter(-tt[:, ::-1], -ii[:, ::-1])
        bwd, has_b = bwd[:, ::-1], has_b[:, ::-1]
        bad = (fwd | ~has_f) & (bwd | ~has_b) & (fwd | bwd)
        stray[cell[inside]] = bad[inside]
        stuck[cell[inside]] = (bad & still)[inside]
        lo = hi
    return stray, stuck


_SCHEMA = "file_id long, beat_idx int, t double, reason string"


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file, chunk and beat; whole series only are handed on, the open one waits for the next batch."""
    rest: pa.Table | None = None
    schema = pa.schema([("file_id", pa.int64()), ("beat_idx", pa.int32()), ("t", pa.float64()), ("reason", pa.string())])

    def solve(tab: pa.Table) -> pa.RecordBatch:
        f, c, own = (tab.column(x).to_numpy() for x in ("file_id", "chunk", "own"))
        i = tab.column("beat_idx").to_numpy().astype(np.int64)
        t = tab.column("t").to_numpy()
        # Repeats of a beat count once.
        first = np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1]) | (i[1:] != i[:-1])] if len(f) else np.zeros(0, bool)
        f, c, own, i, t = f[first], c[first], own[first], i[first], t[first]
        group = np.cumsum(np.r_[0, (f[1:] != f[:-1]) | (c[1:] != c[:-1])]) if len(f) else f
        stray, stuck = stray_beats(group, i, t)
        negative = t < 0
        case = own & (negative | stray)
        why = np.where(negative, "negative", np.where(stuck, "stuck", "off_place"))[case]
        return pa.RecordBatch.from_arrays([pa.array(f[case]), pa.array(i[case].astype(np.int32)), pa.array(t[case]), pa.array(why, pa.string())], schema=schema)

    for b in batches:
        tab = pa.Table.from_batches([b])
        rest = pa.concat_tables([rest, tab]) if rest is not None else tab
        if rest.num_rows < 20_000:
            continue
        f, c = rest.column("file_id").to_numpy(), rest.column("chunk").to_numpy()
        change = np.flatnonzero((f[1:] != f[:-1]) | (c[1:] != c[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield solve(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield solve(rest)


def implausible_times(beats: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Beats whose time is negative, stuck or off its place: file_id, beat_idx, t, reason.

    Null times are no case and are skipped over; rows without file or index are left out;
    repeated rows count once. Files of one or two beats have no forecast, so only their
    negative times are cases. NaN and infinite times are read as null.
    """
    i = F.col("beat_idx").cast("long")
    c = F.floor(i / chunk)
    home = F.array(c)
    left = F.when(F.pmod(i, F.lit(chunk)) < overlap, F.array(c - 1)).otherwise(F.array().cast("array<bigint>"))
    right = F.when(F.pmod(i, F.lit(chunk)) >= chunk - overlap, F.array(c + 1)).otherwise(F.array().cast("array<bigint>"))
    rows = (
        beats.where("file_id is not null and beat_idx is not null")
        .select(F.col("file_id").cast("long").alias("file_id"), F.col("beat_idx").cast("int").alias("beat_idx"), F.col("t").cast("double").alias("t"), c.alias("home"), F.explode(F.concat(home, left, right)).alias("chunk"))
        .select("file_id", "chunk", "beat_idx", "t", (F.col("home") == F.col("chunk")).alias("own"))
    )
    return rows.repartition("file_id", "chunk").sortWithinPartitions("file_id", "chunk", "beat_idx", F.col("t").asc_nulls_last()).mapInArrow(_kernel, _SCHEMA)


def implausible_numbers(beats: DataFrame) -> DataFrame:
    """Beats whose number is below 1 or more than twice the highest usual one: file_id, beat_idx, beat_no, usual, reason.

    A number is usual in a file when it is 1 or its predecessor occurs in the file as well.
    """
    rows = beats.where("file_id is not null and beat_idx is not null and beat_no is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("beat_idx").cast("int").alias("beat_idx"), F.col("beat_no").cast("long").alias("beat_no"))
    hist = rows.select("file_id", "beat_no").distinct()
    per_file = Window.partitionBy("file_id")
    usual = (F.col("beat_no") == 1) | (F.lag("beat_no").over(per_file.orderBy("beat_no")) == F.col("beat_no") - 1)
    marked = hist.withColumn("is_usual", F.coalesce(usual, F.lit(False)) & (F.col("beat_no") >= 1))
    bad = (
        marked.withColumn("usual", F.max(F.when(F.col("is_usual"), F.col("beat_no"))).over(per_file))
        .where((F.col("beat_no") < 1) | (F.col("beat_no") > 2 * F.col("usual")))
        .select("file_id", "beat_no", "usual", F.when(F.col("beat_no") < 1, "number_below_1").otherwise("number_too_high").alias("reason"))
    )
    return rows.join(bad, ["file_id", "beat_no"]).select("file_id", "beat_idx", "beat_no", "usual", "reason")


def implausible_meters(meters: DataFrame) -> DataFrame:
    """Sections with an implausible meter: file_id, section_no, num, den, reason.

    Reasons: *num_range* (outside 1-32), *den* (given and no power of two up to 32) and, in files
    of three or more sections, *num_unlike* (at least 3 times or less than a third of the most
    frequent number; where several are equally frequent, of each of them). Nulls are no case,
    repeated rows count once.
    """
    rows = meters.where("file_id is not null and section_no is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("section_no").cast("int").alias("section_no"), F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den")).distinct()
    hist = rows.groupBy("file_id", "num").agg(F.count_distinct("section_no").alias("n"))
    per_file = Window.partitionBy("file_id")
    normal = (
        hist.withColumn("sections", F.sum("n").over(per_file))
        .withColumn("top", F.max(F.when(F.col("num").isNotNull(), F.col("n"))).over(per_file))
        .where("num is not null and n = top")
        .groupBy("file_id")
        .agg(F.max("sections").alias("sections"), F.min("num").alias("mode_lo"), F.max("num").alias("mode_hi"))
    )
    unlike = (F.col("sections") >= 3) & ((F.col("num") >= 3 * F.col("mode_hi")) | (F.col("num") * 3 < F.col("mode_lo")))
    reason = (
        F.when((F.col("num") < 1) | (F.col("num") > 32), "num_range")
        .when(F.col("den").isNotNull() & ~F.col("den").isin(1, 2, 4, 8, 16, 32), "den")
        .when(unlike, "num_unlike")
    )
    return rows.join(normal, "file_id", "left").withColumn("reason", reason).where("reason is not null").select("file_id", "section_no", "num", "den", "reason")


def implausible(beats: DataFrame, meters: DataFrame) -> DataFrame:
    """All cases, each once: ann_type (beat or meter), file_id, item_no, reason (of several, the first by name)."""
    parts = [
        implausible_times(beats).select(F.lit("beat").alias("ann_type"), "file_id", F.col("beat_idx").cast("long").alias("item_no"), "reason"),
        implausible_numbers(beats).select(F.lit("beat").alias("ann_type"), "file_id", F.col("beat_idx").cast("long").alias("item_no"), "reason"),
        implausible_meters(meters).select(F.lit("meter").alias("ann_type"), "file_id", F.col("section_no").cast("long").alias("item_no"), "reason"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("ann_type", "file_id", "item_no").agg(F.min("reason").alias("reason"))
