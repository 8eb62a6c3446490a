"""Signal features as projections and framed windows over (file_id, frame, x)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions.series import blocked

#: Scale of the logarithmic compression.
LOG_LAMBDA = 10221.0
#: Window of the moving average that is subtracted from an onset function.
MEAN_WINDOW = 100
#: Names of features and their frequency band (Hz) or null for a column transform.
FEATURES = {"lo230_superflux": (0.0, 230.0), "hi250_superflux": (250.0, 44100.0), "superflux": (0.0, 44100.0), "sprflx": (0.0, 44100.0)}


def moving_average(df: DataFrame, w: int, half: bool = False, out: str = "y") -> DataFrame:
    """Trailing mean of ``w`` values; the first w - 1 frames all get the mean of the first w - 1 values.

    ``half`` halves it. Series shorter than the window give no rows.
    """
    size = df.groupBy("file_id").agg(F.count("*").alias("_n"))
    head = df.where(F.col("frame") < w).groupBy("file_id").agg(F.avg("x").alias("_head"))
    rows, own = blocked(df, w - 1)
    win = Window.partitionBy("file_id", "_block").orderBy("frame").rowsBetween(-(w - 1), 0)
    mean = rows.withColumn("_m", F.avg("x").over(win)).where(own).drop("_block", "_home")
    value = F.when(F.col("frame") < w, F.col("_head")).otherwise(F.col("_m"))
    return mean.join(size.where(F.col("_n") >= w).join(head, "file_id", "left"), "file_id").withColumn(out, value * (0.5 if half else 1.0)).drop("_m", "_n", "_head")


def mean_removed(df: DataFrame, w: int = MEAN_WINDOW, out: str = "y") -> DataFrame:
    """x less the moving average of the frame before (nothing at the first). Series shorter than the window stay as they are."""
    avg = moving_average(df, w, out="_avg").select("file_id", (F.col("frame") + 1).alias("frame"), "_avg")
    return df.join(avg, ["file_id", "frame"], "left").withColumn(out, F.col("x") - F.coalesce("_avg", F.lit(0.0))).drop("_avg")


def normalise(df: DataFrame, mode: str, out: str = "y") -> DataFrame:
    """Per file: *var* (x - mean) / variance, *zscore* (x - mean) / deviation, *max* (x - min + 0.001) / max of that."""
    s = df.groupBy("file_id").agg(F.avg("x").alias("_m"), F.var_samp("x").alias("_v"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    x = F.col("x")
    value = {
        "var": (x - F.col("_m")) / F.nullif(F.col("_v"), F.lit(0.0)),
        "zscore": (x - F.col("_m")) / F.nullif(F.sqrt("_v"), F.lit(0.0)),
        "max": (x - F.col("_lo") + 0.001) / (F.col("_hi") - F.col("_lo") + 0.001),
    }[mode]
    return df.join(s, "file_id").withColumn(out, value).drop("_m", "_v", "_lo", "_hi")


def change_frame_rate(df: DataFrame, source: float, target: float) -> DataFrame:
    """file_id, frame, y at another rate: the maximum over each target frame (closed by 1 ms on both sides) when
    going down, linear interpolation when going up; the last frame is the mean of all values. Equal rates change nothing.
    """
    if abs(source - target) <= 0.001:
        return df.select("file_id", "frame", F.col("x").alias("y"))
    n_target = F.floor(F.col("_n") / F.lit(source) * F.lit(target) + 0.5)
    whole = df.groupBy("file_id").agg(F.count("*").alias("_n"), F.avg("x").alias("y")).select("file_id", n_target.cast("long").alias("_last"), "y")
    t = (F.col("frame") - 1) / F.lit(source)
    t2 = lambda i: (i - 1) / F.lit(target)
    i = F.col("_i")
    if source > target:
        at = F.floor(t * F.lit(target)) + 1
        near = df.withColumn("_i", F.explode(F.array(at - 1, at, at + 1))).where((t - t2(i) > -0.001) & (t - t2(i + 1) < 0.001) & (i >= 1))
        inner = near.groupBy("file_id", F.col("_i").alias("frame")).agg(F.max("x").alias("y"))
    else:
        rows, own = blocked(df, 0, 1)
        w = Window.partitionBy("file_id", "_block").orderBy("frame")
        pair = rows.withColumn("_next", F.lead("x").over(w)).where(own)
        first, last = F.ceil(t * F.lit(target) - 1e-9) + 1, F.ceil((F.col("frame") / F.lit(source)) * F.lit(target) - 1e-9)
        inner = (
            pair.withColumn("_i", F.explode(F.when(F.col("_next").isNull(), F.array(first)).when(last >= first, F.sequence(first, last))))
            .withColumn("_u", (t2(i) - t) * F.lit(source))
            .where(F.col("_next").isNotNull() | (F.abs("_u") < 1e-9))
            .select("file_id", i.alias("frame"), F.coalesce(F.col("x") + (F.col("_next") - F.col("x")) * F.col("_u"), F.col("x")).alias("y"))
        )
    kept = inner.join(whole.select("file_id", "_last"), "file_id").where("frame < _last").select("file_id", F.col("frame").cast("long").alias("frame"), "y")
    return kept.unionByName(whole.where("_last >= 1").select("file_id", F.col("_last").alias("frame"), "y"))


def log_compress(mag: Column, lam: float = LOG_LAMBDA) -> Column:
    return F.log10(mag * lam + 1.0)


def spectral_flux(bands: DataFrame, lam: float = LOG_LAMBDA) -> DataFrame:
    """file_id, frame, flux of (file_id, frame, band, mag): rises of the log magnitudes over the frame before, summed over the bands."""
    level = bands.withColumn("_s", log_compress(F.col("mag"), lam))
    before = level.select("file_id", "band", (F.col("frame") + 1).alias("frame"), F.col("_s").alias("_b"))
    rise = level.join(before, ["file_id", "band", "frame"], "left").withColumn("_d", F.greatest(F.col("_s") - F.coalesce("_b", "_s"), F.lit(0.0)))
    return rise.groupBy("file_id", "frame").agg(F.sum("_d").alias("flux"))


def triangular_filterbank(n_bins: int, n_bands: int) -> list[tuple[int, int, float]]:
    """(bin, band, weight), bins from 1: overlapping triangles on a logarithmic axis, each of weights that sum to 1."""
    edges = [2.0 ** (math.log2(n_bins) * k / (n_bands + 1)) for k in range(n_bands + 2)]
    out = []
    for band in range(1, n_bands + 1):
        lo, mid, hi = edges[band - 1], edges[band], edges[band + 1]
        w = {b: max(0.0, min((b - lo) / (mid - lo), (hi - b) / (hi - mid))) for b in range(1, n_bins + 1)}
        total = sum(w.values())
        if total == 0:
            w, total = {max(1, round(mid)): 1.0}, 1.0
        out += [(b, band, v / total) for b, v in w.items() if v > 0]
    return out


def project_bands(spectrum: DataFrame, bank: DataFrame) -> DataFrame:
    """file_id, frame, band, mag of (file_id, frame, bin, mag) by a filterbank (bin, band, weight), whose size does not depend on the data."""
    return spectrum.join(F.broadcast(bank), "bin").groupBy("file_id", "frame", "band").agg(F.sum(F.col("mag") * F.col("weight")).alias("mag"))


def select_bands(bands: DataFrame, bank: list[tuple[int, int, float]], min_f: float, max_f: float, rate: float, n_fft: int) -> DataFrame:
    """Bands whose heaviest bin lies between the bins nearest to two frequencies (the second bin at least)."""
    peak: dict[int, tuple[float, int]] = {}
    for b, band, w in bank:
        peak[band] = max(peak.get(band, (0.0, 0)), (w, -b))
    lo, hi = max(2, round(min_f * n_fft / rate)), max(2, round(max_f * n_fft / rate))
    keep = [band for band, (_, b) in peak.items() if lo <= -b <= hi]
    return bands.where(F.col("band").isin(keep))


def odd_window(size: int) -> int:
    return size - 1 if size % 2 == 0 else size


def hann(size: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / max(size - 1, 1)))


def stft(x: np.ndarray, size: int, hop: int, n_fft: int, normed: bool = False, online: bool = False) -> np.ndarray:
    """Magnitudes, a frame a row and n_fft / 2 bins from 0. Even windows lose a sample; padding is on both sides, or only before when online."""
    size = odd_window(size)
    w = hann(size)
    if normed:
        w = w * 2 / w.sum()
    side = math.floor((size - hop) / 2 + 0.5)
    left, right = (size - hop, 0) if online else (side, side)
    n = len(x) // hop
    padded = np.concatenate([np.zeros(max(left, 0)), x, np.zeros(max(right, 0) + size)])
    frames = padded[np.arange(n)[:, None] * hop + np.arange(size)] * w
    return np.abs(np.fft.rfft(frames, n_fft, axis=1))[:, : n_fft // 2]


def edge_stft(x: np.ndarray, size: int, hop: int, n_fft: int) -> np.ndarray:
    """Magnitudes with windows that grow at the start and shrink at the end instead of padding."""
    size = odd_window(size)
    half = size // 2
    out = []
    for b in range(len(x) // hop):
        mid = b * hop
        reach = min(half, mid, len(x) - 1 - mid)
        w = hann(2 * reach + 1) if reach else np.ones(1)
        out.append(np.abs(np.fft.rfft(x[mid - reach : mid + reach + 1] * w, n_fft))[: n_fft // 2])
    return np.array(out).reshape(-1, n_fft // 2)


def spectrogram(signals: DataFrame, size: int, hop: int, n_fft: int, normed: bool = False, online: bool = False) -> DataFrame:
    """file_id, frame, bin, mag of signals (file_id, samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, x in zip(b.column("file_id").to_pylist(), b.column("samples")):
                m = stft(np.asarray(x.values.to_numpy(zero_copy_only=False), float), size, hop, n_fft, normed, online)
                frames, bins = np.divmod(np.arange(m.size), max(m.shape[1], 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, f, np.int64)), pa.array(frames + 1), pa.array((bins + 1).astype(np.int32)), pa.array(m.ravel())], names=["file_id", "frame", "bin", "mag"])

    return signals.select(F.col("file_id").cast("long").alias("file_id"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "file_id long, frame long, bin int, mag double")


def dft_frames(df: DataFrame, size: int, hop: int, n_bins: int) -> DataFrame:
    """file_id, frame, bin, mag of (file_id, frame, x): the magnitudes of ``stft`` (with n_fft = 2 n_bins) as one aggregation, without Python.

    Each sample goes to the frames whose window holds it; sums of cosines and sines are partly
    aggregated before the shuffle.
    """
    size = odd_window(size)
    side = math.floor((size - hop) / 2 + 0.5)
    pos = F.col("frame") - 1 + side
    first = F.greatest(F.lit(0), F.ceil((pos - (size - 1)) / hop)).cast("long")
    last = F.floor(pos / hop).cast("long")
    blocks = df.groupBy("file_id").agg(F.floor(F.max("frame") / hop).alias("_n"))
    parts = df.withColumn("_f", F.explode(F.when(last >= first, F.sequence(first, last)))).withColumn("_k", pos - F.col("_f") * hop).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n_bins))))
    win = 0.5 * (1 - F.cos(F.lit(2 * math.pi) * F.col("_k") / max(size - 1, 1)))
    angle = F.lit(2 * math.pi) * (F.col("bin") - 1) * F.col("_k") / (2 * n_bins)
    agg = parts.groupBy("file_id", (F.col("_f") + 1).alias("frame"), "bin").agg(F.sum(F.col("x") * win * F.cos(angle)).alias("_re"), F.sum(F.col("x") * win * F.sin(angle)).alias("_im"))
    return agg.join(blocks, "file_id").where("frame <= _n").select("file_id", "frame", "bin", F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("mag"))


def resample(x: np.ndarray, source: int, target: int = 44100) -> np.ndarray:
    """A signal at another rate: a polyphase low-pass filter (sinc under a Kaiser window, ten zero crossings on both sides) at the lower of the rates."""
    if source == target or not len(x):
        return x
    up, down = target // math.gcd(source, target), source // math.gcd(source, target)
    widest = max(up, down)
    half = 10 * widest
    m = np.arange(-half, half + 1)
    h = np.sinc(m / widest) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = -(-len(x) * up // down)
    # Output k lies at k * down of the raised rate, input i at i * up; each output has the inputs within half of it.
    taps = 2 * half // up + 1
    out = np.zeros(n)
    for lo in range(0, n, 1 << 16):
        at = np.arange(lo, min(lo + (1 << 16), n)) * down
        first = -((half - at) // up)
        for j in range(taps):
            i = first + j
            k = at - i * up + half
            ok = (i >= 0) & (i < len(x)) & (k >= 0) & (k <= 2 * half)
            out[lo : lo + len(at)][ok] += x[i[ok]] * h[k[ok]]
    return out


def band_feature(spectrum: DataFrame, name: str, rate: float, n_fft: int, n_bands: int, source: float | None = None, target: float | None = None) -> DataFrame:
    """file_id, frame, y of a spectrum (file_id, frame, bin, mag): the flux of the log magnitudes of the bands between the name's
    frequencies, the transforms that the name asks for, and another frame rate where one is given.
    """
    base = name.lower().split(".")[0]
    if base not in FEATURES:
        raise ValueError(f"unknown feature {base}")
    bank = triangular_filterbank(n_fft // 2, n_bands)
    table = spectrum.sparkSession.createDataFrame(bank, "bin int, band int, weight double")
    bands = select_bands(project_bands(spectrum, table), bank, *FEATURES[base], rate, n_fft)
    out = feature(spectral_flux(bands).withColumnRenamed("flux", "x"), name)
    return out if target is None else change_frame_rate(out.withColumnRenamed("y", "x"), source, target)


def feature(df: DataFrame, name: str) -> DataFrame:
    """file_id, frame, y: the column transforms that a feature's name asks for (``.mvavg``, ``.normZ``), in that order."""
    parts = name.lower().split(".")
    if parts[0] not in FEATURES:
        raise ValueError(f"unknown feature {parts[0]}")
    out = df.select("file_id", "frame", F.col("x").cast("double").alias("x"))
    for p in parts[1:]:
        if p == "mvavg":
            out = mean_removed(out).select("file_id", "frame", F.col("y").alias("x"))
        elif p == "normz":
            out = normalise(out, "var").select("file_id", "frame", F.col("y").alias("x"))
        else:
            raise ValueError(f"unknown transform {p}")
    return out.withColumnRenamed("x", "y")
