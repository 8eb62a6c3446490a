"""Queries of the signal features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions import signal
from metrolith.functions.series import event_series
from metrolith.queries.dealt import table

BINS, BANDS = 64, 12


def _ser(spark: SparkSession, d: str) -> DataFrame:
    return event_series(table(spark, d, "events")).select("file_id", "frame", "x")


def _out(df: DataFrame) -> DataFrame:
    return df.select("file_id", "frame", F.round("y", 6).alias("y"))


def frame_rate_down_max(spark, d):
    return _out(signal.change_frame_rate(_ser(spark, d), 4.0, 1.0))


def frame_rate_up_interp(spark, d):
    return _out(signal.change_frame_rate(_ser(spark, d), 1.0, 2.5))


def moving_average_trailing(spark, d):
    return _out(signal.moving_average(_ser(spark, d), 10))


def moving_average_halfmean(spark, d):
    return _out(signal.moving_average(_ser(spark, d), 10, half=True))


def mean_removed_onset(spark, d):
    return _out(signal.mean_removed(_ser(spark, d), 10))


def norm_zero_mean_var(spark, d):
    return _out(signal.normalise(_ser(spark, d), "var"))


def norm_zscore(spark, d):
    return _out(signal.normalise(_ser(spark, d), "zscore"))


def norm_minmax(spark, d):
    return _out(signal.normalise(_ser(spark, d), "max"))


def _spectrum(spark, d):
    """Embeddings as the spectra of 20 files (labels may repeat, so vectors are dealt by id)."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 20).alias("file_id"), (F.floor(F.col("vec_id") / 20) + 1).alias("frame"), F.posexplode("embedding")).select("file_id", "frame", (F.col("pos") + 1).alias("bin"), F.abs(F.col("col").cast("double")).alias("mag"))


def log_band_flux(spark, d):
    flux = signal.spectral_flux(_spectrum(spark, d).withColumnRenamed("bin", "band"))
    return flux.select("file_id", "frame", F.round("flux", 6).alias("flux"))


def _bank(spark):
    return spark.createDataFrame(signal.triangular_filterbank(BINS, BANDS), "bin int, band int, weight double")


def filterbank_project(spark, d):
    return signal.project_bands(_spectrum(spark, d), _bank(spark)).select("file_id", "frame", "band", F.round("mag", 6).alias("mag"))


def band_selected_flux(spark, d):
    bank = signal.triangular_filterbank(BINS, BANDS)
    bands = signal.select_bands(signal.project_bands(_spectrum(spark, d), _bank(spark)), bank, 0.0, 10.0, 128.0, 128)
    return signal.spectral_flux(bands).select("file_id", "frame", F.round("flux", 6).alias("flux"))


def dft_magnitude(spark, d):
    return signal.dft_frames(_ser(spark, d), 16, 8, 8).select("file_id", "frame", "bin", F.round("mag", 5).alias("mag"))


def feature_low_band(spark, d):
    return _out(signal.band_feature(_spectrum(spark, d), "lo230_superflux.mvavg", 1000.0, 2 * BINS, BANDS))


def feature_high_band(spark, d):
    """The upper band, normalised, at half the frame rate."""
    return _out(signal.band_feature(_spectrum(spark, d), "hi250_superflux.mvavg.normZ", 1000.0, 2 * BINS, BANDS, 2.0, 1.0))


def frame_rate_same(spark, d):
    """Rates that differ by no more than a thousandth are the same."""
    return _out(signal.change_frame_rate(_ser(spark, d), 50.0, 50.0009))


def feature_dispatch(spark, d):
    return _out(signal.feature(_ser(spark, d), "lo230_superflux.mvavg.normZ"))


SER = "ser AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value AS x, event_type, ts, event_id FROM events)"
_SIZE = "sz AS (SELECT file_id, count(*) AS n, avg(x) AS m FROM ser GROUP BY file_id)"


def _mv(w: int, factor: str) -> str:
    return f"""mv AS (SELECT s.file_id, s.frame, s.x, {factor} * CASE WHEN s.frame < {w} THEN avg(s.x) FILTER (s.frame < {w}) OVER (PARTITION BY s.file_id)
      ELSE avg(s.x) OVER (PARTITION BY s.file_id ORDER BY s.frame ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS y FROM ser s JOIN sz USING (file_id) WHERE sz.n >= {w})"""


_SPEC = """spec AS (SELECT vec_id % 20 AS file_id, CAST(floor(vec_id / 20) AS BIGINT) + 1 AS frame, generate_subscripts(embedding, 1) AS bin, abs(CAST(unnest(embedding) AS DOUBLE)) AS mag FROM embeddings)"""


def _flux(src: str, band: str) -> str:
    return f"""lv AS (SELECT file_id, frame, {band} AS band, log10(10221.0::DOUBLE * mag + 1.0::DOUBLE) AS s FROM {src}),
df AS (SELECT file_id, frame, greatest(s - coalesce(lag(s) OVER (PARTITION BY file_id, band ORDER BY frame), s), 0.0::DOUBLE) AS dd FROM lv)
SELECT file_id, frame, round(sum(dd), 6) AS flux FROM df GROUP BY file_id, frame"""


def _values(rows: list[tuple[int, int, float]]) -> str:
    return "fb(bin, band, weight) AS (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in rows) + ")"


_FB = _values(signal.triangular_filterbank(BINS, BANDS))
_PROJ = "pr AS (SELECT file_id, frame, CAST(band AS INTEGER) AS band, sum(mag * weight) AS mag FROM spec JOIN fb USING (bin) GROUP BY ALL)"


def _kept() -> str:
    bank = signal.triangular_filterbank(BINS, BANDS)
    best: dict[int, tuple[float, int]] = {}
    for b, band, w in bank:
        if band not in best or w > best[band][0]:
            best[band] = (w, b)
    return ", ".join(str(k) for k, (_, b) in best.items() if 2 <= b <= 10)


def _band(lo: int, hi: int) -> str:
    """rm(file_id, frame, y): flux of the bands whose heaviest bin is between two, less its moving average."""
    flux = _flux("ps", "band")
    return f"""{_SPEC}, {_FB}, {_PROJ}, pk AS (SELECT band, min(bin) AS bin FROM (SELECT *, max(weight) OVER (PARTITION BY band) AS m FROM fb) WHERE weight = m GROUP BY band),
ps AS (SELECT pr.* FROM pr JOIN pk USING (band) WHERE pk.bin BETWEEN {lo} AND {hi}), {flux[: flux.rindex("SELECT file_id, frame, round")]}, ser AS (SELECT file_id, frame, sum(dd) AS x FROM df GROUP BY ALL), {_SIZE}, {_mv(100, "1.0::DOUBLE")},
rm AS (SELECT s.file_id, s.frame, s.x - coalesce(lag(mv.y) OVER (PARTITION BY s.file_id ORDER BY s.frame), 0.0::DOUBLE) AS y FROM ser s LEFT JOIN mv ON mv.file_id = s.file_id AND mv.frame = s.frame)"""


ORACLES = {
    "feature_low_band": f"WITH {_band(2, 29)} SELECT file_id, frame, round(y, 6) AS y FROM rm",
    "feature_high_band": f"""WITH {_band(32, 64)}, z AS (SELECT file_id, frame, (y - avg(y) OVER w) / nullif(var_samp(y) OVER w, 0) AS x FROM rm WINDOW w AS (PARTITION BY file_id)),
n AS (SELECT file_id, CAST(floor(count(*) / 2.0::DOUBLE + 0.5) AS BIGINT) AS n, avg(x) AS y FROM z GROUP BY 1), i AS (SELECT n.file_id, unnest(generate_series(1, n.n - 1)) AS i FROM n)
SELECT i.file_id, i AS frame, round(max(x), 6) AS y FROM i JOIN z ON z.file_id = i.file_id AND (z.frame - 1) / 2.0::DOUBLE > i - 1 - 0.001::DOUBLE AND (z.frame - 1) / 2.0::DOUBLE < i + 0.001::DOUBLE GROUP BY ALL
UNION ALL SELECT file_id, n, round(y, 6) FROM n""",
    "frame_rate_same": f"WITH {SER} SELECT file_id, frame, round(x, 6) AS y FROM ser",
    "frame_rate_down_max": f"""WITH {SER}, {_SIZE}, tg AS (SELECT file_id, CAST(floor(n / 4.0::DOUBLE * 1.0::DOUBLE + 0.5) AS BIGINT) AS last, m FROM sz),
g AS (SELECT file_id, last, unnest(generate_series(1, last - 1)) AS i FROM tg WHERE last > 1)
SELECT g.file_id, g.i AS frame, round(max(x), 6) AS y FROM g JOIN ser s ON s.file_id = g.file_id AND (s.frame - 1) / 4.0::DOUBLE - (g.i - 1) > -0.001 AND (s.frame - 1) / 4.0::DOUBLE - g.i < 0.001 GROUP BY ALL
UNION ALL SELECT file_id, last AS frame, round(m, 6) AS y FROM tg WHERE last >= 1""",
    "frame_rate_up_interp": f"""WITH {SER}, {_SIZE}, tg AS (SELECT file_id, n, CAST(floor(n / 1.0::DOUBLE * 2.5::DOUBLE + 0.5) AS BIGINT) AS last, m FROM sz),
g AS (SELECT file_id, n, unnest(generate_series(1, last - 1)) AS i FROM tg WHERE last > 1),
p AS (SELECT file_id, i, (i - 1) / 2.5::DOUBLE AS u, CAST(floor((i - 1) / 2.5::DOUBLE + 1e-9::DOUBLE) AS BIGINT) + 1 AS f, n FROM g)
SELECT p.file_id, p.i AS frame, round(CASE WHEN p.f = p.n THEN a.x ELSE a.x + (b.x - a.x) * (p.u - (p.f - 1)) END, 6) AS y FROM p JOIN ser a ON a.file_id = p.file_id AND a.frame = p.f LEFT JOIN ser b ON b.file_id = p.file_id AND b.frame = p.f + 1
WHERE p.u <= p.n - 1 + 1e-9::DOUBLE UNION ALL SELECT file_id, last AS frame, round(m, 6) AS y FROM tg""",
    "moving_average_trailing": f"WITH {SER}, {_SIZE}, {_mv(10, '1.0::DOUBLE')} SELECT file_id, frame, round(y, 6) AS y FROM mv",
    "moving_average_halfmean": f"WITH {SER}, {_SIZE}, {_mv(10, '0.5::DOUBLE')} SELECT file_id, frame, round(y, 6) AS y FROM mv",
    "mean_removed_onset": f"WITH {SER}, {_SIZE}, {_mv(10, '1.0::DOUBLE')} SELECT s.file_id, s.frame, round(s.x - coalesce(lag(mv.y) OVER (PARTITION BY s.file_id ORDER BY s.frame), 0.0::DOUBLE), 6) AS y FROM ser s LEFT JOIN mv ON mv.file_id = s.file_id AND mv.frame = s.frame",
    "norm_zero_mean_var": f"WITH {SER} SELECT file_id, frame, round((x - avg(x) OVER w) / nullif(var_samp(x) OVER w, 0), 6) AS y FROM ser WINDOW w AS (PARTITION BY file_id)",
    "norm_zscore": f"WITH {SER} SELECT file_id, frame, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 6) AS y FROM ser WINDOW w AS (PARTITION BY file_id)",
    "norm_minmax": f"WITH {SER} SELECT file_id, frame, round((x - min(x) OVER w + 0.001::DOUBLE) / (max(x) OVER w - min(x) OVER w + 0.001::DOUBLE), 6) AS y FROM ser WINDOW w AS (PARTITION BY file_id)",
    "log_band_flux": f"WITH {_SPEC}, {_flux('spec', 'bin')}",
    "filterbank_project": f"WITH {_SPEC}, {_FB}, {_PROJ} SELECT file_id, frame, band, round(mag, 6) AS mag FROM pr",
    "band_selected_flux": f"WITH {_SPEC}, {_FB}, {_PROJ}, ps AS (SELECT * FROM pr WHERE band IN ({_kept()})), {_flux('ps', 'band')}",
    "dft_magnitude": f"""WITH {SER}, {_SIZE}, g AS (SELECT file_id, unnest(generate_series(1, CAST(floor(n / 8) AS BIGINT))) AS f FROM sz WHERE n >= 8),
k AS (SELECT g.file_id, g.f, s.x, s.frame - 1 + 4 - (g.f - 1) * 8 AS k FROM g JOIN ser s ON s.file_id = g.file_id AND s.frame - 1 + 4 - (g.f - 1) * 8 BETWEEN 0 AND 14),
b AS (SELECT *, unnest(generate_series(1, 8)) AS bin FROM k),
r AS (SELECT file_id, f AS frame, CAST(bin AS INTEGER) AS bin, sum(x * 0.5::DOUBLE * (1 - cos(2 * pi() * k / 14)) * cos(2 * pi() * (bin - 1) * k / 16)) AS re, sum(x * 0.5::DOUBLE * (1 - cos(2 * pi() * k / 14)) * sin(2 * pi() * (bin - 1) * k / 16)) AS im FROM b GROUP BY ALL)
SELECT file_id, frame, bin, round(sqrt(re * re + im * im), 5) AS mag FROM r""",
    "feature_dispatch": f"""WITH {SER}, {_SIZE}, {_mv(100, '1.0::DOUBLE')}, rm AS (SELECT s.file_id, s.frame, s.x - coalesce(lag(mv.y) OVER (PARTITION BY s.file_id ORDER BY s.frame), 0.0::DOUBLE) AS y FROM ser s LEFT JOIN mv ON mv.file_id = s.file_id AND mv.frame = s.frame)
SELECT file_id, frame, round((y - avg(y) OVER w) / nullif(var_samp(y) OVER w, 0), 6) AS y FROM rm WINDOW w AS (PARTITION BY file_id)""",
}

QUERIES = {
    f.__name__: f
    for f in (frame_rate_down_max, frame_rate_up_interp, moving_average_trailing, moving_average_halfmean, mean_removed_onset, norm_zero_mean_var, norm_zscore, norm_minmax, log_band_flux, filterbank_project, band_selected_flux, dft_magnitude, feature_low_band, feature_high_band, frame_rate_same, feature_dispatch)
}
