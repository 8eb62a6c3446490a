"""Queries of beats, bars, cells and tempo ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.functions.series import event_series
from metrolith.operators import bars, patterns, tempo
from metrolith.queries.dealt import table
from metrolith.queries.signal import SER
from metrolith.sources import files as src

FRAME, DIV = 0.25, 8


def _bts(spark, d):
    """Events as beats: numbers in bars of 3 or 4, some missing, times in days."""
    m = F.lit(3) + F.col("file_id") % 2
    s = event_series(table(spark, d, "events"))
    day = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400e6)
    return bars.dense_beats(s.where("not (event_type = 'error' and frame % 7 = 0)").select("file_id", F.col("frame").alias("beat_idx"), day.alias("t"), ((F.col("frame") - 1) % m + 1).alias("beat_no")))


def _frames(spark, d):
    """Mean value of every quarter of a day in which a user did anything, as two features."""
    day = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400e6)
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("file_id"), (F.floor(day / FRAME) + 1).alias("frame")).agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
    return e.select("file_id", "frame", F.explode(F.array(F.struct(F.lit(1).alias("dim"), F.col("v").alias("value")), F.struct(F.lit(2).alias("dim"), F.col("n").alias("value")))).alias("x")).select("file_id", "frame", "x.dim", "x.value")


def _cells(spark, d):
    b = _bts(spark, d)
    full = bars.full_bars(b)
    grid = full.select("file_id", "meter").distinct().select("file_id", bars.grid_size(F.col("meter"), F.lit(4), DIV).alias("cells"))
    return bars.cell_means(bars.bar_cells(b, full, _frames(spark, d), grid, FRAME)), grid


def predominant_meter(spark, d):
    return bars.predominant_meter(_bts(spark, d))


def predominant_meter_beats(spark, d):
    return bars.predominant_meter(bars.dense_beats(table(spark, d, "beats")))


def full_bars(spark, d):
    return bars.full_bars(_bts(spark, d))


def full_bars_beats(spark, d):
    return bars.full_bars(bars.dense_beats(table(spark, d, "beats")))


def bar_beats(spark, d):
    b = _bts(spark, d)
    return bars.bar_beats(b, bars.full_bars(b)).select("file_id", "beat_idx", "in_bar")


def tempo_range_trimmed(spark, d):
    t = tempo.tempo_range(_bts(spark, d), 5.0)
    return t.select("file_id", F.round("min_bpm", 6).alias("min_bpm"), F.round("max_bpm", 6).alias("max_bpm"))


def same_tempo_per_meter(spark, d):
    t = tempo.restrict(tempo.tempo_range(_bts(spark, d), 5.0), 20.0, 5000.0).withColumn("num", F.lit(3) + F.col("file_id") % 2)
    return tempo.same_per_meter(t, ("num",)).select("file_id", "num", F.round("min_bpm", 6).alias("min_bpm"), F.round("max_bpm", 6).alias("max_bpm"))


def bar_position_cells(spark, d):
    return _cells(spark, d)[0].withColumn("value", F.round("value", 6))


def cell_imputation(spark, d):
    return bars.impute_cells(*_cells(spark, d)).withColumn("value", F.round("value", 6))


def cell_arrays(spark, d):
    """All values of a cell, beside their number."""
    b = _bts(spark, d)
    full = bars.full_bars(b)
    grid = full.select("file_id", "meter").distinct().select("file_id", bars.grid_size(F.col("meter"), F.lit(4), DIV).alias("cells"))
    v = bars.cell_arrays(bars.bar_cells(b, full, _frames(spark, d), grid, FRAME))
    return v.select("file_id", "beat_idx", "cell", "dim", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values"), 6).alias("value"), F.round(F.col("values")[0], 6).alias("least"))


def song_patterns(spark, d):
    """Bars with the pattern of their file."""
    b = bars.full_bars(_bts(spark, d))
    songs = b.select("file_id").distinct().withColumn("pattern", (F.col("file_id") % 5 + 1).cast("int"))
    return patterns.song_clusters_to_bars(b, songs).select("file_id", "beat_idx", "pattern")


def cluster_tempo(spark, d):
    """Tempo limits of clusters of files."""
    b = _bts(spark, d)
    of = b.select("file_id", (F.col("beat_idx") % 3 + F.col("file_id") % 2).cast("int").alias("cluster"))
    t = tempo.cluster_tempo(tempo.tempo_range(b, 5.0), of)
    return t.select("cluster", F.round("min_bpm", 6).alias("min_bpm"), F.round("max_bpm", 6).alias("max_bpm"))


def song_average(spark, d):
    return bars.song_average(_cells(spark, d)[0]).withColumn("value", F.round("value", 6))


def zscore_cells(spark, d):
    return bars.zscore_cells(_cells(spark, d)[0]).withColumn("value", F.round("value", 6))


def annotation_parse(spark, d):
    """Beats written as annotation text and read again."""
    b = _bts(spark, d)
    lines = b.select("file_id", "beat_idx", F.concat(F.format_string("%.6f", "t"), F.lit("\t"), F.floor((F.col("beat_idx") - 1) / 4).cast("string"), F.lit("."), F.col("beat_no").cast("string")).alias("value"))
    return src.parse_beats(lines)


def meter_parse(spark, d):
    m = table(spark, d, "meters").select("file_id", "section_no", F.concat_ws("/", F.col("num").cast("string"), F.col("den").cast("string")).alias("value")).distinct()
    return src.parse_meters(m)


_DAY = "(epoch_us(ts) - 1704067200000000) / 86400e6::DOUBLE"
BTS = f"""{SER}, b0 AS (SELECT file_id, frame, {_DAY} AS t, (frame - 1) % (3 + file_id % 2) + 1 AS beat_no FROM ser WHERE NOT (event_type = 'error' AND frame % 7 = 0)),
bts AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY frame) AS beat_idx, t, beat_no FROM b0)"""
DENSE = "bts AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY beat_idx, t, beat_no) AS beat_idx, t, beat_no FROM (SELECT DISTINCT file_id, beat_idx, t, beat_no FROM beats WHERE t IS NOT NULL AND beat_no IS NOT NULL))"
_MET = """h AS (SELECT file_id, beat_no, count(*) AS n FROM bts WHERE beat_no >= 2 GROUP BY ALL),
met AS (SELECT a.file_id, CAST(max(a.beat_no) AS INTEGER) AS meter FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.file_id = a.file_id AND b.beat_no < a.beat_no AND b.n > 2 * a.n) GROUP BY a.file_id)"""
_BARS = f"""{_MET}, mk AS (SELECT bts.file_id, beat_idx, meter, CASE WHEN lead(t) OVER w - t > 1.8::DOUBLE * (t - lag(t) OVER w) THEN 99 ELSE beat_no END AS no FROM bts JOIN met USING (file_id) WINDOW w AS (PARTITION BY bts.file_id ORDER BY beat_idx)),
de AS (SELECT file_id, beat_idx, meter, lead(no) OVER (PARTITION BY file_id ORDER BY beat_idx) - no AS dd FROM mk),
ar AS (SELECT file_id, meter, list(dd ORDER BY beat_idx) AS l FROM de GROUP BY ALL),
fb AS (SELECT file_id, CAST(k AS BIGINT) AS beat_idx, meter FROM (SELECT file_id, meter, l, unnest(generate_series(1, len(l))) AS k FROM ar) WHERE list_slice(l, k, k + meter) = list_concat(list_concat([1::BIGINT for x in range(meter - 1)], [CAST(1 - meter AS BIGINT)]), [1::BIGINT]))"""
_FR = f"fr AS (SELECT user_id AS file_id, CAST(floor({_DAY} / {FRAME}) AS BIGINT) + 1 AS frame, avg(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), fd AS (SELECT file_id, frame, 1 AS dim, v AS value FROM fr UNION ALL SELECT file_id, frame, 2, n FROM fr)"
_CELL = f"""{BTS}, {_BARS}, {_FR},
bb AS (SELECT fb.file_id, fb.beat_idx, fb.meter, CAST(ceil(fb.meter * {DIV} / 4) AS INTEGER) AS cells, s.t AS t0, e.t AS t1 FROM fb JOIN bts s ON s.file_id = fb.file_id AND s.beat_idx = fb.beat_idx JOIN bts e ON e.file_id = fb.file_id AND e.beat_idx = fb.beat_idx + fb.meter),
bf AS (SELECT bb.*, fd.frame, fd.dim, fd.value, (fd.frame - 0.5::DOUBLE) * {FRAME}::DOUBLE AS c FROM bb JOIN fd ON fd.file_id = bb.file_id AND fd.frame BETWEEN floor(t0 / {FRAME}) + 1 AND floor(t1 / {FRAME}) + 1),
sg AS (SELECT bf.*, (SELECT least(greatest(count(*), 1), meter) FROM bts x WHERE x.file_id = bf.file_id AND x.beat_idx BETWEEN bf.beat_idx AND bf.beat_idx + bf.meter AND x.t <= bf.c) - 1 AS j FROM bf),
ps AS (SELECT sg.*, (j + (c - a.t) / (b.t - a.t)) / meter * cells + 1 AS pos FROM sg JOIN bts a ON a.file_id = sg.file_id AND a.beat_idx = sg.beat_idx + j JOIN bts b ON b.file_id = sg.file_id AND b.beat_idx = sg.beat_idx + j + 1),
ce AS (SELECT file_id, beat_idx, CAST(greatest(floor(pos + 0.5), 1) AS INTEGER) AS cell, dim, cells, avg(value) AS value FROM ps WHERE greatest(floor(pos + 0.5), 1) <= cells GROUP BY ALL)"""
_IMP = """gr AS (SELECT DISTINCT file_id, beat_idx, dim, cells, unnest(generate_series(1, cells)) AS cell FROM ce),
jn AS (SELECT gr.*, ce.value FROM gr LEFT JOIN ce USING (file_id, beat_idx, dim, cell)),
ls AS (SELECT file_id, beat_idx, dim, list(cell ORDER BY cell) AS cs, list(value ORDER BY cell) AS vs FROM ce GROUP BY ALL),
q AS (SELECT jn.*, cs, vs, len(list_filter(cs, lambda z: z <= jn.cell)) AS lo FROM jn JOIN ls USING (file_id, beat_idx, dim)),
q2 AS (SELECT *, CASE WHEN len(cs) = 1 THEN NULL ELSE least(greatest(lo, 1), len(cs) - 1) END AS i FROM q)
SELECT file_id, beat_idx, CAST(dim AS INTEGER) AS dim, CAST(cell AS INTEGER) AS cell, value IS NULL AS imputed, round(CASE WHEN value IS NOT NULL THEN value WHEN i IS NULL THEN vs[1] ELSE vs[i] + (vs[i + 1] - vs[i]) / (cs[i + 1] - cs[i]) * (cell - cs[i]) END, 6) AS value FROM q2"""
_RNG = """pe AS (SELECT file_id, t - lag(t) OVER (PARTITION BY file_id ORDER BY beat_idx) AS p FROM bts),
rk AS (SELECT file_id, p, row_number() OVER (PARTITION BY file_id ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM pe WHERE p IS NOT NULL),
rg AS (SELECT file_id, 60.0::DOUBLE / max(p) AS lo, 60.0::DOUBLE / min(p) AS hi FROM rk WHERE k BETWEEN greatest(floor(n * 5.0::DOUBLE / 100), 1) AND least(floor(n * (1 - 5.0::DOUBLE / 100)), n) GROUP BY file_id)"""

ORACLES = {
    "predominant_meter": f"WITH {BTS}, {_MET} SELECT * FROM met",
    "predominant_meter_beats": f"WITH {DENSE}, {_MET} SELECT * FROM met",
    "full_bars": f"WITH {BTS}, {_BARS} SELECT * FROM fb",
    "full_bars_beats": f"WITH {DENSE}, {_BARS} SELECT * FROM fb",
    "bar_beats": f"WITH {BTS}, {_BARS} SELECT bts.file_id, bts.beat_idx, EXISTS (SELECT 1 FROM fb WHERE fb.file_id = bts.file_id AND bts.beat_idx BETWEEN fb.beat_idx AND fb.beat_idx + fb.meter) AS in_bar FROM bts",
    "tempo_range_trimmed": f"WITH {BTS}, {_RNG} SELECT file_id, round(lo, 6) AS min_bpm, round(hi, 6) AS max_bpm FROM rg",
    "same_tempo_per_meter": f"WITH {BTS}, {_RNG}, r2 AS (SELECT file_id, 3 + file_id % 2 AS num, greatest(lo, 20.0::DOUBLE) AS lo, least(hi, 5000.0::DOUBLE) AS hi FROM rg) SELECT file_id, num, round(min(lo) OVER (PARTITION BY num), 6) AS min_bpm, round(max(hi) OVER (PARTITION BY num), 6) AS max_bpm FROM r2",
    "bar_position_cells": f"WITH {_CELL} SELECT file_id, beat_idx, cell, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM ce",
    "cell_imputation": f"WITH {_CELL}, {_IMP}",
    "cell_arrays": f"WITH {_CELL} SELECT file_id, beat_idx, CAST(greatest(floor(pos + 0.5), 1) AS INTEGER) AS cell, CAST(dim AS INTEGER) AS dim, CAST(count(*) AS INTEGER) AS n, round(avg(value), 6) AS value, round(min(value), 6) AS least FROM ps WHERE greatest(floor(pos + 0.5), 1) <= cells GROUP BY ALL",
    "song_patterns": f"WITH {BTS}, {_BARS} SELECT file_id, beat_idx, CAST(file_id % 5 + 1 AS INTEGER) AS pattern FROM fb",
    "cluster_tempo": f"WITH {BTS}, {_RNG}, k AS (SELECT DISTINCT file_id, CAST(beat_idx % 3 + file_id % 2 AS INTEGER) AS cluster FROM bts) SELECT cluster, round(min(lo), 6) AS min_bpm, round(max(hi), 6) AS max_bpm FROM k JOIN rg USING (file_id) GROUP BY 1",
    "song_average": f"WITH {_CELL} SELECT file_id, cell, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS value FROM ce GROUP BY ALL",
    "zscore_cells": f"WITH {_CELL} SELECT file_id, beat_idx, cell, CAST(dim AS INTEGER) AS dim, round((value - avg(value) OVER (PARTITION BY dim)) / stddev_samp(value) OVER (PARTITION BY dim), 6) AS value FROM ce",
    "annotation_parse": f"WITH {BTS} SELECT file_id, beat_idx, round(t, 6) AS t, CAST(floor((beat_idx - 1) / 4) AS BIGINT) AS bar, beat_no FROM bts",
    "meter_parse": "SELECT DISTINCT file_id, section_no, num, coalesce(den, 4) AS den FROM meters",
}

QUERIES = {
    f.__name__: f
    for f in (predominant_meter, predominant_meter_beats, full_bars, full_bars_beats, bar_beats, tempo_range_trimmed, same_tempo_per_meter, bar_position_cells, cell_imputation, cell_arrays, song_patterns, cluster_tempo, song_average, zscore_cells, annotation_parse, meter_parse)
}
