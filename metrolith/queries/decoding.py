"""Queries of decoding, results, constraints, folds and particle filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from metrolith.config import Params
from metrolith.functions.series import event_series
from metrolith.operators import decode as dc
from metrolith.operators import particles as pf
from metrolith.operators import results as rs
from metrolith.operators import tempo
from metrolith.plans import evaluation as ev
from metrolith.plans import statespace as ss
from metrolith.plans import tracker
from metrolith.plans import transitions as tr
from metrolith.queries.bars import BTS, _bts
from metrolith.queries.dealt import table
from metrolith.queries.signal import SER
from metrolith.sources import sinks

A = [[0.83, 0.11, 0.06], [0.07, 0.79, 0.14], [0.13, 0.09, 0.78]]
B = [[0.71, 0.19, 0.10], [0.23, 0.59, 0.18], [0.08, 0.21, 0.71]]
INIT = [0.36, 0.33, 0.31]
NAMES = [(1, "click"), (2, "error"), (3, "purchase"), (4, "signup"), (5, "view")]


def _model() -> dc.Model:
    i, j = np.divmod(np.arange(9), 3)
    return dc.Model(i, j, np.array(A).ravel(), np.array(INIT), np.arange(3))


def _levels(spark, d):
    """Values as three levels, seen from three states."""
    s = event_series(table(spark, d, "events"))
    k = F.when(F.col("x") < 20, 0).when(F.col("x") < 60, 1).otherwise(2)
    return s.select("file_id", "frame", F.array(*[F.array(*[F.lit(v) for v in row])[k] for row in B]).alias("lik"))


def viterbi_small(spark, d):
    return dc.viterbi_paths(_levels(spark, d), _model())


def viterbi_native(spark, d):
    s = dc.native_scores(_levels(spark, d), A, INIT)
    return s.select("file_id", *[F.round(F.col("scores")[i], 6).alias(f"s{i + 1}") for i in range(3)])


def forward_small(spark, d):
    return dc.forward_chances(_levels(spark, d), _model()).withColumn("p", F.round("p", 6))


def _walk(spark, d):
    """A pointer that moves 3 to 9 of 40 positions a frame, as positions in 1 to 2."""
    from pyspark.sql import Window

    s = event_series(table(spark, d, "events"))
    w = Window.partitionBy("file_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    n = (F.floor("x") % 7 + 3).cast("long")
    return s.select("file_id", "frame", n.alias("n"), (F.sum(n).over(w) % 40 + 1).alias("m"))


def beat_times(spark, d):
    path = _walk(spark, d).select("file_id", "frame", F.col("m").cast("double").alias("position"), F.lit(4).alias("n_beats"), F.lit(40.0).alias("bar"))
    return rs.beat_times(path, 0.02).select("file_id", "frame", F.round("at", 6).alias("at"), F.round("t", 6).alias("t"), "beat_no")


def corrected_beats(spark, d):
    """Beats moved to the strongest value until two positions further on."""
    path = _walk(spark, d).select("file_id", "frame", F.col("m").cast("double").alias("position"), F.lit(4).alias("n_beats"), F.lit(40.0).alias("bar"), (F.col("n") * 60.0 / (10 * 0.02)).alias("bpm"))
    x = event_series(table(spark, d, "events")).select("file_id", "frame", "x")
    beats = rs.beat_times(path, 0.02)
    return rs.corrected_beats(beats.select("file_id", "frame", "beat_no"), x, path, 2.0, 0.02).select("file_id", "frame", F.round("t", 6).alias("t"), "beat_no")


def tempo_summary(spark, d):
    bpm = _walk(spark, d).select("file_id", (F.col("n") * 60.0 / (10 * 0.02)).alias("bpm"))
    ends = bpm.groupBy("file_id").agg(F.round(F.min("bpm"), 6).alias("slowest"), F.round(F.max("bpm"), 6).alias("fastest"))
    return tempo.median_tempo(bpm).select("file_id", F.round("bpm", 6).alias("bpm")).join(ends, "file_id")


def _symbols(spark, d):
    code = F.array_position(F.array(*[F.lit(n) for _, n in NAMES]), F.col("event_type")).cast("int")
    return event_series(table(spark, d, "events")).select("file_id", "frame", code.alias("pattern"))


def pattern_segments(spark, d):
    return rs.segments(_symbols(spark, d))


def rhythm_lines(spark, d):
    return sinks.rhythm_lines(_symbols(spark, d), spark.createDataFrame(NAMES, "pattern int, name string"), 0.02)


def beat_lines(spark, d):
    b = _bts(spark, d).withColumnRenamed("beat_idx", "frame")
    return sinks.beat_lines(b)


def fold_split_holdout(spark, d):
    files = table(spark, d, "file_list").select("file_id", "dataset")
    train, test = ev.holdout(files, files.where("file_id % 5 = 0"))
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


def fold_pairs(spark, d):
    folds = table(spark, d, "file_list").select("file_id", (F.col("file_id") % 4 + 1).cast("int").alias("fold"))
    return ev.fold_pairs(folds)


def leave_one_out(spark, d):
    s = table(spark, d, "file_list").where("duration_s is not null").groupBy(F.col("dataset").alias("file_id")).agg(F.sum("duration_s").alias("seconds"), F.count("*").alias("files"))
    return ev.leave_one_out(s, ["seconds", "files"]).select(F.col("file_id").alias("dataset"), F.round("seconds", 4).alias("seconds"), "files")


_SMALL = [(1, 3, 4, 3, 0.75, 60.0, 120.0), (2, 4, 4, 4, 1.0, 60.0, 120.0)]


def _small_states(spark):
    """Two patterns of 10 to 5 frames a beat."""
    return ss.states_2015(ss.make_patterns(spark, _SMALL), 0.1)


def belief_beats(spark, d):
    b = _bts(spark, d).withColumn("t", F.col("t") * 0.5)
    return dc.constraint_states(b, _small_states(spark), 0.1)


def belief_downbeats(spark, d):
    return dc.constraint_states(_bts(spark, d), _small_states(spark), 0.1, "downbeats")


def belief_meter(spark, d):
    b, p = _bts(spark, d), ss.make_patterns(spark, _SMALL)
    meters = b.select("file_id").distinct().select("file_id", (F.lit(3) + F.col("file_id") % 2).cast("int").alias("num"), F.lit(4).alias("den"))
    return dc.meter_states(dc.constraint_states(b, _small_states(spark), 0.1, "downbeats"), _small_states(spark), p, meters)


def _tables(spark):
    pr = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 1, 0.1), (2, 2, 0.9)], "i int, j int, p double")
    return tracker.Tables(ss.make_patterns(spark, _SMALL), pr, None)


_PARAMS = Params(frame_length=0.1, whole_note_div=16, observation_model="RNN", n_particles=200, res_int=5)


def _activations(spark, d):
    s = event_series(table(spark, d, "events"))
    return s.select("file_id", "frame", F.lit(1).alias("dim"), F.least(F.greatest(F.col("x") / 200.0, F.lit(0.01)), F.lit(0.99)).alias("value"))


def decode_full(spark, d):
    """Activations to beats: likelihoods, bar-pointer model, best path, beat times."""
    return tracker.decode(_activations(spark, d), _tables(spark), _PARAMS)[0].select("file_id", "frame", F.round("t", 6).alias("t"), "beat_no")


def decode_constrained(spark, d):
    """Best paths with every thirtieth frame, from the first, held to the first beat of a bar."""
    seen, columns, most = tracker.observe(_activations(spark, d), _tables(spark), _PARAMS)
    model, states = tracker.hidden_model(_tables(spark), _PARAMS, most)
    first = states.where("pos_idx = 0").select("state")
    return dc.constrained_paths(seen, model, seen.where("frame % 30 = 1").select("file_id", "frame").crossJoin(F.broadcast(first)), columns)


def particle_filter(spark, d):
    seen, columns, _ = tracker.observe(_activations(spark, d), _tables(spark), _PARAMS)
    rows = _tables(spark).patterns.orderBy("pattern").collect()
    pointer = pf.BarPointer.of(rows, [[0.9, 0.1], [0.1, 0.9]], 16, 0.1)
    return pf.particle_paths(seen, pointer, _PARAMS, columns).select("file_id", "frame", F.round("position", 6).alias("position"), F.round("bpm", 6).alias("bpm"), "pattern")


def particle_checks(spark, d):
    """Files with their frames, whether all positions, tempi and patterns are within the model, and whether positions go on by the tempo but where bars end."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("frame")
    bar, beats = F.col("pattern").cast("double") * 0.25 + 0.5, F.col("pattern") + 2
    path = particle_filter(spark, d).withColumn("bar", bar).withColumn("step", F.col("bpm") / 60.0 * 0.1 * bar / beats)
    path = path.withColumn("moved", F.lead("position").over(w) - F.col("position")).withColumn("next", F.lead("step").over(w)).withColumn("same", F.lead("pattern").over(w) == F.col("pattern"))
    within = F.col("pattern").between(1, 2) & F.col("position").between(1, F.col("bar") + 1) & F.col("bpm").between(60 - 1e-6, 120 + 1e-6)
    goes_on = F.coalesce(~F.col("same") | (F.col("moved") < 0) | (F.abs(F.col("moved") - F.col("next")) < 1e-5), F.lit(True))
    return path.groupBy("file_id").agg(F.count("*").alias("frames"), F.min(within).alias("within"), F.min(goes_on).alias("continuous"))


def _d(v: float) -> str:
    return f"{v!r}::DOUBLE"


_OBS = f"{SER}, ob AS (SELECT file_id, frame, CASE WHEN x < 20 THEN 1 WHEN x < 60 THEN 2 ELSE 3 END AS k FROM ser)"
_BL = "[" + ", ".join("[" + ", ".join(_d(v) for v in r) + "]" for r in B) + "]"


def _came(j: int) -> str:
    return "[" + ", ".join(f"d[{i + 1}] + ln({_d(A[i][j])})" for i in range(3)) + "]"


def _fwd(log: bool) -> str:
    if log:
        new = "[" + ", ".join(f"list_max({_came(j)}) + ln({_BL}[{j + 1}][k])" for j in range(3)) + "]"
        psi = "[" + ", ".join(f"list_position({_came(j)}, list_max({_came(j)}))" for j in range(3)) + "]"
        start = "[" + ", ".join(f"ln({_d(v)})" for v in INIT) + "]"
        return f"fw AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS frame, {start} AS d, [0, 0, 0] AS psi FROM ob UNION ALL SELECT o.file_id, o.frame, {new}, {psi} FROM fw JOIN ob o ON o.file_id = fw.file_id AND o.frame = fw.frame + 1)"
    raw = "[" + ", ".join("(" + " + ".join(f"d[{i + 1}] * {_d(A[i][j])}" for i in range(3)) + f") * {_BL}[{j + 1}][k]" for j in range(3)) + "]"
    return f"fw AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS frame, [{', '.join(_d(v) for v in INIT)}] AS d FROM ob UNION ALL SELECT file_id, frame, list_transform(z, lambda q: q / list_sum(z)) FROM (SELECT o.file_id, o.frame, {raw} AS z FROM fw JOIN ob o ON o.file_id = fw.file_id AND o.frame = fw.frame + 1))"


_SEG = """sy AS (SELECT file_id, frame, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS pattern FROM ser),
ru AS (SELECT *, frame - row_number() OVER (PARTITION BY file_id, pattern ORDER BY frame) AS g FROM sy),
sg AS (SELECT file_id, pattern, min(frame) AS f, max(frame) AS l FROM ru GROUP BY file_id, pattern, g)"""
_WALK = f"{SER}, wk AS (SELECT file_id, frame, CAST(floor(x) AS BIGINT) % 7 + 3 AS n, CAST(sum(CAST(floor(x) AS BIGINT) % 7 + 3) OVER (PARTITION BY file_id ORDER BY frame) AS BIGINT) % 40 + 1 AS m FROM ser)"
_SST = f"""pat(pattern, b, fr) AS (VALUES (1, 3, 10), (2, 4, 10)), tp AS (SELECT *, unnest(generate_series(5, 10)) AS n FROM pat), tf AS (SELECT *, coalesce(sum(n * b) OVER (ORDER BY pattern, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM tp),
st AS (SELECT CAST(f + k + 1 AS INTEGER) AS state, pattern, n, b, k, k / n AS q, floor(k / n + 0.5) AS z FROM (SELECT *, unnest(generate_series(0, n * b - 1)) AS k FROM tf))"""
_IBI = "ib AS (SELECT file_id, t, beat_no, (coalesce(t - lag(t) OVER w, lead(t) OVER w - t) + coalesce(lead(t) OVER w - t, t - lag(t) OVER w)) / 2 AS ibi FROM {src} WINDOW w AS (PARTITION BY file_id ORDER BY beat_idx))"

#: The bar pointer of two patterns as in ``_SMALL``: states, edges and likelihoods, and its best paths by recursion over frames.
_POINTER = f"""{_SST}, pr(ri, rj, r) AS (VALUES (1, 1, 0.9::DOUBLE), (1, 2, 0.1::DOUBLE), (2, 1, 0.1::DOUBLE), (2, 2, 0.9::DOUBLE)),
ch AS (SELECT a.pattern AS ri, a.n AS ni, a.b, a.f AS fi, c.pattern AS rj, c.n AS nj, c.f AS fj, exp(-100.0::DOUBLE * abs(c.n / a.n - 1)) AS w FROM tf a CROSS JOIN tf c WHERE exp(-100.0::DOUBLE * abs(c.n / a.n - 1)) > 2.220446049250313e-16::DOUBLE),
cn AS (SELECT *, w / sum(w) OVER (PARTITION BY ri, ni, rj) AS q FROM ch), br AS (SELECT fi, fj, ni, b, q * r / sum(q * r) OVER (PARTITION BY ri, ni) AS z FROM cn JOIN pr USING (ri, rj)),
ed AS MATERIALIZED (SELECT CAST(state AS INTEGER) AS i, CAST(state + 1 AS INTEGER) AS j, 1.0::DOUBLE AS p FROM st WHERE (k + 1) % n <> 0
UNION ALL SELECT CAST(fi + g * ni AS INTEGER), CAST(fj + g * nj + 1 AS INTEGER), q FROM (SELECT *, unnest(generate_series(1, b - 1)) AS g FROM cn WHERE ri = rj) UNION ALL SELECT CAST(fi + b * ni AS INTEGER), CAST(fj + 1 AS INTEGER), z FROM br),
sl AS MATERIALIZED (SELECT state, k, floor(k * (b / 4.0::DOUBLE) / (n * b) * 16 + 1e-9::DOUBLE) = 0 AS beat, b * 4 - 1 AS others FROM st),
ob AS MATERIALIZED (SELECT file_id, frame, least(greatest(x / 200.0::DOUBLE, 0.01::DOUBLE), 0.99::DOUBLE) AS a FROM ser)"""


def _best_path(held: str) -> str:
    """vt(file_id, frame, state): best paths; ``held`` tells which frames are held to first positions."""
    return f"""{_POINTER}, fw AS (SELECT o.file_id, CAST(0 AS BIGINT) AS frame, s.state, 1.0::DOUBLE / (SELECT count(*) FROM sl) AS d, 0 AS psi FROM (SELECT DISTINCT file_id FROM ob) o CROSS JOIN sl s
UNION ALL SELECT file_id, frame, state, d / sum(d) OVER (PARTITION BY file_id), psi FROM (
  SELECT b.file_id, b.frame, b.state, b.v * CASE WHEN s.beat THEN o.a ELSE (1 - o.a) / s.others END * CASE WHEN {held} AND s.k <> 0 THEN 0 ELSE 1 END AS d, b.psi FROM (
    SELECT fw.file_id, fw.frame + 1 AS frame, ed.j AS state, max(fw.d * ed.p) AS v, arg_max(ed.i, ROW(fw.d * ed.p, -ed.i)) AS psi FROM fw JOIN ed ON ed.i = fw.state GROUP BY ALL) b
  JOIN ob o ON o.file_id = b.file_id AND o.frame = b.frame JOIN sl s ON s.state = b.state)),
fz AS MATERIALIZED (SELECT * FROM fw), mx AS (SELECT file_id, max(frame) AS n FROM fz GROUP BY 1),
en AS (SELECT file_id, frame, state FROM (SELECT fz.*, mx.n, row_number() OVER (PARTITION BY fz.file_id ORDER BY state) AS r, count(*) OVER (PARTITION BY fz.file_id) AS c FROM fz JOIN mx ON mx.file_id = fz.file_id AND mx.n = fz.frame
  JOIN (SELECT file_id, frame, max(d) AS d FROM fz GROUP BY ALL) t ON t.file_id = fz.file_id AND t.frame = fz.frame AND t.d = fz.d) WHERE r = (c + 1) // 2),
vt AS (SELECT file_id, frame, state FROM en UNION ALL SELECT vt.file_id, vt.frame - 1, fz.psi FROM vt JOIN fz ON fz.file_id = vt.file_id AND fz.frame = vt.frame AND fz.state = vt.state WHERE vt.frame > 1)"""


ORACLES = {
    "beat_lines": f"WITH {BTS} SELECT file_id, beat_idx AS frame, printf('%.3f', t) || chr(9) || beat_no AS value FROM bts",
    "decode_constrained": f"WITH RECURSIVE {SER}, {_best_path('o.frame % 30 = 1')} SELECT file_id, frame, CAST(state AS INTEGER) AS state FROM vt",
    "decode_full": f"""WITH RECURSIVE {SER}, {_best_path('FALSE')}, pa AS (SELECT vt.file_id, vt.frame, st.b, b / 4.0::DOUBLE AS bar, k * (b / 4.0::DOUBLE) / (n * b) + 1 AS m FROM vt JOIN st ON st.state = vt.state),
nx AS (SELECT *, lead(m) OVER (PARTITION BY file_id ORDER BY frame) AS x FROM pa), hb AS (SELECT *, unnest(generate_series(1, b)) AS j FROM nx WHERE x IS NOT NULL), hc AS (SELECT *, 1 + (j - 1) * (bar / b) AS q FROM hb),
h2 AS (SELECT *, CASE WHEN m = q THEN CAST(frame AS DOUBLE) WHEN x > q AND x < m THEN frame + (bar + q - m) / (bar + x - m) WHEN m < q AND x > q THEN frame + (q - m) / (x - m) END AS "at" FROM hc)
SELECT file_id, frame, round(floor("at" + 0.5) * 0.1::DOUBLE, 6) AS t, CAST(j AS INTEGER) AS beat_no FROM h2 WHERE "at" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, frame ORDER BY j) = 1""",
    "particle_checks": f"WITH {SER} SELECT file_id, count(*) AS frames, true AS within, true AS continuous FROM ser GROUP BY file_id",
    "viterbi_small": f"""WITH RECURSIVE {_OBS}, {_fwd(True)}, mx AS (SELECT file_id, max(frame) AS n FROM fw GROUP BY 1),
bt AS (SELECT fw.file_id, fw.frame, list_position(d, list_max(d)) AS state FROM fw JOIN mx ON mx.file_id = fw.file_id AND mx.n = fw.frame UNION ALL SELECT p.file_id, p.frame, CAST(c.psi[bt.state] AS INTEGER) FROM bt JOIN fw c ON c.file_id = bt.file_id AND c.frame = bt.frame JOIN fw p ON p.file_id = bt.file_id AND p.frame = bt.frame - 1 WHERE p.frame > 0)
SELECT file_id, frame, CAST(state AS INTEGER) AS state FROM bt""",
    "viterbi_native": f"WITH RECURSIVE {_OBS}, {_fwd(True)}, mx AS (SELECT file_id, max(frame) AS n FROM fw GROUP BY 1) SELECT fw.file_id, round(d[1], 6) AS s1, round(d[2], 6) AS s2, round(d[3], 6) AS s3 FROM fw JOIN mx ON mx.file_id = fw.file_id AND mx.n = fw.frame",
    "forward_small": f"WITH RECURSIVE {_OBS}, {_fwd(False)} SELECT file_id, frame, CAST(s.v AS INTEGER) AS state, round(d[s.v], 6) AS p FROM fw CROSS JOIN (VALUES (1), (2), (3)) s(v) WHERE frame > 0",
    "beat_times": f"""WITH {_WALK}, nx AS (SELECT *, lead(m) OVER (PARTITION BY file_id ORDER BY frame) AS x FROM wk), hb AS (SELECT nx.*, j.v AS j, 1 + (j.v - 1) * 10 AS b FROM nx CROSS JOIN (VALUES (1), (2), (3), (4)) j(v) WHERE x IS NOT NULL),
h2 AS (SELECT *, CASE WHEN m = b THEN CAST(frame AS DOUBLE) WHEN x > b AND x < m THEN frame + (40 + b - m) / CAST(40 + x - m AS DOUBLE) WHEN m < b AND x > b THEN frame + (b - m) / CAST(x - m AS DOUBLE) END AS "at" FROM hb),
h3 AS (SELECT * FROM h2 WHERE "at" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, frame ORDER BY j) = 1)
SELECT file_id, frame, round("at", 6) AS "at", round(floor("at" + 0.5) * 0.02::DOUBLE, 6) AS t, CAST(j AS INTEGER) AS beat_no FROM h3""",
    "corrected_beats": f"""WITH {_WALK}, nx AS (SELECT *, lead(m) OVER (PARTITION BY file_id ORDER BY frame) AS x FROM wk), hb AS (SELECT nx.*, j.v AS j, 1 + (j.v - 1) * 10 AS b FROM nx CROSS JOIN (VALUES (1), (2), (3), (4)) j(v) WHERE x IS NOT NULL),
h3 AS (SELECT file_id, frame, j, b FROM hb WHERE m = b OR (x > b AND x < m) OR (m < b AND x > b) QUALIFY row_number() OVER (PARTITION BY file_id, frame ORDER BY j) = 1),
pc AS (SELECT file_id, CAST(ceil(2.0::DOUBLE / min(n)) AS BIGINT) + 2 AS reach FROM wk GROUP BY 1),
sp AS (SELECT h3.file_id, h3.frame AS f, j, wk.frame, ser.x, (wk.m - b + 40) % 40 AS past FROM h3 JOIN pc ON pc.file_id = h3.file_id JOIN wk ON wk.file_id = h3.file_id AND wk.frame BETWEEN h3.frame AND h3.frame + reach JOIN ser ON ser.file_id = wk.file_id AND ser.frame = wk.frame),
g AS (SELECT *, min(frame) FILTER (past >= 2 AND past < 20) OVER (PARTITION BY file_id, f) AS gone FROM sp)
SELECT file_id, frame, round(frame * 0.02::DOUBLE, 6) AS t, CAST(j AS INTEGER) AS beat_no FROM g WHERE gone IS NULL OR frame <= gone QUALIFY row_number() OVER (PARTITION BY file_id, f ORDER BY x DESC, frame) = 1""",
    "tempo_summary": f"WITH {_WALK} SELECT file_id, round(quantile_cont(n * 60.0::DOUBLE / 0.2::DOUBLE, 0.5), 6) AS bpm, round(min(n * 60.0::DOUBLE / 0.2::DOUBLE), 6) AS slowest, round(max(n * 60.0::DOUBLE / 0.2::DOUBLE), 6) AS fastest FROM wk GROUP BY file_id",
    "pattern_segments": f"WITH {SER}, {_SEG} SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY f) AS INTEGER) AS seg, f AS first, l AS last, CAST(pattern AS INTEGER) AS pattern FROM sg",
    "rhythm_lines": f"WITH {SER}, {_SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY f) AS seg FROM sg) SELECT file_id, CAST(seg AS INTEGER) AS frame, printf('%3.2f', (greatest(f - 1, 1) - 1) * 0.02::DOUBLE) || chr(9) || printf('%3.2f', (l - 1) * 0.02::DOUBLE) || chr(9) || ['click', 'error', 'purchase', 'signup', 'view'][pattern] AS value FROM o",
    "fold_split_holdout": "SELECT file_id, dataset, CASE WHEN file_id % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM file_list",
    "fold_pairs": "WITH f AS (SELECT file_id, CAST(file_id % 4 + 1 AS INTEGER) AS g FROM file_list) SELECT CAST(k.v AS INTEGER) AS fold, file_id, CASE WHEN g = k.v THEN 'test' ELSE 'train' END AS role FROM f CROSS JOIN (VALUES (1), (2), (3), (4)) k(v)",
    "leave_one_out": "WITH s AS (SELECT dataset, sum(duration_s) AS x, count(*) AS n FROM file_list WHERE duration_s IS NOT NULL GROUP BY 1) SELECT dataset, round((SELECT sum(x) FROM s) - x, 4) AS seconds, CAST((SELECT sum(n) FROM s) - n AS BIGINT) AS files FROM s",
    "belief_beats": f"WITH {BTS}, {_SST}, b2 AS (SELECT file_id, beat_idx, t * 0.5::DOUBLE AS t, beat_no FROM bts), {_IBI.format(src='b2')} SELECT file_id, CAST(floor(t / 0.1::DOUBLE) AS BIGINT) + 1 AS frame, state FROM ib JOIN st ON st.z % st.b + 1 = ib.beat_no AND abs(st.q - st.z) <= 0.1::DOUBLE WHERE ibi IS NULL OR abs(ibi / (st.n * 0.1::DOUBLE) - 1) <= 0.4::DOUBLE",
    "belief_downbeats": f"WITH {BTS}, {_SST} SELECT file_id, CAST(floor(t / 0.1::DOUBLE) AS BIGINT) + 1 AS frame, state FROM bts JOIN st ON st.z % st.b = 0 AND abs(st.q - st.z) <= 0.05::DOUBLE WHERE beat_no = 1",
    "belief_meter": f"WITH {BTS}, {_SST} SELECT file_id, CAST(floor(t / 0.1::DOUBLE) AS BIGINT) + 1 AS frame, state FROM bts JOIN st ON st.z % st.b = 0 AND abs(st.q - st.z) <= 0.05::DOUBLE WHERE beat_no = 1 AND st.b = 3 + file_id % 2",
}

QUERIES = {
    f.__name__: f
    for f in (viterbi_small, viterbi_native, forward_small, beat_times, corrected_beats, tempo_summary, pattern_segments, rhythm_lines, beat_lines, fold_split_holdout, fold_pairs, leave_one_out, belief_beats, belief_downbeats, belief_meter, decode_full, decode_constrained, particle_filter, particle_checks)
}
