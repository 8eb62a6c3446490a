"""Queries of state spaces, transition models, decoding and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.plans import statespace as ss
from metrolith.plans import transitions as tr

#: Three patterns whose transition counts are known: 8309 states, 13735 edges.
TOY = [(1, 3, 4, 3, 0.75, 50.0, 100.0), (2, 4, 4, 4, 1.0, 70.0, 120.0), (3, 4, 4, 4, 1.0, 90.0, 140.0)]
TOY_PR = [(i + 1, j + 1, p) for i, row in enumerate(((0.8, 0.1, 0.1), (0.1, 0.7, 0.2), (0.1, 0.2, 0.8))) for j, p in enumerate(row)]
FL, LAM, M = 0.02, 100.0, 200


def toy(spark):
    return ss.make_patterns(spark, TOY), spark.createDataFrame(TOY_PR, "i int, j int, p double")


def tempo_grid_2015(spark, d):
    return ss.tempi_2015(toy(spark)[0], FL).select("pattern", "tempo_idx", "frames_per_beat", F.round(60.0 / (F.col("frames_per_beat") * FL), 9).alias("bpm"))


def tempo_grid_log(spark, d):
    return ss.tempi_2015(toy(spark)[0], FL, 10).select("pattern", "tempo_idx", "frames_per_beat")


def state_space_2015(spark, d):
    s = ss.states_2015(toy(spark)[0], FL)
    return s.select("state", "pattern", "tempo_idx", "pos_idx", "beat", F.round("position", 9).alias("position"), F.round("tempo", 12).alias("tempo"))


def state_cells(spark, d):
    return ss.state_cells(ss.states_2015(toy(spark)[0], FL), 64, 64)


def transitions_2015(spark, d):
    p, pr = toy(spark)
    return tr.transitions_2015(ss.states_2015(p, FL), pr, LAM).withColumn("p", F.round("p", 12))


def transition_check(spark, d):
    p, pr = toy(spark)
    s = ss.states_2015(p, FL)
    e = tr.transitions_2015(s, pr, LAM)
    of = e.where("i = 4002").agg(F.sum("j").alias("targets_4002"), F.round(F.sum(F.col("p") * F.col("p")), 12).alias("squares_4002"))
    return e.agg(F.count("*").alias("edges")).crossJoin(of).crossJoin(tr.check_transitions(e, s).agg(F.count("*").alias("faults"))).crossJoin(s.agg(F.count("*").alias("states")))


def transitions_silence(spark, d):
    p, pr = toy(spark)
    return tr.transitions_2015(ss.states_2015(p, FL), pr, LAM, 1e-5, 1e-3, True).groupBy("i").agg(F.count("*").alias("edges"), F.round(F.sum("p"), 9).alias("total"))


def state_space_2006(spark, d):
    return ss.states_2006(toy(spark)[0], FL, M).select("state", "pattern", "tempo", "position", F.round("bpm", 9).alias("bpm"))


def transitions_2006(spark, d):
    p, pr = toy(spark)
    return tr.transitions_2006(p, pr, FL, M).withColumn("p", F.round("p", 12))


def initial_by_meter(spark, d):
    prior = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "pattern int, p double")
    return ss.initial_distribution(ss.states_2015(toy(spark)[0], FL), prior).withColumn("p", F.round("p", 15))


def state_neighbours(spark, d):
    return ss.neighbours_2015(ss.states_2015(toy(spark)[0], FL))


def _v(rows) -> str:
    return ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


_PAT = f"pat(pattern, num, den, b, bar, lo, hi) AS (VALUES {_v(TOY)}), pr(i, j, p) AS (VALUES {_v(TOY_PR)})"
_TP = f"""{_PAT}, tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY n DESC) AS INTEGER) AS ti FROM (SELECT *, unnest(generate_series(CAST(floor(60 / (hi * {FL}::DOUBLE)) AS INTEGER), CAST(ceil(60 / (lo * {FL}::DOUBLE)) AS INTEGER))) AS n FROM pat)),
tf AS (SELECT *, CAST(coalesce(sum(n * b) OVER (ORDER BY pattern, ti ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS f FROM tp)"""
_ST = f"{_TP}, st AS (SELECT *, f + k + 1 AS state FROM (SELECT *, unnest(generate_series(0, n * b - 1)) AS k FROM tf))"
_TR = f"""{_ST}, ch AS (SELECT a.pattern AS ri, a.ti, a.n AS ni, a.f AS fi, a.b, c.pattern AS rj, c.n AS nj, c.f AS fj, exp(-{LAM}::DOUBLE * abs(c.n / a.n - 1)) AS w FROM tf a CROSS JOIN tf c WHERE exp(-{LAM}::DOUBLE * abs(c.n / a.n - 1)) > 2.220446049250313e-16::DOUBLE),
cn AS (SELECT *, w / sum(w) OVER (PARTITION BY ri, ti, rj) AS q FROM ch),
br AS (SELECT cn.*, q * pr.p / sum(q * pr.p) OVER (PARTITION BY ri, ti) AS z FROM cn JOIN pr ON pr.i = ri AND pr.j = rj),
ed AS (SELECT state AS i, state + 1 AS j, 1.0::DOUBLE AS p FROM st WHERE (k + 1) % n <> 0
UNION ALL SELECT fi + g * ni, fj + g * nj + 1, q FROM (SELECT *, unnest(generate_series(1, b - 1)) AS g FROM cn WHERE ri = rj)
UNION ALL SELECT fi + b * ni, fj + 1, z FROM br)"""
_06 = f"""{_PAT}, po AS (SELECT *, CAST(floor({M} * bar / (SELECT max(bar) FROM pat) + 0.5) AS INTEGER) AS m FROM pat),
t6 AS (SELECT *, CAST(coalesce(sum(m) OVER (ORDER BY pattern, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS f FROM (SELECT *, unnest(generate_series(greatest(CAST(floor(lo * (m / b) * {FL}::DOUBLE / 60) AS INTEGER), 1), CAST(ceil(hi * (m / b) * {FL}::DOUBLE / 60) AS INTEGER))) AS n FROM po)),
s6 AS (SELECT *, f + x AS state FROM (SELECT *, unnest(generate_series(1, m)) AS x FROM t6))"""

_QUIET = f"""{_TR}, n AS (SELECT count(*) AS s FROM st), q AS (SELECT i, j, p FROM ed WHERE i NOT IN (SELECT f + n * b FROM tf)
UNION ALL SELECT i, j, p * (1 - 1e-5::DOUBLE) FROM ed WHERE i IN (SELECT f + n * b FROM tf)
UNION ALL SELECT f + n * b, s + 1, 1e-5::DOUBLE FROM (SELECT tf.f, tf.n, tf.b, n.s FROM tf CROSS JOIN n) UNION ALL SELECT s + 1, s + 1, 1 - 1e-3::DOUBLE FROM n
UNION ALL SELECT s + 1, f + 1, 1e-3::DOUBLE / (SELECT count(*) FROM tf) FROM (SELECT tf.f, n.s FROM tf CROSS JOIN n))"""
_NEXT = """nb AS (SELECT st.state, st.pattern, st.ti, st.k, st.f, st.n * st.b AS z, a.f AS fa, a.n * a.b AS za, c.f AS fc, c.n * c.b AS zc FROM st LEFT JOIN tf a ON a.pattern = st.pattern AND a.ti = st.ti - 1 LEFT JOIN tf c ON c.pattern = st.pattern AND c.ti = st.ti + 1)"""

ORACLES = {
    "tempo_grid_log": f"""WITH {_PAT}, r AS (SELECT pattern, CAST(ceil(60 / (lo * {FL}::DOUBLE)) AS INTEGER) AS slow, CAST(floor(60 / (hi * {FL}::DOUBLE)) AS INTEGER) AS fast FROM pat),
g AS (SELECT DISTINCT pattern, slow, fast, p, CAST(floor(pow(2, log2(fast) + (log2(slow) - log2(fast)) * k / (p - 1)) + 0.5) AS INTEGER) AS n FROM (SELECT r.*, p, unnest(generate_series(0, p - 1)) AS k FROM (SELECT r.*, unnest(generate_series(10, 80)) AS p FROM r) r)),
c AS (SELECT pattern, p FROM g GROUP BY pattern, p, slow, fast HAVING count(*) >= least(slow - fast + 1, 10)), m AS (SELECT pattern, min(p) AS p FROM c GROUP BY 1)
SELECT pattern, CAST(row_number() OVER (PARTITION BY pattern ORDER BY n DESC) AS INTEGER) AS tempo_idx, n AS frames_per_beat FROM g JOIN m USING (pattern, p)""",
    "transitions_silence": f"WITH {_QUIET} SELECT CAST(i AS INTEGER) AS i, count(*) AS edges, round(sum(p), 9) AS total FROM q GROUP BY i",
    "state_neighbours": f"""WITH {_ST}, {_NEXT} SELECT CAST(state AS INTEGER) AS state, CAST(f + (k + z - 1) % z + 1 AS INTEGER) AS left, CAST(f + (k + 1) % z + 1 AS INTEGER) AS right,
CAST(fa + floor(k * za / z + 0.5) % za + 1 AS INTEGER) AS slower, CAST(fc + floor(k * zc / z + 0.5) % zc + 1 AS INTEGER) AS faster,
CAST(fa + (floor(k * za / z + 0.5) + za - 1) % za + 1 AS INTEGER) AS down_left, CAST(fc + (floor(k * zc / z + 0.5) + 1) % zc + 1 AS INTEGER) AS up_right FROM nb""",
    "tempo_grid_2015": f"WITH {_TP} SELECT pattern, ti AS tempo_idx, n AS frames_per_beat, round(60 / (n * {FL}::DOUBLE), 9) AS bpm FROM tp",
    "state_space_2015": f"WITH {_ST} SELECT CAST(state AS INTEGER) AS state, pattern, ti AS tempo_idx, CAST(k AS INTEGER) AS pos_idx, CAST(floor(k / n) + 1 AS INTEGER) AS beat, round(k * bar / (n * b) + 1, 9) AS position, round(bar / b / n, 12) AS tempo FROM st",
    "state_cells": f"WITH {_ST}, c AS (SELECT *, CAST(floor(k * bar / (n * b) * 64 + 1e-9::DOUBLE) + 1 AS INTEGER) AS cell FROM st) SELECT CAST(state AS INTEGER) AS state, pattern, cell, (pattern - 1) * 64 + cell AS gmm FROM c",
    "transitions_2015": f"WITH {_TR} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p, 12) AS p FROM ed",
    "transition_check": f"WITH {_TR} SELECT (SELECT count(*) FROM ed) AS edges, (SELECT CAST(sum(j) AS BIGINT) FROM ed WHERE i = 4002) AS targets_4002, (SELECT round(sum(p * p), 12) FROM ed WHERE i = 4002) AS squares_4002, (SELECT count(*) FROM (SELECT i FROM ed GROUP BY i HAVING abs(sum(p) - 1) > 1e-4)) AS faults, (SELECT count(*) FROM st) AS states",
    "state_space_2006": f"WITH {_06} SELECT CAST(state AS INTEGER) AS state, pattern, n AS tempo, CAST(x AS INTEGER) AS position, round(60 * n / (m / b * {FL}::DOUBLE), 9) AS bpm FROM s6",
    "transitions_2006": f"""WITH {_06}, mv(dn, q) AS (VALUES (-1, 0.01::DOUBLE), (0, 0.98::DOUBLE), (1, 0.01::DOUBLE)),
pp AS (SELECT a.pattern AS ri, a.n AS ni, c.pattern AS rj, c.n AS nj, mv.q / sum(mv.q) OVER (PARTITION BY a.pattern, a.n, c.pattern) AS q FROM t6 a CROSS JOIN mv JOIN t6 c ON c.n = a.n + dn),
pb AS (SELECT pp.*, q * pr.p / sum(q * pr.p) OVER (PARTITION BY ri, ni) AS z FROM pp JOIN pr ON pr.i = ri AND pr.j = rj),
sx AS (SELECT state AS i, pattern, n, x, m, (x + n - 1) % m + 1 AS y FROM s6),
e6 AS (SELECT sx.i, s6.state AS j, CASE WHEN y < sx.x THEN z WHEN ri = rj THEN q END AS p FROM sx JOIN pb ON ri = sx.pattern AND ni = sx.n JOIN s6 ON s6.pattern = rj AND s6.n = nj AND s6.x = sx.y)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p, 12) AS p FROM e6 WHERE p > 0""",
    "initial_by_meter": f"WITH {_ST}, w(pattern, p) AS (VALUES (1, 0.5::DOUBLE), (2, 0.3::DOUBLE), (3, 0.2::DOUBLE)) SELECT CAST(state AS INTEGER) AS state, round(p / count(*) OVER (PARTITION BY pattern), 15) AS p FROM st JOIN w USING (pattern)",
}

QUERIES = {f.__name__: f for f in (tempo_grid_2015, tempo_grid_log, state_space_2015, state_cells, transitions_2015, transition_check, transitions_silence, state_space_2006, transitions_2006, initial_by_meter, state_neighbours)}
