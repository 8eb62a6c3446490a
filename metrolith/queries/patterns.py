"""Queries of patterns, mixtures and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.functions.series import event_series
from metrolith.operators import observation as ob
from metrolith.operators import patterns as pt
from metrolith.queries.dealt import table
from metrolith.queries.signal import SER

TYPES = ("click", "error", "purchase", "signup", "view")


def _sym(spark, d):
    code = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int")
    return event_series(table(spark, d, "events")).select("file_id", F.col("frame").alias("bar_no"), code.alias("pattern"))


def pattern_transitions(spark, d):
    return pt.transition_matrix(_sym(spark, d)).withColumn("p", F.round("p", 9))


def pattern_prior(spark, d):
    return pt.pattern_prior(_sym(spark, d)).withColumn("p", F.round("p", 9))


def bar_transitions(spark, d):
    """Patterns that follow one another in the bars of a file."""
    b = table(spark, d, "bars").where("bar2file is not null and bar2cluster is not null").select(F.col("bar2file").alias("file_id"), "bar_no", "bar_id", F.col("bar2cluster").alias("pattern")).distinct()
    return pt.transition_matrix(b, ("bar_no", "bar_id")).withColumn("p", F.round("p", 9))


def label_clusters(spark, d):
    m = table(spark, d, "meters").where("num between 1 and 32").select("file_id", "section_no", "num", F.coalesce("den", F.lit(4)).alias("den")).distinct()
    return pt.label_clusters(m)


def cluster_budgets(spark, d):
    m = table(spark, d, "meters").where("num between 1 and 32").select("file_id", "section_no", "num", F.coalesce("den", F.lit(4)).alias("den")).distinct()
    counts = {(r.num, r.den): r.n for r in m.groupBy("num", "den").agg(F.count("*").alias("n")).collect()}
    rows = [(a, b, n, mode) for mode in ("data", "equal") for (a, b), n in pt.cluster_budget(counts, 40, mode).items()]
    return spark.createDataFrame(rows, "num int, den int, clusters int, mode string")


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])


_DIMS = [f"x{i}" for i in range(4)]
_START = [[-0.1] * 4, [0.0] * 4, [0.1] * 4]


def kmeans_fixed_init(spark, d):
    p = _points(spark, d)
    return pt.assign_nearest(p, _DIMS, pt.lloyd(p, _DIMS, _START, 5)).select("vec_id", "cluster")


def kmeans_per_meter(spark, d):
    p = _points(spark, d).withColumn("num", (F.col("vec_id") % 2 + 3).cast("int")).withColumn("den", F.lit(4))
    return pt.kmeans_per_meter(p, _DIMS, 6).select("vec_id", "pattern", "name")


def kmeans_checks(spark, d):
    """Meters with their points and clusters, and whether every point is nearest to the mean of its own cluster."""
    p = _points(spark, d).withColumn("num", (F.col("vec_id") % 2 + 3).cast("int")).withColumn("den", F.lit(4))
    got = p.join(pt.kmeans_per_meter(p, _DIMS, 6).select("vec_id", "pattern"), "vec_id")
    means = got.groupBy("num", "pattern").agg(*[F.avg(c).alias(f"m{c}") for c in _DIMS])
    far = sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in _DIMS)
    each = got.withColumnRenamed("pattern", "own").join(F.broadcast(means), "num").groupBy("num", "vec_id", "own").agg(F.min(far).alias("least"), F.min(F.when(F.col("own") == F.col("pattern"), far)).alias("mine"))
    return each.groupBy("num").agg(F.count("*").alias("points"), F.count_distinct("own").alias("clusters"), F.min(F.col("mine") <= F.col("least") + 1e-9).alias("nearest"))


def _values2(spark, d):
    v = table(spark, d, "lineitem")
    return v.select("l_returnflag", F.array("l_quantity", F.col("l_quantity") * 0.01 + F.col("l_discount")).alias("x"))


def gmm_joint_moments(spark, d):
    """Mean and covariances of fitted mixtures of vectors, which are those of their values."""
    fit = ob.fit_joint_mixtures(_values2(spark, d), ["l_returnflag"], [1, 2])
    w = F.col("weight")
    mean = [F.sum(w * F.col("mean")[i]) for i in (0, 1)]
    second = lambda i, j: F.sum(w * (F.col("cov")[2 * i + j] + F.col("mean")[i] * F.col("mean")[j]))
    s = fit.groupBy("l_returnflag").agg(F.sum("weight").alias("w"), mean[0].alias("a"), mean[1].alias("b"), second(0, 0).alias("aa"), second(0, 1).alias("ab"), second(1, 1).alias("bb"))
    return s.select("l_returnflag", F.round("w", 6).alias("weight"), F.round("a", 4).alias("mean_a"), F.round("b", 5).alias("mean_b"), F.round(F.col("aa") - F.col("a") ** 2, 3).alias("var_a"), F.round(F.col("ab") - F.col("a") * F.col("b"), 5).alias("cov"), F.round(F.col("bb") - F.col("b") ** 2, 5).alias("var_b"))


#: Mixtures of two features: pattern, cell, comp, weight, mean, covariance.
_JOINT = [(p, c, k, w, [20.0 * c + 30.0 * k, 10.0 * p + 25.0 * k], [400.0 * k, 60.0 * c, 60.0 * c, 250.0 + 50.0 * p]) for p in (1, 2) for c in (1, 2) for k, w in ((1, 0.4), (2, 0.6))]


def _joint(spark, d):
    s = event_series(table(spark, d, "events")).select("file_id", "frame", F.explode(F.array(F.struct(F.lit(1).alias("dim"), F.col("x").alias("value")), F.struct(F.lit(2).alias("dim"), (F.col("x") * 0.5 + 10).alias("value")))).alias("f")).select("file_id", "frame", "f.*")
    return s, spark.createDataFrame([(*r, [1, 2]) for r in _JOINT], "pattern int, cell int, comp int, weight double, mean array<double>, cov array<double>, dims array<int>")


def joint_likelihood(spark, d):
    return ob.joint_likelihood(*_joint(spark, d)).withColumn("lik", F.round(F.col("lik") * 1000, 9))


def likelihood_tensor(spark, d):
    """All likelihood columns of a frame in one array, from the kernel of the decoder."""
    s, gmm = _joint(spark, d)
    x = ob.feature_vectors(s, [1, 2])
    lik = ob.likelihood_arrays(x, ob.Mixtures.of(gmm, lambda p, c: (p - 1) * 2 + c - 1, 4))
    return lik.select("file_id", "frame", F.posexplode("lik").alias("pos", "lik")).select("file_id", "frame", (F.floor(F.col("pos") / 2) + 1).cast("int").alias("pattern"), (F.col("pos") % 2 + 1).alias("cell"), F.round(F.col("lik") * 1000, 9).alias("lik"))

_MIX = [(0.3, 20.0, 90.0), (0.7, 60.0, 900.0)]


def gmm_density(spark, d):
    return table(spark, d, "events").select("event_id", F.round(ob.mixture_density(F.col("value"), _MIX), 9).alias("density"))


def gmm_density_2d(spark, d):
    lit = F.lit
    g = 0.4 * ob.gaussian2(F.col("l_quantity"), F.col("l_discount"), lit(10.0), lit(0.02), lit(40.0), lit(0.01), lit(0.001)) + 0.6 * ob.gaussian2(F.col("l_quantity"), F.col("l_discount"), lit(30.0), lit(0.06), lit(90.0), lit(-0.02), lit(0.002))
    return table(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n")).select("l_quantity", "l_discount", "n", F.round(g, 9).alias("density"))


def gmm_em_1d(spark, d):
    fit = ob.fit_mixtures(table(spark, d, "events").select("event_type", F.col("value").alias("x")), ["event_type"], 5)
    return fit.select("event_type", "comp", F.round("weight", 5).alias("weight"), F.round("mean", 4).alias("mean"), F.round("var", 3).alias("var"))


def mixture_means(spark, d):
    fit = ob.fit_mixtures(table(spark, d, "events").select("event_type", F.col("value").alias("x")), ["event_type"], 5)
    return ob.mixture_means(fit, ("event_type",)).withColumn("mean", F.round("mean", 5))


def rnn_likelihood(spark, d):
    s = event_series(table(spark, d, "events")).select("file_id", "frame", (F.col("x") / 500.0).alias("x"))
    return ob.activation_likelihood(s, spark.createDataFrame([(1, 4), (2, 6)], "pattern int, cells int")).withColumn("lik", F.round("lik", 9))


def gmm_likelihood(spark, d):
    s = event_series(table(spark, d, "events")).select("file_id", "frame", F.explode(F.array(F.struct(F.lit(1).alias("dim"), F.col("x").alias("value")), F.struct(F.lit(2).alias("dim"), (F.col("x") * 0.5).alias("value")))).alias("f")).select("file_id", "frame", "f.dim", "f.value")
    gmm = spark.createDataFrame([(p, c, k, i + 1, w, m * c / k, v) for p in (1, 2) for c in (1, 2, 3) for k in (1, 2) for i, (w, m, v) in enumerate(_MIX)], "pattern int, cell int, dim int, comp int, weight double, mean double, var double")
    return ob.mixture_likelihood(s, gmm).withColumn("lik", F.round("lik", 9))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("w"), "o_orderstatus")


def systematic_resample(spark, d):
    return ob.systematic_resample(_orders(spark, d)).select("file_id", "pid", F.col("copies").cast("long").alias("copies"))


def ess_logsumexp(spark, d):
    w = ob.log_weights(_orders(spark, d).select("file_id", (F.col("w") / 10000.0).alias("logw")))
    s = w.groupBy("file_id").agg(F.first("logsum").alias("logsum"))
    return ob.effective_size(w).join(s, "file_id").select("file_id", F.round("ess", 6).alias("ess"), F.round("logsum", 6).alias("logsum"))


def weight_topk_groups(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = ob.heaviest_groups(o.select(F.col("c_nationkey").alias("file_id"), F.col("c_custkey").alias("group"), F.col("o_totalprice").alias("w")), 3)
    return top.select("file_id", "group", F.round("weight", 2).alias("weight"))


_SYM = f"{SER}, sym AS (SELECT file_id, frame, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS pattern FROM ser)"
_DISTINCT = "m AS (SELECT DISTINCT file_id, section_no, num, coalesce(den, 4) AS den FROM meters WHERE num BETWEEN 1 AND 32)"


def _lloyd_sql() -> str:
    dist = lambda a: " + ".join(f"(x{i} - {a}.x{i}) * (x{i} - {a}.x{i})" for i in range(4))
    out = ["p AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(4)) + " FROM embeddings)", "c0(k, x0, x1, x2, x3) AS (VALUES " + ", ".join(f"({k}, " + ", ".join(f"{v!r}::DOUBLE" for v in c) + ")" for k, c in enumerate(_START, 1)) + ")"]
    for s in range(6):
        out.append(f"a{s} AS (SELECT vec_id, x0, x1, x2, x3, k FROM (SELECT p.*, c.k, row_number() OVER (PARTITION BY vec_id ORDER BY {dist('c').replace('(x', '(p.x')}, c.k) AS r FROM p CROSS JOIN c{s} c) WHERE r = 1)")
        if s < 5:
            out.append(f"c{s + 1} AS (SELECT c.k, " + ", ".join(f"coalesce(avg(a.x{i}), any_value(c.x{i})) AS x{i}" for i in range(4)) + f" FROM c{s} c LEFT JOIN a{s} a ON a.k = c.k GROUP BY c.k)")
    return "WITH " + ", ".join(out) + " SELECT vec_id, CAST(k AS INTEGER) AS cluster FROM a5"


def _g(x: str, m: str, v: str) -> str:
    return f"exp(-(({x}) - ({m})) * (({x}) - ({m})) / (2 * ({v}))) / sqrt(2 * pi() * ({v}))"


def _em_sql(last: str) -> str:
    out = ["e0 AS (SELECT event_type, 0.5::DOUBLE AS w1, avg(value) - sqrt(var_pop(value)) AS m1, var_pop(value) + 1e-10::DOUBLE AS v1, 0.5::DOUBLE AS w2, avg(value) + sqrt(var_pop(value)) AS m2, var_pop(value) + 1e-10::DOUBLE AS v2 FROM events GROUP BY 1)"]
    for s in range(5):
        out.append(f"r{s} AS (SELECT e.event_type, value AS x, w1 * {_g('value', 'm1', 'v1')} AS a, w2 * {_g('value', 'm2', 'v2')} AS b FROM events e JOIN e{s} USING (event_type))")
        out.append(f"q{s} AS (SELECT event_type, x, a / (a + b) AS r FROM r{s})")
        out.append(f"e{s + 1} AS (SELECT event_type, avg(r) AS w1, sum(r * x) / sum(r) AS m1, sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) * (sum(r * x) / sum(r)) + 1e-10::DOUBLE AS v1, avg(1 - r) AS w2, sum((1 - r) * x) / sum(1 - r) AS m2, sum((1 - r) * x * x) / sum(1 - r) - (sum((1 - r) * x) / sum(1 - r)) * (sum((1 - r) * x) / sum(1 - r)) + 1e-10::DOUBLE AS v2 FROM q{s} GROUP BY 1)")
    return "WITH " + ", ".join(out) + " " + last


_G2 = "w * exp(-0.5::DOUBLE * (c * (l_quantity - mx) * (l_quantity - mx) - 2 * b * (l_quantity - mx) * (l_discount - my) + a * (l_discount - my) * (l_discount - my)) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b))"

_JOINT_SQL = f"""WITH {SER}, k(pattern, cell, w, ma, mb, a, b, c) AS (VALUES {", ".join(f"({p}, {c}, {w!r}::DOUBLE, {m[0]!r}::DOUBLE, {m[1]!r}::DOUBLE, {v[0]!r}::DOUBLE, {v[1]!r}::DOUBLE, {v[3]!r}::DOUBLE)" for p, c, _, w, m, v in _JOINT)}),
e AS (SELECT file_id, frame, pattern, cell, w, a, b, c, x - ma AS da, x * 0.5::DOUBLE + 10 - mb AS db FROM ser CROSS JOIN k)
SELECT file_id, frame, pattern, cell, round(1000 * sum(w * exp(-0.5::DOUBLE * (c * da * da - 2 * b * da * db + a * db * db) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b))), 9) AS lik FROM e GROUP BY ALL"""

ORACLES = {
    "joint_likelihood": _JOINT_SQL,
    "likelihood_tensor": _JOINT_SQL,
    "kmeans_checks": "SELECT CAST(vec_id % 2 + 3 AS INTEGER) AS num, count(*) AS points, CAST(3 AS BIGINT) AS clusters, true AS nearest FROM embeddings GROUP BY 1",
    "gmm_joint_moments": "WITH v AS (SELECT l_returnflag, l_quantity AS a, l_quantity * 0.01::DOUBLE + l_discount AS b FROM lineitem) SELECT l_returnflag, 1.0::DOUBLE AS weight, round(avg(a), 4) AS mean_a, round(avg(b), 5) AS mean_b, round(var_pop(a), 3) AS var_a, round(covar_pop(a, b), 5) AS cov, round(var_pop(b), 5) AS var_b FROM v GROUP BY 1",
    "pattern_transitions": f"WITH {_SYM}, b AS (SELECT pattern AS i, lead(pattern) OVER (PARTITION BY file_id ORDER BY frame) AS j FROM sym), n AS (SELECT i, j, count(*) AS n FROM b WHERE j IS NOT NULL GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(n / sum(n) OVER (PARTITION BY i), 9) AS p FROM n",
    "pattern_prior": f"WITH {_SYM} SELECT CAST(pattern AS INTEGER) AS pattern, round(count(*) / (SELECT count(*) FROM sym), 9) AS p FROM sym GROUP BY pattern",
    "bar_transitions": "WITH d AS (SELECT DISTINCT bar2file, bar_no, bar_id, bar2cluster AS pattern FROM bars WHERE bar2file IS NOT NULL AND bar2cluster IS NOT NULL), b AS (SELECT pattern AS i, lead(pattern) OVER (PARTITION BY bar2file ORDER BY bar_no, bar_id) AS j FROM d), n AS (SELECT i, j, count(*) AS n FROM b WHERE j IS NOT NULL GROUP BY ALL) SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 9) AS p FROM n",
    "label_clusters": f"WITH {_DISTINCT} SELECT file_id, section_no, num, den, CAST(dense_rank() OVER (ORDER BY num, den) AS INTEGER) AS pattern, 'set-' || num || '-' || den || '_1' AS name FROM m",
    "cluster_budgets": f"""WITH {_DISTINCT}, c AS (SELECT num, den, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT greatest(40, count(*)) AS k, count(*) AS c, sum(n) AS t FROM c),
s AS (SELECT num, den, o.mode, CASE o.mode WHEN 'data' THEN n * k / t ELSE k / c.cnt END AS share, k FROM (SELECT c.*, count(*) OVER () AS cnt FROM c) c CROSS JOIN k CROSS JOIN (VALUES ('data'), ('equal')) o(mode)),
u AS (SELECT *, greatest(1, CAST(ceil(share) AS INTEGER)) AS up, CAST(sum(greatest(1, CAST(ceil(share) AS INTEGER))) OVER (PARTITION BY mode) AS INTEGER) - k AS over FROM s),
v AS (SELECT num, den, mode, over, row_number() OVER (PARTITION BY mode ORDER BY share - up + s, num, den) AS r FROM (SELECT *, unnest(generate_series(1, up - 1)) AS s FROM u)),
w AS (SELECT num, den, mode, count(*) AS less FROM v WHERE r <= over GROUP BY ALL)
SELECT num, den, CAST(up - coalesce(less, 0) AS INTEGER) AS clusters, mode FROM u LEFT JOIN w USING (num, den, mode)""",
    "kmeans_fixed_init": _lloyd_sql(),
    "gmm_density": "SELECT event_id, round(" + " + ".join(f"{w!r}::DOUBLE * {_g('value', f'{m!r}::DOUBLE', f'{v!r}::DOUBLE')}" for w, m, v in _MIX) + ", 9) AS density FROM events",
    "gmm_density_2d": f"WITH k(w, mx, my, a, b, c) AS (VALUES (0.4::DOUBLE, 10.0::DOUBLE, 0.02::DOUBLE, 40.0::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE), (0.6::DOUBLE, 30.0::DOUBLE, 0.06::DOUBLE, 90.0::DOUBLE, -0.02::DOUBLE, 0.002::DOUBLE)), l AS (SELECT l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_quantity, l_discount, any_value(n) AS n, round(sum({_G2}), 9) AS density FROM l CROSS JOIN k GROUP BY l_quantity, l_discount",
    "gmm_em_1d": _em_sql("SELECT event_type, 1 AS comp, round(w1, 5) AS weight, round(m1, 4) AS mean, round(v1, 3) AS var FROM e5 UNION ALL SELECT event_type, 2, round(w2, 5), round(m2, 4), round(v2, 3) FROM e5"),
    "mixture_means": _em_sql("SELECT event_type, round(w1 * m1 + w2 * m2, 5) AS mean FROM e5"),
    "rnn_likelihood": f"WITH {SER}, k(pattern, cells) AS (VALUES (1, 4), (2, 6)), g AS (SELECT pattern, cells, unnest(generate_series(1, cells)) AS cell FROM k) SELECT file_id, frame, pattern, CAST(cell AS INTEGER) AS cell, round(CASE WHEN cell = 1 THEN x / 500.0::DOUBLE ELSE (1 - x / 500.0::DOUBLE) / (cells - 1) END, 9) AS lik FROM ser CROSS JOIN g",
    "gmm_likelihood": f"""WITH {SER}, k AS (SELECT p.v AS pattern, c.v AS cell, z.v AS dim, m.w, m.m * c.v / z.v AS mean, m.v AS var FROM (VALUES (1), (2)) p(v) CROSS JOIN (VALUES (1), (2), (3)) c(v) CROSS JOIN (VALUES (1), (2)) z(v) CROSS JOIN (VALUES (0.3::DOUBLE, 20.0::DOUBLE, 90.0::DOUBLE), (0.7::DOUBLE, 60.0::DOUBLE, 900.0::DOUBLE)) m(w, m, v)),
f AS (SELECT file_id, frame, 1 AS dim, x FROM ser UNION ALL SELECT file_id, frame, 2, x * 0.5::DOUBLE FROM ser), q AS (SELECT file_id, frame, pattern, cell, dim, sum(w * {_g('x', 'mean', 'var')}) AS g FROM f JOIN k USING (dim) GROUP BY ALL) SELECT file_id, frame, pattern, cell, round(product(g), 9) AS lik FROM q GROUP BY ALL""",
    "systematic_resample": """WITH o AS (SELECT o_custkey AS file_id, o_orderkey AS pid, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS q, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS w, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT file_id, pid, CAST(least(greatest(ceil(q * n - 0.5::DOUBLE - 1e-9::DOUBLE), 0), n) - least(greatest(ceil((q - w) * n - 0.5::DOUBLE - 1e-9::DOUBLE), 0), n) AS BIGINT) AS copies FROM o""",
    "ess_logsumexp": "WITH l AS (SELECT o_custkey AS file_id, o_totalprice / 10000.0::DOUBLE AS lw FROM orders), m AS (SELECT file_id, max(lw) AS m FROM l GROUP BY 1), s AS (SELECT l.file_id, any_value(m) + ln(sum(exp(lw - m))) AS logsum FROM l JOIN m USING (file_id) GROUP BY 1) SELECT l.file_id, round(1 / sum(exp(2 * (lw - logsum))), 6) AS ess, round(any_value(logsum), 6) AS logsum FROM l JOIN s USING (file_id) GROUP BY 1",
    "weight_topk_groups": "WITH s AS (SELECT c_nationkey AS file_id, c_custkey AS \"group\", sum(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT file_id, \"group\", round(w, 2) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY w DESC, \"group\") <= 3",
}

QUERIES = {
    f.__name__: f
    for f in (pattern_transitions, pattern_prior, bar_transitions, label_clusters, cluster_budgets, kmeans_fixed_init, kmeans_per_meter, kmeans_checks, gmm_joint_moments, joint_likelihood, likelihood_tensor, gmm_density, gmm_density_2d, gmm_em_1d, mixture_means, rnn_likelihood, gmm_likelihood, systematic_resample, ess_logsumexp, weight_topk_groups)
}
