"""Transition models as edge lists (i, j, p), built by joins over the tempi of a model.

Only the tempi of two beats are combined with one another, never states with states: the
number of edges is states plus beats times squared tempi.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.plans.statespace import tempi_2006

EPS = sys.float_info.epsilon


def tempo_changes(tempi: DataFrame, lam: float) -> DataFrame:
    """ri, ti, rj, tj, p: change of tempo between any two patterns' tempi, normalised over the target tempi of a pattern.

    exp(-lam |n_j / n_i - 1|) for frames a beat n; values up to the machine epsilon are left out.
    """
    a = tempi.select(F.col("pattern").alias("ri"), F.col("tempo_idx").alias("ti"), F.col("frames_per_beat").alias("_ni"))
    b = tempi.select(F.col("pattern").alias("rj"), F.col("tempo_idx").alias("tj"), F.col("frames_per_beat").alias("_nj"))
    p = a.crossJoin(F.broadcast(b)).withColumn("p", F.exp(-lam * F.abs(F.col("_nj") / F.col("_ni") - 1))).where(F.col("p") > EPS)
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("ri", "ti", "rj"))).select("ri", "ti", "rj", "tj", "p")


def transitions_2015(states: DataFrame, pr: DataFrame, lam: float = 100.0, p2s: float = 0.0, pfs: float = 0.0, silence: bool = False) -> DataFrame:
    """Edges i, j, p. Inside a beat the next position follows for sure; tempi change at beats, patterns (i, j, p) at bars.

    With ``silence`` the state after the last one is entered at the end of bars with p2s, kept
    with 1 - pfs and left for the first position of any tempo; bar-end rows are scaled by 1 - p2s.
    """
    n = F.col("frames_per_beat")
    inner = states.where((F.col("pos_idx") + 1) % n != 0).select(F.col("state").alias("i"), (F.col("state") + 1).alias("j"), F.lit(1.0).alias("p"))
    tempi = states.groupBy("pattern", "tempo_idx", "frames_per_beat", "n_beats").agg(F.first("first").alias("first"))
    change = tempo_changes(tempi, lam)
    a = tempi.select(F.col("pattern").alias("ri"), F.col("tempo_idx").alias("ti"), n.alias("_ni"), F.col("first").alias("_fi"), "n_beats")
    b = tempi.select(F.col("pattern").alias("rj"), F.col("tempo_idx").alias("tj"), n.alias("_nj"), F.col("first").alias("_fj"))
    pairs = change.join(F.broadcast(a), ["ri", "ti"]).join(F.broadcast(b), ["rj", "tj"])
    beat = pairs.where("ri = rj and n_beats > 1").withColumn("_b", F.explode(F.sequence(F.lit(1), F.col("n_beats") - 1)))
    beat = beat.select((F.col("_fi") + F.col("_b") * F.col("_ni")).alias("i"), (F.col("_fj") + F.col("_b") * F.col("_nj") + 1).alias("j"), "p")
    keep = 1.0 - p2s if silence else 1.0
    bar = pairs.join(F.broadcast(pr.select(F.col("i").alias("ri"), F.col("j").alias("rj"), F.col("p").alias("_r"))), ["ri", "rj"]).withColumn("p", F.col("p") * F.col("_r")).where(F.col("p") > 0)
    bar = bar.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("ri", "ti")))
    bar = bar.select((F.col("_fi") + F.col("n_beats") * F.col("_ni")).alias("i"), (F.col("_fj") + 1).alias("j"), (F.col("p") * keep).alias("p"))
    out = inner.unionByName(beat).unionByName(bar)
    if silence:
        quiet = states.agg((F.max("state") + 1).alias("_s"))
        count = tempi.agg(F.count("*").alias("_n"))
        ends = tempi.crossJoin(F.broadcast(quiet)).select((F.col("first") + F.col("n_beats") * n).alias("i"), F.col("_s").alias("j"), F.lit(p2s).alias("p"))
        stay = quiet.select(F.col("_s").alias("i"), F.col("_s").alias("j"), F.lit(1.0 - pfs).alias("p"))
        leave = tempi.crossJoin(F.broadcast(quiet)).crossJoin(F.broadcast(count)).select(F.col("_s").alias("i"), (F.col("first") + 1).alias("j"), (F.lit(pfs) / F.col("_n")).alias("p"))
        out = out.unionByName(ends).unionByName(stay).unionByName(leave)
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "p")


def transitions_2006(patterns: DataFrame, pr: DataFrame, frame_length: float, max_positions: int, pn: float = 0.01, pn_down: float | None = None) -> DataFrame:
    """Edges i, j, p. Each frame moves the position by the tempo, which stays, falls or rises by one (pn) within the target's range;
    a pattern may change where the bar ends. States are numbered as in ``states_2006``.
    """
    down = pn if pn_down is None else pn_down
    t = tempi_2006(patterns, frame_length, max_positions)
    w = Window.orderBy("pattern", "tempo").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("first", F.coalesce(F.sum("positions").over(w), F.lit(0)).cast("int"))
    step = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(q)).alias("q")) for d, q in ((-1, down), (0, 1 - pn - down), (1, pn))]))
    a = t.select(F.col("pattern").alias("ri"), F.col("tempo").alias("ni"), F.col("first").alias("fi"), F.col("positions").alias("mi"), step.alias("s")).select("ri", "ni", "fi", "mi", (F.col("ni") + F.col("s.d")).alias("nj"), "s.q")
    b = t.select(F.col("pattern").alias("rj"), F.col("tempo").alias("nj"), F.col("first").alias("fj"), F.col("positions").alias("mj"))
    pairs = a.join(F.broadcast(b), "nj")
    # Within the range of a target pattern the three chances sum to one.
    pairs = pairs.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("ri", "ni", "rj")))
    bar = pairs.join(F.broadcast(pr.select(F.col("i").alias("ri"), F.col("j").alias("rj"), F.col("p").alias("_r"))), ["ri", "rj"]).withColumn("q", F.col("q") * F.col("_r")).where("q > 0")
    bar = bar.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("ri", "ni")))
    # The last ni positions of a bar end in the next one.
    cross = bar.withColumn("m", F.explode(F.sequence(F.col("mi") - F.col("ni") + 1, F.col("mi"))))
    same = pairs.where("ri = rj and mi > ni").withColumn("m", F.explode(F.sequence(F.lit(1), F.col("mi") - F.col("ni"))))
    to = (F.col("m") + F.col("ni") - 1) % F.col("mi") + 1
    edges = cross.select((F.col("fi") + F.col("m")).alias("i"), (F.col("fj") + to).alias("j"), F.col("q").alias("p"), (to <= F.col("mj")).alias("_ok"))
    inner = same.select((F.col("fi") + F.col("m")).alias("i"), (F.col("fj") + to).alias("j"), F.col("q").alias("p"), F.lit(True).alias("_ok"))
    return edges.unionByName(inner).where("_ok and p > 0").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "p")


def check_transitions(edges: DataFrame, states: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """i, total of states whose outgoing chances sum neither to 1 nor to 0, and of edges from or to no state (total null)."""
    rows = edges.groupBy("i").agg(F.sum("p").alias("total")).where((F.abs(F.col("total") - 1) > tolerance) & (F.abs("total") > tolerance))
    known = states.select("state")
    lost = edges.join(F.broadcast(known), edges["i"] == known["state"], "left_anti").select("i").union(edges.join(F.broadcast(known), edges["j"] == known["state"], "left_anti").select("i")).distinct()
    return rows.unionByName(lost.select("i", F.lit(None).cast("double").alias("total")))
