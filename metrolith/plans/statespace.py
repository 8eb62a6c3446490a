"""State spaces of the bar pointer as tables, built from a few pattern rows.

Patterns are (pattern, num, den, n_beats, bar, min_bpm, max_bpm), ``bar`` in whole notes, so
that the largest position is 1 + bar. Everything derives from these rows by ``sequence`` and
``explode``; a model has thousands of states, whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERNS = "pattern int, num int, den int, n_beats int, bar double, min_bpm double, max_bpm double"


def tempo_grid(min_bpm: float, max_bpm: float, frame_length: float, n_tempi: int | None = None) -> list[int]:
    """Frames a beat, slowest first: all whole numbers between the tempi, or about n of them, evenly on a log scale."""
    slow, fast = math.ceil(60 / (min_bpm * frame_length)), math.floor(60 / (max_bpm * frame_length))
    if n_tempi is None:
        return list(range(slow, fast - 1, -1))
    want, points = min(slow - fast + 1, n_tempi), n_tempi
    while True:
        a, b = math.log2(fast), math.log2(slow)
        grid = {math.floor(2 ** (a + (b - a) * k / max(points - 1, 1)) + 0.5) for k in range(points)}
        if len(grid) >= want:
            return sorted(grid, reverse=True)
        points += 1


def tempi_2015(patterns: DataFrame, frame_length: float, n_tempi: int | None = None) -> DataFrame:
    """Patterns with tempo_idx and frames_per_beat, slowest first."""
    if n_tempi is None:
        slow, fast = F.ceil(60.0 / (F.col("min_bpm") * frame_length)), F.floor(60.0 / (F.col("max_bpm") * frame_length))
        grid = F.when(slow >= fast, F.sequence(slow.cast("int"), fast.cast("int"), F.lit(-1)))
        return patterns.select("*", F.posexplode(grid).alias("tempo_idx", "frames_per_beat")).withColumn("tempo_idx", F.col("tempo_idx") + 1)
    rows = [(r.pattern, i, n) for r in patterns.collect() for i, n in enumerate(tempo_grid(r.min_bpm, r.max_bpm, frame_length, n_tempi), 1)]
    return patterns.join(patterns.sparkSession.createDataFrame(rows, "pattern int, tempo_idx int, frames_per_beat int"), "pattern")


def _offsets(tempi: DataFrame, size) -> DataFrame:
    """Tempi with ``first``, the states before a tempo's; a window over the few tempi of a model."""
    w = Window.orderBy("pattern", "tempo_idx").rowsBetween(Window.unboundedPreceding, -1)
    return tempi.withColumn("first", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int"))


def states_2015(patterns: DataFrame, frame_length: float, n_tempi: int | None = None) -> DataFrame:
    """state (from 1), pattern, tempo_idx, frames_per_beat, pos_idx (from 0), beat, position, tempo, bpm, n_beats, bar, first.

    A tempo of n frames a beat has n positions a beat; states run by pattern, tempo (slowest
    first) and position. Tempo is in positions (whole notes) a frame.
    """
    n, b = F.col("frames_per_beat"), F.col("n_beats")
    t = _offsets(tempi_2015(patterns, frame_length, n_tempi), n * b)
    s = t.withColumn("pos_idx", F.explode(F.sequence(F.lit(0), n * b - 1)))
    k = F.col("pos_idx")
    return s.select(
        (F.col("first") + k + 1).alias("state"), "pattern", "tempo_idx", "frames_per_beat", "pos_idx", (F.floor(k / n) + 1).cast("int").alias("beat"),
        (k * F.col("bar") / (n * b) + 1).alias("position"), (F.col("bar") / b / n).alias("tempo"), (60.0 / (n * frame_length)).alias("bpm"), "n_beats", "bar", "first",
    )


def positions_2006(patterns: DataFrame, max_positions: int) -> DataFrame:
    """Patterns with positions: the longest bar has ``max_positions``, shorter ones their share."""
    longest = patterns.agg(F.max("bar").alias("_l"))
    return patterns.crossJoin(F.broadcast(longest)).withColumn("positions", F.floor(F.lit(max_positions) * F.col("bar") / F.col("_l") + 0.5).cast("int")).drop("_l")


def tempi_2006(patterns: DataFrame, frame_length: float, max_positions: int) -> DataFrame:
    """Patterns with positions and every whole tempo (positions a frame) of their range."""
    p = positions_2006(patterns, max_positions)
    per_beat = F.col("positions") / F.col("n_beats")
    lo = F.floor(F.col("min_bpm") * per_beat * frame_length / 60.0).cast("int")
    hi = F.ceil(F.col("max_bpm") * per_beat * frame_length / 60.0).cast("int")
    return p.withColumn("lo", F.greatest(lo, F.lit(1))).withColumn("hi", hi).withColumn("tempo", F.explode(F.sequence("lo", "hi")))


def states_2006(patterns: DataFrame, frame_length: float, max_positions: int) -> DataFrame:
    """state, pattern, tempo, position (from 1), bpm: the grid of positions and whole tempi."""
    t = tempi_2006(patterns, frame_length, max_positions)
    w = Window.orderBy("pattern", "tempo").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("first", F.coalesce(F.sum("positions").over(w), F.lit(0)).cast("int"))
    s = t.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("positions"))))
    bpm = 60.0 * F.col("tempo") / (F.col("positions") / F.col("n_beats") * frame_length)
    return s.select((F.col("first") + F.col("position")).alias("state"), "pattern", "tempo", "position", bpm.alias("bpm"), "n_beats", "positions", "bar")


def state_cells(states: DataFrame, div: int, max_cells: int) -> DataFrame:
    """state, pattern, cell, gmm: the cell of a state's position, and the number of its mixture."""
    cell = (F.floor((F.col("position") - 1) * div + 1e-9) + 1).cast("int")
    return states.select("state", "pattern", cell.alias("cell")).withColumn("gmm", (F.col("pattern") - 1) * max_cells + F.col("cell"))


def neighbours_2015(states: DataFrame) -> DataFrame:
    """state, left, right, slower, faster and the diagonals down_left and up_right: states next to a state in position and tempo; null beyond the edge."""
    size = F.col("frames_per_beat") * F.col("n_beats")
    s = states.select("state", "pattern", "tempo_idx", "pos_idx", size.alias("size"), "first")
    spans = states.groupBy("pattern", "tempo_idx").agg(F.first("first").alias("f"), F.count("*").alias("n"))

    def other(step: int):
        return spans.select("pattern", (F.col("tempo_idx") - step).alias("tempo_idx"), F.col("f").alias(f"f{step}"), F.col("n").alias(f"n{step}"))

    j = s.join(F.broadcast(other(-1)), ["pattern", "tempo_idx"], "left").join(F.broadcast(other(1)), ["pattern", "tempo_idx"], "left")
    at = lambda f, n, shift: F.col(f) + F.pmod(F.floor(F.col("pos_idx") * F.col(n) / F.col("size") + 0.5) + shift, F.col(n)) + 1
    ring = lambda shift: F.col("first") + F.pmod(F.col("pos_idx") + shift, F.col("size")) + 1
    cols = {"left": ring(-1), "right": ring(1), "slower": at("f-1", "n-1", 0), "faster": at("f1", "n1", 0), "down_left": at("f-1", "n-1", -1), "up_right": at("f1", "n1", 1)}
    cols = {k: (F.col("first") + F.pmod(F.col("pos_idx") + (1 if k == "right" else -1), F.col("size")) + 1 if k in ("left", "right") else v) for k, v in cols.items()}
    return j.select("state", *[v.cast("int").alias(k) for k, v in cols.items()])


def initial_distribution(states: DataFrame, prior: DataFrame | None = None, silence: bool = False) -> DataFrame:
    """state, p: uniform, or by a prior over patterns (pattern, p); all on the last state (silence) if there is one."""
    if silence:
        last = states.agg((F.max("state") + 1).alias("state"))
        return states.select("state", F.lit(0.0).alias("p")).unionByName(last.select("state", F.lit(1.0).alias("p")))
    if prior is None:
        n = states.agg(F.count("*").alias("_n"))
        return states.crossJoin(F.broadcast(n)).select("state", (1.0 / F.col("_n")).alias("p"))
    n = states.groupBy("pattern").agg(F.count("*").alias("_n"))
    w = states.join(F.broadcast(prior), "pattern").join(F.broadcast(n), "pattern").select("state", (F.col("p") / F.col("_n")).alias("p"))
    total = w.agg(F.sum("p").alias("_t"))
    return w.crossJoin(F.broadcast(total)).select("state", (F.col("p") / F.col("_t")).alias("p"))


def make_patterns(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PATTERNS)
