"""Bars from beat annotations, and feature values at positions in a bar.

Beats are (file_id, beat_idx, t, beat_no) with beat_idx dense from 1 in each file. Windows look
a bounded number of beats around, so files are cut into blocks and none needs to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions.series import blocked

#: A period longer than the one before by this factor is a pause; the number such a beat gets.
PAUSE, PAUSED = 1.8, 99
#: Files with bars of more beats are not cut into blocks.
MOST_BEATS = 64


def dense_beats(beats: DataFrame) -> DataFrame:
    """Beats numbered from 1 in order of their index, without repeats or null times."""
    rows = beats.where("file_id is not null and t is not null and beat_no is not null").select("file_id", F.col("beat_idx").cast("long").alias("_i"), "t", F.col("beat_no").cast("long").alias("beat_no")).distinct()
    w = Window.partitionBy("file_id").orderBy("_i", "t", "beat_no")
    return rows.select("file_id", F.row_number().over(w).cast("long").alias("beat_idx"), "t", "beat_no")


def predominant_meter(beats: DataFrame) -> DataFrame:
    """file_id, meter: the largest number from 2 that is at least half as frequent as each smaller one from 2; files without any are left out."""
    hist = beats.where("beat_no >= 2").groupBy("file_id", "beat_no").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file_id").orderBy("beat_no").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("m", F.max("n").over(w)).where(2 * F.col("n") >= F.coalesce("m", F.lit(0))).groupBy("file_id").agg(F.max("beat_no").cast("int").alias("meter"))


def full_bars(beats: DataFrame) -> DataFrame:
    """file_id, beat_idx of the first beat of every complete bar, and the file's meter.

    A bar of m beats starts where the numbers rise by one m - 1 times, fall back by m - 1 and
    rise again. Beats before a pause are marked first, which breaks the bars they are in. Bars may have any number of beats.
    """
    every = beats.join(predominant_meter(beats), "file_id")
    rows, own = blocked(every, MOST_BEATS + 2, 3, order="beat_idx", cut=F.col("meter") <= MOST_BEATS)
    w = Window.partitionBy("file_id", "_block").orderBy("beat_idx")
    gap, last = F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w)
    rows = rows.withColumn("_no", F.when(gap > PAUSE * last, PAUSED).otherwise(F.col("beat_no")))
    rows = rows.withColumn("_d", F.col("_no") - F.lag("_no").over(w))
    # Rows since the numbers last failed to rise by one.
    broken = F.last(F.when(F.coalesce(F.col("_d") != 1, F.lit(True)), F.col("beat_idx")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", F.col("beat_idx") - broken)
    ends = (F.lag("_run").over(w) >= F.col("meter") - 1) & (F.col("_d") == 1 - F.col("meter")) & (F.lead("_d").over(w) == 1)
    found = rows.withColumn("_bar", F.coalesce(ends, F.lit(False))).where(own & F.col("_bar"))
    return found.select("file_id", (F.col("beat_idx") - F.col("meter")).alias("beat_idx"), "meter")


def bar_beats(beats: DataFrame, bars: DataFrame) -> DataFrame:
    """Beats with in_bar: whether they are in a full bar or are the downbeat after one."""
    covered = bars.select("file_id", F.explode(F.sequence(F.col("beat_idx"), F.col("beat_idx") + F.col("meter"))).alias("beat_idx")).distinct().withColumn("in_bar", F.lit(True))
    return beats.join(covered, ["file_id", "beat_idx"], "left").withColumn("in_bar", F.coalesce("in_bar", F.lit(False)))


def files_with_bars(beats: DataFrame) -> DataFrame:
    """file_id of files with more than one downbeat."""
    return beats.groupBy("file_id").agg(F.sum((F.col("beat_no") == 1).cast("int")).alias("n")).where("n > 1").select("file_id")


def beats_within(beats: DataFrame, frames: DataFrame, frame_length: float) -> DataFrame:
    """Beats without the last one of files whose frames end at or before it."""
    length = frames.groupBy("file_id").agg((F.max("frame") * frame_length).alias("_end"))
    last = beats.groupBy("file_id").agg(F.max_by("t", "beat_idx").alias("_t"), F.max("beat_idx").alias("_k"))
    cut = last.join(length, "file_id").where("_end <= _t").select("file_id", F.col("_k").alias("beat_idx"))
    return beats.join(cut, ["file_id", "beat_idx"], "left_anti")


def grid_size(num: Column, den: Column, whole_note_div: int) -> Column:
    return F.ceil(num * whole_note_div / den).cast("int")


def bar_cells(beats: DataFrame, bars: DataFrame, frames: DataFrame, grid: DataFrame, frame_length: float) -> DataFrame:
    """file_id, beat_idx (start of the bar), cell, dim, value: every frame's value at its position in a bar.

    ``frames`` is (file_id, frame, dim, value), ``grid`` (file_id, cells). A frame's centre is
    placed between the beats around it, linearly, and by the outer beats' pace beyond them; it
    goes to the nearest cell, none below the first, and those beyond the last belong to the next
    bar. The frames that a bar may hold are generated and joined by number, not by a range.
    """
    seg = bars.join(grid, "file_id").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("meter") - 1)))
    here = beats.select("file_id", F.col("beat_idx").alias("_k"), F.col("t").alias("_a"))
    seg = seg.withColumn("_k", F.col("beat_idx") + F.col("_j")).join(here, ["file_id", "_k"])
    nxt = here.select("file_id", (F.col("_k") - 1).alias("_k"), F.col("_a").alias("_b"))
    seg = seg.join(nxt, ["file_id", "_k"])
    first_of = lambda t: F.ceil(t / frame_length + 0.5)  # noqa: E731  first frame whose centre is not before t
    at = lambda t: F.floor(t / frame_length) + 1  # noqa: E731  frame that holds t
    lo = F.when(F.col("_j") == 0, F.least(at(F.col("_a")), first_of(F.col("_a")))).otherwise(first_of(F.col("_a")))
    hi = F.when(F.col("_j") == F.col("meter") - 1, at(F.col("_b"))).otherwise(F.least(first_of(F.col("_b")) - 1, F.lit(1 << 60)))
    seg = seg.withColumn("_lo", F.greatest(lo, F.lit(1))).withColumn("_hi", hi).where("_hi >= _lo and _b > _a").withColumn("frame", F.explode(F.sequence("_lo", "_hi")))
    centre = (F.col("frame") - 0.5) * frame_length
    pos = (F.col("_j") + (centre - F.col("_a")) / (F.col("_b") - F.col("_a"))) / F.col("meter") * F.col("cells") + 1
    seg = seg.withColumn("cell", F.greatest(F.floor(pos + 0.5), F.lit(1)).cast("int")).where("cell <= cells")
    return seg.select("file_id", "beat_idx", "cell", "frame").join(frames, ["file_id", "frame"]).select("file_id", "beat_idx", "cell", "dim", "value")


def cell_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file_id", "beat_idx", "cell", "dim").agg(F.avg("value").alias("value"))


def cell_arrays(cells: DataFrame) -> DataFrame:
    """All values of a cell, in ascending order."""
    return cells.groupBy("file_id", "beat_idx", "cell", "dim").agg(F.sort_array(F.collect_list("value")).alias("values"))


def impute_cells(means: DataFrame, grid: DataFrame) -> DataFrame:
    """The means with every missing cell of a bar filled per feature: linearly between the known cells around it, and
    beyond the outer ones by the slope of the two nearest. A bar with one known cell has that value everywhere.
    """
    key = ["file_id", "beat_idx", "dim"]
    w = Window.partitionBy(*key).orderBy("cell")
    rows = means.join(grid, "file_id").select(*key, "cells", "cell", "value", F.lead("cell").over(w).alias("_n"), F.lead("value").over(w).alias("_nv"), F.lag("cell").over(w).alias("_p"), F.lag("value").over(w).alias("_pv"))
    c, n, p = F.col("cell"), F.col("_n"), F.col("_p")
    up = F.coalesce((F.col("_nv") - F.col("value")) / (n - c), F.lit(0.0))
    down = F.coalesce((F.col("value") - F.col("_pv")) / (c - p), F.lit(0.0))
    seq = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    before = F.when(p.isNull(), seq(one, c - 1)).otherwise(F.array().cast("array<int>"))
    after = F.when(n.isNull(), seq(c + 1, F.col("cells"))).otherwise(seq(c + 1, n - 1))
    slope = lambda x: F.when(x < c, up).otherwise(F.when(n.isNull(), down).otherwise(up))
    grown = rows.withColumn("_c", F.explode(F.concat(before, F.array(c), after)))
    return grown.select(*key, F.col("_c").alias("cell"), (F.col("value") + slope(F.col("_c")) * (F.col("_c") - c)).alias("value"), (F.col("_c") != c).alias("imputed"))


def song_average(means: DataFrame) -> DataFrame:
    """Mean of each cell over a file's bars."""
    return means.groupBy("file_id", "cell", "dim").agg(F.avg("value").alias("value"))


def zscore_cells(means: DataFrame) -> DataFrame:
    """Values less their feature's mean over all bars and cells, over its deviation."""
    s = means.groupBy("dim").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return means.join(F.broadcast(s), "dim").withColumn("value", (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")
