"""Tempo ranges and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bpm(tempo: Column, position_per_beat: Column, frame_length: float) -> Column:
    """Beats a minute of a tempo in positions a frame."""
    return tempo * 60.0 / (position_per_beat * frame_length)


def tempo_of_bpm(beats_a_minute: Column, position_per_beat: Column, frame_length: float) -> Column:
    return beats_a_minute * position_per_beat * frame_length / 60.0


def tempo_range(beats: DataFrame, percentile: float = 5.0) -> DataFrame:
    """file_id, min_bpm, max_bpm of (file_id, beat_idx, t), after trimming a percentage of the longest and shortest periods.

    Of n periods in descending order, those from max(floor(n p / 100), 1) to min(floor(n (1 - p / 100)), n) count; the
    median of all where that is an empty range. Files with one beat have no range.
    """
    w = Window.partitionBy("file_id").orderBy("beat_idx")
    periods = beats.select("file_id", (F.col("t") - F.lag("t").over(w)).alias("p")).where("p is not null")
    ranked = periods.select("file_id", "p", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("p"))).alias("k"), F.count("*").over(Window.partitionBy("file_id")).alias("n"))
    lo = F.greatest(F.floor(F.col("n") * percentile / 100.0), F.lit(1))
    hi = F.least(F.floor(F.col("n") * (1 - percentile / 100.0)), F.col("n"))
    kept = F.when((F.col("k") >= lo) & (F.col("k") <= hi), F.col("p"))
    s = ranked.groupBy("file_id").agg(F.max(kept).alias("hi"), F.min(kept).alias("lo"), F.percentile("p", F.lit(0.5)).alias("mid"))
    return s.select("file_id", (60.0 / F.coalesce("hi", "mid")).alias("min_bpm"), (60.0 / F.coalesce("lo", "mid")).alias("max_bpm"))


def restrict(ranges: DataFrame, lowest: float, highest: float) -> DataFrame:
    """Ranges within given limits."""
    return ranges.withColumn("min_bpm", F.greatest("min_bpm", F.lit(lowest))).withColumn("max_bpm", F.least("max_bpm", F.lit(highest)))


def same_per_meter(ranges: DataFrame, by: tuple[str, ...] = ("num", "den")) -> DataFrame:
    """Every range widened to the union of those of its meter."""
    union = ranges.groupBy(*by).agg(F.min("min_bpm").alias("_lo"), F.max("max_bpm").alias("_hi"))
    return ranges.join(union, list(by)).withColumn("min_bpm", F.col("_lo")).withColumn("max_bpm", F.col("_hi")).drop("_lo", "_hi")


def cluster_tempo(ranges: DataFrame, bar_clusters: DataFrame) -> DataFrame:
    """cluster, min_bpm, max_bpm over the files that have a bar in it; ``bar_clusters`` is (file_id, cluster)."""
    return bar_clusters.select("file_id", "cluster").distinct().join(ranges, "file_id").groupBy("cluster").agg(F.min("min_bpm").alias("min_bpm"), F.max("max_bpm").alias("max_bpm"))


def median_tempo(frames: DataFrame) -> DataFrame:
    """file_id, bpm: the exact median of a file's tempi."""
    return frames.groupBy("file_id").agg(F.percentile("bpm", F.lit(0.5)).alias("bpm"))
