"""Irregular readings onto a regular grid.

A *source* is a pair of keys (file and feature type). Readings are reduced to one value per
frame, consecutive frames are paired with ``lead``, and only the frames between a pair are
generated. Nothing is sorted over a whole source: frames are cut into blocks of ``block``
frames, pairs inside a block come from a window over the block, and the pairs that cross
blocks come from a second window over two boundary rows a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No frame is longer than this; a larger number is one of milliseconds.
LONGEST_FRAME_S = 0.1


def canonical_type(c: Column) -> Column:
    """Feature types are the same when they differ only in case and outer blanks."""
    return F.lower(F.btrim(c, F.lit(" \t\r\n\u00a0")))


def frame_seconds(c: Column) -> Column:
    """Seconds of a frame length given in seconds or milliseconds; null for impossible ones."""
    s = F.when(c > LONGEST_FRAME_S, c / F.lit(1000.0)).otherwise(c)
    return F.when((s > 0) & (s <= LONGEST_FRAME_S), s)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clean_readings(frames: DataFrame) -> DataFrame:
    """file_id, feat_type, fl (s or null), t and act (finite or null). Rows without a source are left out."""
    return frames.select(
        F.col("file_id").cast("long").alias("file_id"),
        canonical_type(F.col("feat_type")).alias("feat_type"),
        frame_seconds(F.col("frame_length")).alias("fl"),
        _finite(F.col("t")).alias("t"),
        _finite(F.col("act")).alias("act"),
    ).where(F.col("file_id").isNotNull() & F.col("feat_type").isNotNull())


def source_extent(readings: DataFrame) -> DataFrame:
    """One row per source: its frame length (the one most rows carry, the shorter on a tie) and first and last frame.

    Aggregates twice, first by source and frame length, so that a hot source arrives at the
    second shuffle as a handful of rows. Sources without a frame length or a time have no frames.
    """
    by_len = readings.groupBy("file_id", "feat_type", "fl").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    src = by_len.groupBy("file_id", "feat_type").agg(
        F.max(F.when(F.col("fl").isNotNull(), F.struct("n", (-F.col("fl")).alias("neg")))).alias("best"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )
    return src.select("file_id", "feat_type", (-F.col("best.neg")).alias("fl"), "t0", "t1").where("fl is not null and t0 is not null").select(
        "file_id", "feat_type", "fl", _frame("t0").alias("first_frame"), _frame("t1").alias("last_frame")
    )


def _frame(t: str) -> Column:
    return F.floor(F.col(t) / F.col("fl")) + 1


def regular_grid(frames: DataFrame, max_gap: int = 5, block: int = 1 << 14, observed: bool = True) -> DataFrame:
    """One row per frame of every source, from its first to its last reading.

    Columns: ``file_id, feat_type, frame`` (from 1), ``t`` (start of the frame, s), ``value``,
    ``status``: *observed* (mean of the frame's finite readings), *interpolated* (linear over
    at most ``max_gap`` frames), *gap* (longer, value null) or *edge* (before the first or after
    the last finite reading, value null). Late and repeated readings count like any other,
    readings without ``t`` belong to no frame, those whose ``act`` is null or not finite leave
    their frame empty. A source without any finite reading consists of edge frames. An empty
    table gives no rows; further columns are ignored. ``observed=False`` leaves out observed frames.
    """
    readings = clean_readings(frames)
    src = source_extent(readings)
    key = ["file_id", "feat_type"]
    usable = readings.where("t is not null and act is not null").select(*key, "t", "act")
    # Beyond the broadcast limit this is a shuffle join; the repartition below lets the engine split its skewed keys.
    # All readings lie between the first and the last frame; asking for it lets both uses of the sources share one scan.
    placed = usable.join(src, key).select(*key, "fl", _frame("t").alias("frame"), "act", "first_frame", "last_frame").where("frame between first_frame and last_frame")
    present = (
        placed.withColumn("block", F.floor(F.col("frame") / block))
        .repartition(F.col("file_id"), F.col("feat_type"), F.col("block"))
        .groupBy(*key, "block", "fl", "frame")
        .agg(F.avg("act").alias("value"))
    )
    w = Window.partitionBy(*key, "block").orderBy("frame")
    linked = present.select(*key, "block", "fl", "frame", "value", F.lead("frame").over(w).alias("next"), F.lead("value").over(w).alias("next_value"), F.lag("frame").over(w).alias("prev"))
    # One pass gives the gaps inside blocks and the outer rows of blocks; only the latter are paired again, across blocks.
    outer = F.filter(F.array(F.when(F.col("next") - F.col("frame") > 1, False), F.when(F.col("next").isNull() | F.col("prev").isNull(), True)), lambda x: x.isNotNull())
    found = linked.select(*key, "block", "fl", "frame", "value", "next", "next_value", F.explode(outer).alias("outer"), F.col("next").isNull().alias("closes"))
    bounds = src.select(
        *key, F.lit(None).cast("long").alias("block"), "fl", F.explode(F.array(F.col("first_frame") - 1, F.col("last_frame") + 1)).alias("frame"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("long").alias("next"), F.lit(None).cast("double").alias("next_value"), F.lit(True).alias("outer"), F.lit(True).alias("closes"),
    )
    v = Window.partitionBy(*key, F.when(~F.col("outer"), F.col("block"))).orderBy("frame")
    paired = found.unionByName(bounds).select(*key, "fl", "frame", "value", F.when(F.col("outer"), F.lead("frame").over(v)).otherwise(F.col("next")).alias("next"), F.when(F.col("outer"), F.lead("value").over(v)).otherwise(F.col("next_value")).alias("next_value"), "closes", "outer")
    gaps = paired.where("(closes or not outer) and next - frame > 1").select(*key, "fl", "frame", "value", "next", "next_value")
    span = F.col("next") - F.col("frame")
    # A gap of any length is generated in pieces, so that no row holds an unbounded array.
    pieces = gaps.withColumn("lo", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1, F.lit(block))))
    filled = pieces.withColumn("f", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + (block - 1), F.col("next") - 1))))
    both = F.col("value").isNotNull() & F.col("next_value").isNotNull()
    short = both & (span - 1 <= max_gap)
    missing = filled.select(
        *key,
        F.col("f").alias("frame"),
        ((F.col("f") - 1) * F.col("fl")).alias("t"),
        F.when(short, F.col("value") + (F.col("next_value") - F.col("value")) * (F.col("f") - F.col("frame")) / span).alias("value"),
        F.when(~both, "edge").when(short, "interpolated").otherwise("gap").alias("status"),
    )
    if not observed:
        return missing
    seen = present.select(*key, "frame", ((F.col("frame") - 1) * F.col("fl")).alias("t"), "value", F.lit("observed").alias("status"))
    return seen.unionByName(missing)
