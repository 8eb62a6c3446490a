"""Beats, tempo, meter and rhythm tables from decoded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions.series import blocked


def beat_times(path: DataFrame, frame_length: float, frame_shift: float = 0.0) -> DataFrame:
    """file_id, frame, t, beat_no of paths (file_id, frame, position, n_beats, bar); positions run from 1 to 1 + bar.

    Beats lie at even distances from position 1. A frame but the last gives a beat when it is on
    the beat's position (the frame itself), when the bar wraps beyond it before the next frame,
    or when the position passes it (both interpolated); the lowest such beat. Frames are rounded
    to whole ones after the shift.
    """
    rows, own = blocked(path, 0, 1)
    w = Window.partitionBy("file_id", "_block").orderBy("frame")
    m, nxt, f = F.col("position"), F.col("_next"), F.col("frame")
    # Beside a frame of silence, which the path lacks, there is no next position.
    rows = rows.withColumn("_next", F.when(F.lead("frame").over(w) == f + 1, F.lead("position").over(w))).where(own & F.col("_next").isNotNull())

    def place(j):
        b = 1.0 + (j - 1) * (F.col("bar") / F.col("n_beats"))
        wrap = f + (F.col("bar") + b - m) / (F.col("bar") + nxt - m)
        return F.struct(j.cast("int").alias("beat_no"), F.when(m == b, f.cast("double")).when((nxt > b) & (nxt < m), wrap).when((m < b) & (nxt > b), f + (b - m) / (nxt - m)).alias("at"))

    found = F.filter(F.transform(F.sequence(F.lit(1), F.col("n_beats")), place), lambda x: x["at"].isNotNull())
    hits = rows.select("file_id", "frame", F.try_element_at(found, F.lit(1)).alias("x")).where("x is not null")
    at = F.floor(F.col("x.at") - frame_shift + 0.5)
    return hits.select("file_id", "frame", (at * frame_length).alias("t"), F.col("x.beat_no").alias("beat_no"), F.col("x.at").alias("at"))


def corrected_beats(beats: DataFrame, activations: DataFrame, path: DataFrame, resolution: float, frame_length: float) -> DataFrame:
    """Beats moved to the strongest activation between themselves and the frame ``resolution`` positions on.

    ``activations`` is (file_id, frame, x); of equals the earliest counts. The path tells the slowest pace of a file, and so how
    many frames that may be.
    """
    pace = path.groupBy("file_id").agg(F.min(F.col("bpm") / 60.0 * frame_length * F.col("bar") / F.col("n_beats")).alias("_pace"))
    reach = F.ceil(F.lit(resolution) / F.col("_pace")).cast("long") + 2
    span = beats.join(pace, "file_id").select("file_id", F.col("frame").alias("_f"), "beat_no", F.explode(F.sequence(F.col("frame"), F.col("frame") + reach)).alias("frame"))
    p = path.select("file_id", "frame", "position", "n_beats", "bar")
    seen = span.join(p, ["file_id", "frame"]).join(activations, ["file_id", "frame"])
    start = 1.0 + (F.col("beat_no") - 1) * (F.col("bar") / F.col("n_beats"))
    past = F.pmod(F.col("position") - start, F.col("bar"))
    gone = F.min(F.when((past >= resolution) & (past < F.col("bar") / 2), F.col("frame"))).over(Window.partitionBy("file_id", "_f"))
    kept = seen.withColumn("_g", gone).where(F.col("_g").isNull() | (F.col("frame") <= F.col("_g")))
    best = kept.groupBy("file_id", F.col("_f"), "beat_no").agg(F.max_by("frame", F.struct("x", (-F.col("frame")).alias("n"))).alias("frame"))
    return best.select("file_id", "frame", (F.col("frame") * frame_length).alias("t"), "beat_no")


def decoded_states(paths: DataFrame, states: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths with their states' position, tempo and pattern and the pattern's meter; frames of silence (no such state) are left out."""
    s = states.select("state", "pattern", "position", "bpm", "n_beats", "bar")
    return paths.join(F.broadcast(s), "state").join(F.broadcast(patterns.select("pattern", "num", "den")), "pattern")


def segments(path: DataFrame, value: str = "pattern") -> DataFrame:
    """file_id, seg, first, last, value: runs of equal values in order of frame.

    Ends of runs come from a window over blocks; a run's first frame follows the last one of the run before.
    """
    rows, own = blocked(path, 1, 1)
    w = Window.partitionBy("file_id", "_block").orderBy("frame")
    ends = rows.withColumn("_n", F.lead(value).over(w)).withColumn("_last", F.lead("frame").over(w).isNull()).where(own & (F.col("_last") | ~F.col(value).eqNullSafe(F.col("_n"))))
    v = Window.partitionBy("file_id").orderBy("frame")
    return ends.select("file_id", F.row_number().over(v).cast("int").alias("seg"), (F.coalesce(F.lag("frame").over(v), F.lit(0)) + 1).alias("first"), F.col("frame").alias("last"), value)


def rhythm_segments(path: DataFrame, names: DataFrame, frame_length: float) -> DataFrame:
    """file_id, seg, start, end, name: segments as they are written, each from the last frame of the one before (the first from frame 1)."""
    s = segments(path).join(F.broadcast(names), "pattern")
    return s.select("file_id", "seg", ((F.greatest(F.col("first") - 1, F.lit(1)) - 1) * frame_length).alias("start"), ((F.col("last") - 1) * frame_length).alias("end"), "name")


def tempo_sequence(path: DataFrame, frame_length: float) -> DataFrame:
    return path.select("file_id", "frame", ((F.col("frame") - 1) * frame_length).alias("t"), "bpm")


def file_meters(path: DataFrame) -> DataFrame:
    """file_id, num, den: all meters of a file's path."""
    return path.select("file_id", "num", "den").distinct()


def first_meter(path: DataFrame) -> DataFrame:
    """file_id, num, den: the least of a file's meters, which is the one that is written."""
    return path.groupBy("file_id").agg(F.min(F.struct("num", "den")).alias("m")).select("file_id", "m.num", "m.den")
