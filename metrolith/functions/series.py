"""Series of readings, and windows over them that do not need a whole series in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.session import Workspace


def event_series(events: DataFrame) -> DataFrame:
    """file_id, frame (from 1, in order of time and event), x, and the event's type and time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("file_id"), F.row_number().over(w).cast("long").alias("frame"), F.col("value").alias("x"), "event_type", "ts", "event_id")


def blocked(df: DataFrame, before: int, after: int = 0, block: int = 1 << 13, key: tuple[str, ...] = ("file_id",), order: str = "frame", cut: Column | None = None) -> tuple[DataFrame, Column]:
    """The rows with a column ``_block``, repeated into a neighbouring block where it needs them, and which rows are a block's own.

    Windows over (key, _block) that look at most ``before`` rows back and ``after`` ahead then
    see what windows over the key would; one series may hold any share of the rows. Orders must
    be dense within a key. Series for which ``cut`` is false stay whole.
    """
    f = F.col(order)
    home = F.floor((f - 1) / block)
    spread = F.array_distinct(F.array(home, F.floor((f - 1 + before) / block), F.floor((f - 1 - after) / block)))
    reach = (before + block - 1) // block
    if reach > 1:
        spread = F.sequence(F.floor((f - 1 - after) / block), F.floor((f - 1 + before) / block))
    if cut is not None:
        home, spread = F.when(cut, home).otherwise(0), F.when(cut, spread).otherwise(F.array(F.lit(0).cast("long")))
    rows = df.withColumn("_home", home).withColumn("_block", F.explode(spread)).where("_block >= 0")
    return rows.repartition(*key, "_block"), F.col("_home") == F.col("_block")


def numbered(df: DataFrame, *order: str, name: str = "file_id") -> DataFrame:
    """The rows with a number from 1 in their order: counted per range of the order and shifted by the ranges before, so that no task sees all."""
    ws = Workspace(df.sparkSession, "numbered")
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    rows = ws.keep(local)
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    if not starts:
        return rows.select(F.col("_k").alias(name), *df.columns)
    start = F.element_at(F.create_map(*[F.lit(v) for pair in starts for v in pair]), F.col("_p"))
    return rows.select((start + F.col("_k") + 1).cast("long").alias(name), *df.columns)
