"""Series handed to Arrow kernels one after another, in order of time, however long one is."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one series that are held in memory; longer ones lie in a file of the task, as a sort spills; nothing else reads it.
HELD = 1 << 20


@dataclass
class Series:
    """A file's frame numbers and values (frames x columns, both maybe in a file), and the other columns of its rows by name, where they are not null."""

    file_id: int
    frames: np.ndarray
    x: np.ndarray
    marks: list[tuple[int, dict]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.frames)


class _Open:
    """The series that is being read."""

    def __init__(self, file_id: int, held: int):
        self.file_id, self.held, self.n, self.parts, self.files, self.marks, self.width = file_id, held, 0, [], None, [], 1

    def add(self, frames: np.ndarray, x: np.ndarray, marks: list[tuple[int, dict]]) -> None:
        self.marks += [(self.n + i, m) for i, m in marks]
        self.n += len(frames)
        self.width = x.shape[1]
        self.parts.append((frames, x))
        if self.files is not None or self.n > self.held:
            self.files = self.files or (tempfile.TemporaryFile(), tempfile.TemporaryFile())
            for f, v in self.parts:
                self.files[0].write(np.ascontiguousarray(f, np.int64).tobytes())
                self.files[1].write(np.ascontiguousarray(v, float).tobytes())
            self.parts = []

    def close(self) -> Series:
        if self.files is None:
            return Series(self.file_id, np.concatenate([f for f, _ in self.parts]), np.concatenate([v for _, v in self.parts]), self.marks)
        for f in self.files:
            f.flush()
        return Series(self.file_id, np.memmap(self.files[0], np.int64, "r", shape=(self.n,)), np.memmap(self.files[1], float, "r", shape=(self.n, self.width)), self.marks)


def read_series(batches: Iterator[pa.RecordBatch], value: str, others: tuple[str, ...] = (), held: int = HELD) -> Iterator[Series]:
    """Series of rows sorted by file_id and frame; ``value`` is an array column of one length."""
    now: _Open | None = None
    for b in batches:
        if not b.num_rows:
            continue
        ids, frames = b.column("file_id").to_numpy(), b.column("frame").to_numpy()
        x = b.column(value).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        extra = {c: b.column(c).to_pylist() for c in others}
        marks = [i for i in range(len(ids)) if any(v[i] is not None for v in extra.values())] if extra else []
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if now is not None and now.file_id != ids[lo]:
                yield now.close()
                now = None
            now = now or _Open(int(ids[lo]), held)
            now.add(frames[lo:hi], x[lo:hi], [(i - lo, {c: v[i] for c, v in extra.items()}) for i in marks if lo <= i < hi])
    if now is not None:
        yield now.close()


def by_length(series: Iterator[Series], cost: int, budget: int) -> Iterator[list[Series]]:
    """Series in lots of up to ``budget`` by frames times ``cost``, each the longest first; one that is beyond it comes alone."""
    lot, used = [], 0
    for s in series:
        if lot and used + len(s) * cost > budget:
            yield sorted(lot, key=lambda z: (-len(z), z.file_id))
            lot, used = [], 0
        lot.append(s)
        used += len(s) * cost
    if lot:
        yield sorted(lot, key=lambda z: (-len(z), z.file_id))


def in_series(frames: DataFrame, *columns: str) -> DataFrame:
    """file_id, frame and other columns, a file in one partition and its rows in order.

    The number of partitions is set, as the work does not go by the bytes that adaptive execution would join them by.
    """
    spark = frames.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = frames.select(F.col("file_id").cast("long").alias("file_id"), F.col("frame").cast("long").alias("frame"), *columns)
    return rows.repartition(parts, "file_id").sortWithinPartitions("file_id", "frame")
