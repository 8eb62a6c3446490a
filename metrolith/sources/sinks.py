"""Text and parquet sinks. Lines of one file stay together, in order, under ``file_id=<id>``."""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.operators import results, tempo
from metrolith.session import Workspace
from metrolith.sources import files

#: The folder of lines without a file, as Spark names it, and the name of a file's one text.
_NONE, _TEXT = "__HIVE_DEFAULT_PARTITION__", "part-00000.txt"
#: Folders of files that a task reads at least, and lines and bytes that it returns and reads at a time.
_FOLDERS, _LINES, _BYTES = 2048, 1 << 16, 1 << 22


def beat_lines(beats: DataFrame, numbered: bool = True) -> DataFrame:
    """file_id, frame, value: time in milliseconds and beat number; the time alone where a bar has one beat."""
    text = F.format_string("%.3f\t%d", "t", "beat_no") if numbered else F.format_string("%.3f", "t")
    return beats.select("file_id", "frame", text.alias("value"))


def downbeat_lines(beats: DataFrame) -> DataFrame:
    return beat_lines(beats.where("beat_no = 1"), numbered=False)


def median_tempo_lines(path: DataFrame) -> DataFrame:
    """The median, without decimals where it is whole."""
    m = tempo.median_tempo(path)
    return m.select("file_id", F.lit(1).alias("frame"), F.when(F.col("bpm") == F.floor("bpm"), F.format_string("%d", F.col("bpm").cast("long"))).otherwise(F.format_string("%e", "bpm")).alias("value"))


def tempo_lines(path: DataFrame, frame_length: float) -> DataFrame:
    t = results.tempo_sequence(path, frame_length)
    return t.select("file_id", "frame", F.format_string("%.2f,%.2f", "t", "bpm").alias("value"))


def rhythm_lines(path: DataFrame, names: DataFrame, frame_length: float) -> DataFrame:
    s = results.rhythm_segments(path, names, frame_length)
    return s.select("file_id", F.col("seg").alias("frame"), F.format_string("%3.2f\t%3.2f\t%s", "start", "end", "name").alias("value"))


def meter_lines(path: DataFrame) -> DataFrame:
    return results.first_meter(path).select("file_id", F.lit(1).alias("frame"), F.format_string("%d/%d", "num", "den").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files partitioned by file; one shuffle by file, sorted inside it."""
    lines.repartition("file_id").sortWithinPartitions("file_id", "frame").select("file_id", "value").write.mode("overwrite").partitionBy("file_id").text(path)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path within the machines' own file system; None where it lies elsewhere."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _write_mounted(lines: dict[str, DataFrame], root: str) -> None:
    """The same files as of ``write_lines``, for all kinds in one shuffle, into a mounted folder.

    Spark's writer starts a process for every file there (to set its mode) and its driver moves them one by one, which takes longer than
    all the rest where each of many series has a file. Kernels write a file under a hidden name and then give it its own, so that a
    task may run twice; the folder of a kind replaces the old one when all are written.
    """
    temp, kinds = f"{root}/_temporary-{uuid.uuid4().hex}", list(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, hidden, folder, count = None, None, "", "", 0
        try:
            for b in batches:
                kind, none, text = b.column("kind").to_numpy(), b.column("file_id").is_null().to_numpy(zero_copy_only=False), b.column("value")
                file = b.column("file_id").fill_null(0).to_numpy()
                at = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
                other = (kind[1:] != kind[:-1]) | (file[1:] != file[:-1]) | (none[1:] != none[:-1])
                cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(kind)] if len(kind) else []
                for lo, hi in zip(cuts, cuts[1:]):
                    key = int(kind[lo]), int(file[lo]), bool(none[lo])
                    if key != now:
                        if f is not None:
                            f.close()
                            os.replace(hidden, f"{folder}/{_TEXT}")
                        now, folder = key, f"{temp}/{kinds[key[0]]}/file_id={_NONE if key[2] else key[1]}"
                        hidden = f"{folder}/.{uuid.uuid4().hex}"
                        with suppress(FileExistsError):
                            os.mkdir(folder)
                        f, count = open(hidden, "wb"), count + 1  # noqa: SIM115
                    f.write(memoryview(text.buffers()[2])[at[lo] : at[hi]])
            if f is not None:
                f.close()
                os.replace(hidden, f"{folder}/{_TEXT}")
                f = None
        finally:
            if f is not None:
                f.close()
                if os.path.exists(hidden):
                    os.unlink(hidden)
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["files"])

    both = None
    for i, df in enumerate(lines.values()):
        # With its end of line a text's bytes are those of its rows, one after the other.
        x = df.select(F.lit(i).alias("kind"), F.col("file_id").cast("long").alias("file_id"), "frame", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value"))
        both = x if both is None else both.unionByName(x)
    try:
        for k in kinds:
            os.makedirs(f"{temp}/{k}")
        if both is not None:
            both.repartition("kind", "file_id").sortWithinPartitions("kind", "file_id", "frame").drop("frame").mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()
        for k in kinds:
            shutil.rmtree(f"{root}/{k}", ignore_errors=True)
            os.replace(f"{temp}/{k}", f"{root}/{k}")
            open(f"{root}/{k}/_SUCCESS", "wb").close()
    finally:
        shutil.rmtree(temp, ignore_errors=True)


def save_results(beats: DataFrame, path: DataFrame, names: DataFrame, frame_length: float, out: str, what: frozenset[str] = frozenset({"beats"})) -> None:
    """Writes the results asked for: beats, downbeats, median_tempo, tempo, meter, rhythm; a text a file and kind. Beats and path are made once."""
    spark = beats.sparkSession
    ws = Workspace(spark, "saved")
    makers = {
        "beats": lambda: beat_lines(beats), "downbeats": lambda: downbeat_lines(beats), "median_tempo": lambda: median_tempo_lines(path),
        "tempo": lambda: tempo_lines(path, frame_length), "meter": lambda: meter_lines(path), "rhythm": lambda: rhythm_lines(path, names, frame_length),
    }
    for k in sorted(what):
        if k not in makers:
            raise ValueError(f"no result is called {k}")
    beats = ws.keep(beats) if {"beats", "downbeats"} <= what else beats
    path = ws.keep(path) if len(what & {"median_tempo", "tempo", "meter", "rhythm"}) > 1 else path
    lines = {k: makers[k]() for k in sorted(what)}
    root = _mounted(spark, out)
    if root is not None and all(dict(x.dtypes)["file_id"] in ("tinyint", "smallint", "int", "bigint") for x in lines.values()):
        _write_mounted(lines, root)
    else:
        for k, x in lines.items():
            write_lines(x, f"{out}/{k}")
    ws.drop(*ws.kept)


def load_results(spark: SparkSession, out: str, what: Iterable[str]) -> DataFrame:
    """kind, file_id, line_no (from 1), value of the results that ``save_results`` wrote for whole numbers as files' ids.

    Where the folder is mounted, tasks list and read a part of a kind's files each, so that no list of all files is made.
    """
    root = _mounted(spark, out)
    if root is None:
        lines = files.text_files(spark, [f"{out}/{k}/*/*.txt" for k in sorted(what)])
        kind, file_id = (F.regexp_extract("path", "/([a-z_]+)/file_id=([^/]+)/[^/]*$", k) for k in (1, 2))
        return lines.select(kind.alias("kind"), file_id.try_cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "value")
    most = 4 * spark.sparkContext.defaultParallelism
    jobs = []
    for k in sorted(what):
        with os.scandir(f"{root}/{k}") as found:
            parts = min(1 + sum(1 for _ in found) // _FOLDERS, most)
        jobs += [(k, i, parts) for i in range(parts)]

    def batch(kind: str, ids: list, counts: list, first: list, values: list) -> pa.RecordBatch:
        none = np.repeat([i is None for i in ids], counts)
        file = np.repeat(np.array([i or 0 for i in ids], np.int64), counts)
        line = np.concatenate([np.arange(f, f + n, dtype=np.int64) for f, n in zip(first, counts)])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind), len(values)), pa.array(file, mask=none), pa.array(line), pa.array(values, pa.string())], names=["kind", "file_id", "line_no", "value"])

    def read(job: tuple[str, int, int]) -> Iterator[pa.RecordBatch]:
        kind, part, parts = job
        ids, counts, first, values = [], [], [], []
        with os.scandir(f"{root}/{kind}") as found:
            for e in found:
                if not e.name.startswith("file_id=") or zlib.crc32(e.name.encode()) % parts != part:
                    continue
                name = e.name.partition("=")[2]
                with open(f"{e.path}/{_TEXT}", encoding="utf-8", newline="\n") as f:
                    line = 1
                    while some := f.readlines(_BYTES):
                        ids.append(None if name == _NONE else int(name))
                        counts.append(len(some))
                        first.append(line)
                        values += [x[:-1] for x in some]
                        line += len(some)
                        if len(values) >= _LINES:
                            yield batch(kind, ids, counts, first, values)
                            ids, counts, first, values = [], [], [], []
        if values:
            yield batch(kind, ids, counts, first, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                yield from read(jobs[i])

    return spark.range(0, len(jobs), 1, max(len(jobs), 1)).mapInArrow(run, "kind string, file_id long, line_no long, value string")


def activation_text(frames: DataFrame, fps: float) -> DataFrame:
    """file_id, value: activation files with their header; values of a frame's dimensions side by side. One file's text is one row."""
    rows = frames.groupBy("file_id", "frame").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
    lines = rows.select("file_id", "frame", F.size("v").alias("n"), F.concat_ws(" ", F.transform("v", lambda x: x["value"].cast("string"))).alias("line"))
    whole = lines.groupBy("file_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("frame", "line"))).alias("l"))
    return whole.select("file_id", F.concat(F.format_string("FRAMERATE: %s\nDIMENSION: %d\n", F.lit(str(fps)), "n"), F.concat_ws("\n", F.transform("l", lambda x: x["line"])), F.lit("\n")).alias("value"))


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A model, a clustering or training data as parquet, a folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
