"""Readers of data set lists, annotation files, activation files and audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions.series import numbered
from metrolith.functions.signal import resample

#: Annotation types and the extension of their files.
ANNOTATIONS = ("beats", "meter", "section", "onsets", "bpm", "dancestyle", "rhythm")


def text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no (from 1), value of every line of text files.

    Files are read whole, a file a row, so that lines keep their numbers; annotation files are small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_t"))
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("_t", "(\\r\\n|\\r|\\n)$", ""), "\\r\\n|\\r|\\n")).alias("line_no", "value"))
    return lines.select("path", (F.col("line_no") + 1).alias("line_no"), "value")


def list_files(spark: SparkSession, source: str | list[str], base: str = "") -> DataFrame:
    """file_id, path, dataset of a list of paths, a ``.lab`` file (a path a line) or a single audio file.

    Ids follow the list, a repeated path counts where it stands first; relative paths are put under ``base``; the data set is the list's name.
    """
    if isinstance(source, str) and source.endswith(".lab"):
        # Lists may be long: they are read by block, and lines keep their order in it.
        at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]
        lines = spark.read.text(source).select(F.trim("value").alias("path"), *at).where("path <> ''")
        df = lines.select("path", F.regexp_extract("_f", "([^/\\\\]+)\\.lab(/[^/]*)?$", 1).alias("dataset"), "_f", "_b", "_i")
    else:
        paths = [source] if isinstance(source, str) else list(source)
        df = spark.createDataFrame([(p, "", "", 0, i) for i, p in enumerate(paths)], "path string, dataset string, _f string, _b long, _i long")
    full = F.when(F.col("path").rlike("^([/\\\\]|[A-Za-z]+:)"), F.col("path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/" if base else ""), "path"))
    first = df.select(full.alias("path"), "dataset", F.struct("_f", "_b", "_i").alias("_at")).groupBy("path", "dataset").agg(F.min("_at").alias("_at")).select("path", "dataset", "_at.*")
    return numbered(first, "_f", "_b", "_i").select("file_id", "path", "dataset")


def annotation_path(path: Column, kind: str) -> Column:
    """Where a file's annotations of a kind lie: ``audio`` becomes ``annotations/<kind>``, the extension the kind."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, "(^|/)audio(/|$)", f"$1annotations/{kind}$2"), "\\.[^./]*$", ""), F.lit("." + kind))


def missing_annotations(files: DataFrame, present: DataFrame, kind: str) -> DataFrame:
    """Files without an annotation file of a kind; ``present`` lists paths."""
    return files.withColumn("annotation", annotation_path(F.col("path"), kind)).join(present.select(F.col("path").alias("annotation")), "annotation", "left_anti")


def parse_beats(lines: DataFrame) -> DataFrame:
    """t, bar and beat_no of ``time<TAB>[bar.]beat`` in the column value, with the other columns; bar is null where it is not given."""
    part = F.split("value", "\t")
    number = F.split(F.trim(part[1]), "\\.")
    return lines.withColumns({
        "t": F.trim(part[0]).try_cast("double"),
        "bar": F.when(F.size(number) > 1, number[0].try_cast("bigint")),
        "beat_no": F.element_at(number, -1).try_cast("bigint"),
    }).drop("value")


def parse_meters(lines: DataFrame) -> DataFrame:
    """num and den of ``num/den``; a missing or zero denominator is 4."""
    part = F.split(F.trim("value"), "/")
    den = F.try_element_at(part, F.lit(2)).try_cast("int")
    return lines.withColumns({"num": part[0].try_cast("int"), "den": F.coalesce(F.nullif(den, F.lit(0)), F.lit(4))}).drop("value")


def meters_of(files: DataFrame, meters: DataFrame, pattern_size: str = "bar") -> DataFrame:
    """file_id, num, den of every file: its first annotated meter, 4/4 without one, 1/4 for patterns of a beat."""
    if pattern_size == "beat":
        return files.select("file_id").distinct().select("file_id", F.lit(1).alias("num"), F.lit(4).alias("den"))
    first = meters.where("num is not null").groupBy("file_id").agg(F.min(F.struct("section_no", "num", F.coalesce(F.nullif("den", F.lit(0)), F.lit(4)).alias("den"))).alias("m"))
    return files.select("file_id").distinct().join(first, "file_id", "left").select("file_id", F.coalesce("m.num", F.lit(4)).alias("num"), F.coalesce("m.den", F.lit(4)).alias("den"))


def load_features(cache: DataFrame, names: list[str], compute=None) -> DataFrame:
    """(file_id, frame, dim, value) of several features, each from a cache (file_id, feat_type, frame, y) where it has the file, else
    from ``compute(name)`` (file_id, frame, y); a frame needs all features."""
    parts = []
    for name in names:
        kept = cache.where(F.col("feat_type") == name).select("file_id", "frame", "y")
        if compute is not None:
            made = compute(name).select("file_id", "frame", "y")
            kept = kept.unionByName(made.join(kept.select("file_id").distinct(), "file_id", "left_anti"))
        parts.append(kept)
    return align_features(*parts)


def parse_sections(lines: DataFrame) -> DataFrame:
    """One row a number of a comma-separated line: pos (from 1), section."""
    return lines.select(*[c for c in lines.columns if c != "value"], F.posexplode(F.split("value", ",")).alias("pos", "section")).withColumn("pos", F.col("pos") + 1).withColumn("section", F.trim("section").try_cast("int"))


def parse_numbers(lines: DataFrame) -> DataFrame:
    """Whitespace-separated numbers of a line as an array: onsets, bpm."""
    return lines.withColumn("numbers", F.transform(F.filter(F.split(F.trim("value"), "[\\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))).drop("value")


def first_word(lines: DataFrame) -> DataFrame:
    """The first word of a file's first line: dance style, rhythm."""
    return lines.where("line_no = 1").withColumn("name", F.split(F.trim("value"), "\\s+")[0]).drop("value", "line_no")


def parse_activations(texts: DataFrame, default_fps: float = 100.0) -> DataFrame:
    """file_id, fps, frame, dim, value of whole activation files (file_id, value).

    Optional lines ``FRAMERATE: f`` and ``DIMENSION: n`` lead; the numbers that follow fill the
    dimensions of one frame after another.
    """
    head = lambda word: F.regexp_extract("value", rf"(?i){word}:\s*([0-9.eE+-]+)", 1)
    body = F.regexp_replace("value", r"(?i)(FRAMERATE|DIMENSION):[^\n]*", "")
    numbers = F.filter(F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " "), lambda x: x != "")
    rows = texts.select("file_id", F.coalesce(head("FRAMERATE").try_cast("double"), F.lit(default_fps)).alias("fps"), F.coalesce(head("DIMENSION").try_cast("int"), F.lit(1)).alias("n"), F.posexplode(numbers).alias("pos", "v"))
    return rows.select("file_id", "fps", (F.floor(F.col("pos") / F.col("n")) + 1).alias("frame"), (F.col("pos") % F.col("n") + 1).cast("int").alias("dim"), F.col("v").try_cast("double").alias("value"))


def align_features(*features: DataFrame) -> DataFrame:
    """(file_id, frame, dim, value) of several one-dimensional features (file_id, frame, y): the frames that all have."""
    out = None
    for i, f in enumerate(features):
        f = f.select("file_id", "frame", F.col("y").alias(f"_y{i}"))
        out = f if out is None else out.join(f, ["file_id", "frame"])
    values = F.array(*[F.struct(F.lit(i + 1).alias("dim"), F.col(f"_y{i}").alias("value")) for i in range(len(features))])
    return out.select("file_id", "frame", F.explode(values).alias("x")).select("file_id", "frame", "x.dim", "x.value")


def read_fold_lists(spark: SparkSession, folder: str) -> DataFrame:
    """path, fold of files ``<name>-fold<k>.lab``."""
    lines = spark.read.text(f"{folder.rstrip('/')}/*-fold*.lab").select(F.trim("value").alias("listed"), F.col("_metadata.file_path").alias("_f")).where("listed <> ''")
    return lines.select(F.col("listed").alias("path"), F.regexp_extract("_f", "-fold(\\d+)\\.lab(/[^/]*)?$", 1).cast("int").alias("fold"))


def read_wav(spark: SparkSession, path: str, rate: int = 44100) -> DataFrame:
    """path, samples (mono, in -1 to 1, at a rate) of PCM wave files; other formats need a decoder and are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with wave.open(io.BytesIO(content)) as f:
                    width, channels, fs = f.getsampwidth(), f.getnchannels(), f.getframerate()
                    raw = f.readframes(f.getnframes())
                if width == 1:
                    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
                elif width == 3:
                    q = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((q[:, 0] << 8 | q[:, 1] << 16 | q[:, 2] << 24) >> 8) / float(1 << 23)
                else:
                    x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
                x = resample(x.reshape(-1, channels).mean(axis=1), fs, rate)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([x.tolist()], pa.list_(pa.float64()))], names=["path", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, samples array<double>")
