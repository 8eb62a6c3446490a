"""Annotation lines, set apart into valid beats, valid meters and faulty lines with a reason.

Lines are records already, so a record is assembled by reading one line quote-aware with
Python's strict ``csv`` reader; structural exceptions are caught before the typed
constructors run.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TIME = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_COUNT = re.compile(r"[0-9]+")
_BEAT = re.compile(r"(?:([0-9]+)\.)?([0-9]+)")
_LONGEST = (1 << 31) - 1  # of a field, which the reader would limit otherwise
_PAD = {"\t": re.compile(r" *\t *"), "/": re.compile(r" */ *")}

#: What one parsed line becomes; ``reason`` is null for a valid one.
SCHEMA = "line_id long, file_id long, ann_type string, line_no int, raw_line string, t double, bar long, beat_no long, num long, den long, reason string"


def _fields(line: str, sep: str) -> list[str]:
    """Fields of a line without their outer blanks; csv.Error for a quote that encloses no whole field."""
    line = _PAD[sep].sub(sep, line.strip(" \r\n"))
    if '"' not in line:
        return line.split(sep)
    csv.field_size_limit(_LONGEST)
    rows = list(csv.reader([line], delimiter=sep, strict=True))
    fields = rows[0] if rows else [""]
    if any('"' in f for f in fields):
        raise csv.Error("stray quote")
    return [f.strip(" ") for f in fields]


def _whole(digits: str) -> int | None:
    """The number, null beyond 64 bits."""
    n = digits.lstrip("0")
    return None if len(n) > 19 or int(n or 0) >= 1 << 63 else int(n or 0)


def parse_line(ann_type: str | None, line: str | None) -> tuple:
    """(t, bar, beat_no, num, den, reason) of a line.

    Reasons, the first that applies: *quoting*, *columns* (also a null or empty line), *value*
    (also an unknown annotation type). A bar is null where the line gives none, a denominator
    likewise, and any number that 64 bits do not hold; a time that a double does not hold is a wrong value.
    """
    none = (None,) * 5
    kind = (ann_type or "").strip().lower()
    sep = "\t" if kind == "beats" else "/"
    if line is None:
        return (*none, "columns")
    try:
        fields = _fields(line, sep)
    except csv.Error:
        return (*none, "quoting")
    if fields == [""] or (len(fields) != 2 if kind == "beats" else len(fields) > 2):
        return (*none, "columns")
    if kind == "beats":
        if not _TIME.fullmatch(fields[0]) or not (m := _BEAT.fullmatch(fields[1])):
            return (*none, "value")
        t = float(fields[0])
        if not m[2].strip("0") or t == float("inf"):
            return (*none, "value")
        return t, m[1] and _whole(m[1]), _whole(m[2]), None, None, None
    if kind == "meter" and all(_COUNT.fullmatch(f) and f.strip("0") for f in fields):
        return None, None, None, _whole(fields[0]), _whole(fields[1]) if len(fields) == 2 else None, None
    return (*none, "value")


_ARROW = pa.schema([("line_id", pa.int64()), ("file_id", pa.int64()), ("ann_type", pa.string()), ("line_no", pa.int32()), ("raw_line", pa.string()), ("t", pa.float64()), ("bar", pa.int64()), ("beat_no", pa.int64()), ("num", pa.int64()), ("den", pa.int64()), ("reason", pa.string())])


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parsed = [parse_line(a, x) for a, x in zip(b.column("ann_type").to_pylist(), b.column("raw_line").to_pylist())]
        cols = list(zip(*parsed)) if parsed else [()] * 6
        keep = [b.column(n) for n in ("line_id", "file_id", "ann_type", "line_no", "raw_line")]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(c, _ARROW.field(5 + i).type) for i, c in enumerate(cols)], schema=_ARROW)


def parse_annotations(lines: DataFrame) -> DataFrame:
    """Every line with its parsed values or its reason. Repeated rows stay repeated; further columns are left out; an empty table gives none."""
    return lines.select(F.col("line_id").cast("long").alias("line_id"), F.col("file_id").cast("long").alias("file_id"), F.col("ann_type").cast("string").alias("ann_type"), F.col("line_no").cast("int").alias("line_no"), F.col("raw_line").cast("string").alias("raw_line")).mapInArrow(_kernel, SCHEMA)


def rejected(parsed: DataFrame) -> DataFrame:
    """Faulty lines: line_id, reason (exact repeats once)."""
    return parsed.where("reason is not null").select("line_id", "reason").distinct()


def loaded_beats(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null and t is not null").select("line_id", "file_id", "line_no", "t", "bar", "beat_no").distinct()


def loaded_meters(parsed: DataFrame) -> DataFrame:
    """A missing denominator is read as 4."""
    return parsed.where("reason is null and t is null").select("line_id", "file_id", "line_no", "num", F.coalesce("den", F.lit(4).cast("long")).alias("den")).distinct()
