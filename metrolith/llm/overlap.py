"""Recordings of a training list that are listed for validation or test as well.

A recording is named by its file name: letters without case and accents, and its take,
movement and variation numbers, which must agree. Names are compared through winnowed
fingerprints: every run of ``k + w - 1`` letters that two names share yields a common selected
hash, and two slips leave such a run intact in any name from ``WINNOWED`` letters on. Common
hashes are joined across splits, chained where they are collinear, and the chain is extended by
alignment of what lies between its seeds. Runs of shorter names are too common to join by; they
meet by what is left of them without up to two letters. Names are compared once, however many
files bear them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.session import Workspace

#: Remarks of processing in file names.
REMARKS = {"mono", "stereo", "norm", "normalized", "normalised", "copy", "clean", "remaster", "remastered", "denoised", "trimmed", "final", "edit", "master", "resampled", "converted"}
_RATE = re.compile(r"[0-9]+(?:k|khz|hz|bit|kbps)")
_GLUED = re.compile(r"[0-9]+([^\W\d_]{3,}.*)")
_NUMBERED = re.compile(r"(take|mvt|var)0*([0-9]*)")
_SPLIT = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test", "eval": "test"}
#: Slips that a name may hold, so twice as many between two names.
SLIPS = 2
#: Class: lengths from and to, k, w. Two slips (swaps too) leave a run of 5 letters in 17, and one of 6 in 20; names that differ by two slips meet in one class.
CLASSES = {"m": (17, 21, 4, 2), "l": (20, 1 << 30, 5, 2)}
#: Names from so many letters on are winnowed; up to two more letters they also meet by deletions.
WINNOWED = 17


def list_split(lab: str | None) -> str | None:
    """train, val or test: the last word of a list's name; null for another word or no list."""
    if lab is None:
        return None
    words = re.findall(r"[^\W\d_]+", re.sub(r"\.lab\s*$", "", lab.casefold()))
    return _SPLIT.get(words[-1]) if words else None


def recording_key(path: str | None) -> tuple[str, str] | None:
    """(letters, numbers) of the recording that a path names; null for a path without a name."""
    if path is None:
        return None
    base = re.split(r"[\\/]", unquote(path).strip())[-1]
    stem = re.sub(r"\.[A-Za-z][A-Za-z0-9]{0,4}\s*$", "", base) if "." in base[1:] else base
    bare = "".join(c for c in unicodedata.normalize("NFKD", stem) if not unicodedata.combining(c)).casefold()
    parts = [x for x in re.split(r"[\W_]+", bare) if x]
    if len(parts) > 1 and parts[0].isdigit():
        parts = parts[1:]
    elif parts and (m := _GLUED.fullmatch(parts[0])):
        parts[0] = m[1]
    words, numbers, i = [], [], 0
    while i < len(parts):
        x = parts[i]
        m = _NUMBERED.fullmatch(x)
        if m and (m[2] or x[-1] == "0"):
            numbers.append(f"{m[1]}{int(m[2] or 0)}")
        elif m and i + 1 < len(parts) and parts[i + 1].isdigit():
            numbers.append(f"{m[1]}{int(parts[i + 1])}")
            i += 1
        elif x not in REMARKS and not _RATE.fullmatch(x):
            words.append(x)
        i += 1
    name = "".join(words)
    return (name, " ".join(sorted(numbers))) if name else None


def slips_allowed(n: int) -> int:
    """Slips between two names, the shorter of n letters: two, four from 20 letters on and three from 15, always fewer than half of the letters."""
    return min(2 * SLIPS, max(n // 5, min(SLIPS, (n - 1) // 2)))


def deletions(name: str) -> set[str]:
    """The name without up to two of its letters: names within two slips of one another have one of these in common."""
    one = {name[:i] + name[i + 1 :] for i in range(len(name))}
    return {name} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}


def fingerprints(name: str, listed: bool = True) -> list[tuple[int, int, int]]:
    """(hash, offset, k) selected from a name: the rightmost smallest of each window, for every class the name belongs to; k is 0 for deletions.

    Two names that both have the longest class's length meet in that class only: of the names of the middle class, ``listed``
    (training) ones and others take different marks where they are so long.
    """
    n = len(name)
    most = max(lo for lo, *_ in CLASSES.values())
    out: set[tuple[int, int, int]] = set()
    for c, (lo, hi, k, w) in CLASSES.items():
        if lo <= n <= hi:
            h = [xxhash.xxh64_intdigest(c + name[i : i + k]) >> 1 for i in range(n - k + 1)]
            for i in range(max(1, len(h) - w + 1)):
                j = min(range(i, min(i + w, len(h))), key=lambda x: (h[x], -x))
                marks = (0,) if lo == most else ((1,) if listed else (0,)) if n >= most else ((0,) if listed else (0, 1))
                out |= {(h[j] ^ m, j, k) for m in marks}
    if n < WINNOWED + SLIPS:
        out |= {(xxhash.xxh64_intdigest("d" + x) >> 1, 0, 0) for x in deletions(name)}
    return sorted(out)


def aligned(a: str, b: str, limit: int = 2 * SLIPS) -> int | None:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b; null beyond the limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return None
    big = limit + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [big] * len(b)
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            v = min(one[j - 1] + (x != y), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = v
        if min(row) > limit:
            return None
        two, one = one, row
    return one[-1] if one[-1] <= limit else None


def chained(a: str, b: str, seeds: list[tuple[int, int, int]], limit: int) -> tuple[int, int] | None:
    """(slips, seeds of the chain) of two names: the longest chain of seeds that ascend in both, extended by aligning what lies between them.

    A chain may go astray where a run occurs twice, so names that it does not explain without slips are aligned whole as well.
    """
    seeds = sorted(set(seeds))
    best: list[tuple[int, int]] = []  # length of the chain that ends here, and the seed before
    for i, (x, y, _) in enumerate(seeds):
        before = [(best[j][0], -j) for j in range(i) if seeds[j][0] < x and seeds[j][1] < y]
        n, j = max(before, default=(0, 1))
        best.append((n + 1, -j))
    chain: list[tuple[int, int, int]] = []
    at = max(range(len(seeds)), key=lambda i: best[i][0]) if seeds else -1
    while at >= 0:
        chain.append(seeds[at])
        at = best[at][1]
    total, ea, eb = 0, 0, 0
    for x, y, k in [*reversed(chain), (len(a), len(b), 0)]:
        skip = max(ea - x, eb - y, 0)  # a seed that overlaps the one before only counts beyond it
        if k and skip >= k:
            continue
        part = aligned(a[ea : x + skip], b[eb : y + skip], limit - total)
        if part is None:
            total = limit + 1
            break
        total, ea, eb = total + part, x + k, y + k
    if total:
        whole = aligned(a, b, min(total - 1, limit))
        total = total if whole is None else whole
    return None if total > limit else (total, len(chain))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(f, list_split(lab), recording_key(p)) for f, p, lab in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows = [(f, s, *k) for f, s, k in rows if s is not None and k is not None]
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["file_id", "split", "name", "numbers"])


def named_files(files: DataFrame) -> DataFrame:
    """file_id, split, name, numbers of entries that are in a split and name a recording; entries without an id are left out."""
    return files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("lab_fln").cast("string").alias("lab_fln")).mapInArrow(_keys, "file_id long, split string, name string, numbers string")


def _prints(listed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprints(x, listed) for x in b.column(0).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        h, o, k = (pa.array([x[i] for f in found for x in f], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), h, o, k], names=["name", "numbers", "h", "o", "k"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, s = (b.column(x).to_pylist() for x in ("name_a", "name_b", "met"))
        d = [chained(x, y, [(z["oa"], z["ob"], z["k"]) for z in m], slips_allowed(min(len(x), len(y)))) for x, y, m in zip(a, c, s)]
        t = pa.Table.from_batches([b]).select(["name_a", "name_b", "numbers"]).filter(pa.array([x is not None for x in d], pa.bool_()))
        t = t.append_column("seeds", pa.array([x[1] for x in d if x], pa.int32())).append_column("slips", pa.array([x[0] for x in d if x], pa.int32()))
        t = t.append_column("coverage", pa.array([1.0 - x[0] / max(len(p), len(q)) for x, p, q in zip(d, a, c) if x], pa.float64()))
        yield from t.combine_chunks().to_batches()


def overlapping_names(named: DataFrame) -> DataFrame:
    """name_a (training), name_b (val or test), numbers, seeds of the chain, slips, coverage (the aligned share of the longer name) of names of one recording."""

    # Names are few bytes and much work, so they are spread over all cores, whatever their size.
    parts = 2 * named.sparkSession.sparkContext.defaultParallelism

    def prints(listed: bool) -> DataFrame:
        own = named.where("split = 'train'" if listed else "split <> 'train'").select("name", "numbers").repartition(parts, "name", "numbers").distinct()
        return own.mapInArrow(functools.partial(_prints, listed), "name string, numbers string, h long, o int, k int")

    a = prints(True).withColumnsRenamed({"name": "name_a", "o": "oa"})
    b = prints(False).withColumnsRenamed({"name": "name_b", "o": "ob"}).drop("k")
    # Seeds of one pair lie on a band of diagonals no wider than its slips; a swap is two of the edits counted here.
    seeds = a.join(b, ["numbers", "h"]).where(F.abs(F.col("oa") - F.col("ob")) <= 2 * SLIPS)
    met = F.collect_set(F.when(F.col("k") > 0, F.struct("oa", "ob", "k"))).alias("met")  # no more than the letters of a name squared
    pairs = seeds.groupBy("name_a", "name_b", "numbers").agg(met).where((F.col("name_a") == F.col("name_b")) | (F.levenshtein("name_a", "name_b", 4 * SLIPS) >= 0))
    return pairs.mapInArrow(_confirm, "name_a string, name_b string, numbers string, seeds int, slips int, coverage double")


def overlaps(files: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs of a training entry and a val or test entry of one recording, whatever their data sets:
    train_file, eval_file, eval_split, seeds, slips, coverage.

    Entries without list, path or id are in no pair; repeated rows count once; an empty table gives no rows.
    """
    named = ws.keep(named_files(files).distinct())  # read by every side of the joins
    names = overlapping_names(named)
    t = named.where("split = 'train'").select(F.col("file_id").alias("train_file"), F.col("name").alias("name_a"), "numbers")
    e = named.where("split <> 'train'").select(F.col("file_id").alias("eval_file"), F.col("split").alias("eval_split"), F.col("name").alias("name_b"), "numbers")
    return names.join(t, ["name_a", "numbers"]).join(e, ["name_b", "numbers"]).select("train_file", "eval_file", "eval_split", "seeds", "slips", "coverage").where("train_file <> eval_file")


def overlap_pairs(files: DataFrame, ws: Workspace) -> DataFrame:
    """file_id_a < file_id_b, each pair once."""
    return ws.finish(overlaps(files, ws).select(F.least("train_file", "eval_file").alias("file_id_a"), F.greatest("train_file", "eval_file").alias("file_id_b")).distinct())


def overlap_report(files: DataFrame, ws: Workspace) -> DataFrame:
    """Per split and data set of the val or test entry: entries, entries listed for training too, pairs, and the least coverage."""
    o = overlaps(files, ws)
    ds = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("eval_file"), F.lower(F.trim(F.col("dataset").cast("string"))).alias("dataset")).distinct()
    every = named_files(files).where("split <> 'train'").select(F.col("file_id").alias("eval_file"), F.col("split").alias("eval_split")).distinct()
    # Each entry's pairs are counted before the report is grouped, so that a hot recording arrives as one row an entry.
    hit = o.groupBy("eval_file", "eval_split").agg(F.count("*").alias("pairs"), F.min("coverage").alias("coverage"))
    return ws.finish(
        every.join(ds, "eval_file")
        .join(hit, ["eval_file", "eval_split"], "left")
        .groupBy("eval_split", "dataset")
        .agg(F.count("*").alias("entries"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.min("coverage").alias("least_coverage"))
    )
