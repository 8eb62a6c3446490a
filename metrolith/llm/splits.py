"""Splits that keep related files together: grouped iterative stratification.

Files are related by performer, session or bar. Related files form components; a component is
placed as a whole, those with the rarest outstanding label first, into the split that needs
it most. Nothing but counts of rows reaches the driver: components are placed by tasks, in
buckets, those that are rare or large in fewer buckets and before the others.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.operators.components import LOCAL_EDGES, connected_components
from metrolith.session import Workspace

#: Values that name nobody or nothing, as letters and digits in order of the parts.
NOBODY = {
    "", "unknown", "a n", "na", "n a", "none", "null", "nil", "nan", "anon", "anonymous", "various", "various artists", "artists various", "va", "a v", "v a",
    "tbd", "tba", "tbc", "unnamed", "nobody", "n n", "nn", "artist unknown", "unknown artist", "missing", "undefined", "not available", "available not", "diverse", "0", "x", "xx", "xxx",
}
#: Labels of meters begin so, and the label of bars.
METER, BARS = "meter=", "bars"
#: Components of a bucket on the lowest level, components like it that a component's bucket has room for, buckets to a bucket of the level above.
BUCKET, FINE, FAN = 32_768, 200, 16
PROPORTIONS = {"train": 0.80, "val": 0.08, "test": 0.12}

_PARTS = re.compile(r"[\W_]+")


def performer_key(name: str | None) -> str | None:
    """A performer without case, accents, spacing, punctuation and order of the parts; null for nobody."""
    if name is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold()
    key = " ".join(sorted(x for x in _PARTS.split(bare) if x))
    return None if key in NOBODY else key


def session_key(value: str | None) -> str | None:
    """A session id without case and outer blanks; null for none."""
    if value is None:
        return None
    key = value.strip().casefold()
    return None if " ".join(_PARTS.split(key)).strip() in NOBODY else key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files, kinds, values = [], [], []
        for f, p, s in zip(*(b.column(i).to_pylist() for i in range(3))):
            for kind, v in (("performer", performer_key(p)), ("session", session_key(s))):
                if v is not None:
                    files.append(f)
                    kinds.append(kind)
                    values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["file_id", "kind", "value"])


def related_edges(files: DataFrame, bars: DataFrame) -> DataFrame:
    """Edges a, b from each file to the smallest file that shares a performer, session or bar with it.

    A star a value, never all pairs; bars of files that are not listed relate nothing.
    """
    known = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("performer").cast("string").alias("performer"), F.col("session_id").cast("string").alias("session_id"))
    shared = known.mapInArrow(_keys, "file_id long, kind string, value string")
    by_bar = (
        bars.where("bar_id is not null and bar2file is not null")
        .select(F.col("bar2file").cast("long").alias("file_id"), F.lit("bar").alias("kind"), F.col("bar_id").cast("string").alias("value"))
        .distinct()
        .join(known.select("file_id").distinct(), "file_id", "left_semi")
    )
    owners = shared.unionByName(by_bar)
    first = owners.groupBy("kind", "value").agg(F.min("file_id").alias("b"), F.max("file_id").alias("other")).where("b <> other").select("kind", "value", "b")
    return owners.join(first, ["kind", "value"]).where("file_id <> b").select(F.col("file_id").alias("a"), "b")


def related_files(files: DataFrame, bars: DataFrame, ws: Workspace, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """file_id, group_file_id of every file that is related to another one.

    Null keys and words that name nobody relate nothing; repeated rows count once; empty tables give no rows.
    """
    return ws.finish(connected_components(related_edges(files, bars), ws, local_limit).select(F.col("node").alias("file_id"), F.col("component").alias("group_file_id")))


def file_labels(files: DataFrame, meters: DataFrame) -> DataFrame:
    """Labels to keep in proportion: a file's data set (so that files are, too), and the meters of all its sections (1 to 32), each once. Bars come on top, by number."""
    ds = files.select("file_id", F.concat(F.lit("dataset="), F.coalesce(F.lower(F.trim(F.col("dataset").cast("string"))), F.lit("?"))).alias("label"))
    each = meters.where("file_id is not null and num between 1 and 32").select("file_id", "num").distinct()
    return ds.unionByName(each.join(files.select("file_id"), "file_id", "left_semi").select("file_id", F.concat(F.lit(METER), F.col("num").cast("string")).alias("label")))


def stratify(vectors: dict[int, dict[str, int]], shares: dict[str, list[float]], proportions: list[float]) -> dict[int, int]:
    """Split (by number) of each component of label counts, by grouped iterative stratification.

    ``shares`` tells for each label what part of its items here each split is to get. Components that hold more of a label
    than the smallest split is to get come first, then the others, both in the same way: after each placement the label with
    the fewest outstanding items is chosen anew, and of its components the one with most of them is placed next: into that
    of the splits with room for it under this label that it overfills least under all its labels, of equals the one whose
    shares of them are least filled; where none has room, the one that lacks most of the label.
    """
    totals: dict[str, int] = {}
    for x in vectors.values():
        for k, n in x.items():
            totals[k] = totals.get(k, 0) + n
    labels = {k: i for i, k in enumerate(sorted(totals))}
    total = np.array([totals[k] for k in labels], float)
    need = total[:, None] * np.array([shares[k] for k in labels], float).reshape(len(labels), -1)
    fill = 1.0 / (total[:, None] * np.array(proportions))
    left = total.copy()
    rows = {c: (np.array([labels[k] for k in x]), np.array(list(x.values()), float)) for c, x in vectors.items()}
    placed: dict[int, int] = {}
    # What holds more of a label than the smallest split is to get can only fit while the others are open.
    large = {c for c, (at, n) in rows.items() if (n > min(proportions) * total[at]).any()}
    for part in (large, rows.keys() - large):
        carriers: list[list[tuple]] = [[] for _ in labels]
        for c in part:
            at, counts = rows[c]
            for i, n in zip(at.tolist(), counts.tolist()):
                carriers[i].append((-n, -counts.sum(), c))
        for of in carriers:
            of.sort(reverse=True)
        rarest = [(left[i], i) for i in range(len(left)) if carriers[i]]
        heapq.heapify(rarest)
        while rarest:
            n_left, i = heapq.heappop(rarest)
            of = carriers[i]
            while of and of[-1][2] in placed:
                of.pop()
            if not of:
                continue
            if n_left != left[i]:  # outstanding items have been placed by way of other labels
                heapq.heappush(rarest, (left[i], i))
                continue
            n, _, c = of.pop()
            at, counts = rows[c]
            room = need[i] >= -n
            if room.any():
                open_, beyond = need[at] * fill[at], np.maximum(counts[:, None] - need[at], 0.0) * fill[at]
                s = int(np.lexsort((-open_.sum(0), beyond.sum(0), ~room))[0])
            else:
                s = int(np.argmax(need[i]))
            placed[c] = s
            need[at, s] -= counts
            left[at] -= counts
            heapq.heappush(rarest, (left[i], i))
    return placed


def _place(names: list[str], proportions: list[float]):
    def run(key, t):
        comps, labels, ns = (t.column(c).to_pylist() for c in ("component", "label", "n"))
        vectors: dict[int, dict[str, int]] = {}
        for c, k, n in sorted(zip(comps, labels, ns)):
            vectors.setdefault(c, {})[k] = n
        placed = stratify(vectors, dict(zip(labels, t.column("open").to_pylist())), proportions)
        return pa.table({"component": pa.array(list(placed), pa.int64()), "split": pa.array([names[s] for s in placed.values()], pa.string())})

    return run


def assign_splits(files: DataFrame, bars: DataFrame, meters: DataFrame, ws: Workspace, proportions: dict[str, float] | None = None, bucket: int = BUCKET, fine: int = FINE, fan: int = FAN) -> DataFrame:
    """file_id, component, split of every file (each once; null file ids are left out).

    Components are placed bucket by bucket, at ``fan`` times as many buckets a level as on the level above, until one has
    ``bucket`` components. A component goes to the lowest level on which a bucket has room for at least ``fine`` like it under
    each of its labels, so what is rare or large is placed first and together, and the splits' needs that it leaves are
    shared out below. A bucket has at most ``fine * fan`` components a label, or ``bucket``, whatever the size of the data.
    Proportions are met as nearly as whole components allow; a component above them still stays whole.
    """
    proportions = proportions or PROPORTIONS
    names, goal = list(proportions), list(proportions.values())
    listed = files.where("file_id is not null").withColumn("file_id", F.col("file_id").cast("long")).dropDuplicates(["file_id"])
    groups = related_files(files, bars, ws)
    member = ws.keep(listed.join(groups, "file_id", "left").select("file_id", F.coalesce("group_file_id", "file_id").alias("component"), "dataset"))
    labelled = file_labels(member, meters).join(member.select("file_id", "component"), "file_id").groupBy("component", "label").agg(F.count("*").alias("n"))
    with_bars = bars.where("bar2file is not null").select(F.col("bar2file").cast("long").alias("file_id"), "bar_id").distinct().join(member.select("file_id", "component"), "file_id").groupBy("component").agg(F.lit(BARS).alias("label"), F.count("*").alias("n"))
    vectors = ws.keep(labelled.unionByName(with_bars))
    totals = ws.keep(vectors.groupBy("label").agg(F.sum("n").alias("total")))
    room = vectors.join(totals, "label").groupBy("component").agg(F.min(F.col("total") / F.col("n")).alias("room"))
    lowest = 0
    count = member.select("component").distinct().count()
    while count > bucket * fan**lowest:
        lowest += 1
    level = F.least(F.greatest(F.floor(F.log(F.col("room") / fine) / math.log(fan)), F.lit(0)), F.lit(lowest)).cast("int")
    placed = ws.keep(vectors.join(room.select("component", level.alias("level")), "component"))
    done: list[DataFrame] = []
    need = [F.col("total") * p for p in goal]
    for j in range(lowest + 1):
        if done:
            # What the levels above have left of each label's share.
            so_far = vectors.join(done[-1], "component").groupBy("label").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"_{i}") for i, s in enumerate(names)])
            totals = ws.keep(totals.join(so_far, "label", "left").select("label", "total", *[(F.coalesce(f"got{i}", F.lit(0)) + F.coalesce(f"_{i}", F.lit(0))).alias(f"got{i}") for i in range(len(names))]))
            need = [F.greatest(F.col("total") * p - F.col(f"got{i}"), F.lit(0.0)) for i, p in enumerate(goal)]
        else:
            totals = totals.select("label", "total", *[F.lit(0).cast("long").alias(f"got{i}") for i in range(len(names))])
        lacking = sum(need, F.lit(0.0))
        shares = totals.select("label", F.when(lacking > 0, F.array(*[x / lacking for x in need])).otherwise(F.array(*map(F.lit, goal))).alias("open"))
        here = placed.where(F.col("level") == j).join(shares, "label").withColumn("bucket", F.pmod(F.xxhash64("component", F.lit("split")), F.lit(fan**j)))
        done.append(ws.keep(here.select("bucket", "component", "label", "n", "open").groupBy("bucket").applyInArrow(_place(names, goal), "component long, split string")))
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    return ws.finish(member.join(chosen, "component").select("file_id", "component", "split"))


def bar_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """bar_id, bar2file, split of every distinct bar and file; null where the bar has no listed file."""
    return bars.select("bar_id", F.col("bar2file").cast("long").alias("bar2file")).distinct().join(splits.select(F.col("file_id").alias("bar2file"), "split"), "bar2file", "left").select("bar_id", "bar2file", "split")
