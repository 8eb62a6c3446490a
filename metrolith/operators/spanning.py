"""Minimum spanning forest of a weighted edge list: distributed Borůvka.

Each round every component takes its lightest edge (ties by the edge's ends), components that
meet are merged, and of parallel edges between merged components only the lightest stays. Once
``local_limit`` edges or fewer are left, one task finishes them with Kruskal's method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.operators.components import LOCAL_EDGES, connected_components
from metrolith.session import Workspace


def kruskal(x: np.ndarray, y: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of a minimum spanning forest's edges x-y; of equal weights, those of the smaller (a, b) first."""
    _, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = inv[: len(x)].tolist(), inv[len(x) :].tolist()
    root = list(range(int(inv.max()) + 1 if len(inv) else 0))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for e in np.lexsort((b, a, w)).tolist():
        p, q = find(u[e]), find(v[e])
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(e)
    return np.array(keep, int)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])
    t = pa.Table.from_batches(list(batches), schema=schema)
    keep = kruskal(*(t.column(c).to_numpy() for c in ("x", "y", "w", "a", "b")))
    t = t.take(pa.array(keep)).select(["a", "b", "w"])
    yield from t.combine_chunks().to_batches()


def spanning_forest(edges: DataFrame, ws: Workspace, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """Edges a < b, w of a minimum spanning forest of ``edges`` (a, b, w).

    Loops and rows with a null are left out; of repeats the lightest counts; an empty list gives no rows.
    """
    lo, hi = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    ends = edges.where("a is not null and b is not null and w is not null and a <> b").select(lo.alias("a"), hi.alias("b"), F.col("w").cast("double").alias("w"))
    e = ws.keep(ends.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b"))
    parts: list[DataFrame] = []
    while (n := e.count()) > local_limit:
        edge = F.struct("w", "a", "b", "x", "y")
        both = e.select("x", edge.alias("e")).unionByName(e.select(F.col("y").alias("x"), edge.alias("e")))
        chosen = ws.keep(both.groupBy("x").agg(F.min("e").alias("e")).select("e.*").distinct())
        parts.append(chosen.select("a", "b", "w"))
        comp = ws.keep(connected_components(chosen.select(F.col("x").alias("a"), F.col("y").alias("b")), ws, local_limit))
        cx, cy = comp.select(F.col("node").alias("x"), F.col("component").alias("cx")), comp.select(F.col("node").alias("y"), F.col("component").alias("cy"))
        merged = e.join(cx, "x").join(cy, "y").where("cx <> cy").select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"), F.struct("w", "a", "b").alias("e"))
        e2 = ws.keep(merged.groupBy("x", "y").agg(F.min("e").alias("e")).select("x", "y", "e.*"))
        ws.drop(e, comp)
        e = e2
    out = e.select("x", "y", "w", "a", "b").coalesce(1).mapInArrow(_finish, "a long, b long, w double") if n else e.select("a", "b", "w")
    for p in parts:
        out = out.unionByName(p)
    return out
