"""Connected components of an edge list, by contraction.

Each round points every node at its smallest neighbour (or itself), shortens the pointers, and
replaces edges by those between the nodes pointed at. The node count falls by at least half a
round. What is left below ``local_limit`` edges is closed by one task with a union-find; the
labels of earlier rounds follow by joins. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.session import Workspace

#: Edges that one task may close: 16 bytes each.
LOCAL_EDGES = 400_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo != hi
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tab = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    n, c = union_find(tab.column("a").to_numpy(), tab.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c)], names=["node", "component"])


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops, nulls or repeats: a < b."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def connected_components(edges: DataFrame, ws: Workspace, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """Every node (BIGINT) with an edge to another one, and the smallest node of its component: node, component.

    ``edges`` has columns a and b; loops, repeats and rows with a null add nothing, and an empty
    list gives no rows.
    """
    e = ws.keep(simple_edges(edges))
    maps: list[DataFrame] = []
    while (n := e.count()) > local_limit:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ws.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        far = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        p = ws.keep(up.join(far, "p").select("a", F.col("pp").alias("p")))
        pa_, pb = p.select("a", F.col("p").alias("pa")), p.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e2 = ws.keep(simple_edges(e.join(pa_, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
        ws.drop(up, e)
        maps.append(p)
        e = e2
    out = e.coalesce(1).mapInArrow(_close, "node long, component long") if n else e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for p in reversed(maps):
        last = out.select(F.col("node").alias("p"), "component")
        out = p.join(last, "p", "left").select(F.col("a").alias("node"), F.coalesce("component", "p").alias("component"))
    return out
