"""Bars grouped by profile: hierarchical density clustering.

A bar's profile is the logarithm of its cells without its mean, so levels do not matter. Bars
are compared with those near them in the order of a random-hyperplane code, in blocks of a fixed
size, which gives a sparse graph with the links of every block's own spanning tree. Bars that are
alone in their block, and some of each group that is not, meet again under further sets of
hyperplanes, which links the groups of different blocks. Links are weighted by mutual
reachability: the distance, or the core distance of an end where that is larger. The minimum
spanning forest comes from distributed Borůvka rounds. What the blocks have missed is found
exactly: the groups are cut into balls, all balls and lone bars are compared by a lower bound on
the distance of their members, and only those it cannot part are compared bar by bar. The forest
is condensed from the leaves upwards into a tree of clusters of a least size, of which those
with the greatest stability are selected; splits below the tolerance are none, and members that
join only beyond it are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.operators.components import LOCAL_EDGES, connected_components, union_find
from metrolith.operators.spanning import kruskal, spanning_forest
from metrolith.session import Workspace

#: Root mean square difference of log profiles up to which deviations are small.
TOLERANCE = 0.4
#: Sets of hyperplanes, bits of a code, bars of a block.
ROUNDS, BITS, BLOCK = 8, 40, 384
#: Bars of each group of a block that stand for it under the further sets of hyperplanes.
DELEGATES = 8
#: A bar's core distance is that of the neighbour of this rank, or of the last one within the tolerance where there are fewer.
MIN_SAMPLES = 5
#: Bars that make a cluster; levels of the hierarchy below the tolerance, and the factor between levels.
LEAST, BELOW, GROWTH = 2, 6, 2**0.5
#: Profiles that agree better than this count as this near.
NEAREST = 1e-3
#: Share of cells two bars must both have to be compared.
SHARED = 0.5
#: Bars that may form one ball, balls and lone bars compared at a time, and what rounding may add to a root mean square.
BALL, PIECE, SLACK = 512, 1024, 1e-3


def profile(cells: np.ndarray) -> np.ndarray:
    """log of the positive finite cells without their mean; NaN elsewhere."""
    x = np.where(np.isfinite(cells) & (cells > 0), cells, np.nan)
    z = np.log(x)
    ok = np.isfinite(z)
    n = ok.sum(axis=-1, keepdims=True)
    return z - np.where(ok, z, 0).sum(axis=-1, keepdims=True) / np.maximum(n, 1)


def distances(z: np.ndarray) -> np.ndarray:
    """Root mean square differences over the cells both rows have, their mean taken out; inf where they share too few."""
    n, dim = z.shape
    ok = np.isfinite(z)
    v = np.where(ok, z, 0.0)
    sq = (v * v).sum(1)
    d2 = (sq[:, None] + sq[None, :] - 2 * v @ v.T) / dim
    lacking = np.flatnonzero(~ok.all(1))
    if len(lacking):
        m = ok.astype(float)
        v1, m1 = v[lacking], m[lacking]
        shared = m1 @ m.T
        s2 = (v1 * v1) @ m.T + m1 @ (v * v).T - 2 * v1 @ v.T
        s1 = v1 @ m.T - m1 @ v.T
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(shared >= max(SHARED * dim, 2), s2 / shared - (s1 / shared) ** 2, np.inf)
        d2[lacking] = part
        d2[:, lacking] = part.T
    d = np.sqrt(np.maximum(d2, 0.0))
    np.fill_diagonal(d, np.inf)
    return np.maximum(d, NEAREST)


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The ``distances`` of each row of x to each of y."""
    dim = x.shape[1]
    okx, oky = np.isfinite(x), np.isfinite(y)
    v, u = np.where(okx, x, 0.0), np.where(oky, y, 0.0)
    d2 = ((v * v).sum(1)[:, None] + (u * u).sum(1)[None, :] - 2 * v @ u.T) / dim

    def part(v, okv, u, oku):
        m, n = okv.astype(float), oku.astype(float)
        shared = m @ n.T
        s2 = (v * v) @ n.T + m @ (u * u).T - 2 * v @ u.T
        s1 = v @ n.T - m @ u.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared >= max(SHARED * dim, 2), s2 / shared - (s1 / shared) ** 2, np.inf)

    rows, cols = np.flatnonzero(~okx.all(1)), np.flatnonzero(~oky.all(1))
    if len(rows):
        d2[rows] = part(v[rows], okx[rows], u, oky)
    if len(cols):
        d2[:, cols] = part(v, okx, u[cols], oky[cols])
    return np.maximum(np.sqrt(np.maximum(d2, 0.0)), NEAREST)


def balls(z: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """Rows divided into balls: positions, centre, radius and cells a member may lack.

    The radius is the root of the largest sum of squares of a member's differences from the
    centre over its own cells, their mean taken out; over any fewer cells the sum is no larger.
    """
    d, left, out = distances(z), np.ones(len(z), bool), []
    for i in range(len(z)):
        if not left[i]:
            continue
        rows = np.flatnonzero(left & ((d[i] <= reach) | (np.arange(len(z)) == i)))
        left[rows] = False
        if len(rows) == 1:
            out.append((rows, z[i], 0.0, 0))
            continue
        ok = np.isfinite(z[rows])
        n = ok.sum(0)
        c = np.where(n > 0, np.where(ok, z[rows], 0.0).sum(0) / np.maximum(n, 1), np.nan)
        c = (c - np.nanmean(c)).astype(np.float32).astype(float)
        e = np.where(ok, z[rows] - np.where(n > 0, c, 0.0), 0.0)
        size = ok.sum(1)
        r2 = (e * e).sum(1) - e.sum(1) ** 2 / size
        out.append((rows, c, float(np.sqrt(max(r2.max(), 0.0))), int((n > 0).sum() - size.min())))
    return out


def may_meet(u: np.ndarray, lack: np.ndarray, radius: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether members of two balls may lie within the tolerance; false only where none can.

    ``u`` has the differences of two centres, NaN where one has no cell. Two members share all of those cells but ``lack``
    at most. The least sum of squares (mean taken out) over s of the cells is that of neighbours in sorted order.
    """
    dim = u.shape[1]
    count, out = np.isfinite(u).sum(1), np.zeros(len(u), bool)
    sure = max(int(np.ceil(SHARED * dim)), 2)
    for n, k in np.unique(np.stack([count, lack], 1), axis=0).tolist() if len(u) else []:
        if n < sure:
            continue
        rows = np.flatnonzero((count == n) & (lack == k))
        x = np.sort(u[rows], axis=1)[:, :n]
        c1, c2 = (np.concatenate([np.zeros((len(rows), 1)), np.cumsum(y, axis=1)], axis=1) for y in (x, x * x))

        def least(at, s):
            a = c1[at, s:] - c1[at, : n + 1 - s]
            return np.sqrt(np.maximum((c2[at, s:] - c2[at, : n + 1 - s] - a * a / s).min(1), 0.0))

        low = max(n - k, sure)
        at = np.flatnonzero(least(slice(None), low) <= (tolerance + SLACK) * np.sqrt(n) + radius[rows])
        open_ = np.zeros(len(at), bool)
        for s in range(low, n + 1):
            open_ |= least(at, s) <= (tolerance + SLACK) * np.sqrt(s) + radius[rows[at]]
        out[rows[at[open_]]] = True
    return out


def core_distances(d: np.ndarray, min_samples: int, tolerance: float) -> np.ndarray:
    """Distance of each row's neighbour of a rank, or of its last one within the tolerance; 0 for rows without one."""
    near = np.sort(np.where(d <= tolerance, d, np.inf), axis=1)[:, : max(min(min_samples, len(d) - 1), 1)]
    return np.where(np.isfinite(near), near, 0.0).max(axis=1)


def block_tree(z: np.ndarray, min_samples: int = MIN_SAMPLES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends and distances of the edges of a block's minimum spanning forest under mutual reachability (Prim), and the core distances of its rows."""
    n = len(z)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(n)
    d = distances(z)
    core = core_distances(d, min_samples, tolerance)
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, link, out = w[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    out[0] = True
    best[0] = np.inf
    a, b = [], []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(out, np.inf, best)))
        if out[j]:
            j = int(np.flatnonzero(~out)[0])
        if np.isfinite(best[j]):
            a.append(link[j])
            b.append(j)
        out[j] = True
        closer = ~out & (w[j] < best)
        best[closer] = w[j][closer]
        link[closer] = j
    a, b = np.array(a, int), np.array(b, int)
    return a, b, d[a, b], core


def _planes(dim: int, rounds: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, rounds * bits)).astype(np.float32)


def _profiles(rounds: int, bits: int, seed: int):
    """Profiles of usable bars with their codes; ``lacks`` is the number of missing cells, in powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            arr = b.column("cells")
            lengths = np.diff(arr.offsets.to_numpy())
            flat = arr.values.to_numpy(zero_copy_only=False).astype(float)
            starts = arr.offsets.to_numpy()[:-1]
            ids = b.column("bar_id").to_numpy()
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                z = profile(flat[starts[rows][:, None] + np.arange(dim)])
                usable = np.isfinite(z).sum(1) >= max(2, SHARED * dim)
                rows, z = rows[usable], z[usable].astype(np.float32)
                if not len(rows):
                    continue
                if dim not in planes:
                    planes[dim] = _planes(dim, rounds, bits, seed)
                code = ((np.nan_to_num(z) @ planes[dim]) > 0).reshape(len(rows), rounds, bits) @ weight
                half = z.astype(np.float16)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[rows], pa.int64()), pa.array(np.full(len(rows), dim, np.int32)),
                    pa.array([x.tobytes() for x in half], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, rounds, dtype=np.int32)), pa.array(code.ravel())),
                    pa.array(np.ceil(np.log2((~np.isfinite(z)).sum(1) + 1)).astype(np.int32)),
                ], names=["bar_id", "dim", "z", "codes", "lacks"])

    return run


_LINKS = "a long, b long, w double, dim int, z binary, codes array<bigint>"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("dim", pa.int32()), ("z", pa.binary()), ("codes", pa.list_(pa.int64()))])


def delegates(n: int, a: np.ndarray, b: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Positions that stand for a block's n bars: up to ``most`` of each component of the edges marked near."""
    label = np.arange(n)
    nodes, root = union_find(a[near], b[near])
    label[nodes] = root
    order = np.lexsort((np.random.default_rng(n).random(n), label))
    rank = np.arange(n) - np.maximum.accumulate(np.where(np.r_[True, np.diff(label[order]) != 0], np.arange(n), 0))
    return np.sort(order[rank < most])


def _block_links(block: int, min_samples: int, tolerance: float, most: int):
    """Edges of each block's tree (a, b, w, the distance), core distances (a, w) and, where ``most`` is positive, its delegates (a, dim, z, codes) for further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def emit(key, ids, z, codes):
            x = np.frombuffer(b"".join(z), np.float16).reshape(len(ids), -1).astype(float)
            a, b, w, core = block_tree(x, min_samples, tolerance)
            dense = np.flatnonzero(core > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[dense]), pa.nulls(len(dense), pa.int64()), pa.array(core[dense]), pa.nulls(len(dense), pa.int32()), pa.nulls(len(dense), pa.binary()), pa.nulls(len(dense), pa.list_(pa.int64()))], schema=_LINKS_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(w), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.list_(pa.int64()))], schema=_LINKS_ARROW)
            if most:
                d = delegates(len(ids), a, b, w <= tolerance, most)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.float64()), pa.array(np.full(len(d), key[0], np.int32)), pa.array([z[i] for i in d], pa.binary()), pa.array([codes[i] for i in d], pa.list_(pa.int64()))], schema=_LINKS_ARROW)

        for batch in batches:
            dims, rounds, ids = (batch.column(c).to_numpy() for c in ("dim", "round", "bar_id"))
            z, codes = batch.column("z").to_pylist(), batch.column("codes").to_pylist()
            change = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (rounds[1:] != rounds[:-1])]) if len(ids) else []
            for lo, hi in zip(change, [*change[1:], len(ids)]):
                key = (dims[lo], rounds[lo])
                part = ids[lo:hi], z[lo:hi], codes[lo:hi]
                if held is not None and held[0] != key:
                    yield from emit(*held)
                    held = None
                if held is not None:
                    part = np.concatenate([held[1], part[0]]), held[2] + part[1], held[3] + part[2]
                # Rows of one bar have one code and stand side by side; they count once.
                new = np.r_[True, part[0][1:] != part[0][:-1]]
                if not new.all():
                    part = part[0][new], [x for x, k in zip(part[1], new) if k], [x for x, k in zip(part[2], new) if k]
                while len(part[0]) > block:
                    yield from emit(key, *(x[:block] for x in part))
                    # The last bar opens the next block too, which ties neighbouring blocks together.
                    part = tuple(x[block - 1 :] for x in part)
                held = (key, *part)
        if held is not None:
            yield from emit(*held)

    return run


def bar_profiles(bars: DataFrame, rounds: int = ROUNDS, bits: int = BITS, seed: int = 7) -> DataFrame:
    """bar_id, dim, z, codes, lacks of every usable row of (bar_id, cells)."""
    return bars.mapInArrow(_profiles(rounds, bits, seed), "bar_id long, dim int, z binary, codes array<bigint>, lacks int")


def neighbour_graph(prof: DataFrame, ws: Workspace, block: int = BLOCK, min_samples: int = MIN_SAMPLES, tolerance: float = TOLERANCE, most: int = DELEGATES) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, w) of distances between bars of one length, and core distances (bar_id, core) of bars with a neighbour.

    ``prof`` comes from ``bar_profiles``; bars with several equal rows count once.
    """
    # Equal codes are put in another order each round, so that copies meet in other blocks.
    order = ["dim", "round", "code", F.xxhash64("bar_id", "round"), "bar_id"]
    cols = ["dim", "round", "bar_id", "z", "codes"]
    first = prof.drop("lacks").withColumn("round", F.lit(0)).withColumn("code", F.col("codes")[0])
    links = ws.keep(first.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols).mapInArrow(_block_links(block, min_samples, tolerance, most), _LINKS))
    again = links.where("z is not null").select(F.col("a").alias("bar_id"), "dim", "z", "codes", F.posexplode("codes").alias("round", "code")).where("round > 0").withColumn("codes", F.lit(None).cast("array<bigint>"))
    more = again.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols).mapInArrow(_block_links(block, min_samples, tolerance, 0), _LINKS)
    found = ws.keep(links.where("w is not null").select("a", "b", "w").unionByName(more.select("a", "b", "w")))
    return found.where("b is not null"), found.where("b is null").groupBy(F.col("a").alias("bar_id")).agg(F.min("w").alias("core"))


def reachability(links: DataFrame, cores: DataFrame) -> DataFrame:
    """Links with their mutual reachability: the distance, or an end's core distance if that is larger."""
    a, b = (cores.select(F.col("bar_id").alias(x), F.col("core").alias(f"_{x}")) for x in "ab")
    return links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.greatest("w", "_a", "_b").alias("w"))


_ITEMS = "dim int, comp long, n int, radius double, lack int, centre binary, ids array<bigint>, z binary"


def _items(tolerance: float):
    """Balls of the bars of one group (dim, comp, lacks) that stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def emit(key, ids, z):
            x = np.frombuffer(b"".join(z), np.float16).reshape(len(ids), -1).astype(float)
            found = balls(x, tolerance / 2)
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * len(found), pa.int32()), pa.array([key[1]] * len(found), pa.int64()), pa.array([len(b[0]) for b in found], pa.int32()),
                pa.array([b[2] for b in found], pa.float64()), pa.array([b[3] for b in found], pa.int32()), pa.array([b[1].astype(np.float32).tobytes() for b in found], pa.binary()),
                pa.array([ids[b[0]].tolist() for b in found], pa.list_(pa.int64())), pa.array([b"".join(z[i] for i in b[0]) for b in found], pa.binary()),
            ], names=["dim", "comp", "n", "radius", "lack", "centre", "ids", "z"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("dim", "comp", "lacks")]
            ids, z = batch.column("bar_id").to_numpy(), batch.column("z").to_pylist()
            change = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(ids) else []
            for lo, hi in zip(change, [*change[1:], len(ids)]):
                key, part = tuple(k[lo] for k in keys), (ids[lo:hi], z[lo:hi])
                if held is not None and held[0] != key:
                    yield from emit(*held)
                    held = None
                if held is not None:
                    part = np.concatenate([held[1], part[0]]), held[2] + part[1]
                while len(part[0]) > BALL:
                    yield from emit(key, *(x[:BALL] for x in part))
                    part = tuple(x[BALL:] for x in part)
                held = (key, *part)
        if held is not None:
            yield from emit(*held)

    return run


def _meetings(tolerance: float):
    """Pairs of items of different groups that may hold a link."""

    def run(key, t):
        dim, i, j = (int(k.as_py()) for k in key)
        item, comp, n, radius, lack, piece = (t.column(c).to_numpy() for c in ("item", "comp", "n", "radius", "lack", "piece"))
        z = np.frombuffer(b"".join(t.column("centre").to_pylist()), np.float32).reshape(-1, dim).astype(float)
        x, y = np.flatnonzero(piece == i), np.flatnonzero(piece == j)
        if not len(x) or not len(y):
            return pa.table({"item_a": pa.array([], pa.int64()), "item_b": pa.array([], pa.int64())})
        d, other = between(z[x], z[y]), comp[x][:, None] != comp[y][None, :]
        if i == j:
            other &= x[:, None] < y[None, :]
        ok = np.isfinite(z).astype(float)
        k = lack[x][:, None] + lack[y][None, :]
        far = (radius[x][:, None] + radius[y][None, :]) / np.sqrt(np.maximum(ok[x] @ ok[y].T, 1.0))
        hit = other & (k == 0) & (d <= tolerance + SLACK + far)
        # Only where cells may be lacking is the order of the differences needed.
        a, b = np.nonzero(other & (k > 0))
        for lo in range(0, len(a), 65536):
            p, q = a[lo : lo + 65536], b[lo : lo + 65536]
            hit[p, q] = may_meet(z[x[p]] - z[y[q]], k[p, q], radius[x[p]] + radius[y[q]], tolerance)
        a, b = np.nonzero(hit)
        return pa.table({"item_a": pa.array(item[x[a]]), "item_b": pa.array(item[y[b]])})

    return run


def _members(tolerance: float):
    """Links (a, b, w) within the tolerance between the bars of two items, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for dim, ia, za, ib, zb in zip(*(t.column(c).to_pylist() for c in ("dim", "ids_a", "z_a", "ids_b", "z_b"))):
                d = between(*(np.frombuffer(z, np.float16).reshape(-1, dim).astype(float) for z in (za, zb)))
                p, q = np.nonzero(d <= tolerance)
                a, b, w = np.array(ia, np.int64)[p], np.array(ib, np.int64)[q], d[p, q]
                keep = kruskal(a, b, w, a, b)
                for o, v in zip(out, (a, b, w)):
                    o.append(v[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["a", "b", "w"])

    return run


def missing_links(prof: DataFrame, tree: DataFrame, ws: Workspace, tolerance: float = TOLERANCE, local_limit: int = LOCAL_EDGES, piece: int = PIECE) -> DataFrame:
    """a, b, w: links (by distance) within the tolerance between groups that ``tree`` (a, b, w) leaves apart, enough of them to join all groups that any link joins.

    No pair of bars is left out: groups are cut into balls of up to 512 bars, and two of them are
    passed over only where the lower bound says that no bars of theirs can be within the
    tolerance. Lone bars are balls of one. The number of balls and lone bars is what counts squared.
    """
    base = connected_components(tree.where(F.col("w") <= tolerance).select("a", "b"), ws, local_limit)
    placed = prof.join(base.withColumnRenamed("node", "bar_id"), "bar_id", "left").select("dim", F.coalesce("component", "bar_id").alias("comp"), "lacks", F.col("codes")[0].alias("code"), "bar_id", "z")
    order = ["dim", "comp", "lacks", "code", "bar_id"]
    made = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_items(tolerance), _ITEMS)
    items = ws.keep(made.withColumn("item", F.monotonically_increasing_id()))
    pieces = F.greatest(F.ceil(F.col("count") / piece), F.lit(1)).cast("int")
    sizes = items.groupBy("dim").count().select("dim", pieces.alias("pieces"))
    cut = items.join(F.broadcast(sizes), "dim").withColumn("piece", F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int"))
    each = cut.select("dim", "item", "comp", "n", "radius", "lack", "centre", "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"))
    keyed = each.select("dim", F.least("piece", "k").alias("i"), F.greatest("piece", "k").alias("j"), "item", "comp", "n", "radius", "lack", "centre", "piece")
    parts = int(prof.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = ws.keep(keyed.repartition(parts, "dim", "i", "j").groupBy("dim", "i", "j").applyInArrow(_meetings(tolerance), "item_a long, item_b long"))
    held = [items.select(F.col("item").alias(f"item_{x}"), F.col("ids").alias(f"ids_{x}"), F.col("z").alias(f"z_{x}"), *(["dim"] if x == "a" else [])) for x in "ab"]
    return pairs.join(held[0], "item_a").join(held[1], "item_b").select("dim", "ids_a", "z_a", "ids_b", "z_b").mapInArrow(_members(tolerance), "a long, b long, w double")


def levels_of(tolerance: float, largest: float, below: int = BELOW, growth: float = GROWTH) -> list[float]:
    """Distances at which the hierarchy is looked at: the tolerance times powers of the growth, up to the largest link."""
    out = [tolerance * growth ** (k - below) if k != below else tolerance for k in range(below + 1)]
    while out[-1] < largest:
        out.append(out[-1] * growth)
    return out


def condense(nodes: list[tuple], x: np.ndarray, y: np.ndarray, w: np.ndarray, levels: list[float], start: int, least: int, split: float) -> tuple[list, list]:
    """Owners of the clusters and of the loose nodes of a condensed tree.

    ``nodes`` are (id, size, chain or None, sum of 1 / distance at which members joined, best stability below), the edges x-y
    join them by id. A chain is a cluster from the level where it comes into being to the one where it merges with another.
    Returns (chain, owner or None) of the given chains and (node, owner or None, 1 / distance) of the given nodes without one
    that join a cluster.
    """
    ids = np.array([n[0] for n in nodes], np.int64)
    order = np.argsort(ids)
    x, y = (order[np.searchsorted(ids, v, sorter=order)] for v in (x, y))
    size, acc, below = [n[1] for n in nodes], [n[3] for n in nodes], [n[4] for n in nodes]
    given = [i for i, n in enumerate(nodes) if n[2] is not None]
    chain = [-1] * len(nodes)
    for k, i in enumerate(given):
        chain[i] = k
    parent, selected = [-1] * len(given), [False] * len(given)
    members: dict[int, list[int]] = {i: [i] for i in range(len(nodes)) if chain[i] < 0}
    joined: dict[int, tuple[int, float]] = {}
    label = np.arange(len(nodes))
    at = np.maximum(np.searchsorted(levels, w, side="left"), start)
    for level in np.unique(at).tolist():
        lam, here = 1.0 / levels[level], at == level
        touched, root = union_find(label[x[here]], label[y[here]])
        by = np.argsort(root, kind="stable")
        touched_, root_ = touched[by].tolist(), root[by].tolist()
        lo = 0
        while lo < len(touched_):
            r, hi = root_[lo], lo + 1
            while hi < len(touched_) and root_[hi] == r:
                hi += 1
            kids = touched_[lo:hi]
            lo = hi
            big = [k for k in kids if chain[k] >= 0]
            total = sum(size[k] for k in kids)
            new, a, v = -1, 0.0, 0.0
            if len(big) == 1:
                c = big[0]
                new, a, v = chain[c], acc[c] + lam * (total - size[c]), below[c]
            elif big or total >= least:
                new, a = len(parent), lam * total
                parent.append(-1)
                selected.append(False)
                for c in big:
                    parent[chain[c]] = new
                    if levels[level] > split:
                        own = acc[c] - size[c] * lam
                        selected[chain[c]] = own >= below[c]
                        v += max(own, below[c])
            loose = [m for k in kids if chain[k] < 0 for m in members.pop(k)]
            if new >= 0:
                for m in loose:
                    joined[m] = (new, lam)
            else:
                members[r] = loose
            size[r], acc[r], below[r], chain[r] = total, a, v, new
        label_of = np.arange(len(nodes))
        label_of[touched] = root
        label = label_of[label]
    for r in np.unique(label).tolist():
        if chain[r] >= 0:
            selected[chain[r]] = acc[r] >= below[r]
    # Parents have higher numbers than their children: from the top, the uppermost selected one owns what is below it.
    owner = [-1] * len(parent)
    for c in range(len(parent) - 1, -1, -1):
        above = owner[parent[c]] if parent[c] >= 0 else -1
        owner[c] = above if above >= 0 else c if selected[c] else -1
    name = lambda c: None if owner[c] < 0 else nodes[given[owner[c]]][2] if owner[c] < len(given) else f"top:{owner[c]}"
    return [(nodes[i][2], name(k)) for k, i in enumerate(given)], [(nodes[m][0], name(c), lam) for m, (c, lam) in joined.items()]


_CONDENSED = "chain string, node long, cluster string, lam double"


def _condense(levels: list[float], start: int, least: int, split: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = [b for b in batches if b.num_rows]
        if not tabs:
            return
        t = pa.Table.from_batches(tabs)
        e, n = t.filter(t.column("w").is_valid()), t.filter(t.column("w").is_null())
        nodes = list(zip(*(n.column(c).to_pylist() for c in ("x", "size", "chain", "acc", "below"))))
        chains, loose = condense(nodes, e.column("x").to_numpy(), e.column("y").to_numpy(), e.column("w").to_numpy(), levels, start, least, split)
        rows = [(c, None, o, None) for c, o in chains] + [(None, m, o, lam) for m, o, lam in loose]
        for lo in range(0, len(rows), 50_000):
            cols = list(zip(*rows[lo : lo + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.float64()))], names=["chain", "node", "cluster", "lam"])

    return run


def density_clusters(tree: DataFrame, ws: Workspace, tolerance: float = TOLERANCE, split: float | None = None, least: int = LEAST, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """bar_id, cluster (its smallest bar), persistence (1 / the bar's shortest link) of all clustered bars.

    ``tree`` is a minimum spanning forest. Bars join at growing distances; a set of at least ``least`` bars is a cluster, which
    lasts until it meets another one. Its stability is the sum over its members of the range of 1 / distance in which they
    belong to it; it is selected when it is at least as stable as the best choice below it. Clusters that meet at up to
    ``split`` (the tolerance unless given) are one, and bars that join a cluster only beyond the tolerance are noise.

    A level is a round over the links left between components, until ``local_limit`` are left, which one task takes up to the top.
    """
    split = tolerance if split is None else split
    tree = ws.keep(tree)
    ends = tree.select(F.col("a").alias("node"), "w").unionByName(tree.select(F.col("b").alias("node"), "w")).groupBy("node").agg((1.0 / F.min("w")).alias("persistence"))
    found = tree.agg(F.max("w"), F.count("*")).first()
    levels, n = levels_of(tolerance, found[0] or 0.0), found[1]
    nodes = ends.select(F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("chain"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("below"))
    links = tree.select(F.col("a").alias("x"), F.col("b").alias("y"), "w")
    loose = ends.select("node", F.col("node").alias("comp"))
    chains: list[DataFrame] = []  # chain, parent, whether selected by itself: those that end on a level
    joined: list[DataFrame] = []  # node, chain, lam
    start = 0
    while n > local_limit:
        lam, eps = 1.0 / levels[start], levels[start]
        comp = ws.keep(connected_components(links.where(F.col("w") <= eps).select(F.col("x").alias("a"), F.col("y").alias("b")), ws, local_limit))
        up = ws.keep(nodes.join(comp.select(F.col("node").alias("comp"), F.col("component").alias("next")), "comp", "left").withColumn("next", F.coalesce("next", "comp")))
        is_big = F.col("chain").isNotNull()
        own = F.col("acc") - F.col("size") * lam
        best = F.when(is_big, F.greatest(own, "below") if eps > split else F.lit(0.0))
        g = up.groupBy("next").agg(
            F.count("*").alias("kids"), F.count("chain").alias("big"), F.sum("size").alias("size"), F.sum(F.when(is_big, F.col("size"))).alias("of_big"), F.min("chain").alias("chain"), F.sum(F.when(is_big, F.col("acc"))).alias("acc"),
            F.sum(F.when(is_big, F.col("below"))).alias("below"), F.sum(best).alias("best"),
        )
        fresh = (F.col("big") > 1) | ((F.col("big") == 0) & (F.col("size") >= least))
        # A chain is named by the level at which it begins and its component there.
        merged = g.select(
            F.col("next").alias("comp"), "size", F.when(fresh, F.concat(F.lit(f"{start}:"), "next")).otherwise(F.col("chain")).alias("chain"),
            F.when(fresh, lam * F.col("size")).when(F.col("big") == 1, F.col("acc") + lam * (F.col("size") - F.col("of_big"))).otherwise(0.0).alias("acc"),
            F.when(F.col("big") > 1, F.col("best")).when(F.col("big") == 1, F.col("below")).otherwise(0.0).alias("below"), (F.col("big") > 1).alias("met"),
        )
        now = ws.keep(merged)
        chosen = (own >= F.col("below")) if eps > split else F.lit(False)
        chains.append(ws.keep(up.where(is_big).join(now.where("met").select(F.col("comp").alias("next"), F.col("chain").alias("parent")), "next").select("chain", "parent", chosen.alias("selected"))))
        moved = ws.keep(loose.join(up.select("comp", "next"), "comp").select("node", F.col("next").alias("comp")).join(now.select("comp", "chain"), "comp"))
        joined.append(moved.where("chain is not null").select("node", "chain", F.lit(lam).alias("lam")))
        loose = moved.where("chain is null").select("node", "comp")
        cx, cy = (comp.select(F.col("node").alias(v), F.col("component").alias(f"c{v}")) for v in "xy")
        far = links.where(F.col("w") > eps).join(cx, "x", "left").join(cy, "y", "left")
        links = ws.keep(far.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"), "w"))
        nodes, start, n = now.drop("met"), start + 1, links.count()
    open_ = links.select(F.col("x").alias("comp")).union(links.select("y")).distinct()
    state = nodes.join(open_, "comp", "left_semi").select(F.col("comp").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("w"), "size", "chain", "acc", "below")
    edges = links.select("x", "y", "w", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("chain"), F.lit(None).cast("double").alias("acc"), F.lit(None).cast("double").alias("below"))
    top = ws.keep(state.unionByName(edges).coalesce(1).mapInArrow(_condense(levels, start, least, split), _CONDENSED))
    owner = top.where("chain is not null").select("chain", "cluster")
    done = nodes.where("chain is not null").join(open_, "comp", "left_anti")
    owner = owner.unionByName(done.select("chain", F.when(F.col("acc") >= F.col("below"), F.col("chain")).alias("cluster")))
    # Top down: the uppermost selected chain on the way to each chain.
    known = owner
    for c in reversed(chains):
        above = known.select(F.col("chain").alias("parent"), F.col("cluster").alias("taken"))
        here = c.join(above, "parent").select("chain", F.coalesce("taken", F.when(F.col("selected"), F.col("chain"))).alias("cluster"))
        known = ws.keep(known.unionByName(here))
    member = loose.join(top.where("node is not null").select(F.col("node").alias("comp"), "cluster", "lam"), "comp").select("node", "cluster", "lam")
    for j in joined:
        member = member.unionByName(j.join(known, "chain").select("node", "cluster", "lam"))
    member = member.where((F.col("cluster").isNotNull()) & (F.col("lam") >= 1.0 / tolerance))
    clustered = ws.keep(member.join(ends, "node").select(F.col("node").alias("bar_id"), F.col("cluster").alias("group"), "persistence"))
    names = clustered.groupBy("group").agg(F.min("bar_id").alias("cluster"))
    return clustered.join(names, "group").select("bar_id", "cluster", "persistence")


def bar_cells(bars: DataFrame) -> DataFrame:
    """bar_id, cells of every row; bars without id or cells are left out."""
    return bars.where("bar_id is not null and features_per_bar is not null").select(F.col("bar_id").cast("long").alias("bar_id"), F.col("features_per_bar").cast("array<double>").alias("cells"))


def cluster_bars(bars: DataFrame, ws: Workspace, tolerance: float = TOLERANCE, local_limit: int = LOCAL_EDGES, rounds: int = ROUNDS, split: float | None = None, least: int = LEAST, **graph) -> DataFrame:
    """bar_id, cluster_bar_id, persistence of every bar in a cluster of two or more bars (``least``).

    Null, NaN, infinite and non-positive cells are missing; bars with fewer than half their
    cells are in no cluster, as are those like no other. Repeated rows are one bar; one whose
    rows differ belongs with all of them; bars with different ids and the same array are two. An
    empty table gives no rows.
    """
    prof = ws.keep(bar_profiles(bar_cells(bars), rounds))
    links, cores = neighbour_graph(prof, ws, tolerance=tolerance, **graph)
    tree = ws.keep(spanning_forest(reachability(links, cores), ws, local_limit))
    more = ws.keep(missing_links(prof, tree, ws, tolerance, local_limit))
    if not more.isEmpty():
        tree = spanning_forest(tree.unionByName(reachability(more, cores)), ws, local_limit)
    return ws.finish(density_clusters(tree, ws, tolerance, split, least, local_limit).withColumnRenamed("cluster", "cluster_bar_id"))


def describe_clusters(clustered: DataFrame, bars: DataFrame, rhythms: DataFrame, exemplars: int = 3) -> DataFrame:
    """cluster_bar_id, size, exemplars (the most persistent bars), rhythm_id, num, den.

    The rhythm is the one most of the cluster's bars carry (the smaller on a tie), null where
    they carry none that is listed.
    """
    part = F.pmod(F.xxhash64("bar_id"), F.lit(256))
    best = Window.partitionBy("cluster_bar_id", "part").orderBy(F.desc("persistence"), "bar_id")
    # The best of each part first, so that no cluster is gathered whole.
    top = clustered.withColumn("part", part).withColumn("k", F.row_number().over(best)).where(F.col("k") <= exemplars)
    chosen = top.groupBy("cluster_bar_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("persistence")).alias("p"), "bar_id"))), 1, exemplars)["bar_id"].alias("exemplars"))
    sizes = clustered.groupBy("cluster_bar_id").agg(F.count("*").alias("size"))
    carried = bars.where("bar_id is not null and bar2cluster is not null").select(F.col("bar_id").cast("long").alias("bar_id"), F.col("bar2cluster").cast("int").alias("rhythm_id")).distinct().join(F.broadcast(rhythms.select("rhythm_id").distinct()), "rhythm_id")
    votes = clustered.join(carried, "bar_id").groupBy("cluster_bar_id", "rhythm_id").agg(F.count("*").alias("v")).groupBy("cluster_bar_id").agg((-F.max(F.struct("v", (-F.col("rhythm_id")).alias("r")))["r"]).alias("rhythm_id"))
    return (
        sizes.join(chosen, "cluster_bar_id")
        .join(votes, "cluster_bar_id", "left")
        .join(F.broadcast(rhythms.select("rhythm_id", "num", "den")), "rhythm_id", "left")
        .select("cluster_bar_id", "size", "exemplars", "rhythm_id", "num", "den")
    )
