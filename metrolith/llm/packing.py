"""Filling containers of fixed capacity: hierarchical residual packing.

Each partition packs its items best-fit decreasing and emits what is nearly full. Underfull
containers become items of the next round, on at most half as many partitions, as long as any
two of them could be combined; those that fit with none of the others are emitted before. A
container carries its members along; none has more than its capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.session import Workspace

CAPACITY = 2048
#: Items packed at once, and underfull containers a partition of a later round takes.
BATCH, FAN_IN = 100_000, 8_192
#: Share of the capacity from which a container is nearly full.
FULL = 0.99

_MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, tokens: bigint>"
SCHEMA = f"container bigint, used bigint, done boolean, members array<{_MEMBER}>"
_ARROW = pa.schema([
    ("container", pa.int64()), ("used", pa.int64()), ("done", pa.bool_()),
    ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())]))),
])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by container, each item (largest first) in the fullest container that still takes it.

    Open containers are kept by their room, with one bit a room that occurs, so that a fit is
    found in constant time.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        s = sizes[i]
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - s
        by_room[left].append(k)
        rooms |= 1 << left
    return bins


def pieces(tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, start, tokens) of a text: itself, or full pieces and the rest of one beyond the capacity."""
    return [(p, a, min(capacity, tokens - a)) for p, a in enumerate(range(0, tokens, capacity))]


def _pack(loads: Iterator[tuple[list[int], list[list[dict]]]], round_: int, capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for sizes, members in loads:
        ids, used, done, held = [], [], [], []
        for group in best_fit(sizes, capacity):
            total = sum(sizes[i] for i in group)
            ids.append((round_ << 56) | (part << 32) | k)
            k += 1
            used.append(total)
            done.append(last or total >= FULL * capacity)
            held.append([m for i in group for m in members[i]])
        for a in range(0, len(ids), 2000):
            z = slice(a, a + 2000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[z], pa.int64()), pa.array(used[z], pa.int64()), pa.array(done[z], pa.bool_()), pa.array(held[z], _ARROW.field("members").type)], schema=_ARROW)


def pack(sized: DataFrame, ws: Workspace, capacity: int = CAPACITY, batch: int = BATCH, fan_in: int = FAN_IN) -> DataFrame:
    """container, doc_id, piece, start, tokens of every piece of every row of ``sized`` (doc_id, tokens).

    A text is one piece unless it alone exceeds the capacity; then all its pieces but the last
    fill a container each. Rows without tokens (also null ones) take no room and are in no
    container. Repeated rows are packed as often as they occur; an empty table gives no rows. In
    the end no two containers could be combined, but for nearly full ones with a few tokens.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def loads():
            sizes, members = [], []
            for b in batches:
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist()):
                    for p, a, n in pieces(t or 0, capacity):
                        sizes.append(n)
                        members.append([{"doc_id": d, "piece": p, "start": a, "tokens": n}])
                        if len(sizes) >= batch:
                            yield sizes, members
                            sizes, members = [], []
            if sizes:
                yield sizes, members

        return _pack(loads(), 0, capacity, False)

    def again(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def loads():
                sizes, members = [], []
                for b in batches:
                    sizes += b.column("used").to_pylist()
                    members += b.column("members").to_pylist()
                if sizes:
                    yield sizes, members

            return _pack(loads(), round_, capacity, last)

        return run

    packed = [ws.keep(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens")).mapInArrow(first, SCHEMA))]
    out = packed[0].where("done")
    left, parts, round_ = packed[0].where("not done"), 0, 0
    while True:
        least = [r.used for r in left.orderBy("used").limit(2).select("used").collect()]
        if len(least) < 2 or sum(least) > capacity:
            out = out.unionByName(left)
            break
        # What does not fit with the emptiest fits with none.
        fits = F.col("used") + least[0] <= capacity
        out, left, round_ = out.unionByName(left.where(~fits)), left.where(fits), round_ + 1
        parts = min(max(1, -(-left.count() // fan_in)), max(1, parts // 2) if parts else 1 << 30)
        # A hash mixes the containers of all partitions, so that small and large rooms meet.
        mixed = left.repartition(parts, F.xxhash64("container", F.lit(round_))).sortWithinPartitions("used", "container")
        packed.append(ws.keep(mixed.mapInArrow(again(round_, parts == 1), SCHEMA)))
        out, left = out.unionByName(packed[-1].where("done")), packed[-1].where("not done")
    return ws.finish(out.select("container", F.explode("members").alias("m")).select("container", "m.doc_id", "m.piece", "m.start", "m.tokens"))
