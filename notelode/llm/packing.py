"""Items packed into containers of fixed capacity, each partition's container count checked against a lower bound.

Every partition packs its items by best fit decreasing. Dual feasible functions give a number of containers below
which no packing can go; a partition that reaches it is done, but for its emptiest container. Any other one closes its
full containers and gives the items of the rest back; those of all partitions are dealt out anew and packed again,
over fewer partitions each round, for as long as that closes containers. What each partition needed and its bound is kept
(Packed.bounds), and the bound over all items is worked out from how many there are of each size.

An item longer than the capacity is split into pieces of the capacity and a rest; no other is. An item of no length
takes no room but a place. A null size counts as zero. Ids of any type stay as they are; repeated and null ones are items
of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.session import cut

#: Items packed together in a task; part of the open items that an exchange must close to be followed by another.
ITEMS, GAIN = 100_000, 0.05
#: Part of the capacity that may stay unused in a container that is closed before the last round.
SLACK = 0.002


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of items of these sizes needs."""
    s = np.asarray(sizes, dtype=np.int64)
    return bound_of_counts(np.bincount(s[s > 0], minlength=capacity + 1)[: capacity + 1], capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same, from how many items there are of each size: the best of the sum and two families of dual feasible functions."""
    counts = counts.astype(np.int64)
    counts[0] = 0
    if not counts.any():
        return 0
    at = np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(counts * at)])  # sum of sizes under x
    number = np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(below[-1]) // capacity)
    # Small items weigh nothing, large ones a container each: for every threshold e up to half the capacity.
    e = np.arange(1, capacity // 2 + 1)
    if len(e):
        large = number[-1] - number[capacity - e + 1]
        middle = below[capacity - e + 1] - below[e]
        best = max(best, int((large - (-middle // capacity)).max()))
    # Sizes rounded down to multiples of 1 / (k + 1), which then weigh 1 / k.
    for k in range(1, 33):
        whole = (k + 1) * at % capacity == 0
        weight = np.where(whole, at * k, (k + 1) * at // capacity * capacity)
        best = max(best, -(-int((weight * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are at most the capacity."""
    capacity = int(capacity)
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), dtype=np.int64)
    free: dict[int, list[int]] = {}  # room left -> containers
    rooms = 0  # bit r is set if a container has room r
    n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            spots = free[room]
            b = spots.pop()
            if not spots:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i] = b
        left = room - size
        if not free.get(left):
            free[left] = []
            rooms |= 1 << left
        free[left].append(b)
    return bins


def _split(capacity_of: list[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(b.column("size"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for name, c in capacity_of:
                pieces = np.maximum(1, -(-size // c))
                owner = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = piece * c
                columns = [
                    pa.array([name] * len(owner), pa.string()), pa.array(np.full(len(owner), c, dtype=np.int32)), b.column("key").take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)), pa.array(first), pa.array(np.minimum(size[owner] - first, c).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["pack_name", "capacity", "key", "piece", "first", "size"])

    return run


def _pack(last: bool, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches)
        for name in sorted(pc.unique(table["pack_name"]).to_pylist()):
            # Ties stand in a fixed order, so that a task that is run again gives the same.
            rows = table.filter(pc.equal(table["pack_name"], name)).sort_by([("key", "ascending"), ("piece", "ascending")])
            c, sizes = rows["capacity"][0].as_py(), rows["size"].to_numpy().astype(np.int64)
            bins = best_fit_decreasing(sizes, c)
            used = np.bincount(bins, weights=sizes).astype(np.int64)
            bound = lower_bound(sizes, c)
            closed = np.ones(len(used), dtype=bool) if last or len(used) <= bound else used >= c * (1 - SLACK)
            # Even the fewest containers leave one that is far from full; what lies in it is exchanged as well.
            closed[used.argmin()] = last or used.min() >= c * (1 - SLACK)
            names = np.array([f"{name}/{turn}/{part}/{k}" for k in range(len(used))], dtype=object)
            names[~closed] = None
            made = rows.append_column("container", pa.array(names[bins], pa.string()))
            for column, x in (("bound", bound), ("bins", len(used)), ("closed", int(closed.sum())), ("part", part), ("turn", turn)):
                made = made.append_column(column, pa.array(np.full(len(sizes), x, dtype=np.int32)))
            yield from made.to_batches()

    return run


@dataclass(frozen=True)
class Packed:
    #: pack_name, container, key, piece, first, size: where each piece lies.
    placed: DataFrame
    #: pack_name, turn, part, items, bins, bound, closed: containers a partition needed, those any packing of it needs, and those closed.
    bounds: DataFrame
    #: pack_name, least: containers that any packing of all items needs.
    least: DataFrame


def pack(items: DataFrame, key: str, size: str, packs: list[tuple[str, int]], each: int | None = None) -> Packed:
    """Every item packed for every pack (name, capacity) in turn; each: items packed together in a task."""
    if any(c <= 0 for _, c in packs):
        raise ValueError("a capacity must be positive")
    kind = dict(items.dtypes)[key]
    shape = f"pack_name string, capacity int, key {kind}, piece int, first bigint, size int"
    src = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))
    todo = start = cut(src.mapInArrow(_split(packs), shape))
    n, placed, bounds, turn = todo.count(), None, None, 0
    while True:
        parts = max(1, math.ceil(n / (each or ITEMS)))
        spent = turn and n > (1 - GAIN) * before
        last = parts == 1 or spent
        schema = f"{shape}, container string, bound int, bins int, closed int, part int, turn int"
        made = cut(todo.repartition(parts).mapInArrow(_pack(last, turn), schema))
        put = made.filter("container IS NOT NULL")
        seen = made.groupBy("pack_name", "turn", "part").agg(F.count(F.lit(1)).alias("items"), *(F.max(c).alias(c) for c in ("bins", "bound", "closed")))
        placed, bounds = (put, seen) if placed is None else (placed.unionByName(put), bounds.unionByName(seen))
        if last:
            break
        todo = made.filter("container IS NULL").select(*todo.columns)
        before, n, turn = n, todo.count(), turn + 1
    # How many items there are of each size is as long as a capacity at most.
    spark, least = items.sparkSession, []
    sizes = start.groupBy("pack_name", "size").agg(F.count(F.lit(1)).alias("n")).toArrow()
    for name, c in packs:
        mine = sizes.filter(pc.equal(sizes["pack_name"], name))
        counts = np.zeros(c + 1, dtype=np.int64)
        counts[mine["size"].to_numpy()] = mine["n"].to_numpy()
        least.append((name, bound_of_counts(counts, c)))
    placed = placed.select("pack_name", "container", F.col("key").alias(key), "piece", "first", "size")
    return Packed(placed, bounds, spark.createDataFrame(least, "pack_name string, least bigint"))


def use(packed: Packed, packs: list[tuple[str, int]]) -> DataFrame:
    """pack_name, containers, tokens, least (containers that any packing needs), gap, fill."""
    of = F.coalesce(*(F.when(F.col("pack_name") == name, F.lit(c)) for name, c in packs))
    sums = packed.placed.groupBy("pack_name", "container").agg(F.sum("size").alias("size"))
    by = sums.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"))
    by = by.join(packed.least, "pack_name").withColumn("gap", F.col("containers") - F.col("least"))
    return by.select("pack_name", "containers", "tokens", "least", "gap", F.round(F.col("tokens") / (F.col("containers") * of), 6).alias("fill"))
