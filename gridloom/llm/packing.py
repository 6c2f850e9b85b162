"""Filling containers of several permitted capacities with items of varying length.

Best fit decreasing needs one order over all items, but only their sizes matter: the number of items of each size, at
most one row for each whole size up to the largest capacity, is all that the driver sees. It plans whole runs at once:
so many items of one size go into so many open containers with the same room. A run maps an interval of ranks within a
size to an interval of container numbers, so every item finds its container from its own rank, in parallel and without
a further shuffle. The plan equals that of the sequential algorithm on all items, whatever their number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise


@dataclass
class Plan:
    """Runs (size, first rank, first container, count) and container intervals (first, count, used, capacity)."""

    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    containers: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(n * cap for _, n, _, cap in self.containers)


def _unused(size: int, count: int, remaining: Sequence[tuple[int, int]], capacity: int) -> int:
    """Room left in one container of ``capacity`` that starts with an item of ``size`` and takes from the sizes still to
    come, largest first. ``remaining`` (size, number) descends from ``size`` on; ``count`` items of ``size`` are left."""
    room, i = capacity, 0
    while room and i < len(remaining):
        s, n = remaining[i]
        if i == 0:
            n = count
        if s > room:
            # To the largest size that fits.
            i = max(i + 1, bisect_left(remaining, -room, key=lambda x: -x[0]))
            continue
        room -= min(n, room // s) * s
        i += 1
    return room


def plan_with(counts: Sequence[tuple[int, int]], capacities: Sequence[int], opens: int | None) -> Plan:
    """Best fit decreasing over (size, number) with containers of several capacities.

    An item goes into the open container with the least room that holds it. If none does, a container is opened:
    with ``opens`` None of the capacity that costs least, which is the least unused space for each token it would
    hold if the items still to come filled it, the larger of equals; with a number of the least capacity that
    holds the item ``opens`` times over, or else the largest. At the end each container takes the least capacity
    that holds its contents.
    """
    caps = sorted(capacities)
    plan = Plan()
    rooms: list[int] = []  # the different rooms of open containers, ascending
    by_room: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first container, count, used)
    following = 0
    order = sorted(counts, reverse=True)

    def put(first: int, count: int, used: int, room: int) -> None:
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append((first, count, used))

    def cost(capacity: int, size: int, count: int, remaining: Sequence[tuple[int, int]]) -> tuple[float, int]:
        unused = _unused(size, count, remaining, capacity)
        return unused / (capacity - unused), -capacity

    for at, (size, number) in enumerate(order):
        rank = 0
        choice = None  # holds while this size lasts
        while rank < number:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, count, used = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                n = min(count, number - rank)
                if n < count:
                    put(first + n, count - n, used, room)
            else:
                if opens is not None:
                    choice = next((c for c in caps if c >= size * opens), caps[-1])
                elif choice is None:
                    rest = order[at:]
                    choice = min((cost(c, size, number - rank, rest), c) for c in caps if c >= size)[1]
                room = choice
                n = max(1, (number - rank) // (room // size)) if room // size > 1 else number - rank
                first, used = following, 0
                following += n
            plan.runs.append((size, rank, first, n))
            rank += n
            put(first, n, used + size, room - size)
    for groups in by_room.values():
        plan.containers += [(first, n, used, next(c for c in caps if c >= used)) for first, n, used in groups]
    plan.containers.sort()
    return plan


def best_plan(counts: Sequence[tuple[int, int]], capacities: Sequence[int]) -> Plan:
    """The plan with the least total capacity: opening at least cost, or by one of several fixed rules if that is better."""
    caps = sorted(set(capacities))
    widest = max(2, caps[-1] // max(1, caps[0]) + 1)
    choices = [None, *sorted({1, 2, 4, 8, widest, caps[-1] + 1})]
    return min((plan_with(counts, caps, k) for k in choices), key=lambda p: p.total)


def pack(items: DataFrame, key: str, size: str, capacities: Sequence[int]) -> DataFrame:
    """(key, piece, start, size, container, capacity): where each item goes; container numbers are unique.

    Items of size 0 or null need no container. An item larger than the largest capacity is cut into pieces of that
    size and a rest; no other item is cut. ``start`` is the piece's offset within its item. Ties in size go by key.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps:
        raise ValueError("no capacity is given")
    top = caps[-1]
    spark = items.sparkSession
    n = F.col(size).cast("long")
    whole = items.where(n > 0).select(F.col(key).alias("key"), n.alias("n"))
    pieces = whole.select("key", "n", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / top) - 1).cast("int"))).alias("piece"))
    pieces = pieces.select("key", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece").cast("long") * top).alias("size"))

    ordered = pieces.repartitionByRange("size", "key", "piece").sortWithinPartitions("size", "key", "piece")
    placed = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    placed = placed.withColumns({"part": F.shiftright("_id", 33), "at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    # At most one row for each size and for each partition.
    counts = [(r["size"], r["count"]) for r in placed.groupBy("size").count().collect()]
    parts = sorted(placed.groupBy("part").agg(F.max("at").alias("last")).collect())
    plan = best_plan(counts, caps)

    starts, total = {}, 0
    for s, c in sorted(counts):
        starts[s] = total
        total += c
    offsets, total = {}, 0
    for part, last in parts:
        offsets[part] = total
        total += last + 1
    # Runs by the position of their first item in the sort by size and rank.
    runs = sorted((starts[s] + rank, first) for s, rank, first, _ in plan.runs)
    run_at, run_first = (np.array([r[i] for r in runs], dtype=np.int64) for i in (0, 1))
    box_at, box_cap = (np.array([c[i] for c in plan.containers], dtype=np.int64) for i in (0, 3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos = pdf["part"].map(offsets).to_numpy(dtype=np.int64) + pdf["at"].to_numpy()
            i = np.searchsorted(run_at, pos, side="right") - 1
            container = run_first[i] + pos - run_at[i]
            capacity = box_cap[np.searchsorted(box_at, container, side="right") - 1]
            yield pdf[["key", "piece", "start", "size"]].assign(container=container, capacity=capacity)

    out = f"key {dict(items.dtypes)[key]}, piece int, start long, size long, container long, capacity long"
    return placed.mapInPandas(run, out) if counts else spark.createDataFrame([], out)
