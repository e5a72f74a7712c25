"""Packing items into containers of fixed capacity, balanced by what processing them costs.

An item of n units costs ``linear * n + quadratic * n * n`` (the work per unit and the attention within the item). Items are taken
from large to small, and each goes to the container of lowest cost so far among those with room for it. Items larger than the
capacity alone are cut: full pieces are containers of their own, and only the rests are packed.

Items are dealt to shards by a hash of their id and place in the written table, whatever their source or size, so no shard grows with a
hot key or a repeated id; a shard is packed by one task and holds about ``shard_items`` rests. Each shard starts with as many containers as its units need at least and opens a further
one only when no container has room, so the unused space is a small part of each shard's containers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlume.sources.workspace import written

DEFAULT_CAPACITY = 4096
DEFAULT_SHARD_ITEMS = 20_000
LINEAR_COST, QUADRATIC_COST = 1.0, 1.0 / 1024


def cost(size, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST):
    return linear * size + quadratic * size * size


class _ByRoom:
    """Containers by the room they have left. A tree over the rooms holds the best (cost, number) below each node, so the best one with at
    least some room is found in as many steps as the capacity has bits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.best: dict[int, tuple[float, int, int]] = {}
        self.waiting: dict[int, list[tuple[float, int, int]]] = {}

    def _renew(self, room: int) -> None:
        best, node = self.best, room + self.leaves
        entries = self.waiting[room]
        now = entries[0] if entries else None
        while node:
            if now is None:
                best.pop(node, None)
            else:
                best[node] = now
            other = best.get(node ^ 1)
            if other is not None and (now is None or other < now) and node > 1:
                now = other
            node >>= 1

    def put(self, entries: list[tuple[float, int]], room: int) -> None:
        waiting = self.waiting.setdefault(room, [])
        for cost_, number in entries:
            heapq.heappush(waiting, (cost_, number, room))
        self._renew(room)

    def take(self, least_room: int) -> tuple[float, int, int] | None:
        """Remove and return the (cost, number, room) of least cost, then number, with ``least_room`` or more."""
        low, high, found = least_room + self.leaves, 2 * self.leaves, None
        while low < high:
            if low & 1:
                here = self.best.get(low)
                if here is not None and (found is None or here < found):
                    found = here
                low += 1
            low, high = low >> 1, high >> 1
        if found is not None:
            heapq.heappop(self.waiting[found[2]])
            self._renew(found[2])
        return found


def pack_sizes(sizes: np.ndarray, capacity: int, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST) -> tuple[np.ndarray, np.ndarray]:
    """Container number and offset of each item; sizes between 1 and the capacity.

    Items of equal size are taken in the order given and containers of equal cost in the order of their numbers.
    """
    at = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    if not len(sizes):
        return at, offset
    opened = max(1, math.ceil(int(sizes.sum()) / capacity))
    open_ = _ByRoom(capacity)
    open_.put([(0.0, number) for number in range(opened)], capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_.take(size)
        if found is None:
            found, opened = (0.0, opened, capacity), opened + 1
        before, number, room = found
        at[i], offset[i] = number, capacity - room
        open_.put([(before + cost(size, linear, quadratic), number)], room - size)
    return at, offset


def pack(
    items: DataFrame,
    id_column: str,
    size_column: str,
    capacity: int = DEFAULT_CAPACITY,
    shard_items: int = DEFAULT_SHARD_ITEMS,
    linear: float = LINEAR_COST,
    quadratic: float = QUADRATIC_COST,
) -> DataFrame:
    """One row per piece: the item's id and size, ``piece_no`` of ``n_pieces``, ``piece_start, piece_size``, ``container_id, offset``.

    Items within the capacity are one piece. Items of size 0 or null take no space: one row with size 0, no container and no offset.
    Negative sizes are an error. Repeated rows are items of their own; other columns are dropped; an empty table gives no rows.
    """
    if capacity < 1 or shard_items < 1:
        raise ValueError("capacity and shard_items must be at least 1")
    clash = {id_column, size_column} & {"shard", "rest", "item", "rest_in", "rest_at", "piece_no", "n_pieces", "piece_start", "piece_size", "container_id", "offset"}
    if clash:
        raise ValueError(f"columns may not be named {', '.join(sorted(clash))}")
    sized = items.select(F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{size_column}`").cast("bigint"), F.lit(0)).alias(size_column))
    sized = sized.withColumn(size_column, F.when(F.col(size_column) < 0, F.raise_error(F.lit("negative size")).cast("bigint")).otherwise(F.col(size_column)))

    sized = written(sized, "sizes")  # sizes are used twice and may come from a tokenizer
    size, cap = F.col(f"`{size_column}`"), F.lit(capacity).cast("bigint")
    rest = (size % cap).alias("rest")
    shards = max(1, math.ceil(sized.filter(rest > 0).count() / shard_items))
    dealt = sized.withColumn("rest", rest).withColumn("shard", F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([id_column, size_column], kind="stable").reset_index(drop=True)
        some = shard["rest"].to_numpy() > 0
        at, offset = pack_sizes(shard["rest"].to_numpy()[some], capacity, linear, quadratic)
        number, offsets = int(shard["shard"].iloc[0]), pd.Series(pd.NA, index=shard.index, dtype="Int64")
        names = pd.Series([None] * len(shard), dtype=object)
        names[some] = [f"{number}-{c}" for c in at]
        offsets[some] = offset
        return shard.assign(item=[f"{number}-full-{i}" for i in range(len(shard))], rest_in=names, rest_at=offsets)[[id_column, size_column, "item", "rest_in", "rest_at"]]

    kinds = {f.name: f.dataType.simpleString() for f in sized.schema.fields}
    placed = dealt.groupBy("shard").applyInPandas(packed, f"`{id_column}` {kinds[id_column]}, `{size_column}` bigint, item string, rest_in string, rest_at bigint")
    full = F.col("piece_start") + cap <= size
    return (
        placed.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(size / cap)).cast("int"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("piece_start", F.col("piece_no").cast("bigint") * cap)
        .select(
            F.col(f"`{id_column}`"),
            size.alias(size_column),
            "piece_no",
            "n_pieces",
            "piece_start",
            F.least(cap, size - F.col("piece_start")).alias("piece_size"),
            F.when(full, F.concat_ws(".", "item", F.col("piece_no").cast("string"))).otherwise(F.col("rest_in")).alias("container_id"),
            F.when(full, F.lit(0).cast("bigint")).otherwise(F.col("rest_at")).alias("offset"),
        )
    )


def container_use(packed: DataFrame, capacity: int = DEFAULT_CAPACITY, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST) -> DataFrame:
    """Per container: pieces, units used, units unused and cost."""
    return (
        packed.filter("container_id is not null")
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_size").alias("used"), F.sum(F.lit(linear) * F.col("piece_size") + F.lit(quadratic) * F.col("piece_size") * F.col("piece_size")).alias("cost"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )
