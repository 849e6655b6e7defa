"""Packing texts into containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

Documents are spread by a hash of their id over shards of about SHARD_ITEMS, each packed by itself in one task, so that
shards bound a task's work and cost one badly filled container each, one in some thousand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 16_000


class Remaining:
    """Counts of open containers by remaining capacity, as a segment tree whose leaves are the capacities."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = room + self.leaves
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the container with the least room of at least `size`: (room, number)."""
        at = size + self.leaves
        if not self.open[at]:
            while at and (at & 1 or not self.open[at + 1]):  # go up until a right neighbour holds one
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.leaves
        which = self.bins[room].pop()
        while at:
            self.open[at] -= 1
            at >>= 1
        return room, which


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Number of the container of each item; sizes are in 1..capacity."""
    tree, placed, n = Remaining(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            room, which, n = capacity, n, n + 1
        else:
            room, which = found
        placed[i] = which
        if room > size:
            tree.add(room - size, which)
    return placed


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        ids, size, shard = pdf["_id"].to_numpy(), pdf["_size"].to_numpy(np.int64), int(pdf["_shard"].iloc[0])
        rest = size % capacity
        parts = size // capacity + (rest > 0)
        row = np.repeat(np.arange(len(ids)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(size[row] - part * capacity, capacity)
        return pd.DataFrame({"_id": ids[row], "part": part.astype(np.int32), "container_id": (np.int64(shard) << 32) + best_fit_decreasing(length, capacity), "token_start": part * capacity, "tokens": length})

    return run


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int, shards: int) -> DataFrame:
    """item_id, part, container_id, token_start, tokens: where each part of each item goes.

    items: integral size; other columns are ignored. An item is split, into full containers and a rest, only if its size
    exceeds the capacity; its parts are numbered from 0. Items of size 0 or null have one part without a container
    (null), with 0 tokens. Items with a null or repeated id are items of their own. An empty table gives no row.
    Containers never hold items of two shards.
    """
    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    full = rows.where("_size > 0").withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    packed = full.groupBy("_shard").applyInPandas(_pack(capacity), f"_id {kind}, part int, container_id long, token_start long, tokens long")
    none = rows.where("_size <= 0").select("_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("container_id"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("tokens"))
    return packed.unionByName(none).withColumnRenamed("_id", item_id)


def shard_count(rows: int, shard_items: int = SHARD_ITEMS) -> int:
    return max(1, math.ceil(rows / shard_items))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, fill_permille (null without a container)."""
    used = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens")).withColumn("fill_permille", F.when(F.col("containers") > 0, F.floor(F.col("tokens") * 1000 / (F.col("containers") * capacity))))
