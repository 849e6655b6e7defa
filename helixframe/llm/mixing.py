"""Mixing sources to target shares of the total size.

The texts of a source, in the order of a hash of their ids, are one row of tokens cut into blocks of fixed length. Each
output shard draws how many of its slots go to each source; the slots of a source are numbered over all shards and mapped
to its blocks through a pseudorandom permutation for each round of repeats; blocks are joined by (source, block). A source
has no more slots than its blocks may be used; what a shard drew beyond is drawn again from the sources with room left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.runtime import checkpoint

BLOCK_TOKENS = 2048
SHARD_SLOTS = 256
#: Rows of one ordered window of the prefix sums.
RUN_ROWS = 50_000


def source_name(source: Column) -> Column:
    """Without outer blanks of any kind and without letter case."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def running_totals(df: DataFrame, key: str, bucket: Column, order: list[str], value: str) -> DataFrame:
    """df with `before`, the sum of value over the key's earlier rows, in the order of (bucket, order).

    In two steps: a window inside each (key, bucket), and one over the buckets' sums, so that no window holds a key.
    """
    df = df.withColumn("_b", bucket)
    inside = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(key, "_b").agg(F.sum(value).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [key, "_b"]).withColumn("before", (F.col("_base") + F.col("_in")).cast("long")).drop("_b", "_base", "_in")


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index in a pseudorandom permutation of range(size) chosen by key.

    Four Feistel rounds over the next even number of bits, walked on until inside the range.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 0.5)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (_mix64(right + _mix64(k + np.uint64(r + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted_block(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy().view(np.uint64)))


#: Shards that a task draws for.
TASK_SHARDS = 256
#: Standard deviations of its draws within which a source is looked at whether it is short.
NOISE = 8.0


def _draws(names: list[str], shares: np.ndarray, seed: int, turn: int):
    """For each shard with so many slots: how many go to each source, none for what is left of the shares to 1."""
    out = pa.schema([("shard", pa.int64()), ("source", pa.string()), ("n", pa.int64())])
    shares = np.append(shares, max(0.0, 1.0 - shares.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, slots = b.column(0).to_numpy(), b.column(1).to_numpy()
            n = np.array([np.random.default_rng([seed, turn, int(s)]).multinomial(int(m), shares)[:-1] for s, m in zip(shards, slots)], np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shards, len(names))), pa.array(names * len(shards), pa.string()), pa.array(n)], schema=out)

    return run


def fair_shares(slots: int, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Slots of each source: in proportion to the weights, none more than its room, all slots given out while there is room."""
    out, open_ = np.zeros(len(weights)), weights > 0
    while slots - out.sum() > 1e-6 and (open_ & (out < room)).any():
        open_ &= out < room
        more = (slots - out.sum()) * np.where(open_, weights, 0) / weights[open_].sum()
        out = np.minimum(room, out + more)
    return out


class Mixture:
    """A mixture of `docs` by `targets`.

    docs: doc_id, source (as compared, null for none), tokens, one row a document; it is read several times and should
    be a checkpoint. targets: source, target_permille, max_repeat, a fixed table of some sources, of which the rows are
    gathered by the driver (max_sources is checked). Rows with a null source or target are left out; a null max_repeat
    is 0. The mixture is planned as large as all documents together, those of no target included. Every shard draws its
    slots by the target shares. When all blocks of a source are used max_repeat times, its further slots are drawn
    again from the sources with room, by their shares, until all are filled or no source has room (fill=False: they stay
    empty). Documents without tokens take no room.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 11, block: int = BLOCK_TOKENS, max_sources: int = 10_000, fill: bool = True) -> None:
        spark = docs.sparkSession
        self.block, self.docs = block, docs.where("tokens > 0")
        sizes = self.docs.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("size_tokens"))
        wanted = targets.where("source IS NOT NULL AND target_permille IS NOT NULL").select("source", F.col("target_permille").cast("long").alias("target_permille"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("max_repeat"))
        self.sources = checkpoint(wanted.join(sizes, "source", "left").na.fill(0, ["size_tokens"]).withColumn("blocks", F.expr(f"CAST((size_tokens + {block - 1}) DIV {block} AS LONG)")))
        self.total, self.rows = (x or 0 for x in self.docs.agg(F.sum("tokens"), F.count("*")).first())
        got = sorted(tuple(r) for r in self.sources.select("source", "target_permille", F.expr("blocks * greatest(0, max_repeat)")).limit(max_sources + 1).collect())
        if len(got) > max_sources:
            raise ValueError(f"more than {max_sources} targets")
        names = [s for s, _, _ in got]
        weights, room = np.array([max(0, p) for _, p, _ in got], np.float64), np.array([r for _, _, r in got], np.int64)
        self.planned = -(-self.total // block) if weights.sum() > 0 else 0
        shards = -(-self.planned // SHARD_SLOTS)
        empty = spark.range(0, shards, 1, max(1, -(-shards // TASK_SHARDS))).select("id", F.least(F.lit(SHARD_SLOTS), F.lit(self.planned) - F.col("id") * SHARD_SLOTS).cast("long").alias("slots"))
        shares, used, left, turn = weights / max(1.0, weights.sum()), np.zeros(len(names), np.int64), self.planned, 0
        self.first = self.granted = None
        while turn == 0 or fill and left and (room > used)[weights > 0].any():
            drawn = empty.mapInArrow(_draws(names, shares, seed, turn), "shard long, source string, n long")
            limits = spark.createDataFrame([(n, int(u), int(r)) for n, u, r in zip(names, used, room)], "source string, used long, room long")
            numbered = running_totals(drawn, "source", F.expr("shard DIV 4096"), ["shard"], "n").join(F.broadcast(limits), "source").withColumn("before", F.col("before") + F.col("used"))
            given = checkpoint(numbered.select("shard", "source", "before", "n", F.least(F.col("n"), F.greatest(F.lit(0), F.col("room") - F.col("before"))).alias("given")))
            if turn == 0:
                self.first = given.groupBy("source").agg(F.sum("n").alias("drawn"))
            self.granted = given if turn == 0 else self.granted.unionByName(given)
            # at most max_sources rows
            sums = {r.source: r.g for r in given.groupBy("source").agg(F.sum("given").alias("g")).collect()}
            used = used + np.array([sums.get(n, 0) for n in names], np.int64)
            before, left = left, self.planned - int(used.sum())
            if not fill or turn and left == before:
                break
            empty = empty.join(given.groupBy("shard").agg(F.sum("given").alias("_g")), F.col("id") == F.col("shard"), "left").select("id", (F.col("slots") - F.coalesce("_g", F.lit(0))).alias("slots")).where("slots > 0")
            empty = checkpoint(empty)
            shares = fair_shares(left, weights, (room - used).astype(np.float64)) / max(1, left)
            turn += 1
        each = self.granted.where("given > 0").select("shard", "source", F.explode(F.expr("sequence(before, before + given - 1)")).alias("slot")).join(self.sources, "source")
        key = F.xxhash64(F.lit(seed), "source", F.expr("slot DIV blocks"))
        self.slots = each.select("shard", "source", F.expr("slot DIV blocks").alias("round"), permuted_block(F.expr("slot % blocks"), F.col("blocks"), key).alias("block"), F.col("slot"))

    def shares(self) -> DataFrame:
        """source, target_permille, max_repeat, size_tokens, drawn, mixed_tokens, planned_permille, mixed_permille, short.

        drawn: slots it was due by the first draw. planned_permille: share of the planned size (all documents),
        mixed_permille: of what was mixed, which is less only where no source has room; both rounded to 3 places.
        short: the mixture used all its blocks as often as allowed, and that is less than its target share of all documents.
        """
        mixed = self.mix().groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
        rows = self.sources.join(self.first, "source", "left").join(mixed, "source", "left").na.fill(0, ["drawn", "mixed_tokens"])
        all_mixed = mixed.agg(F.sum("mixed_tokens").alias("_all"))
        most = F.col("blocks") * F.greatest(F.lit(0), F.col("max_repeat"))
        # drawn beyond its blocks, or so near to them that chance may have decided; then the sums do
        due = F.col("drawn") + NOISE * F.sqrt(F.col("drawn") + 1.0)
        short = (due >= most) & (F.col("size_tokens") * F.col("max_repeat") * 1000 < F.col("target_permille") * F.lit(self.total))
        return rows.join(F.broadcast(all_mixed), F.lit(True), "left").select("source", "target_permille", "max_repeat", "size_tokens", "drawn", "mixed_tokens", F.round(F.col("mixed_tokens") * 1000 / F.lit(max(1, self.total)), 3).alias("planned_permille"), F.round(F.coalesce(F.col("mixed_tokens") * 1000 / F.col("_all"), F.lit(0.0)), 3).alias("mixed_permille"), short.alias("short"))

    def segments(self) -> DataFrame:
        """source, block, doc_id, token_start, tokens: the parts of documents that make up each block."""
        buckets = max(1, -(-self.rows // RUN_ROWS))
        used = self.docs.join(self.sources.select("source"), "source", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
        placed = running_totals(used, "source", F.pmod(F.col("_h"), F.lit(buckets)), ["_h", "doc_id"], "tokens")
        blocks = placed.withColumn("block", F.explode(F.expr(f"sequence(before DIV {self.block}, (before + tokens - 1) DIV {self.block})")))
        first = F.greatest(F.col("before"), F.col("block") * self.block)
        end = F.least(F.col("before") + F.col("tokens"), (F.col("block") + 1) * self.block)
        return blocks.select("source", "block", "doc_id", (first - F.col("before")).alias("token_start"), (end - first).alias("tokens"))

    def mix(self) -> DataFrame:
        """shard, source, slot, round, block, doc_id, token_start, tokens: the whole mixture."""
        return self.slots.select("shard", "source", "slot", "round", "block").join(self.segments(), ["source", "block"]).select("shard", "source", "slot", "round", "block", "doc_id", "token_start", "tokens")
