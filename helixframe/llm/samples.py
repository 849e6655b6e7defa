"""Fixed-size uniform samples by adaptive Bernoulli sampling.

Every occurrence met gets a uniform number u, made from its piece's id and its rank, so that a repeated task draws the
same. A buffer at level l holds the occurrences with u < 2^-l; when it overflows, l is raised (the inclusion
probability halved) and the buffer thinned until it fits. Merging buffers brings them to the highest level among them
first. The end is a uniform choice of the wanted size among the occurrences of the last buffer.

A piece may have kept only a uniform choice of what it met. All that it met take part with numbers of their own; those
chosen are filled with its kept occurrences in random order, and only when all of these are used up do they stand in
again. So each occurrence met is equally likely at each place of the sample, however small the piece's cap was; a
sample without such repeats would be impossible where a piece's due share is larger than what it kept. Rows that stand
in are told by `again`, so a user who wants distinct occurrences keeps those with again = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.functions.hashing import splitmix64
from helixframe.llm.mixing import permuted
from helixframe.runtime import spread

#: A level beyond which a piece is taken to have met endlessly much.
MAX_LEVEL = 62
#: Drawn occurrences after which a task's buffers are thinned, and the thinned ones of many keys that it holds at most.
FRESH, HELD = 200_000, 1_000_000
#: Numbers drawn at once.
CELLS = 1 << 20


def _level(u: float) -> int:
    """The smallest level whose probability doesn't reach above u."""
    return MAX_LEVEL if u <= 2.0**-MAX_LEVEL else max(0, int(np.ceil(-np.log2(u))))


def piece_draws(piece: np.ndarray, seen: np.ndarray, kept: np.ndarray, most: int, seed: int, below: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, rank, u, kept occurrence and its earlier uses of those of the `most` smallest of each piece's `seen` uniform
    numbers that are under `below` (1), in rising order a piece.

    The numbers come from the spacings of their order statistics, so their count doesn't depend on `seen`; no more are
    made than the bound is likely to let pass, and all for the pieces where that was too few.
    """
    start = splitmix64(piece.astype(np.int64).view(np.uint64) ^ splitmix64(np.array([seed & (2**63 - 1)], np.uint64)))
    below = np.ones(len(piece)) if below is None else below
    wanted = np.minimum(seen, most)
    due = seen * below
    first = np.minimum(wanted, np.ceil(due + 12 * np.sqrt(due) + 24).astype(np.int64))
    out = []
    todo = [(np.arange(len(piece)), first)]
    while todo:
        rows, n = todo.pop()
        for size in np.unique(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)):
            width = 1 << int(size)
            mine = np.flatnonzero(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) == size)
            for at in range(0, len(mine), max(1, CELLS // width)):
                i = mine[at : at + max(1, CELLS // width)]
                r, rank = rows[i], np.arange(width)
                with np.errstate(over="ignore", divide="ignore"):
                    x = splitmix64(start[r, None] + rank.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)
                    e = -np.log((x.astype(np.float64) + 1) * 2.0**-53) / np.maximum(1, seen[r, None] - rank)
                u = -np.expm1(-np.cumsum(e, axis=1))
                short = (n[i] < wanted[r]) & (u[np.arange(len(i)), n[i] - 1] < below[r])
                if short.any():
                    todo.append((r[short], wanted[r[short]]))
                keep = (rank < n[i][:, None]) & (u < below[r][:, None]) & ~short[:, None]
                a, b = np.nonzero(keep)
                out.append((r[a], b, u[a, b]))
    row, rank, u = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    again = rank // kept[row]
    with np.errstate(over="ignore"):
        key = splitmix64(start[row] + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return row, rank, u, permuted(rank % kept[row], kept[row], key), again


class _Buffers:
    """A task's buffers: one table of all keys' occurrences, and the level of each key that has overflowed."""

    def __init__(self, capacity: int, out: pa.Schema) -> None:
        self.capacity, self.out = capacity, out
        self.levels: dict = {}
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, table: pa.Table) -> None:
        self.held.append(table)
        self.rows += table.num_rows

    def thin(self) -> pa.Table:
        """Brings every buffer to its capacity; of a re-sent piece's equal draws one stays."""
        table = pa.concat_tables(self.held).combine_chunks()
        d = table.column("_key").combine_chunks().dictionary_encode(null_encoding="encode")
        code, keys = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
        u, piece, at = (table.column(c).to_numpy() for c in ("_u", "_piece", "_at"))
        order = np.lexsort((at, piece, u, code))
        c, p, a = code[order], piece[order], at[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (a[1:] != a[:-1])))[: len(c)]
        order, c = order[new], c[new]
        rank = np.arange(len(c)) - np.searchsorted(c, c)
        for i in order[rank == self.capacity]:
            self.levels[keys[code[i]]] = max(self.levels.get(keys[code[i]], 0), _level(float(u[i])))
        level = np.array([self.levels.get(k, 0) for k in keys], np.int64)[code[order]] if len(order) else np.empty(0, np.int64)
        keep = u[order] < 2.0 ** -level.astype(np.float64)
        table = table.take(pa.array(order[keep])).drop_columns(["_level"])
        table = table.append_column("_level", pa.array(level[keep].astype(np.int32))).select(self.out.names)
        self.held, self.rows = [table], table.num_rows
        return table


def _drawn(capacity: int, seed: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers, fresh = _Buffers(capacity, out), 0
        for b in batches:
            if not b.num_rows:
                continue
            key, piece, seen, occs = b.columns
            start = occs.offsets.to_numpy().astype(np.int64)
            d = key.dictionary_encode(null_encoding="encode")
            level = np.array([buffers.levels.get(k, 0) for k in d.dictionary.to_pylist()], np.float64)[d.indices.to_numpy(zero_copy_only=False)]
            for at in range(0, b.num_rows, 1000):
                part = slice(at, at + 1000)
                row, rank, u, which, again = piece_draws(piece.to_numpy()[part], seen.to_numpy()[part], np.diff(start)[part], capacity + 1, seed, 2.0 ** -level[part])
                row = row + at
                cols = [key.take(pa.array(row)), pa.array(piece.to_numpy()[row]), pa.array(rank), pa.array(u), pa.array(np.zeros(len(row), np.int32)), pa.array(again), occs.values.take(pa.array(start[row] + which))]
                buffers.add(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out))
                fresh += len(row)
                if fresh > FRESH:
                    table, fresh = buffers.thin(), 0
                    level = np.array([buffers.levels.get(k, 0) for k in d.dictionary.to_pylist()], np.float64)[d.indices.to_numpy(zero_copy_only=False)]
                    if table.num_rows > HELD:  # of many keys; each goes on with a new buffer
                        yield from table.to_batches()
                        buffers = _Buffers(capacity, out)
        if buffers.rows:
            yield from buffers.thin().to_batches(max_chunksize=10_000)

    return run


def _merge(df: DataFrame, by: list[str], capacity: int) -> DataFrame:
    """One buffer for each group: equal level, thinned to the capacity. Levels only rise.

    The level needed after an overflow is that of the (capacity + 1)-th smallest u.
    """
    whole, rising = W.partitionBy(*by), W.partitionBy(*by).orderBy("_u", "_piece", "_at")
    below = lambda level: F.col("_u") < F.pow(F.lit(2.0), -F.col(level).cast("double"))
    ranked = df.withColumn("_top", F.max("_level").over(whole)).where(below("_top")).withColumn("_rank", F.row_number().over(rising))
    over = F.max(F.when(F.col("_rank") == capacity + 1, F.col("_u"))).over(whole)
    raised = ranked.withColumn("_level", F.greatest(F.col("_top"), F.coalesce(F.ceil(-F.log2(over)), F.lit(0))).cast("int"))
    return raised.where(below("_level")).drop("_top", "_rank")


def sample_occurrences(pieces: DataFrame, size: int, key: str | None = None, piece_id: str = "piece_id", seen: str = "seen", occs: str = "occs", seed: int = 7, slack: int = 4, fan_in: int = 64) -> DataFrame:
    """A uniform sample of `size` of the occurrences that all pieces met, or of up to `size` for each value of `key`.

    pieces: seen is the number of occurrences met, occs an array of those kept (all, or a uniform choice); other columns
    are ignored. Returns key (if given), piece_id, occ, u, level, again; the rows of a key share a level, and again is how
    often the occurrence stood in before (0: not at all). Every occurrence met is equally likely, kept or not; see above
    for those of pieces that kept too few. Fewer met than `size` give all that were met. Re-sent pieces count once. A
    null or too small seen is taken as the number kept; pieces with null or empty occs give nothing. Rows with a null
    piece_id are left out; a null key is a key of its own.

    Buffers hold size * slack, one a key in each task; they are merged in a tree of fan_in tasks' buffers at a time, by
    key and a salt of the piece, so a key with most of the rows is never in one task before it is thinned.
    """
    capacity = size * slack
    k = F.col(key) if key else F.lit(None).cast("long")
    met = F.greatest(F.coalesce(F.col(seen).cast("long"), F.lit(0)), F.size(occs).cast("long"))
    rows = spread(pieces.where(F.size(occs) > 0).select(k.alias("_key"), F.col(piece_id).cast("long").alias("_piece"), met.alias("_seen"), F.col(occs).alias("_occs")).where("_piece IS NOT NULL"))
    element = rows.schema["_occs"].dataType.elementType
    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("_piece", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_u", T.DoubleType()), T.StructField("_level", T.IntegerType()), T.StructField("again", T.LongType()), T.StructField("occ", element)])
    part = rows.mapInArrow(_drawn(capacity, seed, to_arrow_schema(schema)), schema)
    salts = -(-rows.rdd.getNumPartitions() // fan_in)
    # copies of a re-sent piece draw the same numbers, so they meet under one salt
    part = part.groupBy("_key", "_piece", "_at").agg(F.first("_u").alias("_u"), F.max("_level").alias("_level"), F.first("again").alias("again"), F.first("occ").alias("occ"))
    while salts > 1:
        part = _merge(part.withColumn("_salt", F.pmod(F.xxhash64("_piece"), F.lit(salts))), ["_key", "_salt"], capacity).drop("_salt")
        salts = -(-salts // fan_in)
    # u decided who came so far; the last choice is by a number of its own
    lot = F.xxhash64(F.lit(seed), F.lit("last"), "_piece", "_at")
    last = _merge(part, ["_key"], capacity).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(lot, "_piece", "_at"))).where(F.col("_n") <= size)
    return last.select(*([F.col("_key").alias(key)] if key else []), F.col("_piece").alias("piece_id"), F.col("occ"), F.col("_u").alias("u"), F.col("_level").alias("level"), "again")
