"""Masks of records by the counts of their own seeds or those of an index, which no task and no driver must hold as a whole.

Records are put into bins. A bin's distinct seeds go, sorted and as compressed differences, to buckets by value, where the
counts of all bins are added up; a bucket answers each bin with a class for each of its seeds in order. The bin then makes its
seeds again and links the places of frequent ones. So a seed costs a byte or two on its way, and an answer some bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.seq import SpacedSeed
from helixframe.operators.chunks import chunk_records
from helixframe.operators.kmers import CODE, MOST_BASES, packed_seeds
from helixframe.runtime import checkpoint, shuffle_partitions

#: Letters of the pieces in which records longer than this are linked, letters that a kernel handles at once, and most buckets.
CHUNK, PIECE, MOST_BUCKETS = 1 << 20, 1 << 16, 4096
#: Seeds of a task that are counted at once for an index.
COUNTED = 1 << 22
#: An odd number, by which seeds are multiplied so that buckets are even; modulo a power of two no two become equal.
SPREAD = 0x9E3779B97F4A7C15


def packed_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of their places, compressed."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<QB", len(x), width) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b"")


def unpacked_numbers(b: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", b)
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(pa.decompress(b[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def _seeds_of(texts: pa.ChunkedArray, seed: SpacedSeed, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row (both only with places) and spread canonical seed of all windows of some texts, in order."""
    mask = np.uint64((1 << (2 * seed.weight)) - 1)
    parts: list[tuple] = []
    held: list[np.ndarray] = []
    first = done = size = 0

    def piece() -> None:
        end = np.cumsum([len(x) + 1 for x in held])
        codes = np.full(end[-1], 4, np.uint8)  # what parts two texts is in no window
        for e, x in zip(end.tolist(), held):
            codes[e - 1 - len(x) : e - 1] = CODE[x]
        pos, value = packed_seeds(codes, seed, "canonical")
        value = (value * np.uint64(SPREAD)) & mask
        if places:
            row = np.searchsorted(end, pos, side="right")
            parts.append((row + first, pos - np.concatenate(([0], end))[row], value))
        else:
            parts.append((pos[:0], pos[:0], value))

    for s in (s for c in texts.chunks for s in c):
        held.append(np.frombuffer(s.as_buffer(), np.uint8))
        size += len(held[-1])
        done += 1
        if size >= PIECE:
            piece()
            held, size, first = [], 0, done
    if held:
        piece()
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _groups(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the values, and which distinct one each is in this order."""
    at = max(1, len(value)).bit_length()
    if bits + at <= 64:
        both = np.sort((value << np.uint64(at)) | np.arange(len(value), dtype=np.uint64))
        order, value = (both & np.uint64((1 << at) - 1)).astype(np.int64), both >> np.uint64(at)
    else:
        order = np.argsort(value, kind="stable")
        value = value[order]
    return order, np.cumsum(np.concatenate(([False], value[1:] != value[:-1]))[: len(value)])


def _counts(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct seeds and their counts of what is held, which is used up: a batch of them may take a good part of a task's memory."""
    value = held.pop() if len(held) == 1 else np.concatenate(held)
    held.clear()
    value.sort()
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))[: len(value)])
    return value[at], np.diff(at, append=len(value))


def _sent(value: np.ndarray, n: np.ndarray, number: int, below: int) -> pa.Table:
    """bucket, bin, gaps, n: distinct sorted seeds and their counts by bucket, in which the lowest `below` bits tell them apart."""
    bucket = (value >> np.uint64(below)).astype(np.int32)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])
    value = value & np.uint64((1 << below) - 1)
    parts = [slice(a, b) for a, b in zip(at, [*at[1:], len(value)])]
    gaps = [packed_numbers(np.diff(value[p], prepend=np.uint64(0))) for p in parts]
    return pa.table([pa.array(bucket[at]), pa.array(np.full(len(at), number, np.int32)), pa.array(gaps, pa.binary()), pa.array([packed_numbers(n[p]) for p in parts], pa.binary())], names=["bucket", "bin", "gaps", "n"])


SENT = "bucket int, bin int, gaps binary, n binary"
#: Instead of a bin: the index.
INDEX = -1


class _Bucket:
    """The seeds of a bucket: known (None: all that there can be) and total, the sums of their counts in the rows `of`."""

    def __init__(self, group: pa.Table, below: int, of: list[int]) -> None:
        self.gaps = group["gaps"]
        self.size = [struct.unpack_from("<Q", g.as_py())[0] for g in self.gaps]
        self.known = None if 8 * sum(self.size) >= 1 << below else np.unique(np.concatenate([self.read(i) for i in range(len(self.gaps))]))
        self.total = np.zeros((1 << below) if self.known is None else len(self.known), np.int64)
        for i in of:  # a row has each seed once
            self.total[self.places(i)] += unpacked_numbers(group["n"][i].as_py()).astype(np.int64)

    def read(self, i: int) -> np.ndarray:
        return np.cumsum(unpacked_numbers(self.gaps[i].as_py()), dtype=np.uint64)

    def places(self, i: int) -> np.ndarray:
        v = self.read(i)
        return v.astype(np.int64) if self.known is None else np.searchsorted(self.known, v)


def _buckets(bits: int, buckets: int, tasks: int) -> int:
    """Bits that are left below those that tell the bucket."""
    return bits - min(bits, ((buckets or min(MOST_BUCKETS, 8 * tasks)) - 1).bit_length())


def seed_index(records: DataFrame, seed: SpacedSeed | int, min_count: int = 2, buckets: int = 0) -> DataFrame:
    """kmer, cnt of the canonical seeds of all records that occur at least min_count times."""
    seed = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    tasks, bits = shuffle_partitions(records.sparkSession), 2 * seed.weight
    below = _buckets(bits, buckets, tasks)
    back, mask = np.uint64(pow(SPREAD, -1, 1 << 64)), np.uint64((1 << bits) - 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(_seeds_of(pa.chunked_array([b.column(0)]), seed)[2])
            size += len(held[-1])
            if size >= COUNTED:
                yield from _sent(*_counts(held), 0, below).to_batches()
                size = 0
        if size:
            yield from _sent(*_counts(held), 0, below).to_batches()

    def summed(group: pa.Table) -> pa.Table:
        b = _Bucket(group, below, list(range(group.num_rows)))
        at = np.flatnonzero(b.total >= max(1, min_count))
        value = at.astype(np.uint64) if b.known is None else b.known[at]
        value |= np.uint64(group["bucket"][0].as_py() << below)
        return pa.table([pa.array(((value * back) & mask).view(np.int64)), pa.array(b.total[at])], names=["kmer", "cnt"])

    pieces = chunk_records(records.select("rec_id", "seq"), CHUNK, overlap=seed.span - 1).select("s")
    return pieces.mapInArrow(sent, SENT).groupBy("bucket").applyInArrow(summed, "kmer long, cnt long")


def mask_by_counts(records: DataFrame, seed: SpacedSeed | int, low: int = 3, high: int = 3, gap: int = 150, min_len: int = 30, min_hits: int = 1, min_density: float = 0.0, index: DataFrame | None = None, chunk: int = 0, bins: int = 0, buckets: int = 0) -> DataFrame:
    """rec_id, start_pos, end_pos, hits: link_hits of the hits of records in an index (kmer, cnt), with the same cutoffs.

    Without one it is of all seeds of the records that occur at least twice. chunk, bins and buckets (a power of two) change nothing but the work;
    0: CHUNK or more for a wide gap, some for each partition.
    """
    seed = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    if not 2 <= seed.weight <= MOST_BASES:
        raise ValueError(f"2 to {MOST_BASES} compared places")
    high = max(1, high)
    low = min(max(1, low), high)
    chunk = max(chunk or CHUNK, gap + 1)
    tasks = shuffle_partitions(records.sparkSession)
    bins, bits = bins or 4 * tasks, 2 * seed.weight
    below = _buckets(bits, buckets, tasks)
    own = index is None
    least = 2 if own else 1

    pieces = chunk_records(records.select(F.col("rec_id").cast("long").alias("rec_id"), "seq"), chunk, overlap=seed.span - 1)
    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("rec_id", "chunk_no"), F.lit(bins)).cast("int")).repartition(tasks, "bin")

    def sent(group: pa.Table) -> pa.Table:
        return _sent(*np.unique(_seeds_of(group["s"], seed)[2], return_counts=True), group["bin"][0].as_py(), below)

    def of_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = (b.column(0).to_numpy().view(np.uint64) * np.uint64(SPREAD)) & np.uint64((1 << bits) - 1)
            order = np.argsort(value)
            yield from _sent(value[order], b.column(1).to_numpy()[order], INDEX, below).to_batches()

    def answered(group: pa.Table) -> pa.Table:
        number = group["bin"].to_numpy()
        b = _Bucket(group, below, list(range(len(number))) if own else np.flatnonzero(number == INDEX).tolist())
        kind = ((b.total >= max(least, low)).astype(np.uint8) + (b.total >= max(least, high))).astype(np.uint8)
        rows = np.flatnonzero(number != INDEX)
        classes = [pa.compress(kind[b.places(i)].tobytes(), codec="zstd", asbytes=True) for i in rows.tolist()]
        return pa.table([pa.array(number[rows]), group["bucket"].take(pa.array(rows)), pa.array(np.array(b.size, np.int64)[rows]), pa.array(classes, pa.binary())], names=["bin", "bucket", "size", "classes"])

    def linked(group: pa.Table, answers: pa.Table) -> pa.Table:
        row, pos, value = _seeds_of(group["s"], seed, places=True)
        order, which = _groups(value, bits)
        del value
        replies = sorted(zip(answers["bucket"].to_pylist(), answers["size"].to_pylist(), answers["classes"].to_pylist()))
        kinds = np.concatenate([np.frombuffer(pa.decompress(b, n, "zstd", asbytes=True), np.uint8) for _, n, b in replies] or [np.empty(0, np.uint8)])
        if len(kinds) != (which[-1] + 1 if len(which) else 0):
            raise RuntimeError("records differed when they were read again")
        kind = np.empty(len(order), np.uint8)
        kind[order] = kinds[which]
        hit = np.flatnonzero(kind)
        row, pos, strong = row[hit], pos[hit], kind[hit] == 2
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + gap)))[: len(row)]
        at = np.flatnonzero(new)
        n = np.diff(np.concatenate((at, [len(row)])))
        piece, last = row[at], pos[at + n - 1]
        number, off, length = (x.to_numpy()[piece] for x in (group["chunk_no"], group["off"], pa.compute.binary_length(group["s"].cast(pa.binary()))))
        # chains that one of another piece of the record may go on with
        edge = (number > 0) & (pos[at] <= gap) | (length > chunk) & (chunk - last <= gap)
        top = np.maximum.reduceat(strong, at) if len(at) else strong
        cols = [group["rec_id"].to_numpy()[piece], pos[at] + off, last + off, top, n, edge]
        return pa.table([pa.array(c) for c in cols], names=["rec_id", "first", "last", "strong", "hits", "edge"])

    rows = binned.groupBy("bin").applyInArrow(sent, SENT)
    if index is not None:
        rows = rows.unionByName(index.where(F.col("cnt") >= low).select(F.col("kmer").cast("long"), F.col("cnt").cast("long")).mapInArrow(of_index, SENT))
    told = rows.groupBy("bucket").applyInArrow(answered, "bin int, bucket int, size long, classes binary")
    chains = checkpoint(binned.groupBy("bin").cogroup(told.groupBy("bin")).applyInArrow(linked, "rec_id long, first long, last long, strong boolean, hits long, edge boolean"))
    across = W.partitionBy("rec_id").orderBy("first")
    apart = F.coalesce(F.col("first") > F.lag("last").over(across) + gap, F.lit(True)).cast("long")
    joined = chains.where("edge").withColumn("_c", F.sum(apart).over(across)).groupBy("rec_id", "_c").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("strong").alias("strong"), F.sum("hits").alias("hits")).drop("_c")
    whole = chains.where("NOT edge").drop("edge").unionByName(joined).withColumn("end_pos", F.col("last") + seed.span)
    length = F.col("end_pos") - F.col("first")
    return whole.where(F.col("strong") & (length >= min_len) & (F.col("hits") >= min_hits) & (F.col("hits") >= length * min_density)).select("rec_id", F.col("first").alias("start_pos"), "end_pos", "hits")
