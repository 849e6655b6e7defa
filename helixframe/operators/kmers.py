"""Seeds of sequences as a table: one row for each window of a pattern over letters A, C, G, T.

Windows are made on Arrow batches by shifting whole sequences, two bits a letter, so no text is cut apart; everything
after, counting, joining and linking, is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.hashing import SALT, seed_hash
from helixframe.functions.seq import BASES, SpacedSeed, log2_bucket

#: Letters of a sequence that are handled at once.
PIECE = 1 << 22
#: Longest pattern weight whose packed seeds fit a long.
MOST_BASES = 31

CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(BASES):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i

#: ASCII letters in upper case, other bytes as they are.
UPPER = np.arange(256, dtype=np.uint8)
UPPER[97:123] -= 32


def codes_of(seq: pa.StringScalar) -> np.ndarray:
    return CODE[np.frombuffer(seq.as_buffer(), np.uint8)]


def packed_runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Each k successive codes as a number, two bits a code, by doubling the length of what is packed already."""
    power, have, done, out = codes.astype(np.uint64), 1, 0, None
    total = len(codes) - k + 1
    while True:
        if k & have:
            piece = power[done : done + total]
            out = piece.copy() if out is None else (out << np.uint64(2 * have)) | piece
            done += have
        if 2 * have > k:
            return out
        power = (power[:-have] << np.uint64(2 * have)) | power[have:]
        have *= 2


def packed_seeds(codes: np.ndarray, seed: SpacedSeed, strand: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and packed seeds of the windows without other letters. strand: canonical, forward or reverse."""
    n = len(codes) - seed.span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    at = np.flatnonzero(bad[seed.span :] == bad[:n])
    low = codes & 3

    def packed(x: np.ndarray) -> np.ndarray:
        out = None
        for off, length in seed.runs():
            piece = packed_runs(x, length)[off : off + n]
            out = piece if out is None else (out << np.uint64(2 * length)) | piece
        return out

    fwd = packed(low) if strand != "reverse" else None
    # the reverse strand's windows come in the opposite order
    rev = packed((3 - low)[::-1])[::-1] if strand != "forward" else None
    out = rev if fwd is None else fwd if rev is None else np.minimum(fwd, rev)
    return at, out[at]


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of about `size` rows from (id, array, array, ...) for one sequence each: the id goes with every row."""
    held: list[tuple] = []
    n = 0

    def batch() -> pa.RecordBatch:
        lengths = [len(h[1]) for h in held]
        ids = pa.array([h[0] for h in held], schema[0].type).take(pa.array(np.repeat(np.arange(len(held)), lengths)))
        cols = [pa.array(np.concatenate([h[i] for h in held])).cast(schema[i].type) for i in range(1, len(schema))]
        return pa.RecordBatch.from_arrays([ids, *cols], schema=schema)

    for row in rows:
        if len(row[1]):
            held.append(row)
            n += len(row[1])
        if n >= size:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _seed_rows(seed: SpacedSeed, strand: str, sample: int, id_type: pa.DataType):
    out = pa.schema([("rec_id", id_type), ("pos", pa.int64()), ("kmer", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                codes = codes_of(seq)
                for off in range(0, max(1, len(codes) - seed.span + 1), PIECE):
                    pos, kmer = packed_seeds(codes[off : off + PIECE + seed.span - 1], seed, strand)
                    if sample > 1:
                        keep = seed_hash(kmer) & np.uint64(sample - 1) == 0
                        pos, kmer = pos[keep], kmer[keep]
                    yield rec, pos + off, kmer.view(np.int64)

    return lambda batches: in_batches(each(batches), out)


def seeds(records: DataFrame, seed: SpacedSeed | int, strand: str = "canonical", sample: int = 1, rec_id: str = "rec_id", seq: str = "seq") -> DataFrame:
    """rec_id, pos, kmer: every window of the pattern that holds only A, C, G, T (in either case), packed.

    sample: keep the seeds whose hash is one in so many (a power of two), before anything is shuffled. Rows with a null
    sequence, and sequences shorter than the pattern, give nothing. Weight 31 at most, so that a seed fits a long.
    """
    seed = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    if seed.weight > MOST_BASES:
        raise ValueError(f"more than {MOST_BASES} compared places")
    if sample < 1 or sample & (sample - 1):
        raise ValueError("sample must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = records.schema[rec_id].dataType
    rows = records.where(F.col(seq).isNotNull()).select(F.col(rec_id), F.col(seq))
    return rows.mapInArrow(_seed_rows(seed, strand, sample, to_arrow_type(kind)), f"rec_id {kind.simpleString()}, pos long, kmer long")


#: Entries of an index that are broadcast to be looked up where records are read; larger ones are joined.
MOST_LOOKED_UP = 2_000_000


def seed_counts(records: DataFrame, seed: SpacedSeed | int, sample: int = 1, seq: str = "seq") -> DataFrame:
    """kmer, cnt over all records: counted where the records are read, a piece at a time, then summed."""
    seed = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    inner = _seed_rows(seed, "canonical", sample, pa.int64())
    out = pa.schema([("kmer", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c.astype(np.int64))], schema=out)

        for b in inner(batches):
            held.append(b.column(2).to_numpy())
            n += b.num_rows
            if n >= PIECE:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    if seed.weight > MOST_BASES or sample < 1 or sample & (sample - 1):
        raise ValueError(f"at most {MOST_BASES} compared places, a sample that is a power of two")
    rows = records.where(F.col(seq).isNotNull()).select(F.lit(0).cast("long").alias("rec_id"), F.col(seq))
    return rows.mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("cnt"))


def look_up(records: DataFrame, seed: SpacedSeed | int, index: DataFrame, sample: int = 1, most: int = MOST_LOOKED_UP) -> DataFrame:
    """rec_id, pos, kmer, cnt: the records' canonical seeds that are in an index (kmer, cnt).

    At most `most` entries and one more are fetched. If that is all, they are broadcast and only found seeds leave the tasks
    that read the records; else both sides are joined. sample: see seeds; that of the index.
    """
    table = index.select("kmer", "cnt").limit(most + 1).toArrow()
    if table.num_rows > most:
        return seeds(records, seed, sample=sample).join(index, "kmer").select("rec_id", "pos", "kmer", "cnt")
    seed = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    keys, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("kmer", "cnt"))
    order = np.argsort(keys)
    known = records.sparkSession.sparkContext.broadcast((keys[order], counts[order]))
    kind = records.schema["rec_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    inner = _seed_rows(seed, "canonical", sample, to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = known.value
        for b in inner(batches):
            kmer = b.column(2).to_numpy()
            at = np.searchsorted(keys, kmer)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == kmer) if len(keys) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(hit)) for c in b.columns), pa.array(counts[at[hit]])], names=["rec_id", "pos", "kmer", "cnt"])

    rows = records.where(F.col("seq").isNotNull()).select("rec_id", "seq")
    return rows.mapInArrow(run, f"rec_id {kind.simpleString()}, pos long, kmer long, cnt long")


def count_seeds(seed_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """kmer (and by), cnt: exact counts, partial in the map tasks."""
    return seed_rows.groupBy(*(by or []), "kmer").agg(F.count("*").alias("cnt"))


def build_index(records: DataFrame, seed: SpacedSeed | int = 18, sample: int = 16, min_count: int = 2) -> DataFrame:
    """kmer, cnt: sampled seeds of all records that occur at least min_count times. Weight 11 to 31."""
    pattern = SpacedSeed.contiguous(seed) if isinstance(seed, int) else seed
    if not 11 <= pattern.weight <= MOST_BASES:
        raise ValueError("weight must be 11 to 31")
    return seed_counts(records, pattern, sample).where(F.col("cnt") >= min_count)


def histogram(counts: DataFrame) -> DataFrame:
    """bucket, n, at_least: distinct seeds by the binary logarithm of their count, and those in this or a higher bucket."""
    from pyspark.sql import Window as W

    h = counts.groupBy(log2_bucket(F.col("cnt")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return h.withColumn("at_least", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))))


def index_stats(records: DataFrame, seed: SpacedSeed | int = 18, sample: int = 16, min_count: int = 2) -> DataFrame:
    """One row: records, bases, seeds_seen, seeds_sampled, entries."""
    all_seeds = seeds(records, seed)
    from helixframe.functions.hashing import is_sampled, seed_hash_of

    marked = all_seeds.select("kmer", is_sampled(seed_hash_of("kmer"), sample).alias("kept"))
    seen = marked.agg(F.count("*").alias("seeds_seen"), F.coalesce(F.sum(F.col("kept").cast("long")), F.lit(0)).alias("seeds_sampled"))
    entries = build_index(records, seed, sample, min_count).agg(F.count("*").alias("entries"))
    size = records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))
    return size.join(F.broadcast(seen)).join(F.broadcast(entries))


def merge_runs(flushed: DataFrame, value: str = "kmers", count: str = "counts", entry_id: str = "entry_id", min_count: int = 2) -> DataFrame:
    """kmer, cnt of an index whose runs were flushed as entries: sums over distinct entries, at least min_count.

    Entries with a null k-mer, count or id are left out.
    """
    rows = flushed.where(F.col(value).isNotNull() & F.col(count).isNotNull() & F.col(entry_id).isNotNull()).select(entry_id, F.col(value).alias("kmer"), F.col(count).alias("c"))
    return rows.dropDuplicates([entry_id]).groupBy("kmer").agg(F.sum("c").alias("cnt")).where(F.col("cnt") >= min_count)


def neighbours(kmers: DataFrame, k: int, distance: int = 1, itself: bool = False) -> DataFrame:
    """kmer, near: canonical k-mers within `distance` substitutions, without repeats; with the k-mer itself on request."""
    packed = F.col("_near")
    out = kmers.select("kmer").distinct().withColumn("_near", F.col("kmer"))
    for _ in range(distance):
        swapped = F.expr(f"explode(flatten(transform(sequence(0, {k - 1}), i -> transform(sequence(0, 3), b -> (_near & ~shiftleft(3L, CAST(2 * i AS INT))) | shiftleft(CAST(b AS LONG), CAST(2 * i AS INT))))))")
        out = out.select("kmer", swapped.alias("_near")).distinct()
    out = out if itself else out.where("_near <> kmer")
    return out.select("kmer", F.least(packed, packed_revcomp(packed, k)).alias("near")).distinct()


def packed_revcomp(kmer, k: int):
    """Reverse complement of a packed k-mer, by its letters in base 4."""
    return F.conv(F.reverse(F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "3210")), 4, 10).cast("long")


__all__ = ["SALT", "SpacedSeed", "build_index", "count_seeds", "histogram", "index_stats", "merge_runs", "neighbours", "packed_seeds", "seeds"]
