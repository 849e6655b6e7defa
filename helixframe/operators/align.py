"""Alignment of sequences to a library of consensi: seed lookup, ungapped gate, gapped extension.

A library is small by nature (its bases are checked against MAX_LIBRARY_BASES), so it goes to the tasks as a broadcast
variable and a record is scanned where it is read, in blocks of fixed length whose results don't depend on the number of
tasks. Only accepted hits leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.seq import SpacedSeed, complex_enough, revcomp
from helixframe.operators.chunks import chunk_records, with_window
from helixframe.operators.intervals import with_halo
from helixframe.operators.kmers import CODE, UPPER, in_batches, packed_seeds, seeds
from helixframe.runtime import checkpoint

MAX_LIBRARY_BASES = 64_000_000
BLOCK = 1 << 20
FLANK = 32
#: Letters in which seeds are looked up at once, and seed hits that are handled at once (more where one place has more).
PIECE, HITS = 1 << 18, 1 << 14
#: Heaviest pattern whose seeds are told from others by a table of all that there can be.
MOST_TABLED = 12
# Scores of the alignment, the reach of a diagonal, the least consumed length of a hit.
MATCH, MISMATCH, GAP = 1, -1, 3
DIAGONAL, NEAR, LEAST_HIT = 3, 64, 30
CHAINED_GATE = -8
LOW = -(10**9)

CANDIDATES = "rec_id long, start_pos long, end_pos long, consensus string, strand string, score int, score_fwd int, score_bwd int, cons_fwd int, cons_bwd int, cons_len int, gate_left int, gate_right int, gc double, seed_pos long, seed_cpos long"


@dataclass
class Settings:
    """pattern: seed; gate: least sum and side of the ungapped flanks; single_hit: one seed is enough, else two on a diagonal."""

    pattern: str = "111010010100110111"
    min_score: int = 50
    band: int = 16
    xdrop: int = 40
    single_hit: bool = False
    gate: tuple[int, int] = (4, 6)
    thresholds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.gate) != 2:
            raise ValueError("gate has two numbers")


def library_seeds(consensi: DataFrame, pattern: str, name: str = "consensus", seq: str = "seq") -> DataFrame:
    """consensus, reverse, kmer, cpos: forward seeds of both orientations that are complex enough."""
    seed = SpacedSeed(pattern, any_shape=True)
    both = consensi.select(F.struct(F.col(name).alias("consensus"), F.lit(False).alias("reverse")).alias("rec_id"), F.upper(seq).alias("seq"))
    both = both.unionByName(consensi.select(F.struct(F.col(name).alias("consensus"), F.lit(True).alias("reverse")).alias("rec_id"), revcomp(F.upper(seq)).alias("seq")))
    named = both.select(F.to_json("rec_id").alias("rec_id"), "seq")
    rows = seeds(named, seed, strand="forward").withColumn("_o", F.from_json("rec_id", "consensus string, reverse boolean"))
    return rows.where(complex_enough(F.col("kmer"), seed.weight)).select("_o.consensus", "_o.reverse", "kmer", F.col("pos").alias("cpos"))


def diagonal_pairs(hits: DataFrame) -> DataFrame:
    """hits and prev_pos: those of which one of the two latest earlier hits of the same oriented consensus lies on a near diagonal,
    at most NEAR before; the later one counts. The relational form of the chained scan's two slots; the scan itself also
    skips masked bases and forgets what failed."""
    w = W.partitionBy("rec_id", "consensus", "reverse", "_tile").orderBy("pos", "cpos")
    d = F.col("pos") - F.col("cpos")
    out = with_halo(hits, "pos", NEAR, after=False)
    out = out.withColumns({f"{c}{i}": F.lag(x, i).over(w) for i in (1, 2) for c, x in (("_p", F.col("pos")), ("_d", d))}).where("_own")
    fits = [(F.col(f"_p{i}") < F.col("pos")) & (F.col("pos") - F.col(f"_p{i}") <= NEAR) & (F.abs(d - F.col(f"_d{i}")) <= DIAGONAL) for i in (1, 2)]
    return out.withColumn("prev_pos", F.when(fits[0], F.col("_p1")).when(fits[1], F.col("_p2"))).where("prev_pos IS NOT NULL").drop("_p1", "_p2", "_d1", "_d2", "_tile", "_own")


def gate_flanks(hits: DataFrame, records: DataFrame, consensi: DataFrame, span: int) -> DataFrame:
    """hits with genome and consensus letters up to FLANK bases left and right of the seed (g_left, c_left, ...), upper case."""
    c = consensi.select("consensus", F.upper("seq").alias("_f"), revcomp(F.upper("seq")).alias("_r"))
    # of the record only the window around the seed goes with a hit
    ahead = F.least(F.lit(FLANK).cast("long"), F.col("pos"))
    near = with_window(hits, records, F.col("pos") - ahead, F.col("pos") + span + FLANK, 2 * FLANK + span, "_g").withColumn("_g", F.upper("_g"))
    both = near.join(c, "consensus").withColumn("_c", F.when(F.col("reverse"), F.col("_r")).otherwise(F.col("_f")))
    left = F.least(ahead, F.col("cpos")).cast("int")
    right = F.greatest(F.lit(0), F.least(F.lit(FLANK), F.length("_g") - ahead - span, F.length("_c") - F.col("cpos") - span)).cast("int")
    cut = lambda s, at, n: F.substring(F.col(s), at.cast("int"), n)
    out = both.withColumns({"g_left": cut("_g", ahead - left + 1, left), "c_left": cut("_c", F.col("cpos") - left + 1, left), "g_right": cut("_g", ahead + span + 1, right), "c_right": cut("_c", F.col("cpos") + span + 1, right)})
    return out.drop("_g", "_f", "_r", "_c")


def substitution_table(hits: DataFrame, records: DataFrame, consensi: DataFrame, span: int) -> DataFrame:
    """hits with AA, AC, ... TT: how often each base of the consensus stands against each of the genome in the flanks of the hit."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counted(c: pd.Series, g: pd.Series) -> pd.Series:
        row = np.repeat(np.arange(len(c)), c.str.len())
        a, b = (CODE[np.frombuffer("".join(x).encode(), np.uint8)] for x in (c, g))
        known = (a < 4) & (b < 4)
        n = np.bincount(row[known] * 16 + 4 * a[known].astype(np.int64) + b[known], minlength=16 * len(c))
        return pd.Series(list(n.reshape(-1, 16).astype(np.int32)))

    out = gate_flanks(hits, records, consensi, span).withColumn("_n", counted(F.concat("c_left", "c_right"), F.concat("g_left", "g_right")))
    return out.select(*hits.columns, *[F.col("_n")[i].alias(f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in "ACGT" for b in "ACGT")])


def xdrop_extend(a: np.ndarray, b: np.ndarray, band: int, xdrop: int) -> tuple[int, int, int]:
    """Best score of aligning beginnings of a and b within a band, and how much of each it takes (the first best in row order).

    A row is a letter of a, a cell its distance from the diagonal. Gaps along a row spread by a running maximum.
    """
    width, n = 2 * band + 1, len(b)
    off = np.arange(-band, band + 1)
    slope = GAP * np.arange(width)
    row = np.full(width + 1, LOW)  # a last cell for what comes into the band
    row[:width] = np.where((off >= 0) & (off <= n), -GAP * off, LOW)
    best, best_i, best_j = 0, 0, 0
    padded = np.concatenate((np.full(band + 1, 255, np.uint8), b, np.full(len(a) + band + 1, 255, np.uint8)))
    score: dict[int, np.ndarray] = {}  # of each letter of a against all of b
    here, up = np.empty(width, np.int64), np.empty(width, np.int64)
    for i, letter in enumerate(a.tolist(), 1):
        if (s := score.get(letter)) is None:
            s = score[letter] = np.where(padded == letter, MATCH, MISMATCH)
        np.add(row[:width], s[i : i + width], out=here)  # b[j - 1]
        np.subtract(row[1:], GAP, out=up)
        if i <= band:
            here[: band - i + 1] = LOW  # j < 1
            up[: band - i] = LOW
        np.maximum(here, up, out=here)
        if i + band > n:
            here[max(0, n - i + band + 1) :] = LOW
        np.add(here, slope, out=here)
        np.maximum.accumulate(here, out=here)
        np.subtract(here, slope, out=row[:width])
        if i + band > n:
            row[max(0, n - i + band + 1) :] = LOW
        at = int(row.argmax())
        top = int(row[at])
        if top > best:
            best, best_i, best_j = top, i, i + at - band
        if top < best - xdrop:
            break
    return best, best_i, best_j


class Library:
    """Both orientations of each consensus, and their seeds in order of (value, orientation, place)."""

    def __init__(self, consensi: list[tuple[str, str]], pattern: str) -> None:
        self.names = [n for n, _ in consensi]
        self.seed = SpacedSeed(pattern, any_shape=True)
        forward = [np.frombuffer(s.upper().encode(), np.uint8) for _, s in consensi]
        self.seqs = [x for f in forward for x in (f, np.frombuffer(f.tobytes()[::-1].translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8))]
        if sum(map(len, self.seqs)) > 2 * MAX_LIBRARY_BASES:
            raise ValueError(f"library of more than {MAX_LIBRARY_BASES} bases")
        parts = [packed_seeds(CODE[s], self.seed, "forward") for s in self.seqs]
        value = np.concatenate([v for _, v in parts] or [np.empty(0, np.uint64)])
        oi = np.concatenate([np.full(len(v), i) for i, (_, v) in enumerate(parts)] or [np.empty(0, np.int64)])
        cpos = np.concatenate([p for p, _ in parts] or [np.empty(0, np.int64)])
        keep = is_complex(value, self.seed.weight)
        order = np.lexsort((cpos[keep], oi[keep], value[keep]))
        self.value, self.oi, self.cpos = (x[keep][order] for x in (value, oi, cpos))

    @cached_property
    def present(self) -> np.ndarray | None:
        """Whether a seed is in the library, by its value."""
        if self.seed.weight > MOST_TABLED:
            return None
        out = np.zeros(4**self.seed.weight, bool)
        out[self.value] = True
        return out

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All oriented consensi as one, where each begins, and its length."""
        size = np.array([len(s) for s in self.seqs], np.int64)
        return np.concatenate([*self.seqs, np.zeros(1, np.uint8)]), np.cumsum(size) - size, size

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in a sequence, oriented consensi and places in these that have the same seed, in order, about HITS at a time."""
        span = self.seed.span
        for off in range(0, max(1, len(data) - span + 1), PIECE):
            pos, value = packed_seeds(CODE[data[off : off + PIECE + span - 1]], self.seed, "forward")
            if self.present is not None:
                own = self.present[value]
                pos, value = pos[own], value[own]
            first = np.searchsorted(self.value, value)
            n = np.searchsorted(self.value, value, side="right") - first
            end = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + HITS, side="right")))
                m = n[a:b]
                e = np.arange(m.sum()) + np.repeat(first[a:b] - (np.cumsum(m) - m), m)
                yield np.repeat(pos[a:b] + off, m), self.oi[e], self.cpos[e]
                a = b

    def flanks(self, data: np.ndarray, pos: np.ndarray, oi: np.ndarray, cpos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each hit the FLANK letters before the seed, from it on, and the FLANK after it: of the sequence, of the consensus,
        and whether they lie in both."""
        span, (letters, begin, size) = self.seed.span, self.letters
        j = np.arange(FLANK)
        left = np.minimum(pos, cpos)
        right = np.minimum(len(data) - pos, size[oi] - cpos) - span
        at = np.concatenate((-1 - j, span + j))
        inside = np.concatenate((j < left[:, None], j < right[:, None]), axis=1)
        return data.take(pos[:, None] + at, mode="clip"), letters.take((begin[oi] + cpos)[:, None] + at, mode="clip"), inside

    @classmethod
    def of(cls, consensi: DataFrame, pattern: str) -> Library:
        consensi = checkpoint(consensi.select("consensus", "seq"))  # read twice
        size = consensi.agg(F.sum(F.length("seq"))).first()[0] or 0
        if size > MAX_LIBRARY_BASES:
            raise ValueError(f"library of more than {MAX_LIBRARY_BASES} bases")
        return cls(sorted((r.consensus, r.seq) for r in consensi.where("seq IS NOT NULL").select("consensus", "seq").collect()), pattern)


def _scanned(records: DataFrame, consensi: DataFrame, pattern: str, more: list[tuple[str, pa.DataType]], each: Callable) -> DataFrame:
    """rec_id and more: what each(library, upper-case letters of a record) yields as arrays, where the records are read."""
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

    lib = records.sparkSession.sparkContext.broadcast(Library.of(consensi, pattern))
    kind = records.schema["rec_id"].dataType
    out = pa.schema([("rec_id", to_arrow_type(kind)), *more])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        library = lib.value
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                for found in each(library, UPPER[np.frombuffer(seq.as_buffer(), np.uint8)]):
                    yield rec, *found

    fields = ", ".join(f"{n} {from_arrow_type(t).simpleString()}" for n, t in more)
    return records.where("seq IS NOT NULL").select("rec_id", "seq").mapInArrow(lambda batches: in_batches(rows(batches), out), f"rec_id {kind.simpleString()}, {fields}")


_HIT = [("pos", pa.int64()), ("consensus", pa.string()), ("reverse", pa.bool_()), ("cpos", pa.int64())]


def _named(lib: Library, pos: np.ndarray, oi: np.ndarray, cpos: np.ndarray) -> tuple:
    return pos, np.array(lib.names, object)[oi // 2], oi % 2 == 1, cpos


def seed_hits(records: DataFrame, consensi: DataFrame, pattern: str) -> DataFrame:
    """rec_id, pos, consensus, reverse, cpos: windows of the records and of consensi (consensus, seq), in either orientation, with
    the same forward seed, if it is complex enough. Found where the records are read; only hits leave a task."""
    return _scanned(records, consensi, pattern, _HIT, lambda lib, data: (_named(lib, *h) for h in lib.hits(data)))


def seed_hit_gates(records: DataFrame, consensi: DataFrame, pattern: str) -> DataFrame:
    """seed_hits with gate_left, gate_right: 1 for each equal letter of the flanks, -1 for each other."""

    def each(lib: Library, data: np.ndarray) -> Iterator[tuple]:
        for h in lib.hits(data):
            g, c, inside = lib.flanks(data, *h)
            score = np.where(inside, 2 * (g == c).astype(np.int8) - 1, 0)
            yield *_named(lib, *h), score[:, :FLANK].sum(1), score[:, FLANK:].sum(1)

    return _scanned(records, consensi, pattern, [*_HIT, ("gate_left", pa.int32()), ("gate_right", pa.int32())], each)


def _pair_counts(lib: Library, data: np.ndarray, h: tuple) -> np.ndarray:
    """Of each hit how often each base of the consensus stands against each of the sequence in its flanks, 4 times 4 numbers."""
    g, c, inside = lib.flanks(data, *h)
    g, c = CODE[g], CODE[c]
    known = inside & (g < 4) & (c < 4)
    row = np.nonzero(known)[0]
    return np.bincount(16 * row + 4 * c[known].astype(np.int64) + g[known], minlength=16 * len(h[0])).reshape(-1, 16)


PAIRS = [(a, b) for a in "ACGT" for b in "ACGT"]


def seed_hit_substitutions(records: DataFrame, consensi: DataFrame, pattern: str) -> DataFrame:
    """seed_hits with AA, AC, ... TT (see substitution_table)."""
    each = lambda lib, data: ((*_named(lib, *h), *_pair_counts(lib, data, h).T) for h in lib.hits(data))
    return _scanned(records, consensi, pattern, [*_HIT, *((a + b, pa.int32()) for a, b in PAIRS)], each)


def seed_substitution_counts(records: DataFrame, consensi: DataFrame, pattern: str) -> DataFrame:
    """cons_base, genome_base, n over the flanks of all seed hits; letters other than A, C, G, T are left out. Summed where the
    records are read."""
    pair = np.array(PAIRS, object).T

    def each(lib: Library, data: np.ndarray) -> Iterator[tuple]:
        n = sum((_pair_counts(lib, data, h).sum(0) for h in lib.hits(data)), np.zeros(16, np.int64))
        yield pair[0][n > 0], pair[1][n > 0], n[n > 0]

    found = _scanned(records, consensi, pattern, [("cons_base", pa.string()), ("genome_base", pa.string()), ("n", pa.int64())], each)
    return found.groupBy("cons_base", "genome_base").agg(F.sum("n").alias("n"))


def is_complex(values: np.ndarray, weight: int) -> np.ndarray:
    n = np.stack([sum(((values >> np.uint64(2 * i)) & np.uint64(3) == b).astype(np.int32) for i in range(weight)) if len(values) else np.empty(0, np.int32) for b in range(4)])
    return ((n > 0).sum(0) >= 3) & (n.max(0) <= weight - 3)


def _flank_gate(lib: Library, seq: np.ndarray, g: int, oi: int, cpos: int) -> tuple[int, int]:
    c, span = lib.seqs[oi], lib.seed.span
    left = min(FLANK, g, cpos)
    right = max(0, min(FLANK, len(seq) - g - span, len(c) - cpos - span))
    near = lambda x, y: int(2 * (x == y).sum()) - len(x)
    return near(seq[g - left : g], c[cpos - left : cpos]), near(seq[g + span : g + span + right], c[cpos + span : cpos + span + right])


def _extend(lib: Library, s: Settings, seq: np.ndarray, g: int, oi: int, cpos: int) -> tuple[int, int, int, int, int, int] | None:
    c = lib.seqs[oi]
    tail = len(c) - cpos
    f, cf, gf = xdrop_extend(c[cpos:], seq[g : min(g + tail + s.band + NEAR, len(seq))], s.band, s.xdrop)
    r, cb, gb = xdrop_extend(c[:cpos][::-1], seq[max(0, g - cpos - s.band - NEAR) : g][::-1], s.band, s.xdrop)
    if f + r < max(s.min_score, s.thresholds.get(lib.names[oi // 2], s.min_score)) or gf + gb < LEAST_HIT:
        return None
    return f, r, cf, cb, gf, gb


def scan(lib: Library, s: Settings, seq: np.ndarray, start: int, stop: int) -> Iterator[tuple]:
    """Accepted hits whose seeds start in start..stop of a record, from left to right.

    Single-hit: of a position's seeds the two with the best gate are extended. Chained: a seed needs another of the same
    oriented consensus on a near diagonal, at most NEAR before, and is extended from that one. Bases of an accepted hit are
    skipped, and so are diagonals that failed shortly before.
    """
    pos, value = packed_seeds(CODE[seq[start : stop + lib.seed.span - 1]], lib.seed, "forward")
    first, last = np.searchsorted(lib.value, value), np.searchsorted(lib.value, value, side="right")
    masked = 0
    failed: dict[int, tuple[int, int]] = {}
    slots: dict[int, list[tuple[int, int] | None]] = {}
    for at in np.flatnonzero(last > first):
        g = int(pos[at]) + start
        if g < masked:
            continue
        entries = [(int(lib.oi[e]), int(lib.cpos[e])) for e in range(first[at], last[at])]
        if s.single_hit:
            passed = []
            for oi, cpos in entries:
                memo = failed.get(oi)
                if memo and memo[0] + NEAR >= g and abs(memo[1] - (g - cpos)) <= DIAGONAL:
                    continue
                left, right = _flank_gate(lib, seq, g, oi, cpos)
                if left + right >= s.gate[0] or max(left, right) >= s.gate[1]:
                    passed.append((-(left + right), oi, cpos, left, right))
            tries = [(g, oi, cpos, left, right) for _, oi, cpos, left, right in sorted(passed)[:2]]
            for x, oi, cpos, left, right in tries:
                hit = _extend(lib, s, seq, x, oi, cpos)
                failed[oi] = (x if hit is None else x + hit[4], x - cpos)
                if hit:
                    masked = x + hit[4]
                    yield x, oi, cpos, left, right, *hit
                    break
        else:
            for oi, cpos in entries:
                mine = slots.setdefault(oi, [None, None])
                near = next((i for i, m in enumerate(mine) if m and m[0] < g and m[0] + NEAR >= g and abs(m[1] - (g - cpos)) <= DIAGONAL), None)
                if near is None:
                    mine[0 if mine[0] is None or mine[1] is not None and mine[0][0] <= mine[1][0] else 1] = (g, g - cpos)
                    continue
                x, diagonal = mine[near]
                left, right = _flank_gate(lib, seq, x, oi, x - diagonal)
                hit = _extend(lib, s, seq, x, oi, x - diagonal) if left + right >= CHAINED_GATE else None
                if hit is None:
                    mine[near] = None
                    continue
                masked = x + hit[4]
                yield x, oi, x - diagonal, left, right, *hit
                break


def library_candidates(records: DataFrame, consensi: DataFrame, settings: Settings | None = None, block: int = BLOCK) -> DataFrame:
    """Accepted library hits of every record, with the columns of CANDIDATES.

    consensi: consensus, seq. seed_pos and seed_cpos are where the accepted seed stands in the record and in the oriented
    consensus. Rows with a null sequence give nothing. Letter case is ignored. Records longer than a block are
    handed out block by block, with as many letters around as an extension may reach.
    """
    s = settings or Settings()
    made = Library.of(consensi, s.pattern)
    reach = max(map(len, made.seqs), default=0) + s.band + NEAR + FLANK + made.seed.span
    lib = records.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = lib.value
        for b in batches:
            out: list[list] = [[] for _ in range(16)]
            for rec, number, off, text in zip(*(c.to_pylist() for c in b.columns)):
                seq = np.frombuffer(text.encode(), np.uint8)
                for start in range(number * block - off, min(len(seq), (number + 1) * block - off), block):
                    for g, oi, cpos, left, right, f, r, cf, cb, gf, gb in scan(library, s, seq, start, min(start + block, len(seq))):
                        w = seq[g - gb : g + gf]
                        row = (rec, off + g - gb, off + g + gf, library.names[oi // 2], "-" if oi % 2 else "+", f + r, f, r, cf, cb, len(library.seqs[oi]), left, right, round(float(((w == 71) | (w == 67)).mean()), 3), off + g, cpos)
                        for col, v in zip(out, row):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()] * 8 + [pa.float64()] + [pa.int64()] * 2)], names=[x.split()[0] for x in CANDIDATES.split(", ")])

    rows = records.where("seq IS NOT NULL").select(F.col("rec_id").cast("long").alias("rec_id"), F.upper("seq").alias("seq"))
    short = rows.where(F.length("seq") <= block).select("rec_id", F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("off"), F.col("seq").alias("s"))
    long = chunk_records(rows.where(F.length("seq") > block), block, overlap=reach, before=reach).repartition("rec_id", "chunk_no")
    return short.unionByName(long).mapInArrow(run, CANDIDATES)


def candidate_regions(candidates: DataFrame) -> DataFrame:
    """Merged regions named 'consensus:score' after the first hit in each."""
    from helixframe.operators.intervals import union_named

    return union_named(candidates.withColumn("name", F.concat_ws(":", "consensus", F.col("score").cast("string"))), ["rec_id"])
