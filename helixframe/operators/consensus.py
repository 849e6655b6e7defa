"""Consensus sequences of repeat families, built from their most frequent seeds.

The pool of seeds is a ranked table, of which the driver sees a stretch at a time. Occurrences of the next few thousand seeds are
found where the records are read, by a broadcast of the seeds, and sampled per seed; their flanks are cut out where the records
are read again, and the seeds of a task are extended side by side. Extensions don't depend on each other; which of them
are kept does. So seeds are worked off in rounds: the next few are extended, the driver chooses among these few in
order, and the seeds near the consensi that it kept are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.hashing import splitmix64, splitmix64_of
from helixframe.functions.seq import SpacedSeed, kmer_text, revcomp
from helixframe.operators.align import GAP, LOW, MATCH, MISMATCH
from helixframe.operators.chunks import with_window
from helixframe.operators.kmers import CODE, UPPER, packed_revcomp, packed_seeds, seeds
from helixframe.operators.ordering import numbered
from helixframe.runtime import checkpoint, free_shuffles, shuffle_partitions, stored

#: Most seeds of a round, and most of their occurrences. The driver sees the latter, and the extensions that may be kept.
ROUND, ROUND_PLACES = 8000, 100_000
#: Seeds of the pool that the driver sees at once, and occurrences that are looked up at once.
HEAD, PLACES = 1 << 20, 1_000_000
#: Letters in which seeds are looked up at once, bits of the table that most others are told from them by, and occurrences that a
#: task thins at once.
PIECE, SIEVE, FOUND = 1 << 18, 20, 1 << 18
#: Bytes of flanks that leave a task at once, and copies that a task takes at once.
FLANK_BYTES, TAKEN = 1 << 22, 2048
#: Substitutions within which a seed is taken to be covered by one of a consensus.
NEAR = 2


def top_seeds(index: DataFrame, n: int, min_count: int = 1) -> DataFrame:
    """kmer, cnt of the n most frequent seeds; equal counts in the order of the k-mers."""
    return index.where(F.col("cnt") >= min_count).orderBy(F.desc("cnt"), "kmer").limit(n)


def ranked_pool(index: DataFrame, n: int, min_count: int, weight: int) -> DataFrame:
    """top_seeds with their rank, counting from 0. By counts of the counts, and of the first letters of the seeds that have the last
    count of all, little more than the n are sorted. index is read several times."""
    rows = index.where(F.col("cnt") >= min_count).select("kmer", "cnt")

    def least(groups: pd.DataFrame, room: int) -> tuple:
        """The value with which the room is full, and what is left of it before."""
        before = groups["count"].cumsum() - groups["count"]
        full = np.flatnonzero(before + groups["count"] >= room)
        return (groups["v"].iloc[full[0]], room - int(before.iloc[full[0]])) if len(full) else (None, 0)

    last, room = least(rows.groupBy(F.col("cnt").alias("v")).count().toPandas().sort_values("v", ascending=False), n)
    if last is not None:
        first = F.shiftright("kmer", max(0, 2 * weight - 14))
        ties = rows.where(F.col("cnt") == int(last)).groupBy(first.alias("v")).count().toPandas().sort_values("v")
        rows = rows.where((F.col("cnt") > int(last)) | (F.col("cnt") == int(last)) & (first <= int(least(ties, room)[0])))
    return numbered(rows.withColumn("_down", -F.col("cnt")), ["_down", "kmer"], "rank").drop("_down").where(F.col("rank") < n)


def occurrences(records: DataFrame, chosen: DataFrame, k: int | SpacedSeed, per_seed: int, salt: int = 12_648_430) -> DataFrame:
    """kmer, rec_id, pos, forward: up to per_seed occurrences of each chosen seed, picked by a hash (splitmix64) of their place.

    A seed with a large share of all occurrences is thinned in two steps, within a salt and then as a whole.
    """
    weight = k if isinstance(k, int) else k.weight
    fwd = seeds(records, k, strand="forward").withColumnRenamed("kmer", "_f")
    both = fwd.withColumn("_r", packed_revcomp(F.col("_f"), weight)).withColumn("kmer", F.least("_f", "_r"))
    found = both.join(chosen.select("kmer"), "kmer", "left_semi").select("kmer", "rec_id", "pos", (F.col("_f") <= F.col("_r")).alias("forward"), splitmix64_of(F.col("rec_id").cast("long").bitwiseXOR(F.lit(salt))).alias("_r"))
    found = found.withColumn("_h", splitmix64_of(F.col("_r").bitwiseXOR(F.col("pos")))).drop("_r")
    part = W.partitionBy("kmer", F.pmod("_h", F.lit(32))).orderBy("_h", "rec_id", "pos")
    whole = W.partitionBy("kmer").orderBy("_h", "rec_id", "pos")
    thin = found.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= per_seed)
    return thin.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= per_seed).drop("_n", "_h")


def _windows(column: pa.Array, seed: SpacedSeed) -> Iterator[tuple]:
    """Row, place in the row, canonical seed, letter codes and the seed's place among them, for some PIECE letters of sequences."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def piece() -> tuple:
        end = np.cumsum([len(x) + 1 for _, _, x in held])
        codes = np.full(end[-1], 4, np.uint8)  # what parts two texts is in no window
        for e, (_, _, x) in zip(end.tolist(), held):
            codes[e - 1 - len(x) : e - 1] = CODE[x]
        return np.array([r for r, _, _ in held]), np.array([o for _, o, _ in held]), end, codes, *packed_seeds(codes, seed, "canonical")

    for row, s in enumerate(column):
        data = np.frombuffer(s.as_buffer(), np.uint8)
        for off in range(0, max(1, len(data) - seed.span + 1), PIECE):
            held.append((row, off, data[off : off + PIECE + seed.span - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def occurrences_of(records: DataFrame, chosen: np.ndarray, seed: SpacedSeed, per_seed: int, salt: int = 12_648_430) -> DataFrame:
    """occurrences of few enough seeds to be broadcast, found where the records are read. A task sends at most per_seed of a seed
    for each FOUND that it finds. Other ids than whole numbers go through the join."""
    spark, kind = records.sparkSession, records.schema["rec_id"].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        return occurrences(records, _kmers(spark, chosen), seed, per_seed, salt)
    shared = spark.sparkContext.broadcast(np.sort(chosen.astype(np.uint64)))
    ones = [off + i for off, n in seed.runs() for i in range(n)]
    spread, below = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SIEVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        sieve = np.zeros(1 << SIEVE, bool)
        sieve[(keys * spread) >> below] = True
        held: list[tuple] = []
        size = 0

        def thinned() -> pa.RecordBatch:
            kmer, rec, pos, forward = (np.concatenate(x) for x in zip(*held))
            h = splitmix64(splitmix64((rec ^ np.int64(salt)).view(np.uint64)) ^ pos.view(np.uint64)).view(np.int64)
            order = np.lexsort((pos, rec, h, kmer))
            k = kmer[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
            nth = np.arange(len(k)) - np.repeat(first, np.diff([*first, len(k)]))
            order = order[nth < per_seed]
            return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (kmer.view(np.int64), rec, pos, forward, h)], names=["kmer", "rec_id", "pos", "forward", "_h"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, off, end, codes, pos, value in _windows(b.column(1), seed):
                may = np.flatnonzero(sieve[(value * spread) >> below])
                at = np.searchsorted(keys, value[may])
                at[at == len(keys)] = 0
                may = may[keys[at] == value[may]]
                value, pos = value[may], pos[may]
                forward = np.zeros(len(pos), np.uint64)
                for o in ones:
                    forward = (forward << np.uint64(2)) | codes[pos + o]
                i = np.searchsorted(end, pos, side="right")
                held.append((value, ids[row[i]], pos - np.concatenate(([0], end))[i] + off[i], forward == value))
                size += len(value)
                if size >= FOUND:
                    yield thinned()
                    held, size = [], 0
        if size:
            yield thinned()

    rows = records.where("seq IS NOT NULL AND rec_id IS NOT NULL").select("rec_id", "seq")
    found = rows.mapInArrow(run, "kmer long, rec_id long, pos long, forward boolean, _h long")
    nth = F.row_number().over(W.partitionBy("kmer").orderBy("_h", "rec_id", "pos"))
    return found.withColumn("_n", nth).where(F.col("_n") <= per_seed).select("kmer", F.col("rec_id").cast(kind).alias("rec_id"), "pos", "forward")


def flanks_of(records: DataFrame, places: pa.Table, span: int, flank: int) -> DataFrame:
    """oriented_flanks of few enough places (kmer, cnt, rec_id, pos, forward) to be broadcast, cut out where the records are read."""
    places = places.sort_by([("rec_id", "ascending"), ("pos", "ascending")])
    ids = places["rec_id"].to_pylist()
    at = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    shared = records.sparkSession.sparkContext.broadcast(({ids[a]: (a, b) for a, b in zip(at, [*at[1:], len(ids)])}, places.select(["kmer", "cnt", "pos", "forward"]).combine_chunks()))
    kind = records.schema["rec_id"].dataType
    other = bytes.maketrans(b"ACGT", b"TGCA")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, table = shared.value
        pos, forward = table["pos"].to_numpy(), table["forward"].to_numpy()
        for b in batches:
            row: list[int] = []
            took: list[int] = []
            text: list[tuple[bytes, bytes, bytes]] = []
            size = 0

            def batch() -> pa.RecordBatch:
                t = table.take(pa.array(took))
                cols = [*(t[c].combine_chunks() for c in ("kmer", "cnt")), b.column(0).take(pa.array(row)), t["pos"].combine_chunks(), *(pa.array(x, pa.binary()).cast(pa.string()) for x in zip(*text))]
                return pa.RecordBatch.from_arrays(cols, names=["kmer", "cnt", "rec_id", "pos", "seed_seq", "left", "right"])

            for r, rec in enumerate(b.column(0).to_pylist()):
                if (mine := where.get(rec)) is None:
                    continue
                data = memoryview(UPPER[np.frombuffer(b.column(1)[r].as_buffer(), np.uint8)])
                for i in range(*mine):
                    p = int(pos[i])
                    before, mid, after = (bytes(data[x:y]) for x, y in ((max(0, p - flank), p), (p, p + span), (p + span, p + span + flank)))
                    text.append((mid, before[::-1], after) if forward[i] else (mid[::-1].translate(other), after.translate(other), before[::-1].translate(other)))
                    row.append(r)
                    took.append(i)
                    size += len(before) + len(after)
                    if size >= FLANK_BYTES:
                        yield batch()
                        row, took, text, size = [], [], [], 0
            if row:
                yield batch()

    rows = records.where("seq IS NOT NULL").select("rec_id", "seq")
    return rows.mapInArrow(run, f"kmer long, cnt long, rec_id {kind.simpleString()}, pos long, seed_seq string, left string, right string")


def oriented_flanks(records: DataFrame, occ: DataFrame, span: int, flank: int) -> DataFrame:
    """occ with seed_seq, left (read away from the seed) and right, in the seed's orientation, upper case."""
    ahead = F.least(F.lit(flank).cast("long"), F.col("pos"))
    rows = with_window(occ, records, F.col("pos") - ahead, F.col("pos") + span + flank, 2 * flank + span, "_s").withColumn("_s", F.upper("_s"))
    cut = lambda at, n: F.substring(F.col("_s"), (at + 1).cast("int"), n.cast("int"))
    before, mid, after = cut(F.lit(0), ahead), cut(ahead, F.lit(span)), cut(ahead + span, F.lit(flank))
    fwd = F.col("forward")
    return rows.select(*occ.columns, F.when(fwd, mid).otherwise(revcomp(mid)).alias("seed_seq"), F.when(fwd, F.reverse(before)).otherwise(F.reverse(revcomp(after))).alias("left"), F.when(fwd, after).otherwise(revcomp(before)).alias("right"))


class _Growing:
    """Consensi that have come as far as each other: their copies side by side, with a band of alignment scores for each.

    Equal copies of a consensus are one, with as many votes and judges (every third copy, where there are three).
    """

    def __init__(self, number: int, copies: list[bytes], band: int, kind: type) -> None:
        self.number, self.band = [number], band
        own: dict[bytes, int] = {}
        self.which = [np.array([own.setdefault(c, len(own)) for c in copies])]
        self.texts, self.count = list(own), np.array([len(own)])
        self.sizes = np.array([len(c) for c in self.texts], np.int64)
        judge = (np.arange(len(copies)) % 3 == 2) & (len(copies) >= 3)
        self.votes, self.judges = (np.bincount(self.which[0][x], minlength=len(own)).astype(np.int32) for x in (~judge, judge))
        off = (np.arange(2 * band + 1) - band)[:, None]
        self.low = kind(-16_000 if kind is np.int16 else LOW)
        self.col = np.where((off >= 0) & (off <= self.sizes), -GAP * off, self.low).astype(kind)
        self.best, self.best_m = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.kept = np.zeros(len(self.texts), np.int64)
        self.grown = [bytearray()]

    def part(self, alive: np.ndarray) -> _Growing:
        out, own = object.__new__(_Growing), np.repeat(alive, self.count)
        out.number, out.grown, out.which = ([x for x, y in zip(v, alive) if y] for v in (self.number, self.grown, self.which))
        out.texts = [x for x, y in zip(self.texts, own) if y]
        out.count, out.best, out.best_m = (x[alive] for x in (self.count, self.best, self.best_m))
        out.sizes, out.votes, out.judges, out.kept = (x[own] for x in (self.sizes, self.votes, self.judges, self.kept))
        out.col, out.band, out.low = np.ascontiguousarray(self.col[:, own]), self.band, self.low
        return out

    @staticmethod
    def joined(parts: list[_Growing]) -> _Growing:
        out = object.__new__(_Growing)
        out.number, out.texts, out.grown, out.which = ([x for p in parts for x in getattr(p, n)] for n in ("number", "texts", "grown", "which"))
        out.count, out.sizes, out.votes, out.judges, out.best, out.best_m, out.kept = (np.concatenate([getattr(p, n) for p in parts]) for n in ("count", "sizes", "votes", "judges", "best", "best_m", "kept"))
        out.col, out.band, out.low = np.concatenate([p.col for p in parts], axis=1), parts[0].band, parts[0].low
        return out

    def advance(self, first: int, last: int, lookahead: int) -> np.ndarray:
        """Steps first..last of all, and which of them haven't ended then. Gaps along a step never beat where they begin, so a step's
        best scores are known before them, and only the chosen base's are spread."""
        width, kind, n = 2 * self.band + 1, self.col.dtype.type, len(self.texts)
        rows = last - first + width
        # row r is the copies' base at first + r - band - 1; one past the end counts as far below any score
        table = np.full((n, rows), 255, np.uint8)
        for i, c in enumerate(self.texts):
            at = first - self.band - 1
            x = np.frombuffer(c, np.uint8)[max(0, at) : at + rows]
            table[i, max(0, -at) : max(0, -at) + len(x)] = x
        table = np.ascontiguousarray(table.T)
        j = np.arange(rows)[:, None] + first - self.band
        outside = (j < 0) | (j > self.sizes)
        cap = np.where(outside, self.low, kind(np.iinfo(kind).max)).astype(kind)
        step = np.where(table[:, None, :] == LETTERS[None, :, None], kind(MATCH), kind(MISMATCH)).astype(kind)
        np.copyto(step, kind(self.low // 2), where=(outside | (j < 1))[:, None, :])
        slope = (GAP * np.arange(width)).astype(kind)[:, None]
        start = np.cumsum(self.count) - self.count
        of = np.repeat(np.arange(len(self.count)), self.count)
        votes, judges, place = self.votes, self.judges, np.arange(n)
        col, up = self.col, np.empty((width, n), kind)
        four, here = np.empty((width, 4, n), kind), np.empty((width, n), kind)
        up[-1] = self.low
        alive = np.ones(len(self.count), bool)
        for m in range(first, last + 1):
            r = m - first
            np.add(step[r : r + width], col[:, None, :], out=four)
            np.subtract(col[1:], kind(GAP), out=up[:-1])
            np.minimum(up, cap[r : r + width], out=up)
            score = np.maximum(four.max(0), up.max(0))
            positive = np.maximum(score, 0)
            chosen = np.add.reduceat(positive * votes, start, axis=1, dtype=np.int64).argmax(0)
            letter = chosen[of]
            judged = np.add.reduceat(positive[letter, place] * judges, start, dtype=np.int64)
            np.take(four.reshape(width, 4 * n), letter * n + place, axis=1, out=here, mode="clip")
            np.maximum(here, up, out=here)
            here += slope
            np.maximum.accumulate(here, axis=0, out=here)
            here -= slope
            np.minimum(here, cap[r : r + width], out=here)
            np.maximum(here, self.low, out=col)
            for g, x in zip(self.grown, LETTERS[chosen].tolist()):
                g.append(x)
            better = alive & (judged > self.best)
            if better.any():
                self.best[better], self.best_m[better] = judged[better], m
                own = better[of]
                self.kept[own] = score[letter[own], place[own]]
            alive &= m - self.best_m < lookahead
            if not alive.any():
                break
        return alive


#: Copies that are advanced at once, and after how many steps those of consensi that have ended are left out.
ABREAST, STOPS = 512, (16, 60, 120, 200, 300, 450, 700, 1000, 1400, 1900, 2500)
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def extend_all(groups: list[list[bytes]], band: int, lookahead: int, most: int) -> list[tuple[bytes, np.ndarray]]:
    """Grows a consensus over the beginnings of each group's copies, base by base, and gives each copy's score where it was best.

    Each copy keeps a band of alignment scores; all copies and the four bases are advanced at once. Two thirds of the copies
    vote for the next base, every third judges whether it was an improvement; without judges (fewer than three copies)
    there is none. Ends after `lookahead` bases without one. Groups don't see each other; they only share the work of a step.
    """
    kind = np.int16 if most + 4 * GAP * band < 3_500 else np.int32
    out: list = [(b"", np.zeros(len(g), np.int64)) for g in groups]
    line = [_Growing(i, g, band, kind) for i, g in enumerate(groups) if len(g) >= 3]
    done = 0
    ends = [m for m in STOPS if m < most]
    while ends and ends[-1] + 1000 < most:
        ends.append(ends[-1] + 1000)
    for end in [*ends, most]:
        waiting, line, held = line, [], []
        while waiting:
            held.append(waiting.pop())
            if waiting and sum(len(g.texts) for g in held) < ABREAST:
                continue
            now, held = _Growing.joined(held), []
            alive = now.advance(done + 1, end, lookahead) & (end < most)
            first = np.cumsum(now.count) - now.count
            for i in np.flatnonzero(~alive).tolist():
                kept = now.kept[first[i] : first[i] + now.count[i]]
                out[now.number[i]] = bytes(now.grown[i][: now.best_m[i]]), np.where(kept < int(now.low) // 4, LOW, kept)[now.which[i]]
            if alive.any():
                line.append(now.part(alive))
        done = end
    return out


def extend(copies: list[bytes], band: int, lookahead: int, most: int) -> tuple[bytes, np.ndarray]:
    """extend_all of one group."""
    return extend_all([copies], band, lookahead, most)[0]


def is_tandem(seq: bytes) -> bool:
    """At least 60 bases of which 80 % equal the base some period before, of at most 50 and a third of the length."""
    x = np.frombuffer(seq, np.uint8)
    return len(x) >= 60 and any((x[p:] == x[:-p]).mean() >= 0.8 for p in range(1, min(50, len(x) // 3) + 1))


def _trimmed(seq: bytes, least: int = 8) -> bytes:
    for _ in range(2):
        run = len(seq) - len(seq.lstrip(seq[:1])) if seq else 0
        seq = (seq[run:] if run >= least else seq)[::-1]
    return seq


def extended(flanks: DataFrame, span: int, max_occ: int, flank: int, band: int, lookahead: int, min_support: int) -> DataFrame:
    """kmer, cnt, seq, support, occurrences, tandem of every seed with enough occurrences; those of a task are extended side by side.

    flanks: oriented_flanks with cnt; a seed has max_occ rows at most.
    """

    def grown(groups: list[tuple]) -> pa.RecordBatch:
        right = extend_all([g[4] for g in groups], band, lookahead, flank)
        left = extend_all([g[3] for g in groups], band, lookahead, flank)
        out: list[tuple] = []
        for (kmer, cnt, mid, own, _), (l_seq, l_score), (r_seq, r_score) in zip(groups, left, right):
            seq = _trimmed(l_seq[::-1] + mid + r_seq)
            out.append((kmer, cnt, seq.decode(), int((r_score + l_score + span >= 0.25 * len(seq)).sum()), len(own), is_tandem(seq)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["kmer", "cnt", "seq", "support", "occurrences", "tandem"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple] = []
        taken = 0
        now: tuple | None = None
        for b in batches:
            for kmer, cnt, mid, l, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or now[0] != kmer:
                    if now is not None and len(now[3]) >= min_support:
                        groups.append(now)
                        taken += len(now[3])
                    if taken >= TAKEN:
                        yield grown(groups)
                        groups, taken = [], 0
                    now = kmer, cnt, mid.encode(), [], []
                if len(now[3]) < max_occ:
                    now[3].append(l.encode())
                    now[4].append(r.encode())
        if now is not None and len(now[3]) >= min_support:
            groups.append(now)
        if groups:
            yield grown(groups)

    # the number of partitions is set: a group costs far more than its few bytes suggest
    spread = flanks.repartition(2 * shuffle_partitions(flanks.sparkSession), "kmer").sortWithinPartitions("kmer", "rec_id", "pos")
    return spread.select("kmer", "cnt", "seed_seq", "left", "right").mapInArrow(run, "kmer long, cnt long, seq string, support int, occurrences int, tandem boolean")


def _seed_set(seq: str, seed: SpacedSeed) -> np.ndarray:
    return np.unique(packed_seeds(CODE[np.frombuffer(seq.encode(), np.uint8)], seed, "canonical")[1])


def _near_covered(kmer: int, covered: np.ndarray, weight: int) -> bool:
    """Whether the seed or its reverse complement is within NEAR substitutions of a covered one."""
    rc, x = 0, kmer
    for _ in range(weight):
        rc, x = (rc << 2) | (3 - (x & 3)), x >> 2
    for v in (kmer, rc):
        d = covered ^ np.uint64(v)
        if len(d) and int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).min()) <= NEAR:
            return True
    return False


def _reversed(x: np.ndarray, weight: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(weight):
        out, x = (out << np.uint64(2)) | (np.uint64(3) - (x & np.uint64(3))), x >> np.uint64(2)
    return out


def near_any(kmers: np.ndarray, covered: np.ndarray, weight: int) -> np.ndarray:
    """Of each k-mer whether it or its reverse complement is within NEAR substitutions of a covered one.

    Of NEAR + 3 parts, near ones agree in three; so those are compared that agree in some three.
    """
    near = np.zeros(len(kmers), bool)
    cuts = [weight * i // (NEAR + 3) for i in range(NEAR + 4)]
    parts = [((1 << (2 * (b - a))) - 1) << (2 * a) for a, b in zip(cuts, cuts[1:])]
    for three in combinations(parts, 3):
        mask = np.uint64(sum(three))
        order = np.argsort(covered & mask)
        key, value = (covered & mask)[order], covered[order]
        left = np.flatnonzero(~near)
        for x in (kmers[left], _reversed(kmers[left], weight)):
            first = np.searchsorted(key, x & mask)
            n = np.searchsorted(key, x & mask, side="right") - first
            end = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + (1 << 20), side="right")))
                m = n[a:b]
                i = np.repeat(np.arange(a, b), m)
                d = x[i] ^ value[np.arange(len(i)) + np.repeat(first[a:b] - (np.cumsum(m) - m), m)]
                odd = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555))
                near[left[i[odd <= NEAR]]] = True
                a = b
    return near


class _Covered:
    """Seeds of the consensi so far, in the order they came."""

    def __init__(self, weight: int) -> None:
        self.weight, self.parts = weight, [np.empty(0, np.uint64)]

    def add(self, kmers: np.ndarray) -> None:
        self.parts.append(kmers)

    def far(self, kmers: np.ndarray, since: int = 0) -> np.ndarray:
        """Which k-mers aren't near those that came after the first `since`."""
        new = np.unique(np.concatenate(self.parts[since:] or [np.empty(0, np.uint64)]))
        return ~near_any(kmers, new, self.weight) if len(new) and len(kmers) else np.ones(len(kmers), bool)


def build_consensi(records: DataFrame, index: DataFrame, k: int | SpacedSeed = 18, min_seed_count: int = 20, max_families: int = 2000, seed_pool: int = 0, max_occ: int = 100, flank: int = 3000, band: int = 16, lookahead: int = 100, min_len: int = 50, min_support: int = 10, second_pass: bool = False, second_min_len: int = 80, second_min_support: int = 5, second_max_families: int = 500, size: int = 0) -> DataFrame:
    """id, consensus, seq, support, occurrences, seed_count, pass of the families found, in the order they were accepted.

    k: the index' seed, contiguous or spaced. Seeds are taken by falling count. One within two substitutions of an accepted
    consensus is skipped; an extension is kept if it is long enough, has enough support, is no tandem repeat, and less than
    60 % of its 12-mers are in the families so far. A second pass goes over the seeds left with relaxed limits. Seeds are
    extended in rounds (of `size`; 0: a few for each partition, growing to ROUND), within which the choice is made in order, so
    rounds change nothing but the work. The driver holds a stretch of the pool, the extensions of a round that may be kept, and the
    families, which max_families bounds. records are read several times in each round.
    """
    spark = records.sparkSession
    seed = SpacedSeed.contiguous(k) if isinstance(k, int) else k
    pool = stored(ranked_pool(stored(index.select("kmer", "cnt")), seed_pool or max(100, 20 * max_families), min_seed_count, seed.weight))
    free_shuffles(spark)
    records = records.select("rec_id", "seq")
    support = min(min_support, second_min_support) if second_pass else min_support
    least_kept = min(min_len, second_min_len) if second_pass else min_len
    grow = not size
    size = size or min(ROUND, 8 * shuffle_partitions(spark))
    twelve = SpacedSeed.contiguous(12)
    covered, covered12, kept = _Covered(seed.weight), np.zeros(4**12, bool), []
    grown: DataFrame | None = None
    tried, done = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def extensions(kmers: np.ndarray, found: DataFrame) -> dict:
        """The rows of extended, by k-mer; without seq if they can't be kept."""
        nonlocal grown, tried
        here = F.broadcast(_kmers(spark, kmers))
        rows = None if grown is None else grown.join(here, "kmer", "left_semi")
        todo = kmers[~np.isin(kmers, tried)] if second_pass else kmers
        if len(todo):
            places = found.join(F.broadcast(_kmers(spark, todo)), "kmer", "left_semi").toArrow()
            fresh = extended(flanks_of(records, places, seed.span, flank), seed.span, max_occ, flank, band, lookahead, support)
            may = (F.length("seq") >= least_kept) & (F.col("support") >= support) & ~F.col("tandem")
            fresh = fresh.withColumn("seq", F.when(may, F.col("seq")))
            if second_pass:
                fresh = checkpoint(fresh)
                tried = np.concatenate((tried, todo))
                grown = fresh if grown is None else grown.unionByName(fresh)
            rows = fresh if rows is None else rows.unionByName(fresh)
        return {r.kmer: r for r in rows.collect()}

    for number, (most, least_len, least_support) in enumerate([(max_families, min_len, min_support), (second_max_families, second_min_len, second_min_support)][: 1 + second_pass]):
        accepted = candidates = read = 0
        limit = max(100, 20 * most)
        kmers = cnt = np.empty(0, np.uint64)
        end = pool.agg(F.max("rank")).first()[0]
        end = -1 if end is None else end
        while accepted < most and candidates < limit and (len(kmers) or read <= end):
            if not len(kmers):
                head = pool.where((F.col("rank") >= read) & (F.col("rank") < read + HEAD)).select("rank", "kmer", "cnt").toArrow().sort_by("rank")
                read += HEAD
                kmers, cnt = head["kmer"].to_numpy().astype(np.uint64), head["cnt"].to_numpy()
                left = ~np.isin(kmers, done)
                left[left] = covered.far(kmers[left])
                kmers, cnt = kmers[left], cnt[left]
                continue
            n = np.minimum(cnt, max_occ)
            take = max(1, int(np.searchsorted(np.cumsum(n), PLACES, side="right")))
            line, n = kmers[:take], n[:take]
            counts = pd.DataFrame({"kmer": line.astype(np.int64), "cnt": cnt[:take].astype(np.int64)})
            kmers, cnt, since = kmers[take:], cnt[take:], len(covered.parts)
            found = stored(occurrences_of(records, line, seed, max_occ).join(F.broadcast(spark.createDataFrame(counts, "kmer long, cnt long")), "kmer"))
            while len(line) and accepted < most and candidates < limit:
                width = min(size, max(1, int(np.searchsorted(np.cumsum(n), ROUND_PLACES, side="right"))))
                rows, line, n = line[:width], line[width:], n[width:]
                known, before, first = extensions(rows, found), accepted, len(covered.parts)
                skipped = np.zeros(len(rows), bool)
                for i, kmer in enumerate(rows.tolist()):
                    if accepted >= most or candidates >= limit:
                        break
                    r = known.get(kmer)
                    if r is None or r.occurrences < least_support or skipped[i]:
                        continue
                    candidates += 1
                    if r.seq is None or len(r.seq) < least_len or r.support < least_support:
                        continue
                    k12 = _seed_set(r.seq, twelve)
                    if len(k12) and int(covered12[k12].sum()) * 10 >= len(k12) * 6:
                        continue
                    own = np.unique(np.append(_seed_set(r.seq, seed), np.uint64(kmer)))
                    done = np.append(done, np.uint64(kmer))
                    covered.add(own)
                    after = i + 1 + np.flatnonzero(~skipped[i + 1 :])
                    skipped[after] = near_any(rows[after], own, seed.weight)
                    covered12[k12] = True
                    accepted += 1
                    kept.append((len(kept) + 1, f"fam_{len(kept) + 1:05d}", r.seq, r.support, r.occurrences, r.cnt, number + 1))
                if grow and 8 * (accepted - before) < len(rows) < ROUND:  # few of them were alike: larger rounds waste little
                    size = min(ROUND, 2 * size)
                left = covered.far(line, first)
                line, n = line[left], n[left]
            left = covered.far(kmers, since)
            kmers, cnt = kmers[left], cnt[left]
            free_shuffles(spark)
    return spark.createDataFrame(kept, "id int, consensus string, seq string, support int, occurrences int, seed_count long, pass int")


def _kmers(spark, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"kmer": values.astype(np.int64)}), "kmer long")


def redundancy(seqs: DataFrame, k: int = 12) -> DataFrame:
    """rec_id, kmers, shared, redundant of sequences in the order of rank: how many of a sequence's k-mers stand in one of a
    lower rank; redundant from 60 % on. seqs: rec_id, rank, seq."""
    own = seeds(seqs, k).select("rec_id", "kmer").distinct().join(seqs.select("rec_id", "rank"), "rec_id")
    first = own.groupBy("kmer").agg(F.min("rank").alias("_first"))
    out = own.join(first, "kmer").groupBy("rec_id").agg(F.count("*").alias("kmers"), F.sum((F.col("_first") < F.col("rank")).cast("long")).alias("shared"))
    return out.withColumn("redundant", F.col("shared") * 10 >= F.col("kmers") * 6)


def majority_consensus(copies: DataFrame, most: int = 30, shift: int = 20, min_len: int = 100, max_n: float = 0.3) -> DataFrame:
    """family, copies, seq: column-wise majority of a family's longest copies, each shifted ungapped by up to `shift` to agree
    best with the longest. copies: family, copy_id, seq. Copies shorter than min_len or with more than max_n N are left
    out; ties of a column go to the base seen first. At most `most` copies of a family get into its task."""
    good = copies.where(F.col("family").isNotNull() & (F.length("seq") >= min_len) & ((F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit("N"), F.lit("")))) <= max_n * F.length("seq")))
    top = good.withColumn("_n", F.row_number().over(W.partitionBy("family").orderBy(F.desc(F.length("seq")), "copy_id"))).where(F.col("_n") <= most)

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = [np.frombuffer(x.upper().encode(), np.uint8) for x in pdf.sort_values("_n")["seq"]]
        base = seqs[0]
        votes = np.zeros((len(base), 256), np.int64)
        order = np.full((len(base), 256), len(seqs))
        for i, s in enumerate(seqs):
            best, at = -1, 0
            for d in range(-shift, shift + 1):
                lo, hi = max(0, d), min(len(base), len(s) + d)
                same = int((base[lo:hi] == s[lo - d : hi - d]).sum()) if hi > lo else -1
                if same > best:
                    best, at = same, d
            lo, hi = max(0, at), min(len(base), len(s) + at)
            where = np.arange(lo, hi)
            votes[where, s[lo - at : hi - at]] += 1
            order[where, s[lo - at : hi - at]] = np.minimum(order[where, s[lo - at : hi - at]], i)
        letters = np.frombuffer(b"ACGT", np.uint8)
        v, o = votes[:, letters], order[:, letters]
        seq = letters[(v * (len(seqs) + 1) - o).argmax(1)].tobytes().decode()
        return pd.DataFrame({"family": [pdf["family"].iloc[0]], "copies": [len(seqs)], "seq": [seq]})

    return top.groupBy("family").applyInPandas(vote, "family string, copies int, seq string")


__all__ = ["build_consensi", "extend", "is_tandem", "kmer_text", "majority_consensus", "occurrences", "redundancy", "top_seeds"]
