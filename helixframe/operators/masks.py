"""Repeat masks: from counted seeds to masked regions.

Regions have the columns rec_id, start_pos, end_pos (and name where layers give one). Positions of a record are linked by
windows over (rec_id, pos); only windows that passed the count filter get there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.seq import SpacedSeed
from helixframe.operators.chunks import chunk_records
from helixframe.operators.graph import connected_components
from helixframe.operators.intervals import link_gaps, set_runs, with_halo
from helixframe.operators.kmers import CODE, codes_of, count_seeds, in_batches, look_up, neighbours, packed_seeds, seed_counts, seeds
from helixframe.operators.tiles import SEQUENCE, merge_runs, union_intervals

RUN_SCHEMA = "rec_id long, start_pos long, end_pos long"


#: Records up to this length are counted, and their tandem runs found, where they are read; longer ones by shuffles.
WHOLE = 1 << 22
#: Letters that a kernel handles at once, and of the pieces in which records are masked and compared.
PIECE, CHUNK = 1 << 18, 1 << 16


def _near_in(kmers: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers within one substitution of the given ones, themselves included, in order."""
    near = np.concatenate([(kmers & ~np.uint64(3 << (2 * i))) | np.uint64(b << (2 * i)) for i in range(k) for b in range(4)] or [kmers])
    rc, x = np.zeros(len(near), np.uint64), near.copy()
    for _ in range(k):
        rc = (rc << np.uint64(2)) | (np.uint64(3) - (x & np.uint64(3)))
        x >>= np.uint64(2)
    return np.unique(np.minimum(near, rc))


def _frequent_of(codes: np.ndarray, k: int, threshold: int, mismatch: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, k-mers and counts (-1 for those that are near only) of the frequent windows of a coded sequence, in order."""
    pos, kmer = packed_seeds(codes, SpacedSeed.contiguous(k), "canonical")
    _, back, n = np.unique(kmer, return_inverse=True, return_counts=True)
    count = n[back]
    keep = count >= threshold
    if mismatch and keep.any():
        near = np.isin(kmer, _near_in(np.unique(kmer[keep]), k))
        count, keep = np.where(keep, count, -1), near
    return pos[keep], kmer[keep], count[keep]


def _regions_in_record(records: DataFrame, k: int, threshold: int, mismatch: bool, regions) -> DataFrame:
    """regions(places of frequent windows, length) of each record of bounded length: starts and ends of its regions."""
    out = pa.schema([("rec_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                codes = codes_of(seq)
                yield rec, *regions(_frequent_of(codes, k, threshold, mismatch)[0], len(codes))

    return records.select(F.col("rec_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(each(batches), out), RUN_SCHEMA)


def _frequent_in_record(records: DataFrame, k: int, threshold: int, mismatch: bool = False) -> DataFrame:
    """frequent_positions of records of bounded length, counted where they are: nothing is shuffled."""
    out = pa.schema([("rec_id", pa.int64()), ("pos", pa.int64()), ("kmer", pa.int64()), ("cnt", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                pos, kmer, count = _frequent_of(codes_of(seq), k, threshold, mismatch)
                yield rec, pos, kmer.view(np.int64), count

    found = records.select(F.col("rec_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(each(batches), out), "rec_id long, pos long, kmer long, cnt long")
    return found.withColumn("cnt", F.expr("nullif(cnt, -1)")) if mismatch else found


def by_length(records: DataFrame, short, long, whole: int) -> DataFrame:
    """short(records up to `whole` letters) and long(longer records) in one table; rows with a null sequence are left out."""
    return short(records.where(F.length("seq") <= whole)).unionByName(long(records.where(F.length("seq") > whole)))


def frequent_positions(records: DataFrame, k: int, threshold: int, mismatch: bool = False, scope: str = "record", whole: int = WHOLE) -> DataFrame:
    """rec_id, pos, kmer, cnt of the windows whose canonical k-mer occurs at least threshold times.

    scope: counts within the record or in all records ('genome'). mismatch: windows one substitution from such a k-mer
    count too (cnt is then null where the k-mer itself is rarer). The set of frequent k-mers is expanded once, not
    every window, since being near is mutual. whole: longest record that is counted where it is read.
    """
    if scope == "record":
        return by_length(records, lambda r: _frequent_in_record(r, k, threshold, mismatch), lambda r: _frequent_by_join(r, k, threshold, mismatch, ["rec_id"]), whole)
    if not mismatch:
        # counted first, so that only frequent positions leave the tasks that read the records
        return look_up(records, k, seed_counts(records, k).where(F.col("cnt") >= threshold))
    return _frequent_by_join(records, k, threshold, mismatch, [])


def _frequent_by_join(records: DataFrame, k: int, threshold: int, mismatch: bool, by: list[str]) -> DataFrame:
    rows = seeds(records, k)
    high = count_seeds(rows, by).where(F.col("cnt") >= threshold)
    if not mismatch:
        return rows.join(high, [*by, "kmer"]).select("rec_id", "pos", "kmer", "cnt")
    near = neighbours(high, k, 1, itself=True)
    wide = high.select(*by, "kmer").join(near, "kmer").select(*by, F.col("near").alias("kmer")).distinct()
    return rows.join(wide, [*by, "kmer"], "left_semi").join(high, [*by, "kmer"], "left").select("rec_id", "pos", "kmer", "cnt")


def mask_graph(records: DataFrame, k: int = 21, threshold: int = 3, gap: int = 100, min_len: int = 30, mismatch: bool = False, scope: str = "record", inclusive_end: bool = False, whole: int = WHOLE) -> DataFrame:
    """Chains of frequent k-mers that start no further than gap apart. The last base of the last k-mer stays outside
    unless inclusive_end is set."""
    more = k - (0 if inclusive_end else 1)

    def linked(rows: DataFrame, longest: int) -> DataFrame:
        chains = link_gaps(frequent_positions(rows, k, threshold, mismatch, scope, longest), ["rec_id"], "pos", gap)
        out = chains.select("rec_id", F.col("first").alias("start_pos"), (F.col("last") + more).alias("end_pos"))
        return out.where(F.col("end_pos") - F.col("start_pos") >= min_len)

    def chained(pos: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(([True], pos[1:] > pos[:-1] + gap))[: len(pos)]
        start, end = pos[new], pos[np.concatenate((new[1:], [True]))[: len(pos)]] + more
        keep = end - start >= min_len
        return start[keep], end[keep]

    if scope != "record":
        return linked(records, whole)
    return by_length(records, lambda r: _regions_in_record(r, k, threshold, mismatch, chained), lambda r: linked(r, 0), whole)


def mask_windows(records: DataFrame, k: int = 21, threshold: int = 3, window: int = 40, density: float = 0.25, min_len: int = 30, mismatch: bool = False, whole: int = WHOLE) -> DataFrame:
    """Union of the windows in which at least a share `density` of the k-mer starts are frequent.

    Windows begin at 0 to length - window; windows without a frequent k-mer never pass, so density must be above 0 and
    the window at least k.
    """
    if window < k or not 0 < density <= 1:
        raise ValueError("window must be at least k, density above 0 and at most 1")
    starts = window - k + 1
    least = math.ceil(starts * density)

    def dense(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        to = pos[least - 1 :]
        at = pos[: len(to)]
        close = to - at < starts
        first, last = np.maximum(0, to[close] - starts + 1), np.minimum(at[close], length - window)
        first, last = first[last >= first], last[last >= first]
        if not len(first):
            return first, last
        _, start, end = merge_runs(np.zeros(len(first), np.int64), first, last + window)
        keep = end - start >= min_len
        return start[keep], end[keep]

    return by_length(records, lambda r: _regions_in_record(r, k, threshold, mismatch, dense), lambda r: _dense_by_tile(r, k, threshold, mismatch, window, starts, least, min_len), whole)


def _dense_by_tile(records: DataFrame, k: int, threshold: int, mismatch: bool, window: int, starts: int, least: int, min_len: int) -> DataFrame:
    """mask_windows of long records, by windows over tiles of their positions."""
    high = frequent_positions(records, k, threshold, mismatch, whole=0).select("rec_id", "pos").distinct()
    # in order of position: the least-th frequent start from one on lies within the window's starts
    w = W.partitionBy("rec_id", "_tile").orderBy("pos")
    far = with_halo(high, "pos", starts).withColumn("_to", F.lead("pos", least - 1).over(w)).where(F.col("_own") & (F.col("_to") - F.col("pos") < starts))
    size = records.select("rec_id", (F.length("seq") - window).alias("_most"))
    spans = far.join(size, "rec_id").where("_most >= 0").select("rec_id", F.greatest(F.lit(0), F.col("_to") - starts + 1).alias("start_pos"), F.least(F.col("pos"), F.col("_most")).alias("_last")).where("_last >= start_pos")
    regions = union_intervals(spans.withColumn("end_pos", F.col("_last") + window), ["rec_id"], limit=SEQUENCE)
    return regions.where(F.col("end_pos") - F.col("start_pos") >= min_len)


def mask_multi_k(records: DataFrame, ks: list[int], threshold: int = 3, gap: int = 100, min_len: int = 30) -> DataFrame:
    """Union over several k of their regions, each and all at least min_len long."""
    parts = [mask_graph(records, k, threshold, gap, min_len) for k in ks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return union_intervals(whole, ["rec_id"], limit=SEQUENCE).where(F.col("end_pos") - F.col("start_pos") >= min_len)


def mask_components(records: DataFrame, k: int = 21, threshold: int = 3, least: int = 0, min_len: int = 30) -> DataFrame:
    """Regions of the frequent k-mers whose component of the overlap graph is abundant.

    K-mers at successive positions of a record are connected; a component stays if its distinct k-mers' counts add up to
    `least` (0: the larger of 20 and 5 times the threshold). Whole k-mers are masked; touching runs merge.
    """
    least = least or max(20, 5 * threshold)
    high = frequent_positions(records, k, threshold).withColumn("node", F.xxhash64("rec_id", "kmer"))
    w = W.partitionBy("rec_id", "_tile").orderBy("pos")
    edges = with_halo(high, "pos", 1).withColumns({"_p": F.lead("pos").over(w), "_n": F.lead("node").over(w)}).where("_own").select(F.col("node").alias("src"), F.when(F.col("_p") == F.col("pos") + 1, F.col("_n")).otherwise(F.col("node")).alias("dst")).distinct()
    comp = connected_components(edges)
    size = high.select("node", "cnt").distinct().join(comp, "node").groupBy("component").agg(F.sum("cnt").alias("total")).where(F.col("total") >= least)
    kept = high.join(comp.join(size, "component", "left_semi"), "node").select("rec_id", F.col("pos").alias("start_pos"), (F.col("pos") + k).alias("end_pos"))
    return union_intervals(kept, ["rec_id"], limit=SEQUENCE).where(F.col("end_pos") - F.col("start_pos") >= min_len)


def index_hits(seed_rows: DataFrame, index: DataFrame, span: int, low: int, high: int) -> DataFrame:
    """rec_id, pos, stop, strong: windows whose seed's count in the index is at least low; strong from high on.

    An absent seed is no hit, which says nothing about it if the index is sampled. Spark broadcasts an index below its
    own size limit and shuffles both sides otherwise.
    """
    high = max(1, high)
    low = min(max(1, low), high)
    return seed_rows.join(index.where(F.col("cnt") >= low), "kmer").select("rec_id", "pos", (F.col("pos") + span).alias("stop"), (F.col("cnt") >= high).alias("strong"))


def mask_indexed(records: DataFrame, index: DataFrame, seed: SpacedSeed | int, sample: int = 1, low: int = 3, high: int = 3) -> DataFrame:
    """The hits (see index_hits) of records in an index (kmer, cnt) of seeds of which one in `sample` was kept.

    Only seeds that the sample would have kept are looked up; of a sampled index, an absent seed among them is rare, and one
    that isn't among them says nothing.
    """
    high = max(1, high)
    low = min(max(1, low), high)
    span = seed if isinstance(seed, int) else seed.span
    found = look_up(records, seed, index.where(F.col("cnt") >= low), sample)
    return found.select("rec_id", "pos", (F.col("pos") + span).alias("stop"), (F.col("cnt") >= high).alias("strong"))


def link_hits(hits: DataFrame, gap: int = 150, min_len: int = 30, min_hits: int = 1, min_density: float = 0.0) -> DataFrame:
    """Hysteresis: chains of hits whose starts are no further than gap apart, with at least one strong hit, min_hits hits
    and min_density hits a base. Chains aren't merged after, so they may overlap if the gap is below the span."""
    c = link_gaps(hits, ["rec_id"], "pos", gap, end_pos=("max", F.col("stop")), _strong=("max", F.col("strong")), hits=("sum", F.lit(1).cast("long")))
    length = F.col("end_pos") - F.col("first")
    return c.where(F.col("_strong") & (length >= min_len) & (F.col("hits") >= min_hits) & (F.col("hits") >= length * min_density)).select("rec_id", F.col("first").alias("start_pos"), "end_pos", "hits")


def _links(codes: np.ndarray, k: int, max_period: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the windows whose k-mer last stood at most max_period before, in order of place."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, val = packed_seeds(codes, SpacedSeed.contiguous(k), "forward")
    order = np.argsort(val, kind="stable")
    back = np.zeros(len(pos), np.int64)
    sorted_pos, same = pos[order], val[order][1:] == val[order][:-1]
    back[order[1:][same]] = (sorted_pos[1:] - sorted_pos[:-1])[same]
    keep = (back > 0) & (back <= max_period)
    return pos[keep], back[keep]


def tandem_links(records: DataFrame, k: int = 5, max_period: int = 500) -> DataFrame:
    """rec_id, pos, period: windows whose forward k-mer last stood `period` bases before, at most max_period."""
    out = pa.schema([("rec_id", pa.int64()), ("pos", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                codes = codes_of(seq)
                for off in range(0, max(1, len(codes) - k + 1), WHOLE):
                    lead = min(off, max_period)  # what a link may reach back to
                    pos, period = _links(codes[off - lead : off + WHOLE + k - 1], k, max_period)
                    own = pos >= lead
                    yield rec, pos[own] + off - lead, period[own]

    return records.where("seq IS NOT NULL").select(F.col("rec_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(each(batches), out), "rec_id long, pos long, period long")


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def _runs_in_record(records: DataFrame, k: int, max_period: int, min_len: int, density: float, identity: float) -> DataFrame:
    """tandem_runs of records of bounded length, linked and tested where they are."""
    out = pa.schema([(c, pa.int64()) for c in ("rec_id", "period", "start_pos", "end_pos", "matches")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                pos, period = _links(codes_of(seq), k, max_period)
                order = np.lexsort((pos, period))
                pos, period = pos[order], period[order]
                at = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (pos[1:] > pos[:-1] + period[1:] + k)))[: len(pos)])
                if not len(at):
                    continue
                n = np.diff(np.concatenate((at, [len(pos)])))
                d, start, end = period[at], pos[at] - period[at], pos[at + n - 1] + k
                size = end - start
                keep = (size >= min_len) & (size >= 2 * d) & (n >= density * np.maximum(1, size - d))
                if identity > 0:
                    data = _UPPER[np.frombuffer(seq.as_buffer(), np.uint8)]
                    for i in np.flatnonzero(keep):
                        keep[i] = periodic_identity(data[start[i] : end[i]], int(d[i])) >= identity
                yield rec, d[keep], start[keep], end[keep], n[keep]

    return records.select(F.col("rec_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(each(batches), out), "rec_id long, period long, start_pos long, end_pos long, matches long")


def tandem_runs(records: DataFrame, k: int = 5, max_period: int = 500, min_len: int = 20, density: float = 0.25, identity: float = 0.0, whole: int = WHOLE) -> DataFrame:
    """rec_id, period, start_pos, end_pos, matches: runs of one period, of which a share `identity` of the bases after the first
    period is equal to the one a period before (0: not tested).

    A run goes on while the next link of its period is at most period + k further; it covers at least min_len bases and two
    periods, and links on a share `density` of its bases after the first period.
    """

    def linked(long: DataFrame) -> DataFrame:
        w = W.partitionBy("rec_id", "period").orderBy("pos")
        far = F.coalesce(F.col("pos") > F.lag("pos").over(w) + F.col("period") + k, F.lit(True))
        runs = tandem_links(long, k, max_period).withColumn("_r", F.sum(far.cast("long")).over(w)).groupBy("rec_id", "period", "_r").agg((F.min("pos") - F.first("period")).alias("start_pos"), (F.max("pos") + k).alias("end_pos"), F.count("*").alias("matches")).drop("_r")
        length = F.col("end_pos") - F.col("start_pos")
        runs = runs.where((length >= min_len) & (length >= 2 * F.col("period")) & (F.col("matches") >= density * F.greatest(F.lit(1), length - F.col("period"))))
        return _with_identity(runs, long, max_period, identity) if identity > 0 else runs

    return by_length(records, lambda r: _runs_in_record(r, k, max_period, min_len, density, identity), linked, whole)


def _with_identity(runs: DataFrame, records: DataFrame, max_period: int, identity: float) -> DataFrame:
    """The runs with enough equal bases, which are counted in pieces of the records."""
    pieces = chunk_records(records, CHUNK, before=max_period).select("rec_id", "chunk_no", "off", F.upper("s").alias("s"))
    at = F.explode(F.sequence(F.expr(f"(start_pos + period) DIV {CHUNK}"), F.expr(f"(end_pos - 1) DIV {CHUNK}")))

    @F.pandas_udf("long")
    def equal(s, off, period, start, end):
        import pandas as pd

        out = []
        for text, o, p, a, b in zip(s, off, period, start, end):
            x = np.frombuffer(text.encode(), np.uint8)
            out.append(int((x[a - o : b - o] == x[a - o - p : b - o - p]).sum()))
        return pd.Series(out, dtype="int64")

    cut = runs.where("end_pos > start_pos + period").withColumn("chunk_no", at).join(pieces, ["rec_id", "chunk_no"])
    n = equal("s", "off", "period", F.greatest(F.col("start_pos") + F.col("period"), F.col("chunk_no") * CHUNK), F.least("end_pos", (F.col("chunk_no") + 1) * CHUNK))
    key = ["rec_id", "period", "start_pos", "end_pos", "matches"]
    return cut.withColumn("_n", n).groupBy(*key).agg(F.sum("_n").alias("_n")).where(F.col("_n") / (F.col("end_pos") - F.col("start_pos") - F.col("period")) >= identity).drop("_n")


def periodic_identity(codes: np.ndarray, period: int) -> float:
    """Share of bases equal to the one a period before; 0 where there is none."""
    n = len(codes) - period
    return float((codes[period:] == codes[:-period]).mean()) if n > 0 else 0.0


def mask_tandem(records: DataFrame, k: int = 5, max_period: int = 500, min_len: int = 20, density: float = 0.25, identity: float = 0.7, whole: int = WHOLE) -> DataFrame:
    """rec_id, start_pos, end_pos, period, matches of tandem runs whose bases agree with those a period before."""
    k = min(max(k, 4), 8)
    return tandem_runs(records, k, max_period, min_len, density, identity, whole).select("rec_id", "start_pos", "end_pos", "period", "matches")


def low_complexity_scores(codes: np.ndarray, window: int) -> np.ndarray:
    """Twice the pair count of equal triplets in each window, -1 where a triplet has other letters.

    Each triplet's count moves by one as the window moves, so the pair counts are kept by adding differences: a triplet at
    t makes a pair with each earlier equal one less than a window of triplets away.
    """
    n, l = len(codes) - 2, window - 2
    if n < l:
        return np.empty(0, np.int64)
    bad = codes > 3
    c = (codes & 3).astype(np.int64)
    tri = (c[:-2] << 4) | (c[1:-1] << 2) | c[2:]
    wrong = np.concatenate(([0], np.cumsum(bad[:-2] | bad[1:-1] | bad[2:])))
    counts = np.zeros(n - l + 1, np.int64)
    for t in range(64):
        hit = np.concatenate(([0], np.cumsum(tri == t)))
        m = hit[l:] - hit[: n - l + 1]
        counts += m * (m - 1)
    counts[wrong[l:] != wrong[: n - l + 1]] = -1
    return counts


def dust_windows(records: DataFrame, window: int = 64, threshold: float = 5.0) -> DataFrame:
    """rec_id, start_pos, pairs: windows with a score above the threshold; pairs is the sum of c(c-1)/2 over triplets.

    The score is pairs / (triplets - 1), the window holding window - 2 triplets; windows with other letters have none.
    """
    if window < 4:
        raise ValueError("window must be at least 4")
    out = pa.schema([("rec_id", pa.int64()), ("start_pos", pa.int64()), ("pairs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                codes = codes_of(seq)
                for off in range(0, max(1, len(codes) - window + 1), PIECE):
                    score = low_complexity_scores(codes[off : off + PIECE + window - 1], window)
                    at = np.flatnonzero(score > 2 * threshold * (window - 3))
                    yield rec, at + off, score[at] // 2

    return records.where("seq IS NOT NULL").select(F.col("rec_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(run(batches), out), "rec_id long, start_pos long, pairs long")


def mask_dust(records: DataFrame, window: int = 64, threshold: float = 5.0) -> DataFrame:
    """Union of the low-complexity windows."""
    w = dust_windows(records, window, threshold).withColumn("end_pos", F.col("start_pos") + window)
    return union_intervals(w, ["rec_id"], limit=SEQUENCE)


def case_runs(records: DataFrame, kind: str = "lower") -> DataFrame:
    """rec_id, start_pos, end_pos: runs of lower-case letters, of letters other than A, C, G, T ('other'), or of what a soft
    mask counts as masked: everything but upper-case A, C, G, T ('masked')."""
    upper = np.zeros(256, bool)
    upper[[ord(c) for c in "ACGT"]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rec, seq in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(seq.as_buffer(), np.uint8)
                on = (data >= 97) & (data <= 122) if kind == "lower" else CODE[data] > 3 if kind == "other" else ~upper[data]
                edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), rec)), pa.array(start), pa.array(end)], names=["rec_id", "start_pos", "end_pos"])

    return records.where("seq IS NOT NULL").select(F.col("rec_id").cast("long"), "seq").mapInArrow(run, RUN_SCHEMA)


def apply_mask(records: DataFrame, regions: DataFrame, how: str = "soft", chunk: int = CHUNK) -> DataFrame:
    """rec_id, seq with the regions in lower case ('soft') or as N ('hard'); other letters keep their case.

    Records are masked in pieces, each with the merged regions that lie in it, and put together at the end; parts of
    regions beyond the sequence are cut off. Each row of records is masked by itself, also where an id is repeated;
    null sequences stay null.
    """
    rows = records.select("rec_id", "seq").withColumn("_row", F.monotonically_increasing_id())
    pieces = chunk_records(rows, chunk, more=["_row"])
    merged = union_intervals(regions, ["rec_id"], limit=SEQUENCE)
    cut = merged.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"start_pos DIV {chunk}"), F.expr(f"(end_pos - 1) DIV {chunk}"))))
    inside = F.struct((F.greatest("start_pos", F.col("chunk_no") * chunk) - F.col("chunk_no") * chunk).alias("a"), (F.least("end_pos", (F.col("chunk_no") + 1) * chunk) - F.col("chunk_no") * chunk).alias("b"))
    # disjoint regions of one piece: at most half its length
    lists = cut.groupBy("rec_id", "chunk_no").agg(F.collect_list(inside["a"]).alias("_a"), F.collect_list(inside["b"]).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, starts, ends in zip(b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist()):
                data = np.frombuffer(s.as_buffer(), np.uint8).copy()
                for x, y in zip(starts or (), ends or ()):
                    part = data[x:y]
                    if how == "soft":
                        part[(part >= 65) & (part <= 90)] += 32
                    else:
                        part[:] = 78
                out.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary()).cast(pa.string())], names=["rec_id", "_row", "chunk_no", "s"])

    masked = pieces.join(lists, ["rec_id", "chunk_no"], "left").select("rec_id", "_row", "chunk_no", "s", "_a", "_b")
    keyed = masked.mapInArrow(run, f"rec_id {records.schema['rec_id'].dataType.simpleString()}, _row long, chunk_no long, s string")
    whole = keyed.groupBy("_row", "rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "s"))), lambda x: x["s"]), "").alias("seq")).select("rec_id", "seq")
    return whole.unionByName(records.where("seq IS NULL").select("rec_id", "seq"))


def compare_masks(reference: DataFrame, predicted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_id, tp, fp, fn, tn by base: the reference counts everything but upper-case A, C, G, T as masked, the prediction
    lower-case letters; the shorter length counts. Every predicted record needs a reference record, else an error.
    Both are compared in pieces. Each table has one row an id; null sequences compare with nothing."""
    missing = predicted.join(reference, "rec_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("a predicted record has no reference record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.zeros(256, bool)
        upper[[ord(c) for c in "ACGT"]] = True
        for b in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for rec, r, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                r, p = (np.frombuffer(x.as_buffer(), np.uint8) for x in (r, p))
                n = min(len(r), len(p))
                m, q = ~upper[r[:n]], (p[:n] >= 97) & (p[:n] <= 122)
                out.append((rec, int((m & q).sum()), int((~m & q).sum()), int((m & ~q).sum()), int((~m & ~q).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["rec_id", "tp", "fp", "fn", "tn"])

    side = lambda df, name: chunk_records(df.select(F.col("rec_id").cast("long").alias("rec_id"), "seq"), chunk).select("rec_id", "chunk_no", F.col("s").alias(name))
    both = side(predicted, "p").join(side(reference, "r"), ["rec_id", "chunk_no"])
    counts = both.select("rec_id", "r", "p").mapInArrow(run, "rec_id long, tp long, fp long, fn long, tn long")
    return counts.groupBy("rec_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


__all__ = ["apply_mask", "case_runs", "compare_masks", "dust_windows", "frequent_positions", "index_hits", "link_hits", "mask_components", "mask_dust", "mask_graph", "mask_indexed", "mask_multi_k", "mask_tandem", "mask_windows", "set_runs", "tandem_runs"]
