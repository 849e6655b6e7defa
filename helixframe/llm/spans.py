"""Long exact spans shared between records, by relative Lempel-Ziv parsing against indexed reference blocks.

The records are their own reference. A window of SPAN letters has an anchor: the smallest hashed seed in it, the leftmost
of equal ones. Neighbouring windows with one anchor are a stretch, at most LONGEST letters. Equal windows have equal
anchors at equal places, so all that can match a stretch are the stretches of its anchor: they are its reference block, and
shuffling stretches by anchor brings each record to the blocks it may match and to no others.

A task parses its blocks greedily from left to right (`parse`). The index of a block is, for each place relative to the
anchor, its windows in groups of equal letters, each group in the order of the text that follows. A stretch is parsed from
its first window: where the window stands under another record too, the longest match there is the better neighbour of
another record in that order, and becomes a factor; parsing goes on with the first window that reaches over the
factor's end, so that no span is lost at a boundary; elsewhere it goes on with the next window. Factors have SPAN letters
or more, and a source. Letters are compared, two bits each, not hashes.

Blocks are spread by hash of the anchor. The few anchors with too large a share of all stretches (their number is bounded
by that of the tasks) are matched window by window instead, with partial aggregation, and give factors of SPAN letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.tiles import SEQUENCE, union_intervals
from helixframe.runtime import checkpoint, shuffle_partitions, spread

SPAN = 64
#: Letters of an anchor: five bytes.
SEED = 20
REACH = SPAN - SEED + 1  # seeds in a window, and most windows of a stretch
LONGEST = SPAN + REACH - 1
#: Letters that are scanned at once.
PIECE = 1 << 21
#: An anchor with fewer stretches is never hot.
HOT_ROWS = 10_000
#: Stretches that leave a task at once, and that are parsed at once (an anchor's stretches always together).
BATCH_ROWS = 20_000
BLOCK_ROWS = 50_000

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODE[[ord(c) for c in _pair]] = _i

STRETCHES = "rec_id long, place long, bases binary"
FACTORS = "rec_id long, start_pos long, end_pos long, source_rec long, source_start long"
_FRONT, _BACK = 64, 128  # padding, so that words at any place can be read
_RIGHT, _LEFT = 32, 16  # bytes of a stretch from its anchor on, and before it


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def stretches(codes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor's place of each stretch, and each 32 letters from FRONT before codes on as a word.

    codes: at most PIECE + SPAN letters of records one after another; heads: where a record begins. Windows with other
    letters or of two records are left out.
    """
    n = len(codes) - SPAN + 1
    bad = np.concatenate(([0], np.cumsum(codes > 3, dtype=np.int32)))
    valid = bad[SPAN:] == bad[:n]
    over = np.zeros(n + 1, np.int32)
    np.add.at(over, np.clip(heads - SPAN + 1, 0, n), 1)
    np.add.at(over, np.clip(heads, 0, n), -1)
    valid &= np.cumsum(over)[:n] == 0
    p1 = np.concatenate((np.zeros(_FRONT, np.uint8), codes & 3, np.zeros(_BACK, np.uint8)))
    p2 = (p1[:-1] << 2) | p1[1:]
    p4 = (p2[:-2] << 4) | p2[2:]
    p8 = (p4[:-4].astype(np.uint16) << 8) | p4[4:]
    p16 = (p8[:-8].astype(np.uint32) << 16) | p8[8:]
    words = (p16[:-16].astype(np.uint64) << np.uint64(32)) | p16[16:]
    m = len(codes) - SEED + 1
    h = (p16[_FRONT : _FRONT + m].astype(np.uint64) << np.uint64(8)) | p4[_FRONT + 16 : _FRONT + 16 + m]
    with np.errstate(over="ignore"):
        h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    # the place in the low bits makes the leftmost of equal hashes the smallest
    low = np.uint64((1 << 24) - 1)
    place = (_sliding_min((h & ~low) | np.arange(m, dtype=np.uint64), REACH)[:n] & low).astype(np.int64)
    first = valid & np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1]))
    start = np.flatnonzero(first)
    last = np.flatnonzero(valid & np.concatenate((first[1:] | ~valid[1:], [True])))
    return start, last - start + 1, place[start], words


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rec_id and start in the record of each stretch of a batch, and what `stretches` gives but its start, piece by piece."""
    seqs = b.column(1).cast(pa.large_string())
    ends = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(seqs.buffers()[2], np.uint8) if seqs.buffers()[2] else np.empty(0, np.uint8)
    rec = b.column(0).to_numpy()
    for off in range(int(ends[0]), int(ends[-1]) - SPAN + 1, PIECE):
        codes = _CODE[data[off : min(off + PIECE + SPAN - 1, int(ends[-1]))]]
        start, windows, place, words = stretches(codes, ends[(ends > off) & (ends < off + len(codes))] - off)
        row = np.searchsorted(ends, start + off, side="right") - 1
        yield rec[row], start + off - ends[row], windows, place, words, place - start


def _kept(windows: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a stretch's RIGHT + LEFT bytes are stored, and how many: letters from the anchor on, then those before it."""
    right, left = -(-(windows + SPAN - 1 - ahead) // 4), -(-ahead // 4)
    return np.concatenate((np.arange(_RIGHT) < right[:, None], np.arange(_LEFT) >= _LEFT - left[:, None]), 1), right + left


def _anchors(place: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words[_FRONT + place] >> np.uint64(64 - 2 * SEED)


def _stretch_rows(hot: np.ndarray, want_hot: bool):
    """Rows of STRETCHES of the anchors that are hot, or of all others, in batches of some ten thousand."""
    schema = pa.schema([("rec_id", pa.int64()), ("place", pa.int64()), ("bases", pa.binary())])

    def batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rec, place, size, flat = (np.concatenate(x) for x in zip(*held))
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(rec), pa.array(place), pa.Array.from_buffers(pa.binary(), len(rec), [None, ends, pa.py_buffer(flat)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            for rec, start, windows, place, words, ahead in _pieces(b):
                if len(hot):
                    keep = np.isin(_anchors(place, words), hot) == want_hot
                    rec, start, windows, place, ahead = (x[keep] for x in (rec, start, windows, place, ahead))
                for at in range(0, len(rec), BATCH_ROWS):
                    cut = slice(at, at + BATCH_ROWS)
                    base = _FRONT + place[cut, None]
                    raw = words[base + np.array([0, 32, 64, 96, -64, -32])].astype(">u8").view(np.uint8).reshape(-1, _RIGHT + _LEFT)
                    mask, size = _kept(windows[cut], ahead[cut])
                    held.append((rec[cut], (start[cut] << 12) | (ahead[cut] << 6) | windows[cut], size, raw[mask]))
                    n += len(raw)
                    if n >= BATCH_ROWS:
                        yield batch(held)
                        held, n = [], 0
        if held:
            yield batch(held)

    return run


def _decoded(b: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rec_id, start, windows, letters before the anchor, and six words: four from the anchor on, two before it."""
    place = b.column("place").to_numpy()
    start, ahead, windows = place >> 12, (place >> 6) & 63, place & 63
    bases = b.column("bases")
    bases = bases.combine_chunks() if isinstance(bases, pa.ChunkedArray) else bases
    ends = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset : bases.offset + len(bases) + 1]
    mask, _ = _kept(windows, ahead)
    raw = np.zeros(mask.shape, np.uint8)
    raw[mask] = np.frombuffer(bases.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return b.column("rec_id").to_numpy(), start, windows, ahead, raw.view(">u8").astype(np.uint64)


def _window_key(words: np.ndarray, before: int) -> list[np.ndarray]:
    """The letters of the window that begins `before` letters before the anchor, as four words."""
    after = SPAN - before
    top = lambda w, n: w & np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 2 * n)) & 0xFFFFFFFFFFFFFFFF) if n < 32 else w
    bottom = lambda w, n: w & np.uint64((1 << (2 * n)) - 1) if n < 32 else w
    return [top(words[:, 0], min(32, after)), top(words[:, 1], max(0, after - 32)), bottom(words[:, 5], min(32, before)), bottom(words[:, 4], max(0, before - 32))]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first letters the four words of either side have in common."""
    x = a ^ b
    word = (x != 0).argmax(1)
    x = np.take_along_axis(x, word[:, None], 1)[:, 0]
    high = x >> np.uint64(32)
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
    return np.where(x == 0, 4 * 32, 32 * word + (64 - bits) // 2)


def parse(rec: np.ndarray, start: np.ndarray, windows: np.ndarray, ahead: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Columns of FACTORS of whole blocks, parsed greedily by longest match in a record with another rec_id.

    The windows are taken place by place relative to the anchor, so all stretches go from left to right at once; done
    is the first window of each that isn't inside a factor yet.
    """
    done = np.zeros(len(rec), np.int64)
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 5]
    for before in range(int(ahead.max(initial=-1)), -1, -1):
        off = ahead - before
        rows = np.flatnonzero((off >= 0) & (off < windows))
        open_ = done[rows] <= off[rows]
        if not open_.any():
            continue
        key = _window_key(words[rows], before)
        with np.errstate(over="ignore"):
            h = key[0] * np.uint64(0x9E3779B97F4A7C15)
            for x in key[1:]:
                h = ((h ^ (h >> np.uint64(29))) + x) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        order = np.argsort(h)
        differs = lambda o: np.logical_or.reduce([x[o][1:] != x[o][:-1] for x in key])
        new = differs(order)
        if (new & (h[order][1:] == h[order][:-1])).any():  # two windows of one hash
            order = np.lexsort(key)
            new = differs(order)
        at = np.flatnonzero(np.concatenate(([True], new)))
        who = rec[rows[order]]
        want = (np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at)) & np.logical_or.reduceat(open_[order], at)
        if not want.any():
            continue
        size = np.diff(np.concatenate((at, [len(order)])))
        group = np.repeat(np.arange(len(at)), size)
        keep = want[group]
        member, group = order[keep], group[keep]
        text = words[rows[member], :4]
        by_text = np.lexsort((*(text[:, i] for i in (3, 2, 1, 0)), group))
        member, group, text = member[by_text], group[by_text], text[by_text]
        row = rows[member]
        who = rec[row]
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (who[1:] != who[:-1])))
        run = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(row)])) - 1
        ask = np.flatnonzero(open_[member])
        room = windows[row] - 1 - off[row]
        best, source = np.full(len(ask), -1), np.zeros(len(ask), np.int64)
        for other in (first[run[ask]] - 1, last[run[ask]] + 1):
            there = np.clip(other, 0, len(row) - 1)
            same = (other >= 0) & (other < len(row)) & (group[there] == group[ask])
            longer = np.minimum(np.minimum(_common(text[ask], text[there]) - (SPAN - before), room[ask]), room[there])
            longer = np.where(same, longer, -1)
            source = np.where(longer > best, there, source)
            best = np.maximum(best, longer)
        r, s = row[ask], row[source]
        done[r] = off[r] + best + 1
        out.append([rec[r], start[r] + off[r], start[r] + off[r] + SPAN + best, rec[s], start[s] + off[s]])
    return [np.concatenate(x) for x in zip(*out)]


def _parsed(held: pa.Table) -> pa.RecordBatch:
    rec, start, windows, ahead, words = _decoded(held)
    anchor = words[:, 0] >> np.uint64(64 - 2 * SEED)
    at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    several = np.repeat(np.minimum.reduceat(rec, at) != np.maximum.reduceat(rec, at), np.diff(np.concatenate((at, [len(anchor)]))))
    out = parse(*(x[several] for x in (rec, start, windows, ahead, words)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[c.split()[0] for c in FACTORS.split(", ")])


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    anchor = lambda x: x.as_py()[: SEED // 4]
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= BLOCK_ROWS and anchor(held[0].column(2)[0]) != anchor(b.column(2)[-1]):
            # sorted: all blocks before the last are whole
            whole = pa.Table.from_batches(held).combine_chunks()
            first = _decoded(whole)[4][:, 0] >> np.uint64(64 - 2 * SEED)
            split = int(np.searchsorted(first, first[-1]))
            yield _parsed(whole.slice(0, split))
            held, n = whole.slice(split).to_batches(), whole.num_rows - split
    if held:
        yield _parsed(pa.Table.from_batches(held))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w0, w1, rec_id, start_pos of each window of stretches."""
    for b in batches:
        rec, start, windows, ahead, words = _decoded(b)
        # letters in order: those before the anchor, then those from it on
        for before in range(int(ahead.max(initial=-1)), -1, -1):
            off = ahead - before
            row = np.flatnonzero((off >= 0) & (off < windows))
            r0, r1, l0, l1 = _window_key(words[row], before)
            s = np.uint64(2 * (before % 32))
            up = np.uint64(64) - s
            after = lambda x, y: (x >> s) | (y << up) if s else x
            if before < 32:
                w0, w1 = (after(r0, l0) if before else r0), (after(r1, r0) if before else r1)
            else:
                w0, w1 = (l1 << up) | (l0 >> s) if s else l0, (l0 << up) | (r0 >> s) if s else r0
            yield pa.RecordBatch.from_arrays([pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)), pa.array(rec[row]), pa.array(start[row] + off[row])], names=["w0", "w1", "rec_id", "start_pos"])


def _local_counts(tasks: int):
    """The anchors that hold more than their even share of a task's stretches several times over, and the task's total."""

    def merged(values: np.ndarray, counts: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, c = np.unique(np.concatenate(fresh), return_counts=True)
        if not len(values):
            return v, c
        order = np.argsort(both := np.concatenate((values, v)), kind="stable")
        at = np.flatnonzero(np.concatenate(([True], both[order][1:] != both[order][:-1])))
        return both[order][at], np.add.reduceat(np.concatenate((counts, c))[order], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values, counts, fresh, n = 0, np.empty(0, np.uint64), np.empty(0, np.int64), [np.empty(0, np.uint64)], 0
        for b in batches:
            for _, _, _, place, words, _ in _pieces(b):
                fresh.append(_anchors(place, words))
                n += len(place)
                rows += len(place)
                if n > 1_000_000:
                    values, counts = merged(values, counts, fresh)
                    fresh, n = [], 0
                if len(values) > 2_000_000:  # what is dropped here is too rare to be hot; it only decides where work is done
                    keep = counts > np.partition(counts, len(counts) // 2)[len(counts) // 2]
                    values, counts = values[keep], counts[keep]
        if fresh:
            values, counts = merged(values, counts, fresh)
        hot = counts >= max(2, rows // (16 * tasks))
        yield pa.RecordBatch.from_arrays([pa.array([None, *values[hot].tolist()], pa.int64()), pa.array([rows, *counts[hot].tolist()], pa.int64())], names=["anchor", "n"])

    return run


def hot_anchors(rows: DataFrame, least: int = HOT_ROWS) -> list[int]:
    """The anchors of blocks too large for one task: at least `least` stretches and 1/8 of an even task's share of all.

    There are at most eight times as many as tasks, whatever the data.
    """
    tasks = shuffle_partitions(rows.sparkSession)
    seen = checkpoint(rows.mapInArrow(_local_counts(tasks), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))  # read twice
    total = seen.where("anchor IS NULL").select(F.col("n").alias("total"))
    return [r.anchor for r in seen.where("anchor IS NOT NULL").join(F.broadcast(total), F.expr(f"n >= {int(least)} AND n * {8 * tasks} >= total")).select("anchor").collect()]


def shared_factors(records: DataFrame, rec_id: str = "rec_id", seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rec_id, start_pos, end_pos, source_rec, source_start: factors of SPAN letters A, C, G, T or more that together
    hold every such window that also stands, in the same direction, in a record with another rec_id, and one place of
    each there.

    Letter case is ignored; other letters never match. Repeated rows of one rec_id are one record, each parsed. Rows
    with a null rec_id or seq, and sequences shorter than SPAN, give nothing. A match that goes on beyond a stretch is
    given in several factors, which overlap.
    """
    rows = spread(records.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(seq).alias("seq"))).where(f"rec_id IS NOT NULL AND length(seq) >= {SPAN}")
    hot = np.array(sorted(hot_anchors(rows, hot_rows)), np.uint64)
    cold = rows.mapInArrow(_stretch_rows(hot, False), STRETCHES).repartition(F.substring("bases", 1, SEED // 4)).sortWithinPartitions("bases")
    out = cold.mapInArrow(_parse_blocks, FACTORS)
    if len(hot):
        windows = rows.mapInArrow(_stretch_rows(hot, True), STRETCHES).mapInArrow(_window_rows, "w0 long, w1 long, rec_id long, start_pos long")
        place = F.struct("rec_id", "start_pos")
        many = windows.groupBy("w0", "w1").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a.rec_id <> _b.rec_id")
        source = F.when(F.col("rec_id") == F.col("_a.rec_id"), F.col("_b")).otherwise(F.col("_a"))
        found = windows.join(many, ["w0", "w1"]).withColumn("_s", source)
        out = out.unionByName(found.select("rec_id", "start_pos", (F.col("start_pos") + SPAN).alias("end_pos"), F.col("_s.rec_id").alias("source_rec"), F.col("_s.start_pos").alias("source_start")))
    return out


def shared_spans(records: DataFrame, rec_id: str = "rec_id", seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rec_id, start_pos, end_pos: the maximal runs of bases under at least one factor, see shared_factors.

    Bases of a record given several times are shared if they are in any of its rows.
    """
    return union_intervals(shared_factors(records, rec_id, seq, hot_rows), ["rec_id"], limit=SEQUENCE)


def shared_share(records: DataFrame, spans: DataFrame, rec_id: str = "rec_id", seq: str = "seq") -> DataFrame:
    """rec_id, bases, shared, spans, shared_permille (rounded down) of every record; 0 for one that shares nothing.

    The length of a record given several times is the largest; a null or empty sequence has 0 bases and null permille.
    """
    size = records.where(F.col(rec_id).isNotNull()).groupBy(F.col(rec_id).cast("long").alias("rec_id")).agg(F.coalesce(F.max(F.length(seq)), F.lit(0)).cast("long").alias("bases"))
    of = spans.groupBy("rec_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"), F.count("*").alias("spans"))
    return size.join(of, "rec_id", "left").na.fill(0, ["shared", "spans"]).withColumn("shared_permille", F.when(F.col("bases") > 0, F.expr("shared * 1000 DIV bases")))
