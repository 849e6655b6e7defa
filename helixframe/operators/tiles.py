"""Union and complement of intervals by a reduction tree over tiles of the coordinate axis.

The state of the aggregate is a sorted list of disjoint intervals inside one tile of one key. Map tasks build such lists
from the rows they hold; a tile's lists are merged linearly after one shuffle. What lies inside a tile for good, its
periods and gaps but for the first and the last, leaves the tree there; the first and the last go up to a tile FAN times as
wide, and so on until one tile holds all. No task holds more of a key than one tile's list, which is no longer than half
the tile's width, or FAN children's first and last.

An interval over many tiles is cut to its two ends and, for the whole tiles between, a few blocks of tiles (a power of two
of them), which join the tree at the level they fit in; tiles and blocks inside a block have nothing to add and are
dropped. So a single interval of any length makes a few rows and changes no width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a map task gathers before it merges them into lists.
BUFFER_ROWS = 200_000
TILE = 1 << 17
#: Binary logarithm of how many tiles one of the next level holds, and of how many blocks one of the next size.
FAN, RADIX = 14, 7
#: An interval over more whole tiles than this is cut into blocks.
MOST_TILES = 64
#: Coordinates in a sequence are below this, as a text is no longer.
SEQUENCE = 1 << 31

PERIOD, GAP, UP = 0, 1, 2


def _order(group: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows by group, then start. Rows that are sorted lists one after another are merged linearly: the stable sort is a
    natural merge sort."""
    low, high = int(start.min()), int(start.max())
    span = high - low + 1
    if span * (int(group.max()) + 1) < 2**62:
        return np.argsort(group * span + (start - low), kind="stable")
    return np.lexsort((start, group))


def _runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of the maximal covered stretches of sorted intervals."""
    low = int(start.min())
    span = int(end.max()) - low + 2
    rank = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    if span * (int(rank[-1]) + 1) < 2**62:
        base = rank * span - low
        reach = np.maximum.accumulate(end + base)
        new = np.concatenate(([True], start[1:] + base[1:] > reach[:-1]))
        reach = reach - base
    else:
        reach = pd.Series(end).groupby(rank).cummax().to_numpy()
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (start[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return at, reach[np.concatenate((at[1:], [len(start)])) - 1]


def merge_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, sorted intervals of each group; touching ones are joined. Empty ones must be left out before."""
    if not len(start):
        return group, start, end
    order = _order(group, start)
    group, start, end = group[order], start[order], end[order]
    at, reach = _runs(group, start, end)
    return group[at], start[at], reach


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, equal for equal keys (null equals null)."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for col in columns:
        d = col.dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        part = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (len(d.dictionary) + 1) + part
        if len(columns) > 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def _cut(start: np.ndarray, end: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, tile, start and end of the pieces of each interval."""
    first, last = start // tile, (end - 1) // tile
    n = last - first + 1
    row = np.repeat(np.arange(len(start)), n)
    t = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, t, np.maximum(start[row], t * tile), np.minimum(end[row], (t + 1) * tile)


def blocks(low: np.ndarray, high: np.ndarray, radix: int = RADIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, level and number of the blocks that make up each range of tiles: level l holds 2**(radix * l) tiles."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    row, level = np.arange(len(low)), 0
    low, high = low.copy(), high.copy()
    while len(row):
        up_low, up_high = -(-low >> radix), high >> radix
        whole = up_low >= up_high  # no larger block fits
        for a, b in ((low, np.where(whole, high, np.minimum(up_low << radix, high))), (np.where(whole, high, up_high << radix), high)):
            n = b - a
            which = np.repeat(np.arange(len(row)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            out.append((row[which], np.full(len(which), level), a[which] + at))
        row, low, high = row[~whole], up_low[~whole], up_high[~whole]
        level += 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _lists(table: pa.Table, keys: list[str], tile: int, longest: int, radix: int, out: pa.Schema) -> pa.RecordBatch | None:
    start, end = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_s", "_e"))
    if not len(start):
        return None
    low, high = -(-start // tile), end // tile
    long = np.flatnonzero(high - low > longest)
    short = np.ones(len(start), bool)
    short[long] = False
    whole = np.flatnonzero(short)
    # the ends of long ones are pieces like any other
    source = np.concatenate((whole, long, long))
    s = np.concatenate((start[whole], start[long], high[long] * tile))
    e = np.concatenate((end[whole], low[long] * tile, end[long]))
    keep = s < e
    source, s, e = source[keep], s[keep], e[keep]
    row, t, s, e = _cut(s, e, tile)
    source = source[row]
    code = _codes([table.column(k).combine_chunks() for k in keys])[source] if keys else np.zeros(len(source), np.int64)
    if len(code):
        wide = int(t.max()) - int(t.min()) + 1
        by = code * wide + (t - t.min()) if wide * (int(code.max()) + 1) < 2**44 else np.unique(np.stack((code, t), 1), axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)
        order = _order(by, s - t * tile)
        by, s, e, t, source = (x[order] for x in (by, s, e, t, source))
        at, reach = _runs(by, s, e)
        g, s, e, t, source = by[at], s[at], reach, t[at], source[at]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    else:
        head = np.empty(0, np.int64)
    of, level, number = blocks(low[long], high[long], radix)
    width = (1 << (radix * level)) * tile
    ends = np.concatenate((head, len(s) + np.arange(len(of) + 1)))
    ends = pa.array(ends.astype(np.int32))
    cols = [table.column(k).combine_chunks().take(pa.array(np.concatenate((source[head], long[of])))) for k in keys]
    cols += [pa.array(np.concatenate((np.full(len(head), -1), level))), pa.array(np.concatenate((t[head], number)))]
    cols += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in ((s, number * width), (e, (number + 1) * width))]
    cols += [pa.array(np.zeros(len(head) + len(of), bool))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)


def _partial(keys: list[str], tile: int, longest: int, radix: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BUFFER_ROWS:
                if (x := _lists(pa.Table.from_batches(held), keys, tile, longest, radix, out)) is not None:
                    yield x
                held, rows = [], 0
        if held and (x := _lists(pa.Table.from_batches(held), keys, tile, longest, radix, out)) is not None:
            yield x

    return run


def _merged(table: pa.Table, keys: list[str], top: bool, out: pa.Schema) -> pa.RecordBatch:
    """Merges the lists of whole tiles, which are together: periods and gaps that are settled, and for each tile one row UP of its
    first and last period (start_pos, end_pos, and _s2, _e2 if there are two). Gaps inside a list that came up are settled."""
    lists_s, lists_e = table.column("_ss").combine_chunks(), table.column("_es").combine_chunks()
    n = lists_s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), n)
    code = np.zeros(table.num_rows, np.int64)
    for k in [*keys, "_tile"]:
        c = _codes([table.column(k).combine_chunks()])
        code[1:] |= c[1:] != c[:-1]
    code = np.cumsum(code)
    inner = np.concatenate(([False], row[1:] == row[:-1])) & table.column("_settled").combine_chunks().to_numpy(zero_copy_only=False)[row]
    group, s, e = code[row], lists_s.flatten().to_numpy(), lists_e.flatten().to_numpy()
    order = _order(group, s)
    group, s, e, row, inner = (x[order] for x in (group, s, e, row, inner))
    at, e = _runs(group, s, e)
    group, s, row, inner = group[at], s[at], row[at], inner[at]
    nxt = np.flatnonzero((group[1:] == group[:-1]) & ~inner[1:])
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    tail = np.concatenate((head[1:], [len(group)])) - 1
    ends = np.zeros(len(group), bool)
    ends[head] = ends[tail] = not top
    done = np.flatnonzero(~ends)
    up = np.empty(0, np.int64) if top else np.arange(len(head))
    which = np.concatenate((row[done], row[nxt], row[head[up]]))
    none = np.zeros(len(done) + len(nxt), np.int64)
    two = np.concatenate((none > 0, tail[up] > head[up]))
    cols = [table.column(k).combine_chunks().take(pa.array(which)) for k in [*keys, "_tile"]]
    cols += [pa.array(np.concatenate((np.full(len(done), PERIOD), np.full(len(nxt), GAP), np.full(len(up), UP))))]
    cols += [pa.array(np.concatenate((s[done], e[nxt], s[head[up]]))), pa.array(np.concatenate((e[done], s[nxt + 1], e[head[up]])))]
    cols += [pa.array(np.concatenate((none, x[tail[up]])), mask=~two) for x in (s, e)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)


def _merging(keys: list[str], top: bool, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 1000:
                continue
            code = _codes([held.column(k).combine_chunks() for k in [*keys, "_tile"]])
            # rows are sorted by key and tile: all but the last tile are whole
            split = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if split:
                yield _merged(held.slice(0, split), keys, top, out)
                held = held.slice(split)
        if held is not None and held.num_rows:
            yield _merged(held, keys, top, out)

    return run


def _without_covered(lists: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """lists but for tiles and blocks inside a (larger) block, which are few and told apart from tiles by _level."""
    found = lists.where("_level >= 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_level").alias("_in"), F.col("_tile").alias("_block")).distinct()
    for level in range(levels):
        here = found.where(F.col("_in") == level).drop("_in")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        inside = F.expr(f"shiftright(_tile, CAST({RADIX} * ({level} - greatest(_level, 0)) AS INT))") == F.col("_block")
        lists = lists.join(here, same & (F.col("_level") < level) & inside, "left_anti")
    return lists


def interval_periods(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", tile: int | None = None, kinds: tuple[int, ...] = (PERIOD, GAP), limit: int | None = None) -> DataFrame:
    """Continuous periods and the gaps between them, for each key.

    df: rows with the columns keys, start, end (0-based, half-open, integral, between -2^61 and 2^61); other columns are
    ignored. Repeated rows change nothing, so re-sent rows need no removal. Returns keys, start_pos, end_pos, kind (0:
    period, 1: gap).

    Periods are the maximal stretches covered by intervals of a key, touching intervals being joined; a gap lies between
    two successive periods. Rows with a null start or end or with end <= start are left out; a null key is a key of its
    own; an empty table gives no row.

    The range of the coordinates and the longest interval are taken from the rows by one aggregate job, unless a limit is
    given (coordinates are in 0 to limit, parts outside are cut off) or a tile's width (intervals are then cut at the
    edges of tiles, so they should be short).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    width = tile or TILE
    base = df.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).where("_s IS NOT NULL AND _e IS NOT NULL AND _e > _s")
    longest, origin = 0, 0
    if limit:
        base = base.select(*keys, F.greatest("_s", F.lit(0)).alias("_s"), F.least("_e", F.lit(limit)).cast("long").alias("_e")).where("_e > _s")
        most = limit
    elif tile:
        origin = -(1 << 61)
        most = 1 << 62
    else:
        low, most, longest = (x or 0 for x in base.agg(F.min("_s"), F.max("_e"), F.max(F.col("_e") - F.col("_s"))).first())
        origin = low // width * width
        most -= origin
    base = base.select(*keys, (F.col("_s") - origin).alias("_s"), (F.col("_e") - origin).alias("_e"))
    cut_long = longest > width * MOST_TILES
    top = 0  # levels above the tiles, until one tile holds all
    while (most - 1) // width >> (FAN * top) > 0:
        top += 1
    key_fields = [base.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType(), True)
    partial = T.StructType([*key_fields, T.StructField("_level", T.IntegerType()), T.StructField("_tile", T.LongType()), T.StructField("_ss", longs), T.StructField("_es", longs), T.StructField("_settled", T.BooleanType())])
    final = T.StructType([*key_fields, T.StructField("_tile", T.LongType()), T.StructField("kind", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start_pos", "end_pos", "_s2", "_e2")]])
    lists = base.mapInArrow(_partial(keys, width, MOST_TILES if cut_long else 1 << 62, RADIX, to_arrow_schema(partial)), partial)
    if cut_long:
        lists = _without_covered(lists, keys, -(-(longest // width).bit_length() // RADIX))
    joining = lists.where("_level >= 0").dropDuplicates([*keys, "_level", "_tile"])
    out, rows = None, lists.where("_level < 0").drop("_level") if cut_long else lists.drop("_level")
    for step in range(top + 1):
        placed = rows.repartition(*keys, "_tile").sortWithinPartitions(*keys, "_tile")
        pieces = placed.mapInArrow(_merging(keys, step == top, to_arrow_schema(final)), final)
        settled = pieces.where(F.col("kind").isin(list(kinds))).select(*keys, (F.col("start_pos") + origin).alias("start_pos"), (F.col("end_pos") + origin).alias("end_pos"), "kind")
        out = settled if out is None else out.unionByName(settled)
        if step == top:
            return out
        two = F.col("_s2").isNotNull()
        pair = lambda a, b: F.when(two, F.array(a, b)).otherwise(F.array(a))
        rows = pieces.where(F.col("kind") == UP).select(*keys, F.shiftright("_tile", FAN).alias("_tile"), pair("start_pos", "_s2").alias("_ss"), pair("end_pos", "_e2").alias("_es"), F.lit(True).alias("_settled"))
        if cut_long:
            # a block joins at the first level whose tiles are wider; one as wide as the axis at the last
            at = F.least(F.lit(top), F.floor(F.col("_level") * RADIX / FAN) + 1)
            rows = rows.unionByName(joining.where(at == step + 1).select(*keys, F.expr(f"shiftright(_tile, CAST({FAN * (step + 1)} - {RADIX} * _level AS INT))").alias("_tile"), "_ss", "_es", "_settled"))


def union_intervals(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", tile: int | None = None, limit: int | None = None) -> DataFrame:
    """keys, start_pos, end_pos of the continuous periods; see interval_periods."""
    return interval_periods(df, keys, start, end, tile, (PERIOD,), limit).drop("kind")


def covered_bases(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", tile: int | None = None) -> DataFrame:
    """keys, covered: bases under at least one interval of the key."""
    return union_intervals(df, keys, start, end, tile).groupBy(*keys).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered"))


def overlap_pieces(left: DataFrame, right: DataFrame, keys: list[str], tile: int = 1 << 14) -> DataFrame:
    """All columns of both sides and piece_start, piece_end: what each pair of overlapping intervals has in common.

    Both sides have keys, start_pos, end_pos; the right side's other columns must have names of their own, its start and
    end come out as right_start and right_end. Intervals are cut into tiles and joined by (keys, tile), so a pair that
    overlaps in several tiles gives a piece for each; sums over pieces count each base once a pair. Rows with a null
    key, start or end or an end not after the start match nothing.
    """
    cut = lambda df: df.where("end_pos > start_pos").withColumn("_t", F.explode(F.sequence(F.floor(F.col("start_pos") / tile), F.floor((F.col("end_pos") - 1) / tile))))
    r = cut(right).withColumnsRenamed({"start_pos": "right_start", "end_pos": "right_end"})
    start = F.greatest("start_pos", "right_start", F.col("_t") * tile)
    end = F.least("end_pos", "right_end", (F.col("_t") + 1) * tile)
    return cut(left).join(r, [*keys, "_t"]).withColumns({"piece_start": start, "piece_end": end}).where("piece_end > piece_start").drop("_t")
