"""Interval tables: linking, depth, overlap, as-of lookup. Coordinates are 0-based and half-open.

Unions with many rows a key go through helixframe.operators.tiles; what is here works on rows ordered by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.seq import f1, ratio
from helixframe.operators.tiles import GAP, interval_periods, overlap_pieces, union_intervals
from helixframe.runtime import checkpoint


#: Positions of a key are worked on in tiles of about this width, so that no window holds a key.
TILE = 1 << 18


def link_gaps(df: DataFrame, keys: list[str], pos: str, gap: int | Column, tile: int | None = None, **aggs: tuple[str, Column]) -> DataFrame:
    """keys, first, last and aggs of each chain of positions of which none is further than gap from the one before.

    aggs: name=(how, column) with how 'max', 'min' or 'sum', over the rows of a chain. Chains are made inside tiles of
    (keys, position); only those that come within gap of their tile's edge, a few a tile, are linked over tiles. Rows
    with a null position are left out. A gap that differs by key is a column of the keys; then the tile must be given.
    """
    how = {"max": F.max, "min": F.min, "sum": F.sum}
    tile = tile or max(TILE, 16 * gap)
    rows = df.where(F.col(pos).isNotNull()).select(*keys, F.col(pos).cast("long").alias("_p"), F.floor(F.col(pos) / tile).alias("_t"), *[c.alias(n) for n, (_, c) in aggs.items()])
    w = W.partitionBy(*keys, "_t").orderBy("_p")
    far = F.coalesce(F.col("_p") > F.lag("_p").over(w) + gap, F.lit(True)).cast("long")
    merged = [how[h](n).alias(n) for n, (h, _) in aggs.items()]
    local = rows.withColumn("_c", F.sum(far).over(w)).groupBy(*keys, "_t", "_c").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), *merged)
    edge = (F.col("first") - F.col("_t") * tile <= gap) | ((F.col("_t") + 1) * tile - F.col("last") <= gap)
    across = W.partitionBy(*keys).orderBy("first") if keys else W.partitionBy(F.lit(0)).orderBy("first")
    apart = F.coalesce(F.col("first") > F.lag("last").over(across) + gap, F.lit(True)).cast("long")
    joined = local.where(edge).withColumn("_c", F.sum(apart).over(across)).groupBy(*keys, "_c").agg(F.min("first").alias("first"), F.max("last").alias("last"), *merged)
    return local.where(~edge).drop("_t", "_c").unionByName(joined.drop("_c"))


def set_runs(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, start_pos, end_pos: runs of successive positions; repeated positions count once."""
    runs = link_gaps(df.select(*keys, pos), keys, pos, 1)
    return runs.select(*keys, F.col("first").alias("start_pos"), (F.col("last") + 1).alias("end_pos"))


def with_halo(df: DataFrame, pos: str, reach: int, tile: int = TILE, after: bool = True) -> DataFrame:
    """df with _tile and _own: each row in its position's tile, and (not _own) in the tile before if it is within `reach` of it.

    So a window over a tile's rows in order shows each own row all that follow within the reach; with after=False all
    that come before within it.
    """
    own = F.floor(F.col(pos) / tile)
    near = F.col(pos) - own * tile < reach if after else (own + 1) * tile - F.col(pos) <= reach
    both = F.when(near, F.array(own, own - 1 if after else own + 1)).otherwise(F.array(own))
    return df.withColumn("_tile", F.explode(both)).withColumn("_own", F.col("_tile") == own)


def union_named(df: DataFrame, keys: list[str], name: str = "name", order: str | None = None, tile: int = TILE) -> DataFrame:
    """keys, start_pos, end_pos, name: touching intervals merged, with the first non-empty name in (start, order); '' without one.

    The merged intervals are made first; each named row then meets the one that its start lies in, by tile, and the first
    name is a minimum, so no window holds a key. A null key is a key of its own.
    """
    by = ["start_pos", *([order] if order else []), "end_pos", name]
    rows = checkpoint(df.where("end_pos > start_pos").select(*keys, *dict.fromkeys(by)))  # read three times
    whole = union_intervals(rows, keys)
    cut = F.explode(F.sequence(F.floor(F.col("start_pos") / tile), F.floor((F.col("end_pos") - 1) / tile)))
    spans = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), cut.alias("_t"))
    named = rows.where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("_at", F.floor(F.col("start_pos") / tile))
    inside = (F.col("_at") == F.col("_t")) & (F.col("start_pos") >= F.col("_s")) & (F.col("start_pos") < F.col("_e"))
    for i, k in enumerate(keys):
        inside = inside & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    first = named.join(spans, inside).groupBy(*[f"_k{i}" for i in range(len(keys))], "_s").agg(F.min(F.struct(*by)).alias("_first"))
    own = F.col("start_pos") == F.col("_s")
    for i, k in enumerate(keys):
        own = own & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return whole.join(first, own, "left").select(*keys, "start_pos", "end_pos", F.coalesce(F.col("_first")[name], F.lit("")).alias(name))


def _tiled(df: DataFrame, tile: int) -> DataFrame:
    """df with _t, and start_pos and end_pos cut to that tile: one row for each tile an interval lies in."""
    rows = df.where("end_pos > start_pos").withColumn("_t", F.explode(F.sequence(F.floor(F.col("start_pos") / tile), F.floor((F.col("end_pos") - 1) / tile))))
    return rows.withColumns({"start_pos": F.greatest(F.col("start_pos"), F.col("_t") * tile), "end_pos": F.least(F.col("end_pos"), (F.col("_t") + 1) * tile)})


def depth_segments(sides: dict[str, DataFrame], keys: list[str], tile: int = TILE, gaps: bool = False) -> DataFrame:
    """keys, start_pos, end_pos and one depth column for each side: the stretches between successive borders that lie under
    an interval of any side; with gaps, also those between them.

    Intervals are cut at the edges of tiles, so stretches end there too, and no window holds more than a tile of a key.
    """
    events = None
    for side, df in sides.items():
        cut = _tiled(df.select(*keys, "start_pos", "end_pos"), tile)
        for at, step in (("start_pos", 1), ("end_pos", -1)):
            e = cut.select(*keys, "_t", F.col(at).alias("at"), *[F.lit(step if s == side else 0).alias(s) for s in sides])
            events = e if events is None else events.unionByName(e)
    at_border = events.groupBy(*keys, "_t", "at").agg(*[F.sum(s).alias(s) for s in sides])
    w = W.partitionBy(*keys, "_t").orderBy("at")
    out = at_border.select(*keys, F.col("at").alias("start_pos"), F.lead("at").over(w).alias("end_pos"), *[F.sum(s).over(w).alias(s) for s in sides])
    out = out.where(F.col("end_pos").isNotNull() & (sum(F.col(s) for s in sides) > 0))
    if not gaps:
        return out
    whole = None
    for df in sides.values():
        rows = df.select(*keys, "start_pos", "end_pos")
        whole = rows if whole is None else whole.unionByName(rows)
    between = interval_periods(whole, keys, kinds=(GAP,)).select(*keys, "start_pos", "end_pos", *[F.lit(0).cast("long").alias(s) for s in sides])
    return out.unionByName(between)


def sweep_counts(truth: DataFrame, pred: DataFrame, keys: list[str], tile: int | None = None) -> DataFrame:
    """keys, truth, pred, both: bases under each and under both, each base once. Keys of either side appear."""
    t, p = union_intervals(truth, keys, tile=tile), union_intervals(pred, keys, tile=tile)
    length = F.sum(F.col("end_pos") - F.col("start_pos"))
    both = overlap_pieces(t, p, keys).groupBy(*keys).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("both"))
    a, b = t.groupBy(*keys).agg(length.alias("truth")), p.groupBy(*keys).agg(length.alias("pred"))
    return a.join(b, keys, "full").join(both, keys, "left").na.fill(0, ["truth", "pred", "both"])


def base_metrics(counts: DataFrame) -> DataFrame:
    """One row of truth_bases, pred_bases, both_bases, precision, recall, f1 from the columns truth, pred, both."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_bases") for c in ("truth", "pred", "both")])
    s = s.withColumn("precision", ratio(F.col("both_bases"), F.col("pred_bases"))).withColumn("recall", ratio(F.col("both_bases"), F.col("truth_bases")))
    return s.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def evaluate(truth: DataFrame, pred: DataFrame, keys: list[str], tile: int | None = None) -> DataFrame:
    """Base-level precision, recall and F1 of predicted against true intervals; keys must agree for bases to match."""
    return base_metrics(sweep_counts(truth, pred, keys, tile))


def family_recall(truth: DataFrame, pred: DataFrame, keys: list[str], family: str = "family", tile: int | None = None) -> DataFrame:
    """family, truth_bases, hit_bases, recall: each family's intervals merged on their own; null families are left out."""
    t = union_intervals(truth.where(F.col(family).isNotNull()), [*keys, family], tile=tile)
    p = union_intervals(pred, keys, tile=tile)
    size = t.groupBy(family).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("truth_bases"))
    hit = overlap_pieces(t, p, keys).groupBy(family).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("hit_bases"))
    out = size.join(hit, family, "left").na.fill(0, ["hit_bases"])
    return out.withColumn("recall", ratio(F.col("hit_bases"), F.col("truth_bases")))


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_pos, end_pos: maximal stretches under the left but not the right intervals."""
    return union_intervals(depth_segments({"a": left, "b": right}, keys).where("a > 0 AND b = 0"), keys, tile=1 << 17)


def point_in_interval(points: DataFrame, spans: DataFrame, keys: list[str], pos: str = "pos", tile: int = TILE) -> DataFrame:
    """points and inside: whether the last span that starts at or before the point reaches beyond it (as-of lookup).

    Spans are cut into tiles, so a point meets those of its own tile only; of spans cut at an edge the one that started
    last counts. Spans that overlap should be merged first, else one that ended in an earlier tile isn't seen. Points with a null place are inside nothing.
    """
    cols = points.columns
    p = points.withColumns({"_t": F.floor(F.col(pos) / tile), "_at": F.col(pos).cast("long"), "_from": F.lit(None).cast("long"), "_end": F.lit(None).cast("long"), "_point": F.lit(1)})
    cut = _tiled(spans.select(*keys, "start_pos", "end_pos").withColumn("_from", F.col("start_pos")), tile)
    s = cut.select(*keys, "_t", F.col("start_pos").alias("_at"), "_from", F.col("end_pos").alias("_end"), F.lit(0).alias("_point"))
    w = W.partitionBy(*keys, "_t").orderBy("_at", "_point", "_from", "_end")
    both = p.unionByName(s, allowMissingColumns=True).withColumn("_reach", F.last("_end", ignorenulls=True).over(w))
    return both.where("_point = 1").select(*cols, F.coalesce(F.col("_reach") > F.col(pos), F.lit(False)).alias("inside"))


def overlap_bases(rows: DataFrame, spans: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """rows and overlap: bases of each row under the union of the spans; 0 for rows without or with unusable borders.

    Spans are merged first, so a row meets each base once. row_id must be unique and not null.
    """
    merged = union_intervals(spans, keys)
    got = overlap_pieces(rows.select(row_id, *keys, "start_pos", "end_pos"), merged, keys).groupBy(row_id).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("overlap"))
    return rows.join(got, row_id, "left").na.fill(0, ["overlap"])
