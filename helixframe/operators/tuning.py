"""Search over mask settings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.seq import ratio
from helixframe.operators.intervals import TILE, link_gaps
from helixframe.operators.masks import frequent_positions, mask_windows
from helixframe.operators.tiles import SEQUENCE, overlap_pieces, union_intervals
from helixframe.runtime import checkpoint


def k_sets(ks: list[int]) -> list[tuple[int, ...]]:
    """Single k, all of them if there are two or more, and all pairs if there are three or more."""
    return [(k,) for k in ks] + ([tuple(ks)] if len(ks) > 1 else []) + (list(combinations(ks, 2)) if len(ks) > 2 else [])


def graph_grid(records: DataFrame, ks: list[int], thresholds: list[int], gaps: list[int], min_len: int = 30) -> DataFrame:
    """k, threshold, gap, rec_id, start_pos, end_pos: the regions of every setting.

    Seeds of a k are made and counted once; thresholds and gaps are columns, so one plan links the whole grid.
    """
    out = None
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(g).alias("gap")) for t in thresholds for g in gaps]))
    for k in ks:
        counted = frequent_positions(records, k, min(thresholds)).withColumnRenamed("cnt", "_c")
        rows = counted.select("rec_id", "pos", "_c", grid.alias("_g")).select("rec_id", "pos", "_c", "_g.*").where(F.col("_c") >= F.col("threshold")).withColumn("k", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    key = ["k", "threshold", "gap", "rec_id"]
    chains = link_gaps(out, key, "pos", F.col("gap"), max(TILE, 16 * max(gaps))).select(*key, F.col("first").alias("start_pos"), (F.col("last") + F.col("k") - 1).alias("end_pos"))
    return chains.where(F.col("end_pos") - F.col("start_pos") >= min_len)


def tune_graph(records: DataFrame, truth: DataFrame, ks: list[int], thresholds: list[int], gaps: list[int], top: int = 10) -> DataFrame:
    """The `top` settings by F1 against the true intervals (rec_id, start_pos, end_pos); equal ones by smaller settings."""
    key = ["k", "threshold", "gap"]
    length = F.sum(F.col("end_pos") - F.col("start_pos"))
    t = union_intervals(truth, ["rec_id"], limit=SEQUENCE)
    p = union_intervals(graph_grid(records, ks, thresholds, gaps), [*key, "rec_id"], limit=SEQUENCE)
    both = overlap_pieces(p, t, ["rec_id"]).groupBy(*key).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("both_bases"))
    settings = records.sparkSession.createDataFrame([(k, th, g) for k in ks for th in thresholds for g in gaps], "k int, threshold int, gap int")
    out = settings.join(p.groupBy(*key).agg(length.alias("pred_bases")), key, "left").join(both, key, "left").join(F.broadcast(t.agg(F.coalesce(length, F.lit(0)).alias("truth_bases")))).na.fill(0, ["pred_bases", "both_bases"])
    out = out.withColumn("f1", ratio(2 * F.col("both_bases"), F.col("pred_bases") + F.col("truth_bases")))
    return out.orderBy(F.desc("f1"), *key).limit(top)


def mask_grid(records: DataFrame, ks: list[int], thresholds: list[int], gaps: list[int], mismatches: list[bool], window: int = 40, density: float = 0.25, min_len: int = 30) -> DataFrame:
    """ks, threshold, gap, mismatch, rec_id, start_pos, end_pos: the regions of every setting. ks is one k or several joined by commas
    (see k_sets), whose regions are united. A gap of 0 stands for masking by the density of windows."""
    frequent, windows = None, None
    for k in ks:
        for m in mismatches:
            # the near k-mers follow from the threshold, so with mismatches each has positions of its own
            for t in thresholds if m else [min(thresholds)]:
                rows = frequent_positions(records, k, t, m).select("rec_id", "pos", F.explode(F.array(*map(F.lit, [t] if m else thresholds))).alias("threshold"), "cnt", F.lit(k).alias("k"), F.lit(m).alias("mismatch"))
                rows = rows if m else rows.where(F.col("cnt") >= F.col("threshold"))
                frequent = rows if frequent is None else frequent.unionByName(rows)
            if 0 in gaps:
                for t in thresholds:
                    w = mask_windows(records, k, t, window, density, min_len, m).select(F.lit(k).alias("k"), F.lit(t).alias("threshold"), F.lit(0).alias("gap"), F.lit(m).alias("mismatch"), "rec_id", "start_pos", "end_pos")
                    windows = w if windows is None else windows.unionByName(w)
    linked = [g for g in gaps if g]
    key = ["k", "threshold", "gap", "mismatch", "rec_id"]
    single = windows
    if linked:
        rows = frequent.withColumn("gap", F.explode(F.array(*map(F.lit, linked))))
        chains = link_gaps(rows, key, "pos", F.col("gap"), max(TILE, 16 * max(linked))).select(*key, F.col("first").alias("start_pos"), (F.col("last") + F.col("k") - 1).alias("end_pos"))
        chains = chains.where(F.col("end_pos") - F.col("start_pos") >= min_len)
        single = chains if single is None else single.unionByName(chains)
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(",".join(map(str, s))).alias("ks")) for s in k_sets(ks) for k in s])).alias("s")
    members = records.sparkSession.range(1).select(sets).select("s.*")
    named = single.join(F.broadcast(members), "k").drop("k")
    return union_intervals(named, ["ks", "threshold", "gap", "mismatch", "rec_id"], limit=SEQUENCE).where(F.col("end_pos") - F.col("start_pos") >= min_len)


def tune_masks(records: DataFrame, truth: DataFrame, ks: list[int], thresholds: list[int], gaps: list[int], mismatches: list[bool] | None = None, top: int = 10, **window: float) -> DataFrame:
    """ks, threshold, gap, mismatch, truth_bases, pred_bases, both_bases, precision, recall, f1: the `top` settings by F1 against the true
    intervals (rec_id, start_pos, end_pos); equal ones in the order of the settings."""
    mismatches = mismatches or [False]
    key = ["ks", "threshold", "gap", "mismatch"]
    length = F.sum(F.col("end_pos") - F.col("start_pos"))
    t = union_intervals(truth, ["rec_id"], limit=SEQUENCE)
    p = checkpoint(mask_grid(records, ks, thresholds, gaps, mismatches, **window))  # read for its bases and for what it shares
    both = overlap_pieces(p, t, ["rec_id"]).groupBy(*key).agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("both_bases"))
    settings = records.sparkSession.createDataFrame([(",".join(map(str, s)), th, g, m) for s in k_sets(ks) for th in thresholds for g in gaps for m in mismatches], "ks string, threshold int, gap int, mismatch boolean")
    out = settings.join(p.groupBy(*key).agg(length.alias("pred_bases")), key, "left").join(both, key, "left").join(F.broadcast(t.agg(F.coalesce(length, F.lit(0)).alias("truth_bases")))).na.fill(0, ["pred_bases", "both_bases"])
    out = out.withColumns({"precision": ratio(F.col("both_bases"), F.col("pred_bases")), "recall": ratio(F.col("both_bases"), F.col("truth_bases")), "f1": ratio(2 * F.col("both_bases"), F.col("pred_bases") + F.col("truth_bases"))})
    return out.orderBy(F.desc("f1"), *key).limit(top)
