"""Score cutoffs that keep a target share of each source's records, by iterative histogram refinement.

Distinct records are first reduced to (source, score, n). Each round counts the scores of every unsettled source into
equal bins between the ends of its range, finds the bin that holds the target rank and goes on with the lowest and
highest score in that bin, until it holds one score. Only counts leave a task; the state is one row a target.

Bins are equal in the order-preserving 64-bit pattern of a double, so that a round narrows any range, also one with
infinite ends or one wider than the largest double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.runtime import checkpoint, distinct_rows

BINS = 256


#: Rounds after which any 64-bit range is one score, even with two bins.
MOST_ROUNDS = 130


@F.pandas_udf(T.LongType())
def score_key(v: pd.Series) -> pd.Series:
    """A number for each double in the same order, from its bits; both zeros are one."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def _cell(bins: int) -> Column:
    """The bin of key k between lo and hi: lo is in the first, hi in the last, so each round narrows the range."""
    share = "IF((lo < 0) = (hi < 0), DOUBLE(IF((lo < 0) = (hi < 0), k - lo, 0)) / IF((lo < 0) = (hi < 0), hi - lo, 1), (DOUBLE(k) - DOUBLE(lo)) / (DOUBLE(hi) - DOUBLE(lo)))"
    return F.least(F.lit(bins - 1), F.floor(F.expr(share) * bins)).alias("cell")


def share_cutoffs(records: DataFrame, targets: DataFrame, source: str, score: str, record_id: str, permille: str, bins: int = BINS) -> DataFrame:
    """source, n, cutoff, kept: one row for each row of targets, repeated ones included.

    cutoff is the highest score occurring in the source for which the records with score >= cutoff number kept with
    kept * 1000 >= permille * n, n being the source's distinct records with a score. A source without such records, or
    one that even all its records can't satisfy (permille over 1000), has a null cutoff and kept 0; so has a row of
    targets with a null source or permille. Records with a null source, score or id, NaN scores, and records of sources
    without a target are left out; infinite scores count like others. Equal scores are kept or dropped together. Scores
    are compared as double.
    """
    if bins < 2:
        raise ValueError("at least two bins")
    want = targets.select(F.col(source).alias("_src"), F.col(permille).cast("double").alias("_pm"))
    asked = want.where("_src IS NOT NULL AND _pm IS NOT NULL AND NOT isnan(_pm)").distinct()
    rows = records.select(F.col(record_id).alias("_id"), F.col(source).alias("_src"), F.col(score).cast("double").alias("_v")).where("_src IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v)")
    rows = distinct_rows(rows.join(asked.select("_src").distinct(), "_src", "left_semi"), "_id")
    counts = checkpoint(rows.groupBy("_src", "_v").agg(F.count("*").alias("_c")).withColumn("k", score_key("_v")))
    state = counts.groupBy("_src").agg(F.sum("_c").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).join(asked, "_src")
    state = checkpoint(state.where("_pm <= 1000").select("_src", "_pm", "n", F.greatest(F.lit(1.0), F.ceil(F.expr("_pm * n / 1000"))).cast("long").alias("rank"), F.lit(0).cast("long").alias("above"), "lo", "hi"))
    rounds = 0
    while state.where("lo < hi").limit(1).count():
        # several targets of one source are states of their own
        live = state.where("lo < hi")
        hist = counts.join(live, "_src").where("k BETWEEN lo AND hi").groupBy("_src", "_pm", "n", "rank", "above", _cell(bins)).agg(F.sum("_c").alias("c"), F.min("k").alias("low"), F.max("k").alias("high"))
        down = hist.withColumn("upto", F.col("above") + F.sum("c").over(W.partitionBy("_src", "_pm").orderBy(F.desc("cell"))))
        zoomed = down.where("upto >= rank AND upto - c < rank").select("_src", "_pm", "n", "rank", (F.col("upto") - F.col("c")).alias("above"), F.col("low").alias("lo"), F.col("high").alias("hi"))
        state = checkpoint(zoomed.unionByName(state.where("lo = hi")))
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError("ranges of scores no longer narrow")
    last = state.select("_src", "_pm", "above", F.col("lo").alias("k"))
    kept = last.join(counts, ["_src", "k"]).select("_src", "_pm", F.col("_v").alias("cutoff"), (F.col("above") + F.col("_c")).alias("kept"))
    sizes = counts.groupBy("_src").agg(F.sum("_c").alias("_n"))
    kind = records.schema[score].dataType
    return want.join(sizes, "_src", "left").join(kept, ["_src", "_pm"], "left").select(F.col("_src").alias(source), F.coalesce("_n", F.lit(0)).cast("long").alias("n"), F.col("cutoff").cast(kind).alias("cutoff"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
