"""Per-key results where a few keys hold most rows.

Rows are made distinct by their id, which spreads evenly, and then only mergeable states of a key (count, best score,
disjoint intervals of a tile) leave a map task: Spark's partial aggregation keeps them in hash maps that spill, and what
is shuffled by key is one row for each key and task. No key's rows ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.tiles import covered_bases
from helixframe.runtime import distinct_rows


def region_key(name: Column) -> Column:
    """The name up to its first colon; null for a null, empty or '.' name."""
    return F.when(name.isNull() | name.isin("", "."), F.lit(None)).otherwise(F.substring_index(name, ":", 1))


def key_counts(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """hot_key (null for rows without a key) and n, the distinct rows of each key. An empty table gives no row."""
    return distinct_rows(df.select(id_col, key.cast("string").alias("hot_key")), id_col).groupBy("hot_key").agg(F.count("*").alias("n"))


def heavy_keys(df: DataFrame, id_col: str, key: Column, share_percent: int = 3) -> DataFrame:
    """hot_key, n, total of the keys that hold at least share_percent of the distinct rows.

    Rows without a key (null) count in the total but are no key. Keys on the limit are kept. The total is a scalar join
    of one row.
    """
    counts = key_counts(df, id_col, key)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.where(F.col("hot_key").isNotNull()).join(F.broadcast(total), F.expr(f"n * 100 >= total * {int(share_percent)}")).select("hot_key", "n", "total")


def key_summary(df: DataFrame, id_col: str, key: Column, score: Column, place: tuple[str, ...] = ("asm_id", "chrom")) -> DataFrame:
    """hot_key, n_rows, bases, best_score of every key.

    n_rows: distinct rows. bases: bases of (asm_id, chrom) under at least one of the key's intervals; rows with a null
    chrom, start or end or an end not after the start cover none, so a key with only such rows has 0. best_score: the
    largest score, null where no row has one. Rows without a key are left out.
    """
    keyed = df.select(id_col, *place, "start_pos", "end_pos", key.cast("string").alias("hot_key"), score.alias("_score")).where("hot_key IS NOT NULL")
    rows = distinct_rows(keyed.select(id_col, "hot_key", "_score"), id_col).groupBy("hot_key").agg(F.count("*").alias("n_rows"), F.max("_score").alias("best_score"))
    bases = covered_bases(keyed.where(F.col(place[-1]).isNotNull()), ["hot_key", *place]).groupBy("hot_key").agg(F.sum("covered").alias("bases"))
    return rows.join(bases, "hot_key", "left").select("hot_key", "n_rows", F.coalesce("bases", F.lit(0)).alias("bases"), "best_score")
