"""A counting Bloom filter as a table of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.hashing import bloom_slots_of


def _slotted(rows: DataFrame, seed_rows: DataFrame, k: int, factor: int) -> DataFrame:
    """rows with idx, one row for each of a k-mer's slots; the filter has factor slots a seed, 1,024 at least."""
    size = seed_rows.agg(F.greatest(F.lit(1024), F.count("*") * factor).alias("_m"))
    return rows.join(F.broadcast(size)).withColumn("idx", F.explode(bloom_slots_of(k)("kmer", "_m"))).drop("_m")


def filter_slots(seed_rows: DataFrame, k: int, factor: int = 8) -> DataFrame:
    """idx, cnt: the counters that aren't 0, saturated at 255. Seeds are counted first, so each is hashed once."""
    counts = seed_rows.groupBy("kmer").agg(F.count("*").alias("_n"))
    return _slotted(counts, seed_rows, k, factor).groupBy("idx").agg(F.least(F.lit(255), F.sum("_n")).cast("int").alias("cnt"))


def merge_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """Saturating sum of two filters of the same size."""
    return one.unionByName(other).groupBy("idx").agg(F.least(F.lit(255), F.sum("cnt")).cast("int").alias("cnt"))


def estimate(kmers: DataFrame, slots: DataFrame, seed_rows: DataFrame, k: int, factor: int = 8) -> DataFrame:
    """kmers with estimate: the least of a k-mer's counters, 0 where one is missing; never below the count, up to 255."""
    at = _slotted(kmers, seed_rows, k, factor).join(slots.withColumnRenamed("cnt", "_c"), "idx", "left")
    return at.groupBy(*kmers.columns).agg(F.min(F.coalesce("_c", F.lit(0))).alias("estimate"))
