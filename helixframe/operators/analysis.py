"""Diagnostics of seeds, pairs, labels and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.seq import family_of_name, kmer_text
from helixframe.operators.intervals import point_in_interval
from helixframe.operators.kmers import SpacedSeed, seeds
from helixframe.operators.ordering import running_sum
from helixframe.operators.tiles import SEQUENCE, union_intervals

# Borders of the distance bands of pairs.
BANDS = [0, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, 250_000_000]


def exact_pairs(records: DataFrame, k: int) -> DataFrame:
    """kmer (letters), rec_id, pos1, pos2: forward k-mers that stand exactly twice, both times in one record.

    Counts, least and greatest place are partial aggregates, so frequent k-mers are never gathered.
    """
    rows = seeds(records, SpacedSeed.contiguous(k), strand="forward")
    g = rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("rec_id").alias("rec_id"), F.max("rec_id").alias("_r"), F.min("pos").alias("pos1"), F.max("pos").alias("pos2"))
    return g.where("n = 2 AND rec_id = _r").select(kmer_text(F.col("kmer"), k).alias("kmer"), "rec_id", "pos1", "pos2")


def distance_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, least, most, mean (4 places), median, and how many are at least 100, 1,000 and 10,000 apart."""
    d = F.abs(F.col("pos2") - F.col("pos1"))
    return pairs.agg(F.count("*").alias("pairs"), F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.avg(d), 4).alias("mean"), F.percentile(d, 0.5).alias("median"), *[F.count_if(d >= t).alias(f"at_least_{t}") for t in (100, 1000, 10000)])


def pairs_in_spans(pairs: DataFrame, spans: DataFrame, key: str = "rec_id") -> DataFrame:
    """pairs with in1, in2: whether each end lies in the last span starting at or before it."""
    ends = pairs.select("kmer", key, F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("pos1").alias("pos")), F.struct(F.lit(2).alias("end"), F.col("pos2").alias("pos")))).alias("e"), "pos1", "pos2").select("kmer", key, "pos1", "pos2", "e.*")
    seen = point_in_interval(ends, spans, [key])
    return seen.groupBy("kmer", key, "pos1", "pos2").agg(F.max(F.when(F.col("end") == 1, F.col("inside"))).alias("in1"), F.max(F.when(F.col("end") == 2, F.col("inside"))).alias("in2"))


def crosstab(marked: DataFrame) -> list:
    one = F.col("in1") | F.col("in2")
    return [F.count("*").alias("total"), F.count_if(F.col("in1") & F.col("in2")).alias("both"), F.count_if(one).alias("at_least_one"), F.count_if(~one).alias("neither")]


def span_crosstab(marked: DataFrame) -> DataFrame:
    return marked.agg(*crosstab(marked))


def span_crosstab_by_distance(marked: DataFrame) -> DataFrame:
    """band (its lower border) and counts, for bands that hold a pair."""
    d = F.abs(F.col("pos2") - F.col("pos1"))
    band = F.lit(None).cast("long")
    for lo, hi in zip(BANDS, BANDS[1:]):
        band = F.when((d >= lo) & (d < hi), F.lit(lo).cast("long")).otherwise(band)
    return marked.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(*crosstab(marked))


def pair_regions(pairs: DataFrame, expand: int = 50, length: int = 64, least: int = 0, most: int = 1 << 40, key: str = "rec_id") -> DataFrame:
    """key, start_pos, end_pos: merged surroundings of the ends of pairs at a distance of least to below most."""
    d = F.abs(F.col("pos2") - F.col("pos1"))
    ends = pairs.where((d >= least) & (d < most)).select(key, F.explode(F.array("pos1", "pos2")).alias("p"))
    return union_intervals(ends.select(key, F.greatest(F.lit(0), F.col("p") - expand).alias("start_pos"), (F.col("p") + length + expand).alias("end_pos")), [key], limit=SEQUENCE)


def top_labels(hits: DataFrame, by: str, family: str, n: int = 3) -> DataFrame:
    """by, family, bases, permille, place: the families that cover most of each key's hits; equal ones by name."""
    per = hits.where("end_pos > start_pos").where(F.col(by).isNotNull() & F.col(family).isNotNull()).groupBy(by, family).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    w = W.partitionBy(by)
    ranked = per.withColumns({"_all": F.sum("bases").over(w), "place": F.row_number().over(w.orderBy(F.desc("bases"), family))}).where(F.col("place") <= n)
    return ranked.select(by, family, "bases", F.expr("bases * 1000 DIV _all").alias("permille"), "place")


def length_histogram(df: DataFrame, length: str, width: int = 100) -> DataFrame:
    """bucket (its lower border) and n."""
    return df.where(F.col(length).isNotNull()).groupBy((F.floor(F.col(length) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: median, the upper of the two middle values; found by value counts, so no list is gathered."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    run = running_sum(per, [value], F.col("_c"), "_before")
    total = per.agg(F.sum("_c").alias("_all"))
    return run.join(F.broadcast(total)).where("_before + _c > _all DIV 2").agg(F.min(value).alias("median"))


def wrong_arity(lines: DataFrame, fields: int, sep: str = "\t", line: str = "value") -> DataFrame:
    """lines with n_fields, those with another number of fields."""
    return lines.withColumn("n_fields", F.size(F.split(F.col(line), sep))).where(F.col("n_fields") != fields)


def random_rows(df: DataFrame, row_id: str, n: int, seed: int = 1) -> DataFrame:
    """n rows chosen by a hash of their id, the same ones each time; all if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(n)


def records_by_header(records: DataFrame, pattern: str, header: str = "header") -> DataFrame:
    """records whose header matches a regular expression in any letter case; those without a header match nothing."""
    return records.where(F.col(header).rlike(f"(?i){pattern}"))


def with_added_labels(labels: DataFrame, added: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """labels (name, family, hits, bases, share) and, after them, a label for each added sequence: the family that its name stands
    for, no hits, its length and a share of 0. Names in both stand in both."""
    new = added.select(F.col(name).alias("name"), family_of_name(F.col(name)).alias("family"), F.lit(0).cast("long").alias("hits"), F.coalesce(F.length(seq), F.lit(0)).cast("long").alias("bases"), F.lit(0.0).alias("share"))
    return labels.select("name", "family", "hits", "bases", "share").unionByName(new)
