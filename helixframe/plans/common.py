"""What the core's queries have in common: tables bound to operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.runtime import shuffle_partitions, table

PLACED = "chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos"


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, asm_id, header, chrom, seq: one row for each record; of re-sent ones the first by seq and header.

    The number of partitions is set, since what follows costs far more than the few bytes of a record suggest.
    """
    w = W.partitionBy("rec_id").orderBy("seq", "header")
    spread = table(spark, sf_dir, "records").where("rec_id IS NOT NULL").repartition(shuffle_partitions(spark), "rec_id")
    return spread.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """copy_id, rec_id, start_pos, end_pos, family: annotated copies, each once."""
    return table(spark, sf_dir, "repeats").where("copy_id IS NOT NULL AND rec_id IS NOT NULL AND end_pos > start_pos").dropDuplicates(["copy_id"])


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """consensus (the family's name), copy_id, seq: each family's longest copy, in upper case."""
    w = W.partitionBy("family").orderBy(F.desc(F.length("seq")), "copy_id")
    cut = F.expr("upper(substring(seq, CAST(start_pos + 1 AS INT), CAST(end_pos - start_pos AS INT)))")
    rows = copies(spark, sf_dir).where("family IS NOT NULL").join(genome(spark, sf_dir).select("rec_id", "seq"), "rec_id").withColumn("seq", cut)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("family").alias("consensus"), "copy_id", "seq")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).where(PLACED)


# the same in SQL
G = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq NULLS FIRST, header NULLS FIRST) AS rn FROM records WHERE rec_id IS NOT NULL) WHERE rn = 1)"
COPIES = "cp AS (SELECT DISTINCT ON (copy_id) copy_id, rec_id, start_pos, end_pos, family FROM repeats WHERE copy_id IS NOT NULL AND rec_id IS NOT NULL AND end_pos > start_pos)"
LIBRARY = f"{G}, {COPIES}, lb AS (SELECT consensus, copy_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY consensus ORDER BY LENGTH(seq) DESC, copy_id) AS n FROM (SELECT family AS consensus, copy_id, UPPER(substr(g.seq, start_pos + 1, end_pos - start_pos)) AS seq FROM cp JOIN g ON g.rec_id = cp.rec_id WHERE family IS NOT NULL)) WHERE n = 1)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTacgt', 'TGCAtgca'))"


def windows(k: int, source: str = "g", key: str = "rec_id", name: str = "w") -> str:
    """CTE of the k-long windows without other letters: key, pos, f."""
    return f"{name} AS (SELECT {key}, pos, f FROM (SELECT {key}, pos, substr(s, CAST(pos + 1 AS BIGINT), {k}) AS f FROM (SELECT {key}, UPPER(seq) AS s, UNNEST(range(0, LENGTH(seq) - {k} + 1)) AS pos FROM {source} WHERE LENGTH(seq) >= {k})) WHERE NOT regexp_matches(f, '[^ACGT]'))"


def kmers(k: int, name: str = "km", windows_name: str = "w") -> str:
    """CTEs of the canonical k-mers: rec_id, pos, kmer."""
    return f"{windows(k, name=windows_name)}, {name} AS (SELECT rec_id, pos, LEAST(f, {rc('f')}) AS kmer FROM {windows_name})"


def spaced(pattern: str, x: str) -> str:
    from helixframe.functions.seq import SpacedSeed

    return " || ".join(f"substr({x}, {at + 1}, {n})" for at, n in SpacedSeed(pattern, any_shape=True).runs())


def union_sql(source: str, keys: str, out: str, extra: str = "") -> str:
    """CTEs of merged intervals of source: keys, start_pos, end_pos."""
    return f"""{out}_o AS (SELECT {keys}, start_pos, end_pos, MAX(end_pos) OVER (PARTITION BY {keys} ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT {keys}, start_pos, end_pos FROM {source}{extra})),
    {out}_i AS (SELECT *, SUM(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_o),
    {out} AS (SELECT {keys}, CAST(MIN(start_pos) AS BIGINT) AS start_pos, CAST(MAX(end_pos) AS BIGINT) AS end_pos FROM {out}_i GROUP BY {keys}, isl)"""


def chains_sql(source: str, out: str, gap: int, more: str = "") -> str:
    """CTEs of chains of positions of source (rec_id, pos): rec_id, first, last and more."""
    return f"""{out}_f AS (SELECT *, CASE WHEN pos > LAG(pos) OVER (PARTITION BY rec_id ORDER BY pos) + {gap} THEN 1 ELSE 0 END AS brk FROM {source}),
    {out}_c AS (SELECT *, SUM(brk) OVER (PARTITION BY rec_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ch FROM {out}_f),
    {out} AS (SELECT rec_id, MIN(pos) AS first, MAX(pos) AS last{more} FROM {out}_c GROUP BY rec_id, ch)"""


TWO64 = "18446744073709551616::UHUGEINT"


def splitmix_sql(x: str) -> str:
    """splitmix64 of a UHUGEINT below 2^64, as a UHUGEINT."""
    from helixframe.functions.hashing import GAMMA, MIX1, MIX2

    z = f"(({x} + {GAMMA}::UHUGEINT) % {TWO64})"
    z = f"list_transform([{z}], lambda z: (xor(z, z >> 30) * {MIX1}::UHUGEINT) % {TWO64})"
    z = f"list_transform({z}, lambda z: (xor(z, z >> 27) * {MIX2}::UHUGEINT) % {TWO64})"
    return f"list_transform({z}, lambda z: xor(z, z >> 31))[1]"


def packed_sql(text: str, k: int) -> str:
    return f"list_sum(list_transform(range(1, {k + 1}), lambda i: ((instr('ACGT', substr({text}, i, 1)) - 1)::BIGINT << (2 * ({k} - i))::INT)))::BIGINT"


def hash_sql(packed: str) -> str:
    from helixframe.functions.hashing import SALT

    return splitmix_sql(f"xor(({packed})::UHUGEINT, {SALT}::UHUGEINT)")
