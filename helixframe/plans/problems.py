"""Queries of the general numbered problems (3: periods and gaps, 5: keys that hold most rows), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import heavy_keys as H
from helixframe.operators import tiles
from helixframe.runtime import table

PLACED = "chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["asm_id", "chrom", "start_pos", "end_pos"]
    both = table(spark, sf_dir, "ref_interval").select(F.lit("ref_interval").alias("tab"), *cols).unionByName(table(spark, sf_dir, "masked_region").select(F.lit("masked_region").alias("tab"), *cols))
    kind = F.when(F.col("kind") == tiles.GAP, "gap").otherwise("period").alias("kind")
    return tiles.interval_periods(both.where(PLACED), ["tab", "asm_id", "chrom"]).select("tab", kind, "asm_id", "chrom", "start_pos", "end_pos")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = H.heavy_keys(table(spark, sf_dir, "candidate"), "cand_id", F.col("cid"))
    region = H.heavy_keys(table(spark, sf_dir, "masked_region"), "region_id", H.region_key(F.col("name")))
    return cand.select(F.lit("candidate").alias("tab"), "hot_key").unionByName(region.select(F.lit("masked_region").alias("tab"), "hot_key"))


def p5_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bases covered and best score of every cid."""
    return H.key_summary(table(spark, sf_dir, "candidate"), "cand_id", F.col("cid"), F.col("score").cast("long"))


def p5_region_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bases covered and best score (behind the name's first colon, where it is a number) of every name."""
    name = F.col("name")
    score = F.when(name.rlike("^[^:]*:-?[0-9]+$"), F.substring_index(name, ":", -1)).cast("long")
    return H.key_summary(table(spark, sf_dir, "masked_region"), "region_id", H.region_key(name), score)


def _union_sql(source: str, keys: str) -> str:
    return f"""o AS (SELECT {keys}, start_pos, end_pos, MAX(end_pos) OVER (PARTITION BY {keys} ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT {keys}, start_pos, end_pos FROM {source})),
    i AS (SELECT *, SUM(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM o),
    u AS (SELECT {keys}, isl, MIN(start_pos) AS start_pos, MAX(end_pos) AS end_pos FROM i GROUP BY {keys}, isl)"""


_SUMMARY = """WITH d AS (SELECT {id}, asm_id, chrom, start_pos, end_pos, {key} AS hot_key, {score} AS sc FROM {tab}),
 r AS (SELECT hot_key, CAST(COUNT(*) AS BIGINT) AS n_rows, MAX(sc) AS best_score FROM (SELECT DISTINCT ON ({id}) {id}, hot_key, sc FROM d WHERE hot_key IS NOT NULL) GROUP BY hot_key),
 b AS (SELECT * FROM d WHERE hot_key IS NOT NULL AND {placed}), {union},
 c AS (SELECT hot_key, SUM(end_pos - start_pos) AS bases FROM u GROUP BY hot_key)
 SELECT r.hot_key, r.n_rows, CAST(COALESCE(c.bases, 0) AS BIGINT) AS bases, r.best_score FROM r LEFT JOIN c ON r.hot_key = c.hot_key"""

_NAME_KEY = "CASE WHEN name IS NULL OR name IN ('', '.') THEN NULL ELSE split_part(name, ':', 1) END"

QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_candidate_keys": p5_candidate_keys, "p5_region_keys": p5_region_keys}

SQL = {
    "p3_found": f"""WITH b AS (SELECT 'ref_interval' AS tab, asm_id, chrom, start_pos, end_pos FROM ref_interval WHERE {PLACED}
      UNION ALL SELECT 'masked_region', asm_id, chrom, start_pos, end_pos FROM masked_region WHERE {PLACED}), {_union_sql("b", "tab, asm_id, chrom")},
      g AS (SELECT tab, asm_id, chrom, end_pos AS start_pos, LEAD(start_pos) OVER (PARTITION BY tab, asm_id, chrom ORDER BY start_pos) AS end_pos FROM u)
      SELECT tab, 'period' AS kind, asm_id, chrom, start_pos, end_pos FROM u UNION ALL SELECT tab, 'gap' AS kind, asm_id, chrom, start_pos, end_pos FROM g WHERE end_pos IS NOT NULL""",
    "p5_found": f"""WITH d AS (SELECT 'candidate' AS tab, CAST(cid AS VARCHAR) AS hot_key FROM (SELECT DISTINCT ON (cand_id) cand_id, cid FROM candidate)
      UNION ALL SELECT 'masked_region', {_NAME_KEY} FROM (SELECT DISTINCT ON (region_id) region_id, name FROM masked_region)),
      c AS (SELECT tab, hot_key, COUNT(*) AS n FROM d GROUP BY tab, hot_key), t AS (SELECT tab, SUM(n) AS total FROM c GROUP BY tab)
      SELECT c.tab, c.hot_key FROM c JOIN t ON c.tab = t.tab WHERE c.hot_key IS NOT NULL AND c.n * 100 >= 3 * t.total""",
    "p5_candidate_keys": _SUMMARY.format(id="cand_id", key="CAST(cid AS VARCHAR)", score="CAST(score AS BIGINT)", tab="candidate", placed=PLACED, union=_union_sql("b", "hot_key, asm_id, chrom")),
    "p5_region_keys": _SUMMARY.format(id="region_id", key=_NAME_KEY, score="CASE WHEN regexp_matches(name, '^[^:]*:-?[0-9]+$') THEN CAST(split_part(name, ':', 2) AS BIGINT) END", tab="masked_region", placed=PLACED, union=_union_sql("b", "hot_key, asm_id, chrom")),
}
