"""Queries of the numbered problems for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import cutoffs, frequent, mixing, packing, samples, sentences, spans
from helixframe.llm.tokens import token_count
from helixframe.operators.tiles import SEQUENCE, overlap_pieces, union_intervals
from helixframe.runtime import checkpoint, spread, table

P1_PARTS = 500
P7_CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.heavy_values(table(spark, sf_dir, "kmer_index"), "kmers", "counts", "entry_id", P1_PARTS).select(F.col("value").alias("kmers"))


def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent k-mers with their sums."""
    return frequent.frequent_values(table(spark, sf_dir, "kmer_index"), "kmers", "counts", "entry_id", 100).select(F.col("value").alias("kmers"), F.col("total").alias("counts"))


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.share_cutoffs(table(spark, sf_dir, "candidate"), table(spark, sf_dir, "keep_targets"), "cid", "score", "cand_id", "keep_permille")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2(spark, sf_dir).select("cid", "cutoff")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff, records and records kept of every cid."""
    return _p2(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "records"))


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every record is shared."""
    records = table(spark, sf_dir, "records")
    return spans.shared_share(records, spans.shared_spans(records))


def p4_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared bases of each record under the annotated copies of each family (null: copies without one)."""
    found = spans.shared_spans(table(spark, sf_dir, "records"))
    copies = union_intervals(table(spark, sf_dir, "repeats").where("rec_id IS NOT NULL"), ["rec_id", "family"], limit=SEQUENCE)
    pieces = overlap_pieces(found, copies, ["rec_id"])
    return pieces.groupBy("rec_id", "family").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("shared"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 occurrences of all that the pieces met; again: how often it stands in already."""
    s = samples.sample_occurrences(table(spark, sf_dir, "reservoir"), 1000)
    return s.select("piece_id", "occ.rec", "occ.pos", "occ.is_forward", "again")


def p6_per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 50 occurrences of every seed."""
    s = samples.sample_occurrences(table(spark, sf_dir, "reservoir"), 50, key="seed_kmer")
    return s.select("seed_kmer", "piece_id", "occ.rec", "occ.pos", "occ.is_forward", "again")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = checkpoint(spread(docs).select("doc_id", token_count(F.col("text")).alias("tokens")))  # read for packed and for empty texts
    return packing.pack_items(sizes, "doc_id", "tokens", P7_CAPACITY, packing.shard_count(sizes.count()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were split: those with a second part."""
    return _packed(spark, sf_dir).where("part = 1").select("doc_id")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every part of every document."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and how full the containers are."""
    return packing.fill_report(_packed(spark, sf_dir), P7_CAPACITY)


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", mixing.source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.Mixture(checkpoint(docs), targets.withColumn("source", mixing.source_name(F.col("source"))))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose blocks the mixture used up before their share was reached."""
    targets = table(spark, sf_dir, "mix_targets").select(F.col("source").alias("given"), mixing.source_name(F.col("source")).alias("source"))
    return _mixture(spark, sf_dir).shares().where("short").join(targets, "source").select(F.col("given").alias("source"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mixture(spark, sf_dir).shares()


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source stand how often in the mixture, by the most used of their parts."""
    parts = _mixture(spark, sf_dir).mix().groupBy("source", "doc_id", "token_start").agg(F.count("*").alias("n"))
    return parts.groupBy("source", "doc_id").agg(F.max("n").alias("uses")).groupBy("source", "uses").agg(F.count("*").alias("documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: every slot's block with the document parts in it."""
    return _mixture(spark, sf_dir).mix()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


_P1 = "WITH d AS (SELECT DISTINCT ON (entry_id) entry_id, kmers, counts FROM kmer_index WHERE kmers IS NOT NULL AND counts IS NOT NULL), s AS (SELECT kmers, SUM(counts) AS t FROM d GROUP BY kmers)"

_P4 = """WITH r AS (SELECT rec_id, UPPER(seq) AS seq FROM records WHERE rec_id IS NOT NULL AND seq IS NOT NULL), p AS (SELECT rec_id, UNNEST(range(0, LENGTH(seq) - 63)) AS pos, seq FROM r WHERE LENGTH(seq) >= 64),
 w AS (SELECT rec_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 64) AS s FROM p), v AS (SELECT DISTINCT * FROM w WHERE NOT regexp_matches(s, '[^ACGT]')), m AS (SELECT s FROM v GROUP BY s HAVING COUNT(DISTINCT rec_id) > 1),
 b AS (SELECT rec_id, pos AS start_pos, pos + 64 AS end_pos FROM v SEMI JOIN m ON v.s = m.s),
 o AS (SELECT *, MAX(end_pos) OVER (PARTITION BY rec_id ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b),
 i AS (SELECT *, SUM(CASE WHEN e IS NULL OR start_pos > e THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS isl FROM o),
 u AS (SELECT rec_id, CAST(MIN(start_pos) AS BIGINT) AS start_pos, CAST(MAX(end_pos) AS BIGINT) AS end_pos FROM i GROUP BY rec_id, isl)"""

_P2 = """WITH d AS (SELECT DISTINCT ON (cand_id) cand_id, cid, score FROM candidate WHERE cid IS NOT NULL AND score IS NOT NULL), n AS (SELECT cid, COUNT(*) AS n FROM d GROUP BY cid),
 s AS (SELECT cid, score, SUM(COUNT(*)) OVER (PARTITION BY cid ORDER BY score DESC) AS kept FROM d GROUP BY cid, score),
 c AS (SELECT t.cid, MAX(s.score) AS cutoff, MIN(s.kept) AS kept FROM keep_targets t JOIN n ON n.cid = t.cid JOIN s ON s.cid = t.cid WHERE s.kept * 1000 >= t.keep_permille * n.n GROUP BY t.cid)"""

QUERIES = {"p1_found": p1_found, "p1_top": p1_top, "p2_found": p2_found, "p2_kept": p2_kept, "p4_found": p4_found, "p4_share": p4_share, "p4_families": p4_families, "p6_sample": p6_sample, "p6_per_seed": p6_per_seed, "p7_found": p7_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_shares": p8_shares, "p8_uses": p8_uses, "p8_mix": p8_mix, "p9_found": p9_found}

SQL = {
    "p4_found": f"{_P4} SELECT rec_id, start_pos, end_pos FROM u",
    "p4_share": f"""{_P4}, z AS (SELECT rec_id, CAST(COALESCE(MAX(LENGTH(seq)), 0) AS BIGINT) AS bases FROM records WHERE rec_id IS NOT NULL GROUP BY rec_id), y AS (SELECT rec_id, SUM(end_pos - start_pos) AS shared, COUNT(*) AS spans FROM u GROUP BY rec_id)
      SELECT z.rec_id, z.bases, CAST(COALESCE(shared, 0) AS BIGINT) AS shared, COALESCE(spans, 0) AS spans, CASE WHEN bases > 0 THEN CAST(COALESCE(shared, 0) * 1000 // bases AS BIGINT) END AS shared_permille FROM z LEFT JOIN y ON z.rec_id = y.rec_id""",
    "p4_families": f"""{_P4}, c AS (SELECT DISTINCT rec_id, family, UNNEST(range(start_pos, end_pos)) AS pos FROM repeats WHERE rec_id IS NOT NULL AND end_pos > start_pos), x AS (SELECT rec_id, UNNEST(range(start_pos, end_pos)) AS pos FROM u)
      SELECT c.rec_id, c.family, COUNT(*) AS shared FROM c JOIN x ON c.rec_id = x.rec_id AND c.pos = x.pos GROUP BY c.rec_id, c.family""",
    "p1_found": f"{_P1} SELECT kmers FROM s WHERE t * {P1_PARTS} >= (SELECT SUM(t) FROM s)",
    "p1_top": f"{_P1} SELECT kmers, CAST(t AS BIGINT) AS counts FROM s ORDER BY t DESC, kmers LIMIT 100",
    "p2_found": f"{_P2} SELECT t.cid, c.cutoff FROM keep_targets t LEFT JOIN c ON c.cid = t.cid",
    "p2_kept": f"{_P2} SELECT t.cid, CAST(COALESCE(n.n, 0) AS BIGINT) AS n, c.cutoff, CAST(COALESCE(c.kept, 0) AS BIGINT) AS kept FROM keep_targets t LEFT JOIN n ON n.cid = t.cid LEFT JOIN c ON c.cid = t.cid",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
