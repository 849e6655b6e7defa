"""Queries on the consensus library: seeds, hits, alignment, building of consensi; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import align as A
from helixframe.operators import consensus as C
from helixframe.operators import kmers as K
from helixframe.operators.counted import seed_index
from helixframe.operators.models import substitution_summary
from helixframe.plans.common import COPIES, G, LIBRARY, copies, genome, library, rc, spaced, windows
from helixframe.runtime import free_shuffles, stored

PATTERN = "111010010100110111"
SPAN, WEIGHT = len(PATTERN), PATTERN.count("1")


def library_seed_table(spark: SparkSession, d: str) -> DataFrame:
    return A.library_seeds(library(spark, d), PATTERN).select("consensus", "reverse", seq.kmer_text(F.col("kmer"), WEIGHT).alias("seed"), "cpos")


def seed_complexity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Distinct seeds of the genome by whether they are complex enough for the library."""
    rows = K.seeds(genome(spark, d), seq.SpacedSeed(PATTERN, any_shape=True), strand="forward").select("kmer").distinct()
    return rows.groupBy(seq.complex_enough(F.col("kmer"), WEIGHT).alias("complex")).agg(F.count("*").alias("seeds"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return A.seed_hits(genome(spark, d), library(spark, d), PATTERN)


def library_seed_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy("rec_id", "consensus", "reverse").agg(F.count("*").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def diag_chain_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.diagonal_pairs(_hits(spark, d)).select("rec_id", "consensus", "reverse", "pos", "cpos", "prev_pos")


def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hits by the scores of their ungapped flanks."""
    return A.seed_hit_gates(genome(spark, d), library(spark, d), PATTERN).groupBy("gate_left", "gate_right").agg(F.count("*").alias("hits"))


def subst_table(spark: SparkSession, d: str) -> DataFrame:
    """The 16 counts of every seed hit."""
    return A.seed_hit_substitutions(genome(spark, d), library(spark, d), PATTERN)


def candidate_substitutions(spark: SparkSession, d: str) -> DataFrame:
    """The 16 counts of every accepted hit, with its place and score."""
    c = mask_library_chained(spark, d).select("rec_id", "start_pos", "end_pos", "consensus", "strand", "score", F.col("seed_pos").alias("pos"), F.col("seed_cpos").alias("cpos"), (F.col("strand") == "-").alias("reverse"))
    return A.substitution_table(c, genome(spark, d), library(spark, d), SPAN).drop("pos", "cpos", "reverse")


def subst_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.seed_substitution_counts(genome(spark, d), library(spark, d), PATTERN)


def ti_tv_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = substitution_summary(subst_counts(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("ti_tv", "transition_score", "transversion_score")})


def mask_library_chained(spark: SparkSession, d: str) -> DataFrame:
    return A.library_candidates(genome(spark, d), library(spark, d), A.Settings())


def mask_library_single_hit(spark: SparkSession, d: str) -> DataFrame:
    return A.library_candidates(genome(spark, d), library(spark, d), A.Settings(single_hit=True, gate=(-4, 2)))


def mask_library_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The fragment layer: a lighter seed, a low score, hits of at least 50 bases."""
    s = A.Settings(pattern="11011011011011", min_score=8, xdrop=30, single_hit=True, gate=(-6, 0))
    return A.library_candidates(genome(spark, d), library(spark, d), s).where("end_pos - start_pos >= 50")


def mask_library_regions(spark: SparkSession, d: str) -> DataFrame:
    return A.candidate_regions(mask_library_chained(spark, d))


def _read_often(spark: SparkSession, d: str) -> DataFrame:
    g = stored(genome(spark, d).select("rec_id", "seq"))
    free_shuffles(spark)
    return g


def consensus_build(spark: SparkSession, d: str) -> DataFrame:
    g = _read_often(spark, d)
    return C.build_consensi(g, seed_index(g, 18, 6), 18, min_seed_count=6, min_support=5)


def consensus_spaced(spark: SparkSession, d: str) -> DataFrame:
    """With a spaced seed, and a pool of a million."""
    g, p = _read_often(spark, d), seq.SpacedSeed("11011011011011011011")
    return C.build_consensi(g, seed_index(g, p, 6), p, min_seed_count=6, min_support=5, seed_pool=1_000_000)


def consensus_two_pass(spark: SparkSession, d: str) -> DataFrame:
    g = _read_often(spark, d)
    return C.build_consensi(g, seed_index(g, 18, 4), 18, min_seed_count=4, min_support=6, second_pass=True, second_min_support=3)


def majority_vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    cut = F.expr("substring(seq, CAST(start_pos + 1 AS INT), CAST(end_pos - start_pos AS INT))")
    rows = copies(spark, d).join(genome(spark, d).select("rec_id", "seq"), "rec_id").select("family", "copy_id", cut.alias("seq"))
    return C.majority_consensus(rows)


_BASES = ", ".join(f"LENGTH(s) - LENGTH(replace(s, '{b}', ''))" for b in "ACGT")
_COMPLEX = f"(list_sum(list_transform([{_BASES}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) >= 3 AND list_max([{_BASES}]) <= {WEIGHT - 3})"
_LIB_SEEDS = f"""{LIBRARY}, lo AS (SELECT consensus, FALSE AS reverse, seq FROM lb UNION ALL SELECT consensus, TRUE, {rc('seq')} FROM lb), {windows(SPAN, 'lo', 'consensus, reverse', 'lw')}, ls AS (SELECT consensus, reverse, pos AS cpos, {spaced(PATTERN, 'f')} AS s FROM lw), lt AS (SELECT consensus, reverse, s AS seed, cpos FROM ls WHERE {_COMPLEX})"""
_GEN_SEEDS = f"{windows(SPAN, name='gw')}, gs AS (SELECT rec_id, pos, {spaced(PATTERN, 'f')} AS seed FROM gw)"
_HITS = f"{_LIB_SEEDS}, {_GEN_SEEDS}, ht AS (SELECT rec_id, pos, consensus, reverse, cpos FROM gs JOIN lt ON lt.seed = gs.seed)"
_FLANKS = f"""{_HITS}, fl AS (SELECT ht.*, UPPER(g.seq) AS gq, lo.seq AS cq, LEAST(32, pos, cpos) AS l, GREATEST(0, LEAST(32, LENGTH(g.seq) - pos - {SPAN}, LENGTH(lo.seq) - cpos - {SPAN})) AS r FROM ht JOIN g ON g.rec_id = ht.rec_id JOIN lo ON lo.consensus = ht.consensus AND lo.reverse = ht.reverse),
 fw AS (SELECT substr(gq, CAST(pos - l + 1 AS BIGINT), CAST(l AS BIGINT)) AS gl, substr(cq, CAST(cpos - l + 1 AS BIGINT), CAST(l AS BIGINT)) AS cl, substr(gq, CAST(pos + {SPAN} + 1 AS BIGINT), CAST(r AS BIGINT)) AS gr, substr(cq, CAST(cpos + {SPAN} + 1 AS BIGINT), CAST(r AS BIGINT)) AS cr FROM fl)"""
_SUBST = f"{_FLANKS}, pr AS (SELECT UNNEST(string_split(cl || cr, '')) AS cons_base, UNNEST(string_split(gl || gr, '')) AS genome_base FROM fw WHERE LENGTH(gl) + LENGTH(gr) > 0), sc AS (SELECT cons_base, genome_base, COUNT(*) AS n FROM pr WHERE cons_base IN ('A', 'C', 'G', 'T') AND genome_base IN ('A', 'C', 'G', 'T') GROUP BY ALL)"


def _agree(a: str, b: str) -> str:
    return f"CAST(COALESCE(list_sum(list_transform(range(1, LENGTH({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, i, 1) THEN 1 ELSE -1 END)), 0) AS INTEGER)"


QUERIES = {f.__name__: f for f in (library_seed_table, seed_complexity_filter, library_seed_hits, diag_chain_pairs, gate_scores, subst_table, candidate_substitutions, subst_counts, ti_tv_ratio, mask_library_chained, mask_library_single_hit, mask_library_fragments, mask_library_regions, consensus_build, consensus_spaced, consensus_two_pass, majority_vote_consensus)}

SQL = {
    "majority_vote_consensus": f"""WITH {G}, {COPIES}, c AS (SELECT family, copy_id, UPPER(substr(g.seq, start_pos + 1, end_pos - start_pos)) AS s FROM cp JOIN g ON g.rec_id = cp.rec_id WHERE family IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY LENGTH(s) DESC, copy_id) AS n FROM c WHERE LENGTH(s) >= 100 AND LENGTH(s) - LENGTH(replace(s, 'N', '')) <= 0.3 * LENGTH(s)),
      t AS (SELECT t.family, t.n, t.s, b.s AS b FROM o t JOIN o b ON b.family = t.family AND b.n = 1 WHERE t.n <= 30), d AS (SELECT *, UNNEST(range(-20, 21)) AS d FROM t), l AS (SELECT *, GREATEST(0, d) AS lo, LEAST(LENGTH(b), LENGTH(s) + d) AS hi FROM d),
      e AS (SELECT *, CASE WHEN hi > lo THEN list_sum(list_transform(range(lo, hi), lambda i: CASE WHEN substr(b, i + 1, 1) = substr(s, i - d + 1, 1) THEN 1 ELSE 0 END)) ELSE -1 END AS same FROM l), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, n ORDER BY same DESC, d) AS r FROM e) WHERE r = 1),
      v AS (SELECT family, n, d, s, UNNEST(range(lo, hi)) AS i FROM q), w AS (SELECT family, i, substr(s, i - d + 1, 1) AS x, COUNT(*) AS votes, MIN(n) AS first FROM v GROUP BY ALL), y AS (SELECT family, i, x, row_number() OVER (PARTITION BY family, i ORDER BY votes DESC, first, x) AS r FROM w WHERE x IN ('A', 'C', 'G', 'T')),
      p AS (SELECT family, UNNEST(range(0, LENGTH(b))) AS i FROM t WHERE n = 1) SELECT p.family, CAST((SELECT COUNT(*) FROM t WHERE t.family = p.family) AS INTEGER) AS copies, string_agg(COALESCE(x, 'A'), '' ORDER BY p.i) AS seq FROM p LEFT JOIN y ON y.family = p.family AND y.i = p.i AND y.r = 1 GROUP BY p.family""",
    "library_seed_table": f"WITH {_LIB_SEEDS} SELECT * FROM lt",
    "seed_complexity_filter": f"WITH {LIBRARY}, {_GEN_SEEDS}, u AS (SELECT DISTINCT seed AS s FROM gs) SELECT {_COMPLEX} AS complex, COUNT(*) AS seeds FROM u GROUP BY 1",
    "library_seed_hits": f"WITH {_HITS} SELECT rec_id, consensus, reverse, COUNT(*) AS hits, MIN(pos) AS first, MAX(pos) AS last FROM ht GROUP BY ALL",
    "diag_chain_pairs": f"WITH {_HITS}, x AS (SELECT *, LAG(pos) OVER w AS p1, LAG(pos - cpos) OVER w AS d1, LAG(pos, 2) OVER w AS p2, LAG(pos - cpos, 2) OVER w AS d2 FROM ht WINDOW w AS (PARTITION BY rec_id, consensus, reverse ORDER BY pos, cpos)), y AS (SELECT *, CASE WHEN p1 < pos AND pos - p1 <= 64 AND abs(pos - cpos - d1) <= 3 THEN p1 WHEN p2 < pos AND pos - p2 <= 64 AND abs(pos - cpos - d2) <= 3 THEN p2 END AS prev_pos FROM x) SELECT rec_id, consensus, reverse, pos, cpos, prev_pos FROM y WHERE prev_pos IS NOT NULL",
    "gate_scores": f"WITH {_FLANKS} SELECT {_agree('gl', 'cl')} AS gate_left, {_agree('gr', 'cr')} AS gate_right, COUNT(*) AS hits FROM fw GROUP BY ALL",
    "subst_table": f"WITH {_FLANKS.replace(' FROM fl)', ', fl.rec_id, fl.pos, fl.consensus, fl.reverse, fl.cpos FROM fl)')}, pq AS (SELECT rec_id, pos, consensus, reverse, cpos, list_transform(range(1, LENGTH(cl || cr) + 1), lambda i: substr(cl || cr, i, 1) || substr(gl || gr, i, 1)) AS p FROM fw) SELECT rec_id, pos, consensus, reverse, cpos, {', '.join(f"CAST(len(list_filter(p, lambda x: x = '{a}{b}')) AS INTEGER) AS {a}{b}" for a in 'ACGT' for b in 'ACGT')} FROM pq",
    "subst_counts": f"WITH {_SUBST} SELECT * FROM sc",
    "ti_tv_ratio": f"""WITH {_SUBST}, s AS (SELECT CAST(SUM(CASE WHEN cons_base = genome_base THEN n ELSE 0 END) AS BIGINT) AS matches, CAST(SUM(CASE WHEN cons_base || genome_base IN ('AG', 'GA', 'CT', 'TC') THEN n ELSE 0 END) AS BIGINT) AS transitions, CAST(SUM(CASE WHEN cons_base <> genome_base AND cons_base || genome_base NOT IN ('AG', 'GA', 'CT', 'TC') THEN n ELSE 0 END) AS BIGINT) AS transversions FROM sc),
      r AS (SELECT *, transitions / (transitions + transversions) AS q FROM s) SELECT matches, transitions, transversions, round(transitions / transversions, 6) AS ti_tv, round(-0.75 / (0.75 * (q + (1 - q) * 1.5)), 6) AS transition_score, round(-0.75 / (0.75 * (q + (1 - q) * 1.5)) * 1.5, 6) AS transversion_score FROM r""",
}
