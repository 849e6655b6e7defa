"""Queries that mask sequences and handle masks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import kmers as K
from helixframe.operators import masks as M
from helixframe.operators.counted import mask_by_counts
from helixframe.operators.intervals import union_named
from helixframe.operators.tiles import union_intervals
from helixframe.plans.common import COPIES, G, chains_sql, copies, genome, hash_sql, kmers, packed_sql, placed, rc, spaced, union_sql, windows
from helixframe.runtime import checkpoint
from helixframe.sources import text

_SP2 = "11011011011011011011"


def mask_graph_exact(spark: SparkSession, d: str) -> DataFrame:
    """Counts within the record."""
    return M.mask_graph(genome(spark, d), 12, 2)


def mask_graph_genome(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all records."""
    return M.mask_graph(_records(spark, d), 15, 3, scope="genome")


def mask_graph_mismatch1(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_graph(genome(spark, d), 12, 2, mismatch=True)


def mask_window_density(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_windows(genome(spark, d), 12, 2)


def mask_multi_k_union(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_multi_k(genome(spark, d), [11, 12, 15], 2)


def mask_assembly_components(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_components(genome(spark, d), 12, 2, least=20)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records that are read several times, once to count seeds and once to look them up."""
    return checkpoint(genome(spark, d).select("rec_id", "seq"))


def _hits(spark: SparkSession, d: str, low: int, high: int) -> DataFrame:
    g = _records(spark, d)
    return M.mask_indexed(g, K.build_index(g, 15, 1, 2), 15, low=low, high=high)


def mask_indexed(spark: SparkSession, d: str) -> DataFrame:
    return M.link_hits(_hits(spark, d, 3, 3))


def mask_indexed_sampled(spark: SparkSession, d: str) -> DataFrame:
    """The usual way: an index of one seed in 16, in which only such seeds are looked up."""
    g = _records(spark, d)
    return M.link_hits(M.mask_indexed(g, K.build_index(g, 18, 16, 2), 18, 16, 2, 4), gap=250)


def mask_spaced_sampled(spark: SparkSession, d: str) -> DataFrame:
    """The same with a spaced seed."""
    g, s = _records(spark, d), seq.SpacedSeed(_SP2)
    return M.link_hits(M.mask_indexed(g, K.build_index(g, s, 16, 2), s, 16, 2, 4), gap=250)


def mask_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return mask_by_counts(genome(spark, d), 15, 2, 5, gap=250)


def mask_density_gate(spark: SparkSession, d: str) -> DataFrame:
    return mask_by_counts(genome(spark, d), 15, 2, 3, gap=100, min_hits=20, min_density=0.3)


def mask_two_index_union(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a contiguous and of a spaced index, linked together."""
    g, s = _records(spark, d), seq.SpacedSeed(_SP2)
    plain = M.mask_indexed(g, K.build_index(g, 15, 1, 2), 15)
    return M.link_hits(plain.unionByName(M.mask_indexed(g, K.build_index(g, s, 1, 2), s)), gap=150)


def mask_graph_long(spark: SparkSession, d: str) -> DataFrame:
    """As mask_graph_exact, with all records above 1,000 bases counted as long ones."""
    return M.mask_graph(genome(spark, d), 12, 2, whole=1000)


def mask_windows_long(spark: SparkSession, d: str) -> DataFrame:
    """As mask_window_density, with all records above 1,000 bases counted as long ones."""
    return M.mask_windows(genome(spark, d), 12, 2, whole=1000)


def mask_tandem_long(spark: SparkSession, d: str) -> DataFrame:
    """As mask_tandem, with all records above 1,000 bases linked and tested as long ones."""
    return M.mask_tandem(genome(spark, d), whole=1000)


def tandem_period_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.tandem_runs(genome(spark, d))


def mask_tandem(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_tandem(genome(spark, d))


def dust_score(spark: SparkSession, d: str) -> DataFrame:
    return M.dust_windows(genome(spark, d), 64, 2.0)


def mask_dust(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_dust(genome(spark, d), 64, 2.0)


def mask_layered_union(spark: SparkSession, d: str) -> DataFrame:
    """Index, tandem and low-complexity layers and annotated copies in one; the name is that of the first named region."""
    g = genome(spark, d)
    name = lambda df, n: df.select("rec_id", "start_pos", "end_pos", n.alias("name"))
    layers = name(M.link_hits(_hits(spark, d, 3, 3)), F.lit("")).unionByName(name(M.mask_tandem(g), F.concat(F.lit("tandem:period="), F.col("period").cast("string")))).unionByName(name(M.mask_dust(g, 64, 2.0), F.lit("dust")))
    return union_named(layers.unionByName(name(copies(spark, d), F.coalesce("family", F.lit("")))), ["rec_id"]).select("rec_id", "start_pos", "end_pos")


def merge_named_regions(spark: SparkSession, d: str) -> DataFrame:
    """Masked regions merged, with the first name in each; of equal places the first by name."""
    rows = placed(spark, d, "masked_region").withColumn("name", F.when(F.col("name") == ".", "").otherwise(F.coalesce("name", F.lit(""))))
    return union_named(rows.select("asm_id", "chrom", "start_pos", "end_pos", "name").distinct(), ["asm_id", "chrom"])


def soft_mask(spark: SparkSession, d: str) -> DataFrame:
    """Upper-cased records with annotated copies in lower case."""
    return M.apply_mask(genome(spark, d).withColumn("seq", F.upper("seq")), copies(spark, d), "soft")


def hard_mask(spark: SparkSession, d: str) -> DataFrame:
    return M.apply_mask(genome(spark, d), copies(spark, d), "hard")


def demask(spark: SparkSession, d: str) -> DataFrame:
    return genome(spark, d).select("rec_id", F.upper("seq").alias("seq"))


def soft_mask_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.case_runs(genome(spark, d), "lower")


def n_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.case_runs(genome(spark, d), "other")


def compare_mask_by_record(spark: SparkSession, d: str) -> DataFrame:
    """The records' own soft mask as reference, annotated copies as prediction."""
    g = genome(spark, d)
    return M.compare_masks(g, M.apply_mask(g.withColumn("seq", F.upper("seq")), copies(spark, d)))


def compare_mask_total(spark: SparkSession, d: str) -> DataFrame:
    """By assembly, and in all (null)."""
    by = compare_mask_by_record(spark, d).join(genome(spark, d).select("rec_id", "asm_id"), "rec_id")
    return by.rollup("asm_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def regions_to_bed(spark: SparkSession, d: str) -> DataFrame:
    return text.bed_lines(placed(spark, d, "masked_region").dropDuplicates(["region_id"]), F.col("chrom"))


def regions_to_gtf(spark: SparkSession, d: str) -> DataFrame:
    regions = union_intervals(placed(spark, d, "masked_region"), ["asm_id", "chrom"])
    return text.gtf_lines(regions, F.col("chrom"), ["asm_id", "chrom", "start_pos"])


_MASKED = "mk AS (SELECT DISTINCT rec_id, UNNEST(range(start_pos, end_pos)) AS pos FROM cp), ch AS (SELECT rec_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 1) AS c FROM (SELECT rec_id, seq, UNNEST(range(0, LENGTH(seq))) AS pos FROM g))"
_HITS = f"{G}, {kmers(15)}, ix AS (SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer HAVING COUNT(*) >= 2)"


def _hits_sql(low: int, high: int) -> str:
    return f"{_HITS}, ht AS (SELECT rec_id, pos, pos + 15 AS stop, cnt >= {high} AS strong FROM km JOIN ix ON ix.kmer = km.kmer WHERE cnt >= {low})"


def _link_sql(gap: int, min_hits: int = 1, density: float = 0.0) -> str:
    return f"{chains_sql('ht', 'cc', gap, ', MAX(stop) AS stop, BOOL_OR(strong) AS strong, COUNT(*) AS hits')} SELECT rec_id, first AS start_pos, stop AS end_pos, hits FROM cc WHERE strong AND stop - first >= 30 AND hits >= {min_hits} AND hits >= (stop - first) * {density}"


def _sampled_sql(k: int, span: int, low: int, high: int, gap: int) -> str:
    """Hits of the seeds of CTE km that one in 16 keeps, by counts of their own, linked."""
    return f"""c AS (SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer HAVING COUNT(*) >= {low}), x AS (SELECT kmer, cnt, {hash_sql('p')} AS h FROM (SELECT kmer, cnt, {packed_sql('kmer', k)} AS p FROM c)),
     ht AS (SELECT rec_id, pos, pos + {span} AS stop, cnt >= {high} AS strong FROM km JOIN x ON x.kmer = km.kmer WHERE h % 16 = 0), {_link_sql(gap)}"""


def graph_sql(k: int, t: int, gap: int = 100, scope: str = "record", name: str = "gr", first: bool = True) -> str:
    """CTEs of graph masking of the k-mers km{k}, which the first use of k makes."""
    by = "rec_id, kmer" if scope == "record" else "kmer"
    made = kmers(k, f"km{k}", f"w{k}") + ", " if first else ""
    return f"{made}{name}_h AS (SELECT rec_id, pos FROM (SELECT *, COUNT(*) OVER (PARTITION BY {by}) AS cnt FROM km{k}) WHERE cnt >= {t}), {chains_sql(f'{name}_h', f'{name}_c', gap)}, {name} AS (SELECT rec_id, first AS start_pos, last + {k - 1} AS end_pos FROM {name}_c WHERE last + {k - 1} - first >= 30)"


_TANDEM = f"""{G}, {windows(5)}, lk AS (SELECT rec_id, pos, pos - LAG(pos) OVER (PARTITION BY rec_id, f ORDER BY pos) AS period FROM w), lp AS (SELECT * FROM lk WHERE period <= 500),
 lb AS (SELECT *, CASE WHEN pos > LAG(pos) OVER (PARTITION BY rec_id, period ORDER BY pos) + period + 5 THEN 1 ELSE 0 END AS brk FROM lp), ls AS (SELECT *, SUM(brk) OVER (PARTITION BY rec_id, period ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM lb),
 tr AS (SELECT rec_id, period, MIN(pos) - period AS start_pos, MAX(pos) + 5 AS end_pos, COUNT(*) AS matches FROM ls GROUP BY rec_id, period, r),
 tn AS (SELECT * FROM tr WHERE end_pos - start_pos >= 20 AND end_pos - start_pos >= 2 * period AND matches >= 0.25 * GREATEST(1, end_pos - start_pos - period))"""
_TANDEM_MASK = f"""{_TANDEM}, tb AS (SELECT tn.*, UPPER(substr(seq, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT))) AS s FROM tn JOIN g ON g.rec_id = tn.rec_id),
 ti AS (SELECT * FROM tb WHERE list_sum(list_transform(range(CAST(period AS BIGINT) + 1, LENGTH(s) + 1), lambda i: CASE WHEN substr(s, i, 1) = substr(s, i - CAST(period AS BIGINT), 1) THEN 1 ELSE 0 END)) >= 0.7 * (LENGTH(s) - period))"""
_DUST = f"""{windows(3, name='w3')}, tc AS (SELECT rec_id, pos, f FROM w3), tw AS (SELECT rec_id, f, UNNEST(range(GREATEST(0, pos - 61), pos + 1)) AS win FROM tc),
 tg AS (SELECT rec_id, win, f, COUNT(*) AS c FROM tw GROUP BY rec_id, win, f), ds AS (SELECT rec_id, win AS start_pos, CAST(SUM(c * (c - 1) // 2) AS BIGINT) AS pairs FROM tg GROUP BY rec_id, win HAVING SUM(c) = 62 AND SUM(c * (c - 1) // 2) > 2.0 * 61)"""

QUERIES = {f.__name__: f for f in (mask_graph_exact, mask_graph_genome, mask_graph_mismatch1, mask_window_density, mask_multi_k_union, mask_assembly_components, mask_graph_long, mask_windows_long, mask_indexed, mask_indexed_sampled, mask_spaced_sampled, mask_hysteresis, mask_density_gate, mask_two_index_union, tandem_period_runs, mask_tandem, mask_tandem_long, dust_score, mask_dust, mask_layered_union, merge_named_regions, soft_mask, hard_mask, demask, soft_mask_runs, n_runs, compare_mask_by_record, compare_mask_total, regions_to_bed, regions_to_gtf)}

_CASE_RUNS = "WITH {g}, ch AS (SELECT rec_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 1) AS c FROM (SELECT rec_id, seq, UNNEST(range(0, LENGTH(seq))) AS pos FROM g)), p AS (SELECT rec_id, pos FROM ch WHERE {test}), r AS (SELECT *, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM p) SELECT rec_id, MIN(pos) AS start_pos, MAX(pos) + 1 AS end_pos FROM r GROUP BY rec_id, run"
_COMPARE = f"{G}, {COPIES}, {_MASKED}, b AS (SELECT ch.rec_id, ch.c NOT IN ('A', 'C', 'G', 'T') AS m, mk.pos IS NOT NULL AND UPPER(ch.c) <> LOWER(ch.c) AS q FROM ch LEFT JOIN mk ON mk.rec_id = ch.rec_id AND mk.pos = ch.pos), s AS (SELECT rec_id, COUNT(CASE WHEN m AND q THEN 1 END) AS tp, COUNT(CASE WHEN NOT m AND q THEN 1 END) AS fp, COUNT(CASE WHEN m AND NOT q THEN 1 END) AS fn, COUNT(CASE WHEN NOT m AND NOT q THEN 1 END) AS tn FROM b GROUP BY rec_id)"

_DENSE = f"""WITH {G}, {kmers(12)}, hi AS (SELECT rec_id, pos FROM (SELECT *, COUNT(*) OVER (PARTITION BY rec_id, kmer) AS cnt FROM km) WHERE cnt >= 2), al AS (SELECT rec_id, n, UNNEST(range(0, n)) AS pos FROM (SELECT rec_id, LENGTH(seq) AS n FROM g)),
      fl AS (SELECT al.rec_id, al.n, al.pos, CASE WHEN hi.pos IS NULL THEN 0 ELSE 1 END AS h FROM al LEFT JOIN hi ON hi.rec_id = al.rec_id AND hi.pos = al.pos), wn AS (SELECT *, SUM(h) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 28 FOLLOWING) AS c FROM fl),
      sp AS (SELECT rec_id, pos AS start_pos, pos + 40 AS end_pos FROM wn WHERE pos <= n - 40 AND c >= 8), {union_sql('sp', 'rec_id', 'u')} SELECT * FROM u WHERE end_pos - start_pos >= 30"""

SQL = {
    "mask_graph_exact": f"WITH {G}, {graph_sql(12, 2)} SELECT * FROM gr",
    "mask_graph_genome": f"WITH {G}, {graph_sql(15, 3, scope='genome')} SELECT * FROM gr",
    "mask_graph_mismatch1": f"""WITH {G}, {kmers(12)}, hi AS (SELECT rec_id, kmer FROM km GROUP BY rec_id, kmer HAVING COUNT(*) >= 2), nb AS (SELECT rec_id, substr(kmer, 1, i) || b || substr(kmer, i + 2) AS x FROM hi, (SELECT UNNEST(range(0, 12)) AS i), (SELECT UNNEST(['A', 'C', 'G', 'T']) AS b)),
      wd AS (SELECT DISTINCT rec_id, LEAST(x, {rc('x')}) AS kmer FROM nb), ht AS (SELECT km.rec_id, pos FROM km JOIN wd ON wd.rec_id = km.rec_id AND wd.kmer = km.kmer), {chains_sql('ht', 'cc', 100)} SELECT rec_id, first AS start_pos, last + 11 AS end_pos FROM cc WHERE last + 11 - first >= 30""",
    "mask_window_density": _DENSE,
    "mask_windows_long": _DENSE,
    "mask_multi_k_union": f"WITH {G}, {graph_sql(11, 2, name='ga')}, {graph_sql(12, 2, name='gb')}, {graph_sql(15, 2, name='gc')}, al AS (SELECT * FROM ga UNION ALL SELECT * FROM gb UNION ALL SELECT * FROM gc), {union_sql('al', 'rec_id', 'u')} SELECT * FROM u WHERE end_pos - start_pos >= 30",
    "mask_assembly_components": f"""WITH RECURSIVE {G}, {kmers(12)}, hi AS (SELECT rec_id, pos, kmer, cnt FROM (SELECT *, COUNT(*) OVER (PARTITION BY rec_id, kmer) AS cnt FROM km) WHERE cnt >= 2), rn AS (SELECT *, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM hi),
      fi AS (SELECT rec_id, kmer, MIN(run) AS b FROM rn GROUP BY rec_id, kmer), ed AS (SELECT DISTINCT rn.rec_id, run AS a, b FROM rn JOIN fi ON fi.rec_id = rn.rec_id AND fi.kmer = rn.kmer UNION SELECT DISTINCT rn.rec_id, b, run FROM rn JOIN fi ON fi.rec_id = rn.rec_id AND fi.kmer = rn.kmer),
      cl AS (SELECT DISTINCT rec_id, run AS a, run AS b FROM rn UNION SELECT cl.rec_id, cl.a, ed.b FROM cl JOIN ed ON ed.rec_id = cl.rec_id AND ed.a = cl.b), cm AS (SELECT rec_id, a AS run, MIN(b) AS comp FROM cl GROUP BY rec_id, a),
      sz AS (SELECT rec_id, comp, SUM(cnt) AS total FROM (SELECT DISTINCT rn.rec_id, comp, kmer, cnt FROM rn JOIN cm ON cm.rec_id = rn.rec_id AND cm.run = rn.run) GROUP BY rec_id, comp),
      sp AS (SELECT rn.rec_id, pos AS start_pos, pos + 12 AS end_pos FROM rn JOIN cm ON cm.rec_id = rn.rec_id AND cm.run = rn.run JOIN sz ON sz.rec_id = cm.rec_id AND sz.comp = cm.comp WHERE total >= 20), {union_sql('sp', 'rec_id', 'u')} SELECT * FROM u WHERE end_pos - start_pos >= 30""",
    "mask_indexed": f"WITH {_hits_sql(3, 3)}, {_link_sql(150)}",
    "mask_graph_long": f"WITH {G}, {graph_sql(12, 2)} SELECT * FROM gr",
    "mask_indexed_sampled": f"WITH {G}, {kmers(18)}, {_sampled_sql(18, 18, 2, 4, 250)}",
    "mask_spaced_sampled": f"WITH {G}, {windows(20)}, km AS (SELECT rec_id, pos, LEAST({spaced(_SP2, 'f')}, {spaced(_SP2, rc('f'))}) AS kmer FROM w), {_sampled_sql(seq.SpacedSeed(_SP2).weight, 20, 2, 4, 250)}",
    "mask_hysteresis": f"WITH {_hits_sql(2, 5)}, {_link_sql(250)}",
    "mask_density_gate": f"WITH {_hits_sql(2, 3)}, {_link_sql(100, 20, 0.3)}",
    "mask_two_index_union": f"""WITH {_HITS}, {windows(20, name='w2')}, k2 AS (SELECT rec_id, pos, LEAST({spaced(_SP2, 'f')}, {spaced(_SP2, rc('f'))}) AS kmer FROM w2), i2 AS (SELECT kmer, COUNT(*) AS cnt FROM k2 GROUP BY kmer HAVING COUNT(*) >= 2),
      ht AS (SELECT rec_id, pos, pos + 15 AS stop, TRUE AS strong FROM km JOIN ix ON ix.kmer = km.kmer WHERE cnt >= 3 UNION ALL SELECT rec_id, pos, pos + 20, TRUE FROM k2 JOIN i2 ON i2.kmer = k2.kmer WHERE cnt >= 3), {_link_sql(150)}""",
    "tandem_period_runs": f"WITH {_TANDEM} SELECT * FROM tn",
    "mask_tandem": f"WITH {_TANDEM_MASK} SELECT rec_id, start_pos, end_pos, period, matches FROM ti",
    "mask_tandem_long": f"WITH {_TANDEM_MASK} SELECT rec_id, start_pos, end_pos, period, matches FROM ti",
    "dust_score": f"WITH {G}, {_DUST} SELECT * FROM ds",
    "mask_dust": f"WITH {G}, {_DUST}, sp AS (SELECT rec_id, start_pos, start_pos + 64 AS end_pos FROM ds), {union_sql('sp', 'rec_id', 'u')} SELECT * FROM u",
    "mask_layered_union": f"WITH {_TANDEM_MASK}, {_DUST}, {COPIES}, {_hits_sql(3, 3).removeprefix(G + ', ').replace('w AS (', 'w15 AS (').replace('FROM w)', 'FROM w15)')}, {_link_sql(150).replace(' SELECT rec_id, first AS start_pos', ', lh AS (SELECT rec_id, first AS start_pos')}), al AS (SELECT rec_id, start_pos, end_pos FROM lh UNION ALL SELECT rec_id, start_pos, end_pos FROM ti UNION ALL SELECT rec_id, start_pos, start_pos + 64 FROM ds UNION ALL SELECT rec_id, start_pos, end_pos FROM cp), {union_sql('al', 'rec_id', 'u')} SELECT * FROM u",
    "merge_named_regions": f"""WITH b AS (SELECT DISTINCT asm_id, chrom, start_pos, end_pos, CASE WHEN name IS NULL OR name = '.' THEN '' ELSE name END AS name FROM masked_region WHERE chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos),
      o AS (SELECT *, MAX(end_pos) OVER (PARTITION BY asm_id, chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b), i AS (SELECT *, SUM(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY asm_id, chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM o)
      SELECT asm_id, chrom, MIN(start_pos) AS start_pos, MAX(end_pos) AS end_pos, COALESCE(FIRST(name ORDER BY start_pos, end_pos, name) FILTER (WHERE name <> ''), '') AS name FROM i GROUP BY asm_id, chrom, isl""",
    "soft_mask": f"WITH {G}, {COPIES}, {_MASKED} SELECT ch.rec_id, string_agg(CASE WHEN mk.pos IS NULL THEN UPPER(c) ELSE LOWER(c) END, '' ORDER BY ch.pos) AS seq FROM ch LEFT JOIN mk ON mk.rec_id = ch.rec_id AND mk.pos = ch.pos GROUP BY ch.rec_id",
    "hard_mask": f"WITH {G}, {COPIES}, {_MASKED} SELECT ch.rec_id, string_agg(CASE WHEN mk.pos IS NULL THEN c ELSE 'N' END, '' ORDER BY ch.pos) AS seq FROM ch LEFT JOIN mk ON mk.rec_id = ch.rec_id AND mk.pos = ch.pos GROUP BY ch.rec_id",
    "demask": f"WITH {G} SELECT rec_id, UPPER(seq) AS seq FROM g",
    "soft_mask_runs": _CASE_RUNS.format(g=G, test="c <> UPPER(c)"),
    "n_runs": _CASE_RUNS.format(g=G, test="UPPER(c) NOT IN ('A', 'C', 'G', 'T')"),
    "compare_mask_by_record": f"WITH {_COMPARE} SELECT * FROM s",
    "compare_mask_total": f"WITH {_COMPARE} SELECT asm_id, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, CAST(SUM(tn) AS BIGINT) AS tn FROM s JOIN g ON g.rec_id = s.rec_id GROUP BY ROLLUP (asm_id)",
    "regions_to_bed": "SELECT chrom || chr(9) || start_pos || chr(9) || end_pos || chr(9) || CASE WHEN name IS NULL OR name = '' THEN '.' ELSE name END AS value FROM (SELECT DISTINCT ON (region_id) * FROM masked_region WHERE chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos)",
    "regions_to_gtf": f"WITH b AS (SELECT * FROM masked_region WHERE chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos), {union_sql('b', 'asm_id, chrom', 'u')} SELECT concat_ws(chr(9), chrom, 'helixframe', 'repeat', start_pos + 1, end_pos, '.', '.', '.', 'repeat_id \"' || (row_number() OVER (ORDER BY asm_id, chrom, start_pos) - 1) || '\"') AS value FROM u",
}
