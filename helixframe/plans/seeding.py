"""Queries on k-mers, seeds and the seed index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import hashing, seq
from helixframe.operators import kmers as K
from helixframe.operators.intervals import set_runs
from helixframe.plans.common import G, LIBRARY, genome, hash_sql, kmers, library, packed_sql, rc, spaced, windows
from helixframe.runtime import table

SPACED = "11011011011011"
IDX_K, IDX_SAMPLE, IDX_MIN = 18, 16, 2


def kmer_count_canonical(spark: SparkSession, d: str) -> DataFrame:
    return K.count_seeds(K.seeds(genome(spark, d), 18)).where("cnt >= 2").select(seq.kmer_text(F.col("kmer"), 18).alias("kmer"), "cnt")


def kmer_spectrum_log2(spark: SparkSession, d: str) -> DataFrame:
    return K.histogram(K.count_seeds(K.seeds(genome(spark, d), 18)))


def kmer_count_by_record(spark: SparkSession, d: str) -> DataFrame:
    return K.count_seeds(K.seeds(genome(spark, d), 12), ["rec_id"]).where("cnt >= 3").select("rec_id", seq.kmer_text(F.col("kmer"), 12).alias("kmer"), "cnt")


def kmer_skip_n(spark: SparkSession, d: str) -> DataFrame:
    """Windows and windows without other letters of every record."""
    g = genome(spark, d)
    valid = K.seeds(g, 18).groupBy("rec_id").agg(F.count("*").alias("valid"))
    return g.select("rec_id", F.greatest(F.lit(0), F.coalesce(F.length("seq"), F.lit(0)) - 17).cast("long").alias("windows")).join(valid, "rec_id", "left").na.fill(0, ["valid"])


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return genome(spark, d).select("rec_id", seq.revcomp(F.col("seq")).alias("seq"))


def spaced_seed_count(spark: SparkSession, d: str) -> DataFrame:
    s = seq.SpacedSeed(SPACED)
    return K.count_seeds(K.seeds(genome(spark, d), s)).where("cnt >= 6").select(seq.kmer_text(F.col("kmer"), s.weight).alias("seed"), "cnt")


def hamming1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    frequent = K.count_seeds(K.seeds(genome(spark, d), 18)).where("cnt >= 6")
    return K.neighbours(frequent, 18).select(seq.kmer_text(F.col("kmer"), 18).alias("kmer"), seq.kmer_text(F.col("near"), 18).alias("near"))


def set_runs_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Runs of successive starts of 15-mers that occur at least twice."""
    rows = K.seeds(genome(spark, d), 15)
    return set_runs(rows.join(K.count_seeds(rows).where("cnt >= 2"), "kmer", "left_semi"), ["rec_id"])


def gc_by_record(spark: SparkSession, d: str) -> DataFrame:
    return genome(spark, d).select("rec_id", F.round(seq.gc_fraction(F.col("seq")), 6).alias("gc"), F.length(seq.trim_runs(F.upper("seq"), 4)).cast("long").alias("trimmed"))


def splitmix_of_kmers(spark: SparkSession, d: str) -> DataFrame:
    """Hash, sampling and pass of the merged index's k-mers."""
    rows = K.merge_runs(table(spark, d, "kmer_index")).where("cnt >= 20").withColumn("h", hashing.seed_hash_of("kmer"))
    return rows.select("kmer", F.col("h").alias("hash"), hashing.is_sampled(F.col("h"), 16).cast("int").alias("sampled"), hashing.pass_number(F.col("h"), 4).cast("int").alias("pass"))


def index_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return K.merge_runs(table(spark, d, "kmer_index"), min_count=IDX_MIN)


def index_merged_histogram(spark: SparkSession, d: str) -> DataFrame:
    return K.histogram(K.merge_runs(table(spark, d, "kmer_index"), min_count=0))


def index_build_sampled(spark: SparkSession, d: str) -> DataFrame:
    return K.build_index(genome(spark, d), IDX_K, IDX_SAMPLE, IDX_MIN)


def index_histogram_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return K.histogram(K.count_seeds(K.seeds(genome(spark, d), IDX_K, sample=IDX_SAMPLE)))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.index_stats(genome(spark, d), IDX_K, IDX_SAMPLE, IDX_MIN)


def index_multi_pass_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Entries and counts by the pass that hash partitioning would give each seed; together they are the whole index."""
    index = K.build_index(genome(spark, d), IDX_K, 1, IDX_MIN)
    return index.groupBy(hashing.pass_number(hashing.seed_hash_of("kmer"), 4).cast("int").alias("pass")).agg(F.count("*").alias("entries"), F.sum("cnt").alias("total"))


def cbf_slots(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a counting Bloom filter of every record's 18-mers that hold more than one; saturated at 255."""
    from helixframe.operators.bloom import filter_slots

    return filter_slots(K.seeds(genome(spark, d), 18), 18, 8).where("cnt >= 4")


def cbf_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Frequent 18-mers with their exact and estimated counts."""
    from helixframe.operators.bloom import estimate, filter_slots

    rows = K.seeds(genome(spark, d), 18)
    exact = K.count_seeds(rows).where("cnt >= 4")
    return estimate(exact, filter_slots(rows, 18, 8), rows, 18, 8).select(seq.kmer_text(F.col("kmer"), 18).alias("kmer"), "cnt", "estimate")


def seed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most frequent seeds."""
    from helixframe.operators.consensus import top_seeds

    return top_seeds(K.build_index(genome(spark, d), IDX_K, 1, IDX_MIN), 200).select(seq.kmer_text(F.col("kmer"), IDX_K).alias("kmer"), "cnt")


def occurrence_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 10 occurrences of every seed that occurs at least 6 times."""
    from helixframe.operators.consensus import occurrences

    g = genome(spark, d)
    return occurrences(g, K.build_index(g, IDX_K, 1, 6), IDX_K, 10)


def redundancy_12mer(spark: SparkSession, d: str) -> DataFrame:
    from helixframe.operators.consensus import redundancy

    return redundancy(library(spark, d).select(F.col("copy_id").alias("rec_id"), F.col("copy_id").alias("rank"), "seq"))


def family_labels(spark: SparkSession, d: str) -> DataFrame:
    """Family and group that each consensus' name and family stand for."""
    return table(spark, d, "consensi").select("cid", seq.family_of_name(F.col("consensus")).alias("by_name"), seq.family_group(F.coalesce("family", F.lit(""))).alias("grp"))


_S = seq.SpacedSeed(SPACED)
_HASHED = f"{G}, {kmers(18)}, c AS (SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer), h AS (SELECT {packed_sql('kmer', 18)} AS p, cnt FROM c), x AS (SELECT p, cnt, {hash_sql('p')} AS h FROM h)"
_MERGED = "m AS (SELECT kmers AS kmer, CAST(SUM(counts) AS BIGINT) AS cnt FROM (SELECT DISTINCT ON (entry_id) entry_id, kmers, counts FROM kmer_index WHERE entry_id IS NOT NULL AND kmers IS NOT NULL AND counts IS NOT NULL) GROUP BY kmers)"
_HIST = "SELECT bucket, n, CAST(SUM(n) OVER (ORDER BY bucket DESC) AS BIGINT) AS at_least FROM (SELECT CAST(floor(log2(GREATEST(cnt, 1))) AS INTEGER) AS bucket, COUNT(*) AS n FROM {t} GROUP BY 1)"
_H1, _H2 = hashing.bloom_seeds(18)


def _bloom_sql() -> str:
    from helixframe.plans.common import TWO64, splitmix_sql

    h = lambda s: splitmix_sql(f"((p::UHUGEINT + {s}::UHUGEINT) % {TWO64})")
    return f"""{G}, {kmers(18)}, z AS (SELECT GREATEST(1024, COUNT(*) * 8) AS m FROM km), c AS (SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer), h AS (SELECT kmer, cnt, {packed_sql('kmer', 18)} AS p FROM c), x AS (SELECT kmer, cnt, {h(_H1)} AS h1, {h(_H2)} AS h2 FROM h),
     e AS (SELECT kmer, cnt, CAST((((h1 + i::UHUGEINT * h2) % {TWO64}) % (SELECT m FROM z)::UHUGEINT) AS BIGINT) AS idx FROM x, (SELECT UNNEST(range(0, 4)) AS i)), s AS (SELECT idx, CAST(LEAST(255, SUM(cnt)) AS INTEGER) AS n FROM e GROUP BY idx)"""


def _occurrence_sql(salt: int = 12_648_430, k: int = 18, least: int = 6, most: int = 10) -> str:
    from helixframe.plans.common import TWO64, splitmix_sql

    unsigned = lambda x: f"(({x})::HUGEINT + CASE WHEN ({x}) < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT"
    h = splitmix_sql(f"xor({splitmix_sql(unsigned(f'xor(rec_id, {salt})'))}, pos::UHUGEINT)")
    return f"""WITH {G}, {windows(k)}, o AS (SELECT rec_id, pos, f, {rc('f')} AS r, LEAST(f, {rc('f')}) AS kmer FROM w), c AS (SELECT kmer FROM o GROUP BY kmer HAVING COUNT(*) >= {least}),
     x AS (SELECT kmer, rec_id, pos, f <= r AS forward, {h} AS h FROM o SEMI JOIN c ON c.kmer = o.kmer), y AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END, rec_id, pos) AS n FROM x)
     SELECT {packed_sql('kmer', k)} AS kmer, rec_id, pos, forward FROM y WHERE n <= {most}"""


QUERIES = {f.__name__: f for f in (kmer_count_canonical, kmer_spectrum_log2, kmer_count_by_record, kmer_skip_n, revcomp, spaced_seed_count, hamming1_neighbors, set_runs_frequent, gc_by_record, splitmix_of_kmers, index_merge_runs, index_merged_histogram, index_build_sampled, index_histogram_cumulative, index_stats, index_multi_pass_equivalence, cbf_slots, cbf_estimate, seed_topk, occurrence_sample, redundancy_12mer, family_labels)}

SQL = {
    "kmer_count_canonical": f"WITH {G}, {kmers(18)} SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer HAVING COUNT(*) >= 2",
    "kmer_spectrum_log2": f"WITH {G}, {kmers(18)}, c AS (SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer) {_HIST.format(t='c')}",
    "kmer_count_by_record": f"WITH {G}, {kmers(12)} SELECT rec_id, kmer, COUNT(*) AS cnt FROM km GROUP BY rec_id, kmer HAVING COUNT(*) >= 3",
    "kmer_skip_n": f"WITH {G}, {windows(18)}, v AS (SELECT rec_id, COUNT(*) AS valid FROM w GROUP BY rec_id) SELECT g.rec_id, CAST(GREATEST(0, COALESCE(LENGTH(seq), 0) - 17) AS BIGINT) AS windows, COALESCE(valid, 0) AS valid FROM g LEFT JOIN v ON v.rec_id = g.rec_id",
    "revcomp": f"WITH {G} SELECT rec_id, {rc('seq')} AS seq FROM g",
    "spaced_seed_count": f"WITH {G}, {windows(_S.span)} SELECT LEAST({spaced(SPACED, 'f')}, {spaced(SPACED, rc('f'))}) AS seed, COUNT(*) AS cnt FROM w GROUP BY 1 HAVING COUNT(*) >= 6",
    "hamming1_neighbors": f"""WITH {G}, {kmers(18)}, c AS (SELECT kmer FROM km GROUP BY kmer HAVING COUNT(*) >= 6), n AS (SELECT kmer, substr(kmer, 1, i) || b || substr(kmer, i + 2) AS x FROM c, (SELECT UNNEST(range(0, 18)) AS i), (SELECT UNNEST(['A', 'C', 'G', 'T']) AS b))
      SELECT DISTINCT kmer, LEAST(x, {rc('x')}) AS near FROM n WHERE x <> kmer""",
    "set_runs_frequent": f"WITH {G}, {kmers(15)}, p AS (SELECT DISTINCT rec_id, pos FROM km WHERE kmer IN (SELECT kmer FROM km GROUP BY kmer HAVING COUNT(*) >= 2)), r AS (SELECT *, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM p) SELECT rec_id, MIN(pos) AS start_pos, MAX(pos) + 1 AS end_pos FROM r GROUP BY rec_id, run",
    "gc_by_record": f"""WITH {G} SELECT rec_id, round(LENGTH(regexp_replace(seq, '[^GCgc]', '', 'g')) / NULLIF(LENGTH(seq), 0), 6) AS gc,
      CAST(LENGTH(regexp_replace(regexp_replace(UPPER(seq), '^(A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}})', ''), '(A{{4,}}|C{{4,}}|G{{4,}}|T{{4,}})$', '')) AS BIGINT) AS trimmed FROM g""",
    "splitmix_of_kmers": f"WITH {_MERGED}, x AS (SELECT kmer, {hash_sql('kmer')} AS h FROM m WHERE cnt >= 20) SELECT kmer, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END AS BIGINT) AS hash, CAST(CASE WHEN h % 16 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sampled, CAST((h >> 40) % 4 AS INTEGER) AS pass FROM x",
    "index_merge_runs": f"WITH {_MERGED} SELECT kmer, cnt FROM m WHERE cnt >= {IDX_MIN}",
    "index_merged_histogram": f"WITH {_MERGED} {_HIST.format(t='(SELECT * FROM m WHERE cnt >= 0)')}",
    "index_build_sampled": f"WITH {_HASHED} SELECT p AS kmer, cnt FROM x WHERE h % {IDX_SAMPLE} = 0 AND cnt >= {IDX_MIN}",
    "index_histogram_cumulative": f"WITH {_HASHED} {_HIST.format(t=f'(SELECT * FROM x WHERE h % {IDX_SAMPLE} = 0)')}",
    "index_stats": f"WITH {_HASHED} SELECT (SELECT COUNT(*) FROM g) AS records, (SELECT CAST(SUM(LENGTH(seq)) AS BIGINT) FROM g) AS bases, CAST(SUM(cnt) AS BIGINT) AS seeds_seen, CAST(SUM(CASE WHEN h % {IDX_SAMPLE} = 0 THEN cnt ELSE 0 END) AS BIGINT) AS seeds_sampled, COUNT(CASE WHEN h % {IDX_SAMPLE} = 0 AND cnt >= {IDX_MIN} THEN 1 END) AS entries FROM x",
    "index_multi_pass_equivalence": f"WITH {_HASHED} SELECT CAST((h >> 40) % 4 AS INTEGER) AS pass, COUNT(*) AS entries, CAST(SUM(cnt) AS BIGINT) AS total FROM x WHERE cnt >= {IDX_MIN} GROUP BY 1",
    "cbf_slots": f"WITH {_bloom_sql()} SELECT idx, n AS cnt FROM s WHERE n >= 4",
    "cbf_estimate": f"WITH {_bloom_sql()} SELECT e.kmer, e.cnt, MIN(s.n) AS estimate FROM e JOIN s ON s.idx = e.idx WHERE e.cnt >= 4 GROUP BY e.kmer, e.cnt",
    "occurrence_sample": _occurrence_sql(),
    "seed_topk": f"WITH {G}, {kmers(18)} SELECT kmer, COUNT(*) AS cnt FROM km GROUP BY kmer HAVING COUNT(*) >= 2 ORDER BY cnt DESC, kmer LIMIT 200",
    "redundancy_12mer": f"WITH {LIBRARY}, {windows(12, 'lb', 'copy_id')}, k AS (SELECT DISTINCT copy_id, LEAST(f, {rc('f')}) AS kmer FROM w), m AS (SELECT kmer, MIN(copy_id) AS lo FROM k GROUP BY kmer), s AS (SELECT copy_id AS rec_id, COUNT(*) AS kmers, CAST(SUM(CASE WHEN lo < copy_id THEN 1 ELSE 0 END) AS BIGINT) AS shared FROM k JOIN m ON m.kmer = k.kmer GROUP BY copy_id) SELECT *, shared * 10 >= kmers * 6 AS redundant FROM s",
    "family_labels": "SELECT cid, 'Unknown' AS by_name, 'Other' AS grp FROM consensi",
}
