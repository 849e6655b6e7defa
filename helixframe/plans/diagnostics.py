"""Queries on pairs, labels and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import analysis as D
from helixframe.operators import kmers as K
from helixframe.operators.counted import seed_index
from helixframe.operators.tiles import SEQUENCE, union_intervals
from helixframe.plans.common import COPIES, G, LIBRARY, PLACED, copies, genome, library, packed_sql, placed, rc, union_sql, windows
from helixframe.plans.masking import SQL as MASKING
from helixframe.runtime import shared_folder, table
from helixframe.sources import text

#: So long that other places agree with a pair by chance only in far more than 10^10 bases.
PAIR_K = 18


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_pairs(genome(spark, d), PAIR_K)


def kmer_exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def pair_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.distance_summary(_pairs(spark, d))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return D.pairs_in_spans(_pairs(spark, d), union_intervals(copies(spark, d), ["rec_id"], limit=SEQUENCE))


def pair_sd_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return D.span_crosstab(_marked(spark, d))


def pair_sd_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return D.span_crosstab_by_distance(_marked(spark, d))


def pairs_to_regions(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_regions(_pairs(spark, d), length=PAIR_K, least=50, most=5000)


def label_library_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three families that cover most of each chromosome's annotations."""
    return D.top_labels(placed(spark, d, "ref_interval").where("interval_id IS NOT NULL").dropDuplicates(["interval_id"]), "chrom", "family")


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.length_histogram(table(spark, d, "consensi"), "cons_len")


def median_length(spark: SparkSession, d: str) -> DataFrame:
    return D.upper_median(genome(spark, d).select(F.length("seq").cast("long").alias("n")), "n")


def tblout_to_bed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates written as lines of a profile-search table, and read again with a least score."""
    c = placed(spark, d, "candidate").where("cand_id IS NOT NULL AND consensus IS NOT NULL AND score IS NOT NULL").dropDuplicates(["cand_id"])
    a, b = (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string")
    fwd = F.col("strand") == "+"
    line = F.concat_ws("  ", "chrom", F.lit("-"), "consensus", F.lit("-"), F.lit("1"), F.col("cons_len").cast("string"), F.when(fwd, a).otherwise(b), F.when(fwd, b).otherwise(a), a, b, F.lit("1000"), "strand", F.lit("1e-9"), F.col("score").cast("string"), F.lit("0.1"), F.lit("-"))
    return text.parse_hit_table(c.select(line.alias("value")), min_score=100.0)


def bed_filter_chrom(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d, "ref_interval").where("chrom = 'chr1' AND end_pos - start_pos >= 100").dropDuplicates(["interval_id"]).select("interval_id", F.lit("chrom_one").alias("chrom"), "start_pos", "end_pos")


def row_arity_check(spark: SparkSession, d: str) -> DataFrame:
    """Headers that aren't of one word."""
    return D.wrong_arity(genome(spark, d).select("rec_id", F.col("header").alias("value")), 1, " ")


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA and read again."""
    path = shared_folder(spark, "fasta")
    text.write_fasta(genome(spark, d), path)
    return text.read_fasta(spark, path)


def bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "bed")
    text.write_lines(text.bed_lines(placed(spark, d, "ref_interval").dropDuplicates(["interval_id"]), F.col("chrom"), "family"), path)
    return text.read_bed(spark, path).groupBy("chrom", "start_pos", "end_pos", "family").agg(F.count("*").alias("rows"))


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An index written in ranges of its seeds and read again."""
    path = shared_folder(spark, "index")
    text.write_index(K.build_index(genome(spark, d), PAIR_K, 1, 2), path, span=PAIR_K, sample=1, min_count=2)
    return text.read_index(spark, path, span=PAIR_K, sample=1).agg(F.count("*").alias("entries"), F.sum("cnt").alias("total"))


def candidate_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "candidates")
    c = placed(spark, d, "candidate").where("cand_id IS NOT NULL").dropDuplicates(["cand_id"]).withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    text.write_tsv(c.select(*[x.split()[0] for x in text.CANDIDATE_TSV.split(", ")]), path)
    return text.read_tsv(spark, path, text.CANDIDATE_TSV).groupBy("chrom", "strand").agg(F.count("*").alias("rows"), F.sum("score").alias("score"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def window_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Annotated copies cut out of chunked records."""
    chunks = text.chunk_records(genome(spark, d), 500)
    wanted = copies(spark, d).select(F.col("copy_id").alias("id"), "rec_id", "start_pos", "end_pos")
    return text.fetch_windows(wanted, chunks, 500).select("id", "rec_id", "seq")


def mask_stream(spark: SparkSession, d: str) -> DataFrame:
    """Records read as a stream, masked by a static index in micro-batches."""
    from helixframe.streaming.masking import stream_mask

    g = genome(spark, d)
    return stream_mask(spark, f"{d}/records.parquet", seed_index(g, 15), shared_folder(spark, "stream"), 15, 3)


def header_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records whose header says that they are drafts or screened, in any letter case."""
    return D.records_by_header(genome(spark, d), r"DRAFT|screened \d").select("rec_id", "header")


def augmented_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the library's consensi, and of the longest annotated copies as added sequences."""
    c = table(spark, d, "consensi").where("consensus IS NOT NULL").select(F.col("consensus").alias("name"), F.coalesce("family", F.lit("Unknown")).alias("family"), F.col("occurrences").cast("long").alias("hits"), F.col("cons_len").cast("long").alias("bases"), F.round(F.col("support") / F.greatest(F.lit(1), "occurrences"), 4).alias("share"))
    return D.with_added_labels(c, library(spark, d).withColumn("name", F.concat(F.lit("L2_"), "consensus")), seq="seq")


def index_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a written index, numbered in the order of their seeds."""
    from helixframe.operators.ordering import numbered

    path = shared_folder(spark, "index")
    text.write_index(K.build_index(genome(spark, d), PAIR_K, 1, 3), path, span=PAIR_K)
    return numbered(text.read_index(spark, path, span=PAIR_K), ["kmer"], "entry")


def event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream, counted by hour and type with a watermark."""
    from helixframe.streaming.masking import stream_windows

    return stream_windows(spark, f"{d}/events.parquet", shared_folder(spark, "windows"))


_PAIRS = f"{G}, {windows(PAIR_K)}, pr AS (SELECT f AS kmer, MIN(rec_id) AS rec_id, MIN(pos) AS pos1, MAX(pos) AS pos2 FROM w GROUP BY f HAVING COUNT(*) = 2 AND MIN(rec_id) = MAX(rec_id))"
_MARKED = f"{_PAIRS}, {COPIES}, {union_sql('cp', 'rec_id', 'cu')}, mk AS (SELECT pr.*, EXISTS (SELECT 1 FROM cu WHERE cu.rec_id = pr.rec_id AND cu.start_pos <= pos1 AND pos1 < cu.end_pos) AS in1, EXISTS (SELECT 1 FROM cu WHERE cu.rec_id = pr.rec_id AND cu.start_pos <= pos2 AND pos2 < cu.end_pos) AS in2 FROM pr)"
_CROSS = "COUNT(*) AS total, COUNT(CASE WHEN in1 AND in2 THEN 1 END) AS \"both\", COUNT(CASE WHEN in1 OR in2 THEN 1 END) AS at_least_one, COUNT(CASE WHEN NOT (in1 OR in2) THEN 1 END) AS neither"
_BAND = "CASE " + " ".join(f"WHEN abs(pos2 - pos1) >= {lo} AND abs(pos2 - pos1) < {hi} THEN {lo}::BIGINT" for lo, hi in zip(D.BANDS, D.BANDS[1:])) + " END"

QUERIES = {f.__name__: f for f in (kmer_exact_pairs, pair_distance_summary, pair_sd_crosstab, pair_sd_by_distance, pairs_to_regions, label_library_top3, length_histogram, median_length, tblout_to_bed, bed_filter_chrom, row_arity_check, fasta_round_trip, bed_round_trip, index_round_trip, candidate_round_trip, window_fetch, header_filter, augmented_labels, index_in_order, mask_stream, event_windows_stream)}

SQL = {
    "header_filter": f"WITH {G} SELECT rec_id, header FROM g WHERE regexp_matches(header, 'DRAFT|screened \\d', 'i')",
    "augmented_labels": f"WITH {LIBRARY} SELECT consensus AS name, COALESCE(family, 'Unknown') AS family, CAST(occurrences AS BIGINT) AS hits, CAST(cons_len AS BIGINT) AS bases, round(support / GREATEST(1, occurrences), 4) AS share FROM consensi WHERE consensus IS NOT NULL UNION ALL SELECT 'L2_' || consensus, 'LINE/L2', 0, LENGTH(seq), 0.0 FROM lb",
    "index_in_order": f"WITH {G}, {windows(PAIR_K)}, k AS (SELECT LEAST(f, {rc('f')}) AS kmer FROM w), c AS (SELECT kmer, COUNT(*) AS cnt FROM k GROUP BY kmer HAVING COUNT(*) >= 3) SELECT {packed_sql('kmer', PAIR_K)} AS kmer, cnt, row_number() OVER (ORDER BY kmer) - 1 AS entry FROM c",
    "mask_stream": MASKING["mask_indexed"],
    "kmer_exact_pairs": f"WITH {_PAIRS} SELECT * FROM pr",
    "pair_distance_summary": f"WITH {_PAIRS}, x AS (SELECT abs(pos2 - pos1) AS d FROM pr) SELECT COUNT(*) AS pairs, MIN(d) AS least, MAX(d) AS most, round(AVG(d), 4) AS mean, median(d) AS median, COUNT(CASE WHEN d >= 100 THEN 1 END) AS at_least_100, COUNT(CASE WHEN d >= 1000 THEN 1 END) AS at_least_1000, COUNT(CASE WHEN d >= 10000 THEN 1 END) AS at_least_10000 FROM x",
    "pair_sd_crosstab": f"WITH {_MARKED} SELECT {_CROSS} FROM mk",
    "pair_sd_by_distance": f"WITH {_MARKED} SELECT {_BAND} AS band, {_CROSS} FROM mk WHERE {_BAND} IS NOT NULL GROUP BY 1",
    "pairs_to_regions": f"WITH {_PAIRS}, e AS (SELECT rec_id, UNNEST([pos1, pos2]) AS p FROM pr WHERE abs(pos2 - pos1) >= 50 AND abs(pos2 - pos1) < 5000), r AS (SELECT rec_id, GREATEST(0, p - 50) AS start_pos, p + 50 + {PAIR_K} AS end_pos FROM e), {union_sql('r', 'rec_id', 'u')} SELECT * FROM u",
    "label_library_top3": f"WITH t AS (SELECT DISTINCT ON (interval_id) * FROM ref_interval WHERE interval_id IS NOT NULL AND {PLACED}), p AS (SELECT chrom, family, SUM(end_pos - start_pos) AS bases FROM t WHERE family IS NOT NULL GROUP BY ALL), r AS (SELECT *, SUM(bases) OVER (PARTITION BY chrom) AS al, row_number() OVER (PARTITION BY chrom ORDER BY bases DESC, family) AS place FROM p) SELECT chrom, family, CAST(bases AS BIGINT) AS bases, CAST(bases * 1000 // al AS BIGINT) AS permille, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3",
    "length_histogram": "SELECT CAST(cons_len // 100 * 100 AS BIGINT) AS bucket, COUNT(*) AS n FROM consensi WHERE cons_len IS NOT NULL GROUP BY 1",
    "median_length": f"WITH {G}, n AS (SELECT LENGTH(seq) AS n, row_number() OVER (ORDER BY LENGTH(seq)) - 1 AS i, COUNT(*) OVER () AS c FROM g WHERE seq IS NOT NULL) SELECT n AS median FROM n WHERE i = c // 2",
    "tblout_to_bed": f"SELECT chrom, start_pos, end_pos, CASE WHEN consensus LIKE 'CR1%' THEN 'LINE/CR1' WHEN consensus = 'MIR' THEN 'SINE/MIR' WHEN consensus = 'L2' THEN 'LINE/L2' ELSE consensus END AS family, CAST(score AS DOUBLE) AS score, 1e-9::DOUBLE AS evalue FROM (SELECT DISTINCT ON (cand_id) * FROM candidate WHERE cand_id IS NOT NULL AND consensus IS NOT NULL AND score IS NOT NULL AND {PLACED}) WHERE score >= 100",
    "bed_filter_chrom": f"SELECT DISTINCT ON (interval_id) interval_id, 'chrom_one' AS chrom, start_pos, end_pos FROM ref_interval WHERE chrom = 'chr1' AND end_pos - start_pos >= 100 AND {PLACED}",
    "row_arity_check": f"WITH {G} SELECT rec_id, header AS value, CAST(len(string_split(header, ' ')) AS INTEGER) AS n_fields FROM g WHERE len(string_split(header, ' ')) <> 1",
    "fasta_round_trip": f"WITH {G} SELECT header, chrom, seq FROM g",
    "bed_round_trip": f"SELECT chrom, start_pos, end_pos, COALESCE(family, '.') AS family, COUNT(*) AS rows FROM (SELECT DISTINCT ON (interval_id) * FROM ref_interval WHERE {PLACED}) GROUP BY ALL",
    "index_round_trip": f"WITH {G}, {windows(18)}, k AS (SELECT LEAST(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, COUNT(*) AS c FROM w GROUP BY 1 HAVING COUNT(*) >= 2) SELECT COUNT(*) AS entries, CAST(SUM(c) AS BIGINT) AS total FROM k",
    "candidate_round_trip": f"SELECT chrom, strand, COUNT(*) AS rows, CAST(SUM(score) AS BIGINT) AS score, CAST(SUM(end_pos - start_pos) AS BIGINT) AS bases FROM (SELECT DISTINCT ON (cand_id) * FROM candidate WHERE cand_id IS NOT NULL AND {PLACED}) GROUP BY chrom, strand",
    "window_fetch": f"WITH {G}, {COPIES} SELECT copy_id AS id, cp.rec_id, substr(seq, start_pos + 1, end_pos - start_pos) AS seq FROM cp JOIN g ON g.rec_id = cp.rec_id",
    "event_windows_stream": "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
