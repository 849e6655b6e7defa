"""Queries that evaluate, compare and sweep interval tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import intervals as I
from helixframe.operators import masks as M
from helixframe.operators import tuning
from helixframe.operators.tiles import covered_bases, overlap_pieces, union_intervals
from helixframe.plans.common import COPIES, G, PLACED, chains_sql, copies, genome, kmers, placed, rc, union_sql
from helixframe.plans.masking import graph_sql
from helixframe.runtime import checkpoint

KEYS = ["asm_id", "chrom"]


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return union_intervals(placed(spark, d, "ref_interval"), KEYS)


def interval_covered_bp(spark: SparkSession, d: str) -> DataFrame:
    return covered_bases(placed(spark, d, "ref_interval"), KEYS)


def interval_intersection_bp(spark: SparkSession, d: str) -> DataFrame:
    return I.sweep_counts(placed(spark, d, "ref_interval"), placed(spark, d, "masked_region"), KEYS)


def interval_depth(spark: SparkSession, d: str) -> DataFrame:
    """Bases of each assembly by how many annotations and masked regions cover them."""
    once = lambda n, i: placed(spark, d, n).dropDuplicates([i])
    seg = I.depth_segments({"truth": once("ref_interval", "interval_id"), "pred": once("masked_region", "region_id")}, KEYS, gaps=True)
    return seg.groupBy("asm_id", F.least("truth", F.lit(3)).cast("int").alias("truth"), F.least("pred", F.lit(3)).cast("int").alias("pred")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


def interval_except(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(placed(spark, d, "ref_interval"), placed(spark, d, "masked_region"), KEYS)


def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Common stretches of merged annotations and merged masked regions."""
    a, b = union_intervals(placed(spark, d, "ref_interval"), KEYS), union_intervals(placed(spark, d, "masked_region"), KEYS)
    return overlap_pieces(a, b, KEYS).groupBy(*KEYS, "start_pos", "end_pos", "right_start", "right_end").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("common"))


def point_in_interval_asof(spark: SparkSession, d: str) -> DataFrame:
    """Whether each candidate's start lies in an annotation, by as-of lookup."""
    points = placed(spark, d, "candidate").where("cand_id IS NOT NULL").dropDuplicates(["cand_id"]).select("cand_id", *KEYS, F.col("start_pos").alias("pos"))
    return I.point_in_interval(points, union_intervals(placed(spark, d, "ref_interval"), KEYS), KEYS)


def evaluate_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = I.evaluate(placed(spark, d, "ref_interval"), placed(spark, d, "masked_region"), KEYS)
    return m.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def evaluate_per_family_recall(spark: SparkSession, d: str) -> DataFrame:
    return I.family_recall(placed(spark, d, "ref_interval"), placed(spark, d, "masked_region"), KEYS).withColumn("recall", F.round("recall", 4))


def tune_mask_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five settings of graph masking whose masks agree best with the annotated copies."""
    return tuning.tune_graph(genome(spark, d), copies(spark, d), [11, 12, 15], [2, 3], [100, 250], top=5).withColumn("f1", F.round("f1", 6))


FULL_KS, FULL_T, FULL_GAPS = [11, 12, 15], [2], [0, 100]


def tune_mask_full(spark: SparkSession, d: str) -> DataFrame:
    """The ten best settings of sets of k, linking or windows, with or without a mismatch."""
    out = tuning.tune_masks(checkpoint(genome(spark, d).select("rec_id", "seq")), copies(spark, d), FULL_KS, FULL_T, FULL_GAPS, [False, True], top=10)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def session_gap_link(spark: SparkSession, d: str) -> DataFrame:
    """Periods of activity of a user, events at most 30 minutes apart, as gap linking of seconds."""
    from helixframe.runtime import table

    e = table(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("pos"))
    return I.link_gaps(e, ["user_id"], "pos", 1800, events=("sum", F.lit(1).cast("long")))


_BOTH = f"t AS (SELECT * FROM ref_interval WHERE {PLACED}), p AS (SELECT * FROM masked_region WHERE {PLACED}), {union_sql('t', 'asm_id, chrom', 'tu')}, {union_sql('p', 'asm_id, chrom', 'pu')}"
_JOIN = "SELECT {cols} FROM tu JOIN pu ON tu.asm_id = pu.asm_id AND tu.chrom = pu.chrom AND tu.start_pos < pu.end_pos AND pu.start_pos < tu.end_pos"
_COMMON = "LEAST(tu.end_pos, pu.end_pos) - GREATEST(tu.start_pos, pu.start_pos)"
_SIZES = f"""{_BOTH}, a AS (SELECT asm_id, chrom, SUM(end_pos - start_pos) AS truth FROM tu GROUP BY ALL), b AS (SELECT asm_id, chrom, SUM(end_pos - start_pos) AS pred FROM pu GROUP BY ALL), c AS ({_JOIN.format(cols=f'tu.asm_id, tu.chrom, SUM({_COMMON}) AS bth')} GROUP BY ALL),
 s AS (SELECT COALESCE(a.asm_id, b.asm_id) AS asm_id, COALESCE(a.chrom, b.chrom) AS chrom, CAST(COALESCE(truth, 0) AS BIGINT) AS truth, CAST(COALESCE(pred, 0) AS BIGINT) AS pred, CAST(COALESCE(bth, 0) AS BIGINT) AS both_b FROM a FULL JOIN b ON a.asm_id = b.asm_id AND a.chrom = b.chrom LEFT JOIN c ON c.asm_id = COALESCE(a.asm_id, b.asm_id) AND c.chrom = COALESCE(a.chrom, b.chrom))"""


def _prf(tp: str, pred: str, truth: str, digits: int) -> str:
    p, r = f"CASE WHEN {pred} > 0 THEN {tp} / {pred} ELSE 0.0 END", f"CASE WHEN {truth} > 0 THEN {tp} / {truth} ELSE 0.0 END"
    return f"round({p}, {digits}) AS precision, round({r}, {digits}) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / ({p} + {r}) ELSE 0.0 END, {digits}) AS f1"


def _tune_sql() -> str:
    grid = [(k, t, gap) for k in (11, 12, 15) for t in (2, 3) for gap in (100, 250)]
    parts = [graph_sql(k, t, gap, name=f"g{i}", first=(t, gap) == (2, 100)) for i, (k, t, gap) in enumerate(grid)]
    unions = [union_sql(f"g{i}", "rec_id", f"u{i}") for i in range(len(grid))]
    rows = [f"SELECT {k} AS k, {t} AS threshold, {gap} AS gap, COALESCE((SELECT SUM(end_pos - start_pos) FROM u{i}), 0) AS pred, COALESCE((SELECT SUM(end_pos - start_pos) FROM cu), 0) AS truth, COALESCE((SELECT SUM(LEAST(a.end_pos, b.end_pos) - GREATEST(a.start_pos, b.start_pos)) FROM u{i} a JOIN cu b ON a.rec_id = b.rec_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos), 0) AS tp" for i, (k, t, gap) in enumerate(grid)]
    return f"WITH {G}, {COPIES}, {', '.join(parts)}, {', '.join(unions)}, {union_sql('cp', 'rec_id', 'cu')}, al AS ({' UNION ALL '.join(rows)}) SELECT k, threshold, gap, CAST(truth AS BIGINT) AS truth_bases, CAST(pred AS BIGINT) AS pred_bases, CAST(tp AS BIGINT) AS both_bases, round(CASE WHEN pred + truth > 0 THEN 2 * tp / (pred + truth) ELSE 0.0 END, 6) AS f1 FROM al ORDER BY CASE WHEN pred + truth > 0 THEN 2 * tp / (pred + truth) ELSE 0.0 END DESC, k, threshold, gap LIMIT 5"


def _full_sql() -> str:
    parts, names = [], {}
    for k in FULL_KS:
        parts.append(kmers(k, f"km{k}", f"w{k}"))
        for t in FULL_T:
            parts.append(f"hi{k}{t} AS (SELECT rec_id, kmer FROM km{k} GROUP BY rec_id, kmer HAVING COUNT(*) >= {t})")
            parts.append(f"nb{k}{t} AS (SELECT DISTINCT rec_id, LEAST(x, {rc('x')}) AS kmer FROM (SELECT rec_id, substr(kmer, 1, i) || b || substr(kmer, i + 2) AS x FROM hi{k}{t}, (SELECT UNNEST(range(0, {k})) AS i), (SELECT UNNEST(['A', 'C', 'G', 'T']) AS b)))")
            for m, near in ((0, "hi"), (1, "nb")):
                h = f"h{k}{t}{m}"
                parts.append(f"{h} AS (SELECT a.rec_id, a.pos FROM km{k} a JOIN {near}{k}{t} b ON a.rec_id = b.rec_id AND a.kmer = b.kmer)")
                for gap in FULL_GAPS:
                    name = f"r{k}{t}{m}{gap}"
                    if gap:
                        parts += [chains_sql(h, f"c{name}", gap), f"{name} AS (SELECT rec_id, first AS start_pos, last + {k - 1} AS end_pos FROM c{name} WHERE last + {k - 1} - first >= 30)"]
                    else:
                        starts = 40 - k + 1
                        parts += [
                            f"f{name} AS (SELECT al.rec_id, al.n, al.pos, CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END AS h FROM al LEFT JOIN {h} h ON h.rec_id = al.rec_id AND h.pos = al.pos)",
                            f"w{name} AS (SELECT *, SUM(h) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {starts - 1} FOLLOWING) AS c FROM f{name})",
                            f"s{name} AS (SELECT rec_id, pos AS start_pos, pos + 40 AS end_pos FROM w{name} WHERE pos <= n - 40 AND c >= {-(-starts // 4)})",
                            union_sql(f"s{name}", "rec_id", f"v{name}"),
                            f"{name} AS (SELECT * FROM v{name} WHERE end_pos - start_pos >= 30)",
                        ]
                    names[k, t, m, gap] = name
    rows = []
    for n, s in enumerate(tuning.k_sets(FULL_KS)):
        for t in FULL_T:
            for gap in FULL_GAPS:
                for m in (0, 1):
                    u = f"q{n}_{t}{gap}{m}"
                    parts += [f"{u} AS ({' UNION ALL '.join(f'SELECT * FROM {names[k, t, m, gap]}' for k in s)})", union_sql(u, "rec_id", f"{u}u")]
                    rows.append(f"SELECT '{','.join(map(str, s))}' AS ks, {t} AS threshold, {gap} AS gap, {bool(m)} AS mismatch, COALESCE((SELECT SUM(end_pos - start_pos) FROM {u}u), 0) AS pred, COALESCE((SELECT SUM(LEAST(a.end_pos, b.end_pos) - GREATEST(a.start_pos, b.start_pos)) FROM {u}u a JOIN cu b ON a.rec_id = b.rec_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos), 0) AS tp, COALESCE((SELECT SUM(end_pos - start_pos) FROM cu), 0) AS truth")
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0.0 END"
    f = ratio("2 * tp", "pred + truth")
    return f"WITH {G}, {COPIES}, {union_sql('cp', 'rec_id', 'cu')}, al AS (SELECT rec_id, n, UNNEST(range(0, n)) AS pos FROM (SELECT rec_id, LENGTH(seq) AS n FROM g)), {', '.join(parts)}, z AS ({' UNION ALL '.join(rows)}) SELECT ks, threshold, gap, mismatch, CAST(truth AS BIGINT) AS truth_bases, CAST(pred AS BIGINT) AS pred_bases, CAST(tp AS BIGINT) AS both_bases, round({ratio('tp', 'pred')}, 6) AS precision, round({ratio('tp', 'truth')}, 6) AS recall, round({f}, 6) AS f1 FROM z ORDER BY {f} DESC, ks, threshold, gap, mismatch LIMIT 10"


QUERIES = {f.__name__: f for f in (interval_union, interval_covered_bp, interval_intersection_bp, interval_depth, interval_except, interval_overlaps, point_in_interval_asof, evaluate_metrics, evaluate_per_family_recall, tune_mask_topk, tune_mask_full, session_gap_link)}

_EVENTS = "e AS (SELECT asm_id, chrom, start_pos AS bp, 1 AS a, 0 AS b FROM {t} UNION ALL SELECT asm_id, chrom, end_pos, -1, 0 FROM {t} UNION ALL SELECT asm_id, chrom, start_pos, 0, 1 FROM {p} UNION ALL SELECT asm_id, chrom, end_pos, 0, -1 FROM {p}), x AS (SELECT asm_id, chrom, bp, SUM(a) AS a, SUM(b) AS b FROM e GROUP BY ALL), y AS (SELECT asm_id, chrom, bp AS start_pos, LEAD(bp) OVER w AS end_pos, SUM(a) OVER w AS a, SUM(b) OVER w AS b FROM x WINDOW w AS (PARTITION BY asm_id, chrom ORDER BY bp))"

SQL = {
    "interval_union": f"WITH t AS (SELECT * FROM ref_interval WHERE {PLACED}), {union_sql('t', 'asm_id, chrom', 'tu')} SELECT * FROM tu",
    "interval_covered_bp": f"WITH t AS (SELECT * FROM ref_interval WHERE {PLACED}), {union_sql('t', 'asm_id, chrom', 'tu')} SELECT asm_id, chrom, CAST(SUM(end_pos - start_pos) AS BIGINT) AS covered FROM tu GROUP BY ALL",
    "interval_intersection_bp": f'WITH {_SIZES} SELECT asm_id, chrom, truth, pred, both_b AS "both" FROM s',
    "interval_depth": f"WITH t AS (SELECT DISTINCT ON (interval_id) * FROM ref_interval WHERE {PLACED}), p AS (SELECT DISTINCT ON (region_id) * FROM masked_region WHERE {PLACED}), {_EVENTS.format(t='t', p='p')} SELECT asm_id, CAST(LEAST(a, 3) AS INTEGER) AS truth, CAST(LEAST(b, 3) AS INTEGER) AS pred, CAST(SUM(end_pos - start_pos) AS BIGINT) AS bases FROM y WHERE end_pos IS NOT NULL GROUP BY 1, 2, 3",
    "interval_except": f"WITH {_BOTH}, {_EVENTS.format(t='tu', p='pu')} SELECT asm_id, chrom, start_pos, end_pos FROM y WHERE a > 0 AND b = 0 AND end_pos IS NOT NULL",
    "interval_overlaps": f"WITH {_BOTH} {_JOIN.format(cols=f'tu.asm_id, tu.chrom, tu.start_pos, tu.end_pos, pu.start_pos AS right_start, pu.end_pos AS right_end, {_COMMON} AS common')}",
    "point_in_interval_asof": f"WITH t AS (SELECT * FROM ref_interval WHERE {PLACED}), {union_sql('t', 'asm_id, chrom', 'tu')}, c AS (SELECT DISTINCT ON (cand_id) cand_id, asm_id, chrom, start_pos AS pos FROM candidate WHERE cand_id IS NOT NULL AND {PLACED}) SELECT c.*, EXISTS (SELECT 1 FROM tu WHERE tu.asm_id = c.asm_id AND tu.chrom = c.chrom AND tu.start_pos <= c.pos AND c.pos < tu.end_pos) AS inside FROM c",
    "evaluate_metrics": f"WITH {_SIZES}, z AS (SELECT CAST(SUM(truth) AS BIGINT) AS truth_bases, CAST(SUM(pred) AS BIGINT) AS pred_bases, CAST(SUM(both_b) AS BIGINT) AS both_bases FROM s) SELECT *, {_prf('both_bases', 'pred_bases', 'truth_bases', 4)} FROM z",
    "evaluate_per_family_recall": f"""WITH t AS (SELECT * FROM ref_interval WHERE family IS NOT NULL AND {PLACED}), p AS (SELECT * FROM masked_region WHERE {PLACED}), {union_sql('t', 'asm_id, chrom, family', 'tu')}, {union_sql('p', 'asm_id, chrom', 'pu')}, a AS (SELECT family, SUM(end_pos - start_pos) AS n FROM tu GROUP BY family),
      b AS ({_JOIN.format(cols=f'family, SUM({_COMMON}) AS n')} GROUP BY family) SELECT a.family, CAST(a.n AS BIGINT) AS truth_bases, CAST(COALESCE(b.n, 0) AS BIGINT) AS hit_bases, round(COALESCE(b.n, 0) / a.n, 4) AS recall FROM a LEFT JOIN b ON a.family = b.family""",
    "tune_mask_topk": _tune_sql(),
    "tune_mask_full": _full_sql(),
    "session_gap_link": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), f AS (SELECT *, CASE WHEN pos > LAG(pos) OVER (PARTITION BY user_id ORDER BY pos) + 1800 THEN 1 ELSE 0 END AS brk FROM e),
      c AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS ch FROM f) SELECT user_id, MIN(pos) AS first, MAX(pos) AS last, COUNT(*) AS events FROM c GROUP BY user_id, ch""",
}
