"""Queries on labelled candidates: thresholds, scores, sweeps, training; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import models as L
from helixframe.plans.common import PLACED, placed, union_sql
from helixframe.runtime import checkpoint, shared_folder, table
from helixframe.sources import text

KEYS = ["asm_id", "chrom"]
#: Chromosomes to train on; the others show how a model does.
TRAIN, NOT_TRAIN = "pmod(xxhash64(chrom), 2) = 0", "pmod(xxhash64(chrom), 2) <> 0"
TAUS = [t / 20 for t in range(2, 19)]
KEPT_TAUS = [0.2, 0.4, 0.6, 0.8]
#: Least precision of a chosen cutoff; few candidates of the test tables are annotated.
FLOOR = 0.001
#: Families that the specialist is for.
RARE = 5
#: A fixed logistic model: weights, bias, means, deviations.
WEIGHTS = [0.8, 0.3, 1.1, 0.4, -0.2, 0.6, 0.5, 0.1]
BIAS, MU, SD = -0.3, [250.0, 5.0, 1.5, 0.5, 0.45, 10.0, 2.0, 6.5], [200.0, 1.0, 1.0, 0.4, 0.1, 15.0, 10.0, 0.8]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return L.label(placed(spark, d, "candidate"), placed(spark, d, "ref_interval"), KEYS)


def label_candidates_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("cand_id", "size", "overlap", "label")


def threshold_per_consensus(spark: SparkSession, d: str) -> DataFrame:
    return L.base_thresholds(_labelled(spark, d))


def threshold_length_weighted(spark: SparkSession, d: str) -> DataFrame:
    return L.vote_thresholds(_labelled(spark, d), 8, F.col("size"))


def threshold_count_weighted(spark: SparkSession, d: str) -> DataFrame:
    return L.vote_thresholds(_labelled(spark, d), 15, F.lit(1).cast("long"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return L.features(_labelled(spark, d)).withColumn("prob", F.round(L.probability(WEIGHTS, BIAS, MU, SD), 9))


def logistic_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("cand_id", F.round("prob", 6).alias("prob"))


def tau_sweep_f1(spark: SparkSession, d: str) -> DataFrame:
    s = L.sweep(_scored(spark, d), TAUS)
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def standard_features(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the features by strand."""
    s = L.standardisation(L.features(placed(spark, d, "candidate").where("cand_id IS NOT NULL").dropDuplicates(["cand_id"])), ["strand"])
    return s.select("strand", *[F.round(c, 5).alias(c) for c in s.columns if c != "strand"])


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Consensi by the first letter of their family: up to M in 'early', later ones in 'late', those without in no group."""
    rows = table(spark, d, "consensi").where("consensus IS NOT NULL AND family IS NOT NULL").select("consensus", F.when(F.col("family") < "N", "early").otherwise("late").alias("grp"), (F.col("cid") % 5 / 10).alias("shift"))
    return rows.dropDuplicates(["consensus"])


def family_model_apply(spark: SparkSession, d: str) -> DataFrame:
    """A fixed model for the early group, thresholds for all others."""
    rows = L.features(_labelled(spark, d))
    out = L.apply_models(rows, _fixed_model(spark), _groups(spark, d), threshold_count_weighted(spark, d))
    return out.select("cand_id", "grp", F.round("prob", 6).alias("prob"), "kept")


def _fixed_model(spark: SparkSession, tau: float = 0.5) -> DataFrame:
    return spark.createDataFrame([("early", WEIGHTS, MU, SD, BIAS, tau)], "grp string, w array<double>, mu array<double>, sd array<double>, b0 double, tau double")


def family_model_file(spark: SparkSession, d: str) -> DataFrame:
    """The same with the model written as text with another cutoff, the cutoff set in the text, and the text read again."""
    folder = shared_folder(spark, "model")
    made = text.model_lines(_fixed_model(spark, 0.9), _groups(spark, d), threshold_count_weighted(spark, d))
    lines = made.coalesce(1).sortWithinPartitions("place").select(F.explode(F.split("value", "\n")).alias("value"))
    text.write_lines(text.set_tau(lines, 0.5), folder)
    out = L.apply_models(L.features(_labelled(spark, d)), *text.read_model_file(spark, folder))
    return out.select("cand_id", "grp", F.round("prob", 6).alias("prob"), "kept")


def kept_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How the merged candidates kept at each of a few cutoffs agree with all annotations."""
    s = L.evaluate_kept(_scored(spark, d), placed(spark, d, "ref_interval"), KEYS, KEPT_TAUS)
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def best_tau_floor(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff of the best F1 among those with enough precision, by size-weighted labels."""
    return L.best_tau(L.sweep(_scored(spark, d), TAUS), FLOOR).select("tau", "tp", "fp", "fn")


def rare_family_labels(spark: SparkSession, d: str) -> DataFrame:
    """Which candidates touch an annotation of the five rarest families, and of any."""
    truth = placed(spark, d, "ref_interval")
    return L.touch_labels(placed(spark, d, "candidate"), truth, L.rare_families(truth, RARE), KEYS).select("cand_id", "target", "any")


def train_rare_family(spark: SparkSession, d: str) -> DataFrame:
    """A specialist for the five rarest families, trained on some chromosomes, and how it finds them on the others."""
    truth = placed(spark, d, "ref_interval")
    rare = checkpoint(L.rare_families(truth, RARE))
    rows = L.features(L.touch_labels(placed(spark, d, "candidate"), truth, rare, KEYS).withColumn("label", F.col("target")))
    scored = _trained_on_some(rows)
    return L.evaluate_kept(scored, truth.where(NOT_TRAIN).join(F.broadcast(rare), "family", "left_semi"), KEYS, TAUS)


def _trained_on_some(rows: DataFrame) -> DataFrame:
    """The rows of the other chromosomes with prob, by a model with an offset for each consensus; none if there is no model."""
    rows = checkpoint(rows)
    model = L.train_groups(rows.where(TRAIN).withColumn("grp", F.lit("all")), "grp", offset="consensus")
    shifts = model.select(F.explode("shifts").alias("consensus", "shift"), "grp")
    groups = rows.where("consensus IS NOT NULL").select("consensus").distinct().join(shifts, "consensus", "left").select("consensus", F.lit("all").alias("grp"), F.coalesce("shift", F.lit(0.0)).alias("shift"))
    return L.apply_models(rows.where(NOT_TRAIN), model.drop("shifts", "rows"), groups).where("prob IS NOT NULL")


def train_group_logistic(spark: SparkSession, d: str) -> DataFrame:
    """A model for each group of consensi."""
    rows = L.features(_labelled(spark, d)).join(_groups(spark, d), "consensus", "left").withColumn("grp", F.coalesce("grp", F.lit("Other")))
    return L.train_groups(rows, "grp")


def train_logistic(spark: SparkSession, d: str) -> DataFrame:
    """One model for all with an offset for each consensus, trained on some chromosomes, and how the merged candidates that
    it keeps agree with the annotations of the others."""
    scored = _trained_on_some(L.features(_labelled(spark, d)))
    return L.evaluate_kept(scored, placed(spark, d, "ref_interval").where(NOT_TRAIN), KEYS, TAUS)


def train_gbt(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees, trained on some chromosomes; counts of right and wrong labels on the others, none without a model."""
    rows = checkpoint(L.tree_features(_labelled(spark, d)).select("cand_id", "chrom", "label", "t_cons", *[f"t_{i}" for i in range(16)]))
    fitted = L.train_trees(rows.where(TRAIN))
    scored = fitted.transform(rows.where(NOT_TRAIN)) if fitted else rows.where("false").withColumn("prediction", F.lit(0.0))
    return scored.groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("rows"))


_LABELLED = f"""t AS (SELECT * FROM ref_interval WHERE {PLACED}), {union_sql('t', 'asm_id, chrom', 'tu')}, c AS (SELECT DISTINCT ON (cand_id) * FROM candidate WHERE cand_id IS NOT NULL AND {PLACED}),
 ov AS (SELECT cand_id, SUM(LEAST(c.end_pos, tu.end_pos) - GREATEST(c.start_pos, tu.start_pos)) AS o FROM c JOIN tu ON tu.asm_id = c.asm_id AND tu.chrom = c.chrom AND tu.start_pos < c.end_pos AND c.start_pos < tu.end_pos GROUP BY cand_id),
 lb AS (SELECT c.*, c.end_pos - c.start_pos AS size, CAST(COALESCE(o, 0) AS BIGINT) AS overlap, CASE WHEN 2 * COALESCE(o, 0) >= c.end_pos - c.start_pos THEN 1 ELSE 0 END AS label FROM c LEFT JOIN ov ON ov.cand_id = c.cand_id)"""


def _best(by: str, gain: str, name: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    where = f"{by} IS NOT NULL AND score IS NOT NULL" if by else "consensus IS NOT NULL AND score IS NOT NULL"
    return f"{name}_r AS (SELECT {cols}score, SUM(SUM({gain})) OVER ({part} ORDER BY score DESC) AS net, COUNT(*) AS c FROM lb WHERE {where} GROUP BY {cols}score), {name} AS (SELECT {cols}arg_max(score, (net, score)) AS threshold, MAX(net) AS net, SUM(c) AS n FROM {name}_r {f'GROUP BY {by}' if by else ''})"


_FEAT = """ft AS (SELECT *, CAST(score AS DOUBLE) AS f_score, ln(size) AS f_len, score / size AS f_per_base, (cons_fwd + cons_bwd) / cons_len AS f_cover, gc AS f_gc, CAST(gate_left + gate_right AS DOUBLE) AS f_gate, CAST(LEAST(gate_left, gate_right) AS DOUBLE) AS f_side, ln(cons_len) AS f_cons FROM lb
 WHERE score IS NOT NULL AND cons_len > 0 AND gc IS NOT NULL AND cons_fwd IS NOT NULL AND cons_bwd IS NOT NULL AND gate_left IS NOT NULL AND gate_right IS NOT NULL)"""
_Z = " + ".join(f"{w} * ({c} - {m}) / {s}" for c, w, m, s in zip(L.FEATURES, WEIGHTS, MU, SD))
_SIGMOID = "1 / (1 + exp(-GREATEST(LEAST({z}, 30), -30)))"
_SCORED = f"{_LABELLED}, {_FEAT}, sc AS (SELECT *, round({_SIGMOID.format(z=f'{BIAS} + {_Z}')}, 9) AS prob FROM ft)"
_COUNTED = f"{_best('consensus', 'CASE WHEN label = 1 THEN 1 ELSE -1 END', 'bc')}, th AS (SELECT consensus, CAST(GREATEST(15, threshold) AS INTEGER) AS threshold FROM bc)"

QUERIES = {f.__name__: f for f in (label_candidates_overlap, threshold_per_consensus, threshold_length_weighted, threshold_count_weighted, logistic_score, tau_sweep_f1, standard_features, family_model_apply, family_model_file, kept_sweep, best_tau_floor, rare_family_labels, train_group_logistic, train_logistic, train_rare_family, train_gbt)}

SQL = {
    "label_candidates_overlap": f"WITH {_LABELLED} SELECT cand_id, size, overlap, label FROM lb",
    "threshold_per_consensus": f"WITH {_LABELLED}, {_best('consensus', '2 * overlap - size', 'bo')}, {_best('', '2 * overlap - size', 'ba')} SELECT bo.consensus, CAST(CASE WHEN bo.n < {L.FEW} THEN CASE WHEN ba.net > 0 THEN ba.threshold ELSE 0 END WHEN bo.net > 0 THEN bo.threshold ELSE {L.NOTHING} END AS INTEGER) AS threshold FROM bo, ba",
    "threshold_length_weighted": f"WITH {_LABELLED}, {_best('consensus', 'CASE WHEN label = 1 THEN size ELSE -size END', 'bl')} SELECT consensus, CAST(GREATEST(8, threshold) AS INTEGER) AS threshold FROM bl",
    "threshold_count_weighted": f"WITH {_LABELLED}, {_COUNTED} SELECT * FROM th",
    "logistic_score": f"WITH {_SCORED} SELECT cand_id, round(prob, 6) AS prob FROM sc",
    "tau_sweep_f1": f"""WITH {_SCORED}, ta AS (SELECT UNNEST({TAUS}) AS tau), s AS (SELECT CAST(tau AS DOUBLE) AS tau, CAST(SUM(CASE WHEN prob >= tau AND label = 1 THEN size ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN prob >= tau AND label = 0 THEN size ELSE 0 END) AS BIGINT) AS fp, CAST(SUM(CASE WHEN prob < tau AND label = 1 THEN size ELSE 0 END) AS BIGINT) AS fn FROM sc, ta GROUP BY tau),
      m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM s) SELECT tau, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m""",
    "standard_features": f"WITH {_LABELLED}, {_FEAT} SELECT strand, {', '.join(f'round(AVG({c}), 5) AS mu_{c}, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END, 5) AS sd_{c}' for c in L.FEATURES)} FROM ft GROUP BY strand",
    "family_model_apply": f"""WITH {_LABELLED}, {_FEAT}, {_COUNTED}, gr AS (SELECT DISTINCT ON (consensus) consensus, CASE WHEN family < 'N' THEN 'early' ELSE 'late' END AS grp, cid % 5 / 10 AS shift FROM consensi WHERE consensus IS NOT NULL AND family IS NOT NULL),
      x AS (SELECT ft.*, COALESCE(gr.grp, 'Other') AS grp, th.threshold, CASE WHEN gr.grp = 'early' THEN {_SIGMOID.format(z=f'{BIAS} + COALESCE(shift, 0) + {_Z}')} END AS prob FROM ft LEFT JOIN gr ON gr.consensus = ft.consensus LEFT JOIN th ON th.consensus = ft.consensus)
      SELECT cand_id, grp, round(prob, 6) AS prob, CASE WHEN prob IS NOT NULL THEN prob >= 0.5 ELSE score >= COALESCE(threshold, score) END AS kept FROM x""",
    "family_model_file": f"""WITH {_LABELLED}, {_FEAT}, {_COUNTED}, gr AS (SELECT DISTINCT ON (consensus) consensus, CASE WHEN family < 'N' THEN 'early' ELSE 'late' END AS grp, cid % 5 / 10 AS shift FROM consensi WHERE consensus IS NOT NULL AND family IS NOT NULL),
      x AS (SELECT ft.*, COALESCE(gr.grp, 'Other') AS grp, th.threshold, CASE WHEN gr.grp = 'early' THEN {_SIGMOID.format(z=f'{BIAS} + COALESCE(shift, 0) + {_Z}')} END AS prob FROM ft LEFT JOIN gr ON gr.consensus = ft.consensus LEFT JOIN th ON th.consensus = ft.consensus)
      SELECT cand_id, grp, round(prob, 6) AS prob, CASE WHEN prob IS NOT NULL THEN prob >= 0.5 ELSE score >= COALESCE(threshold, score) END AS kept FROM x""",
    "kept_sweep": f"""WITH {_SCORED}, ta AS (SELECT CAST(UNNEST({KEPT_TAUS}) AS DOUBLE) AS tau), kp AS (SELECT tau, asm_id, chrom, start_pos, end_pos FROM sc, ta WHERE prob >= tau), {union_sql('kp', 'tau, asm_id, chrom', 'ku')}, ks AS (SELECT tau, SUM(end_pos - start_pos) AS kept FROM ku GROUP BY tau), tr AS (SELECT SUM(end_pos - start_pos) AS truth FROM tu),
      bo AS (SELECT tau, SUM(LEAST(ku.end_pos, tu.end_pos) - GREATEST(ku.start_pos, tu.start_pos)) AS tp FROM ku JOIN tu ON ku.asm_id = tu.asm_id AND ku.chrom = tu.chrom AND ku.start_pos < tu.end_pos AND tu.start_pos < ku.end_pos GROUP BY tau),
      m AS (SELECT ta.tau, COALESCE(truth, 0) AS truth, COALESCE(kept, 0) AS kept, COALESCE(tp, 0) AS tp FROM ta LEFT JOIN ks ON ks.tau = ta.tau LEFT JOIN bo ON bo.tau = ta.tau, tr), q AS (SELECT *, CASE WHEN kept > 0 THEN tp / kept ELSE 0.0 END AS p, CASE WHEN truth > 0 THEN tp / truth ELSE 0.0 END AS r FROM m)
      SELECT tau, CAST(truth AS BIGINT) AS truth_bases, CAST(kept AS BIGINT) AS kept_bases, CAST(tp AS BIGINT) AS both_bases, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM q""",
    "best_tau_floor": f"""WITH {_SCORED}, ta AS (SELECT CAST(UNNEST({TAUS}) AS DOUBLE) AS tau), s AS (SELECT tau, SUM(CASE WHEN prob >= tau AND label = 1 THEN size ELSE 0 END) AS tp, SUM(CASE WHEN prob >= tau AND label = 0 THEN size ELSE 0 END) AS fp, SUM(CASE WHEN prob < tau AND label = 1 THEN size ELSE 0 END) AS fn FROM sc, ta GROUP BY tau),
      m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM s) SELECT tau, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM m WHERE p >= {FLOOR} ORDER BY CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END DESC, tau LIMIT 1""",
    "rare_family_labels": f"""WITH t AS (SELECT * FROM ref_interval WHERE {PLACED} AND family IS NOT NULL), rf AS (SELECT family FROM (SELECT DISTINCT ON (interval_id) interval_id, family FROM t WHERE interval_id IS NOT NULL) GROUP BY family ORDER BY COUNT(*), family LIMIT {RARE}), c AS (SELECT DISTINCT ON (cand_id) * FROM candidate WHERE cand_id IS NOT NULL AND {PLACED})
      SELECT cand_id, MAX(CASE WHEN t.family IN (SELECT family FROM rf) THEN 1 ELSE 0 END) AS target, MAX(CASE WHEN t.family IS NULL THEN 0 ELSE 1 END) AS "any" FROM c LEFT JOIN t ON t.asm_id = c.asm_id AND t.chrom = c.chrom AND t.start_pos < c.end_pos AND c.start_pos < t.end_pos GROUP BY cand_id""",
}
