"""Learned filters of library hits: labels, thresholds per consensus, logistic models, cutoff sweeps.

Counting, thresholds, scoring and sweeps are relational. The weights of a group's logistic model are fitted on a bounded,
documented sample of its labelled rows; everything else, also its means, deviations and cutoff, uses all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.seq import f1, ratio, sigmoid
from helixframe.operators.intervals import overlap_bases
from helixframe.operators.ordering import running_sum
from helixframe.operators.tiles import overlap_pieces, union_intervals
from helixframe.runtime import checkpoint

FEATURES = ["f_score", "f_len", "f_per_base", "f_cover", "f_gc", "f_gate", "f_side", "f_cons"]
NOTHING = 10**6
#: Labelled rows of a group that the fit of its weights uses at most, chosen by a hash of their id.
FIT_ROWS = 50_000
FEW = 20


def label(candidates: DataFrame, truth: DataFrame, keys: list[str], row_id: str = "cand_id") -> DataFrame:
    """candidates with size, overlap, label: 1 if at least half of the bases are annotated. Rows without usable borders go."""
    usable = candidates.where("end_pos > start_pos").dropDuplicates([row_id]).where(F.col(row_id).isNotNull())
    out = overlap_bases(usable, truth, keys, row_id).withColumn("size", F.col("end_pos") - F.col("start_pos"))
    return out.withColumn("label", (2 * F.col("overlap") >= F.col("size")).cast("int"))


def best_cut(rows: DataFrame, by: list[str], score: str, gain: Column, count: Column | None = None) -> DataFrame:
    """by, threshold, net, n: the score at which the gain of all rows with at least that score is largest.

    Equal scores enter together; of equal gains the highest score counts. Rows of a key are first reduced to one a score.
    count: how many a row stands for (1).
    """
    per = rows.groupBy(*by, score).agg(F.sum(gain).alias("_g"), F.sum(F.lit(1) if count is None else count).alias("_c"))
    if by:
        run = per.withColumn("_net", F.sum("_g").over(W.partitionBy(*by).orderBy(F.desc(score))))
    else:
        down = running_sum(per.withColumn("_down", -F.col(score)), ["_down"], F.col("_g"), "_before")
        run = down.withColumn("_net", F.col("_before") + F.col("_g"))
    return run.groupBy(*by).agg(F.max_by(F.col(score), F.struct("_net", score)).alias("threshold"), F.max("_net").alias("net"), F.sum("_c").alias("n"))


def base_thresholds(labelled: DataFrame, by: str = "consensus", score: str = "score", few: int = FEW) -> DataFrame:
    """by, threshold: the score that maximises annotated less other bases. Keys with few rows take the threshold of all rows,
    0 where that gains nothing; keys that gain nothing take NOTHING."""
    gain = 2 * F.col("overlap") - F.col("size")
    rows = labelled.where(F.col(by).isNotNull() & F.col(score).isNotNull())
    # both cuts are made from the same sums
    sums = checkpoint(rows.groupBy(by, score).agg(F.sum(gain).alias("_gain"), F.count("*").alias("_rows")))
    own, whole = (best_cut(sums, keys, score, F.col("_gain"), F.col("_rows")) for keys in ([by], []))
    whole = whole.select(F.when(F.col("net") > 0, F.col("threshold")).otherwise(F.lit(0)).alias("_all"))
    return own.join(F.broadcast(whole)).select(by, F.when(F.col("n") < few, F.col("_all")).when(F.col("net") > 0, F.col("threshold")).otherwise(F.lit(NOTHING)).cast("int").alias("threshold"))


def vote_thresholds(labelled: DataFrame, floor: int, weight: Column, by: str = "consensus", score: str = "score") -> DataFrame:
    """by, threshold: as base_thresholds, but each row counts for or against by its label with the given weight, and no
    threshold is below the floor."""
    rows = labelled.where(F.col(by).isNotNull() & F.col(score).isNotNull())
    own = best_cut(rows, [by], score, F.when(F.col("label") == 1, weight).otherwise(-weight))
    return own.select(by, F.greatest(F.lit(floor), F.col("threshold")).cast("int").alias("threshold"))


def features(candidates: DataFrame) -> DataFrame:
    """candidates with the eight numbers of the logistic models; rows with a null among their sources are left out."""
    size = F.col("end_pos") - F.col("start_pos")
    rows = candidates.where("end_pos > start_pos AND score IS NOT NULL AND cons_len > 0 AND gc IS NOT NULL AND cons_fwd IS NOT NULL AND cons_bwd IS NOT NULL AND gate_left IS NOT NULL AND gate_right IS NOT NULL")
    gate = F.col("gate_left") + F.col("gate_right")
    return rows.withColumns({"f_score": F.col("score").cast("double"), "f_len": F.log(size.cast("double")), "f_per_base": F.col("score") / size, "f_cover": (F.col("cons_fwd") + F.col("cons_bwd")) / F.col("cons_len"), "f_gc": F.col("gc"), "f_gate": gate.cast("double"), "f_side": F.least("gate_left", "gate_right").cast("double"), "f_cons": F.log(F.col("cons_len").cast("double"))})


def standardisation(rows: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """by, mu_*, sd_*: mean and population deviation of each feature, a deviation of 0 taken as 1; and more aggregates."""
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0))
    return rows.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"mu_{c}") for c in FEATURES], *[sd(c).alias(f"sd_{c}") for c in FEATURES], *more)


def probability(weights: list[Column | float], bias: Column | float, mu: list[Column | float], sd: list[Column | float]) -> Column:
    z = F.lit(bias) if isinstance(bias, (int, float)) else bias
    for c, w, m, s in zip(FEATURES, weights, mu, sd):
        z = z + w * (F.col(c) - m) / s
    return sigmoid(z)


def apply_models(rows: DataFrame, models: DataFrame, groups: DataFrame, fallback: DataFrame | None = None, by: str = "consensus") -> DataFrame:
    """rows with grp, prob, kept: the group's model decides where it has one, else the consensus' threshold.

    models: grp, w, mu, sd (arrays of eight), b0, tau. groups: by, grp, shift (the consensus' own offset). fallback: by,
    threshold. A consensus in no group is in 'Other'; without model and threshold a row is kept.
    """
    out = rows.join(groups, by, "left").withColumns({"grp": F.coalesce("grp", F.lit("Other")), "shift": F.coalesce("shift", F.lit(0.0))}).join(models, "grp", "left")
    z = F.col("b0") + F.col("shift") + sum(F.col("w")[i] * (F.col(c) - F.col("mu")[i]) / F.col("sd")[i] for i, c in enumerate(FEATURES))
    out = out.withColumn("prob", F.when(F.col("w").isNotNull(), sigmoid(z)))
    out = out.join(fallback.select(by, F.col("threshold").alias("_t")), by, "left") if fallback is not None else out.withColumn("_t", F.lit(None).cast("int"))
    return out.withColumn("kept", F.when(F.col("prob").isNotNull(), F.col("prob") >= F.col("tau")).otherwise(F.col("score") >= F.coalesce("_t", F.col("score")))).drop("_t", "w", "mu", "sd", "b0", "tau", "shift")


def sweep(scored: DataFrame, taus: list[float], prob: str = "prob") -> DataFrame:
    """tau, tp, fp, fn, precision, recall, f1 of keeping rows with at least each cutoff, by size-weighted labels.

    The cutoffs are few and fixed, so each row's weights are added to the highest cutoff it reaches, then summed upwards:
    one pass, whatever the number of cutoffs.
    """
    reached = sum((F.col(prob) >= t).cast("int") for t in taus)
    w = F.col("size").cast("long")
    got = scored.groupBy(reached.alias("_n")).agg(F.sum(F.when(F.col("label") == 1, w).otherwise(F.lit(0))).alias("_t"), F.sum(F.when(F.col("label") == 1, F.lit(0)).otherwise(w)).alias("_f"))
    levels = scored.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(sorted(taus))], "_k int, tau double")
    # at most len(taus) + 1 rows on either side
    sums = levels.join(got, F.lit(True)).groupBy("tau").agg(F.sum(F.when(F.col("_n") >= F.col("_k"), F.col("_t")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("_n") >= F.col("_k"), F.col("_f")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("_n") < F.col("_k"), F.col("_t")).otherwise(0)).alias("fn"))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def evaluate_kept(scored: DataFrame, truth: DataFrame, keys: list[str], taus: list[float], prob: str = "prob") -> DataFrame:
    """tau, truth_bases, kept_bases, both_bases, precision, recall, f1 of keeping rows with at least each cutoff.

    The kept intervals are merged, so every base counts once, and compared with all annotated bases (keys, start_pos,
    end_pos), so those without a candidate are missed. The cutoffs are few and fixed: a row goes with each it reaches.
    """
    reached = F.filter(F.array(*[F.struct(F.lit(t).alias("tau")) for t in taus]), lambda t: t["tau"] <= F.col(prob))
    kept = scored.where(F.col(prob).isNotNull()).select(*keys, "start_pos", "end_pos", F.explode(reached).alias("_tau")).withColumn("tau", F.col("_tau.tau")).drop("_tau")
    merged, t = union_intervals(kept, ["tau", *keys]), union_intervals(truth, keys)
    size = F.sum(F.col("end_pos") - F.col("start_pos"))
    both = overlap_pieces(merged, t, keys).groupBy("tau").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("both_bases"))
    out = scored.sparkSession.createDataFrame([(t,) for t in sorted(taus)], "tau double").join(merged.groupBy("tau").agg(size.alias("kept_bases")), "tau", "left").join(both, "tau", "left")
    out = out.join(F.broadcast(t.agg(F.coalesce(size, F.lit(0)).alias("truth_bases")))).na.fill(0, ["kept_bases", "both_bases"])
    out = out.withColumns({"precision": ratio(F.col("both_bases"), F.col("kept_bases")), "recall": ratio(F.col("both_bases"), F.col("truth_bases"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("tau", "truth_bases", "kept_bases", "both_bases", "precision", "recall", "f1")


def rare_families(truth: DataFrame, n: int, row_id: str = "interval_id", family: str = "family") -> DataFrame:
    """family: the n with the fewest distinct annotations, equal ones by name."""
    once = truth.where(F.col(family).isNotNull() & F.col(row_id).isNotNull()).dropDuplicates([row_id])
    return once.groupBy(family).agg(F.count("*").alias("_n")).orderBy("_n", family).limit(n).select(family)


def touch_labels(candidates: DataFrame, truth: DataFrame, families: DataFrame, keys: list[str], row_id: str = "cand_id", family: str = "family") -> DataFrame:
    """candidates with size, target and any (0 or 1): whether they touch an annotation of the families, and one of any family."""
    usable = candidates.where("end_pos > start_pos").dropDuplicates([row_id]).where(F.col(row_id).isNotNull())
    named = truth.where(F.col(family).isNotNull())
    one = overlap_bases(usable, named.join(F.broadcast(families), family, "left_semi"), keys, row_id).withColumnRenamed("overlap", "_t")
    both = overlap_bases(one, named, keys, row_id)
    return both.withColumns({"size": F.col("end_pos") - F.col("start_pos"), "target": (F.col("_t") > 0).cast("int"), "any": (F.col("overlap") > 0).cast("int")}).drop("_t", "overlap")


def best_tau(swept: DataFrame, least_precision: float = 0.0) -> DataFrame:
    """The row of the best F1 among those with enough precision; the lower cutoff of equal ones."""
    return swept.where(F.col("precision") >= least_precision).orderBy(F.desc("f1"), "tau").limit(1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, decay: float, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a full-batch logistic fit of standardised features, and an offset for each code (none without).

    Offsets are shrunk ten times as much as weights; the step of each is that of its own rows' mean, so that those of few
    rows settle as soon as others.
    """
    w = np.zeros(x.shape[1] + 1)
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    n = 0 if code is None else int(code.max()) + 1
    shift = np.zeros(n)
    own = np.bincount(code, weight, n) if n else shift
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w + (shift[code] if n else 0), -30, 30)))
        error = weight * (p - y)
        step = x.T @ error
        step[:-1] += decay * w[:-1]
        w -= rate * step
        if n:
            shift -= rate * (np.bincount(code, error, n) / np.maximum(own, 1e-12) + 10 * decay * shift)
    return w, shift


def train_groups(rows: DataFrame, group: str, row_id: str = "cand_id", epochs: int = 200, rate: float = 0.5, decay: float = 1e-3, least: int = 50, most: int = FIT_ROWS, offset: str | None = None) -> DataFrame:
    """grp, w, mu, sd, b0, tau, rows, shifts: one logistic model for each group, weighted by size.

    shifts (a map) has the offset of each value of the column `offset` among the rows of the fit; without one it is empty.

    Only the weights and b0 are fitted on a sample: at most `most` labelled rows of a group, those with the smallest hash of
    their id. Means, deviations and tau are of all rows. Groups with fewer than `least` rows, or with one label only, get no
    model. tau is the cutoff of 0.025, 0.05, ... 0.975 with the best weighted F1, the lower one of equal ones.
    """
    # read three times, and made by joins
    by = F.coalesce(F.col(offset).cast("string"), F.lit("")) if offset else F.lit("")
    rows = checkpoint(rows.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(row_id).alias("_id"), by.alias("_by"), "label", "size", *FEATURES))
    stats = standardisation(rows, ["grp"], F.count("*").alias("rows"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where((F.col("rows") >= least) & (F.col("_lo") < F.col("_hi")))
    stats = stats.select("grp", "rows", *[F.array(*[f"{x}_{c}" for c in FEATURES]).alias(x) for x in ("mu", "sd")])
    # few of a large group's rows get to the windows: a fifth more than are wanted, by the same hash that orders them
    below = (F.lit(1.2 * most) / F.col("rows") - 0.5) * 2.0**64
    chosen = rows.join(stats, "grp").withColumn("_h", F.xxhash64("_id")).where((F.col("rows") <= 2 * most) | (F.col("_h").cast("double") < below)).withColumn("_salt", F.pmod("_h", F.lit(16)))
    inner, outer = W.partitionBy("grp", "_salt").orderBy("_h", "_id"), W.partitionBy("grp").orderBy("_h", "_id")
    few = chosen.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= most).withColumn("_n", F.row_number().over(outer)).where(F.col("_n") <= most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, sd = np.array(pdf["mu"].iloc[0]), np.array(pdf["sd"].iloc[0])
        code, names = pd.factorize(pdf["_by"])
        w, shift = fit_logistic((pdf[FEATURES].to_numpy(float) - mu) / sd, pdf["label"].to_numpy(float), pdf["size"].to_numpy(float), epochs, rate, decay, code if offset else None)
        return pd.DataFrame({"shifts": [dict(zip(names.tolist(), shift.tolist()))], "grp": [pdf["grp"].iloc[0]], "w": [w[:-1].tolist()], "mu": [mu.tolist()], "sd": [sd.tolist()], "b0": [float(w[-1])], "rows": [pdf["rows"].iloc[0]]})

    fitted = checkpoint(few.select("grp", "_by", "label", "size", *FEATURES, "mu", "sd", "rows").groupBy("grp").applyInPandas(fit, "shifts map<string,double>, grp string, w array<double>, mu array<double>, sd array<double>, b0 double, rows long"))
    return fitted.join(_group_taus(rows, fitted), "grp").select("grp", "w", "mu", "sd", "b0", "tau", "rows", "shifts")


def _group_taus(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """grp, tau: the best cutoff of each fitted model, swept over all rows of its group, which are reduced to one a cutoff."""
    taus = [t / 40 for t in range(1, 40)]
    scored = rows.join(fitted.drop("rows"), "grp").withColumn("_p", probability([F.col("w")[i] for i in range(len(FEATURES))], F.col("b0") + F.coalesce(F.try_element_at("shifts", "_by"), F.lit(0.0)), [F.col("mu")[i] for i in range(len(FEATURES))], [F.col("sd")[i] for i in range(len(FEATURES))]))
    got = scored.groupBy("grp", sum((F.col("_p") >= t).cast("int") for t in taus).alias("_n")).agg(F.sum("size").alias("_s"), F.sum(F.when(F.col("label") == 1, F.col("size")).otherwise(0)).alias("_t"))
    # at most len(taus) + 1 rows a group
    levels = got.join(fitted.select(F.col("grp"), F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("tau")) for i, t in enumerate(taus)])).alias("l")).select("grp", "l.*"), "grp")
    reached = F.col("_n") >= F.col("k")
    sums = levels.groupBy("grp", "tau").agg(F.sum(F.when(reached, F.col("_t")).otherwise(0)).alias("_tp"), F.sum(F.when(reached, F.col("_s")).otherwise(0)).alias("_kept"), F.sum("_t").alias("_all"))
    score = 2 * F.col("_tp") / F.greatest(F.lit(1), F.col("_kept") + F.col("_all"))
    return sums.groupBy("grp").agg(F.max_by("tau", F.struct(score, -F.col("tau"))).alias("tau"))


def tree_features(candidates: DataFrame) -> DataFrame:
    """candidates with the sixteen numbers of the boosted trees, t_0 to t_15, and the consensus as text, t_cons; see features."""
    size = F.col("end_pos") - F.col("start_pos")
    cover = (F.col("cons_fwd") + F.col("cons_bwd")) / F.greatest(F.lit(1), F.col("cons_len"))
    numbers = [F.col("score"), F.col("score_fwd"), F.col("score_bwd"), F.log(size.cast("double")), size, F.col("score") / size, cover, F.col("cons_fwd"), F.col("cons_bwd"), F.col("gc"), F.col("gate_left"), F.col("gate_right"), F.col("gate_left") + F.col("gate_right"), F.least("gate_left", "gate_right"), F.log(F.col("cons_len").cast("double")), (F.col("strand") == "+").cast("int")]
    out = features(candidates).where("score_fwd IS NOT NULL AND score_bwd IS NOT NULL AND strand IS NOT NULL")
    return out.withColumns({f"t_{i}": c.cast("double") for i, c in enumerate(numbers)} | {"t_cons": F.coalesce("consensus", F.lit(""))})


def train_trees(rows: DataFrame, row_id: str = "cand_id", depth: int = 4, rounds: int = 10, most_categories: int = 4096):
    """A gradient-boosted model of Spark's own, on all labelled rows with tree_features; the fitted model, None without rows of both
    labels. The consensus is a category; more of them than most_categories are an error, as each split looks at all."""
    if rows.select("label").distinct().count() < 2:
        return None
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    numbers = [f"t_{i}" for i in range(16)]
    categories = rows.select("t_cons").distinct().count() + 1
    if categories > most_categories:
        raise ValueError(f"more than {most_categories} consensi")
    index = StringIndexer(inputCol="t_cons", outputCol="t_code", handleInvalid="keep")
    trees = GBTClassifier(maxDepth=depth, maxIter=rounds, seed=7, maxBins=max(32, categories))
    return Pipeline(stages=[index, VectorAssembler(inputCols=[*numbers, "t_code"], outputCol="features"), trees]).fit(rows.select("label", "t_cons", *numbers))


def substitution_summary(counts: DataFrame) -> DataFrame:
    """One row: matches, transitions, transversions, ti_tv, and scores of both that keep -0.5 a random base (match 1,
    transversions punished half as much again). counts: cons_base, genome_base, n."""
    pair = F.concat("cons_base", "genome_base")
    s = counts.agg(*[F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).alias(k) for k, c in (("matches", F.col("cons_base") == F.col("genome_base")), ("transitions", pair.isin("AG", "GA", "CT", "TC")), ("transversions", (F.col("cons_base") != F.col("genome_base")) & ~pair.isin("AG", "GA", "CT", "TC")))])
    share = ratio(F.col("transitions"), F.col("transitions") + F.col("transversions"))
    ts = F.lit(-0.75) / (0.75 * (share + (1 - share) * 1.5))
    return s.withColumn("ti_tv", ratio(F.col("transitions"), F.col("transversions"))).withColumn("transition_score", ts).withColumn("transversion_score", ts * 1.5)
