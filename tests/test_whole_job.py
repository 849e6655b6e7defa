"""Cases in which a bound or a sample once decided over rows it must not decide over."""

from __future__ import annotations

import random

import numpy as np
import pytest

from helixframe.operators import models
from helixframe.plans import library


def dna(seed: int, n: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.mark.parametrize("query", [library.consensus_build, library.consensus_two_pass])
def test_family_below_a_hot_one_is_built(spark, tmp_path, query):
    # the hot family has more seeds than a pool of 1,000, and is longer than two flanks of 600
    hot, rare = dna(1, 1500), dna(2, 150)
    seq = "".join(x for i in range(18) for x in (dna(100 + i, 80), hot)) + "".join(x for i in range(9) for x in (dna(200 + i, 80), rare)) + dna(300, 80)
    spark.createDataFrame([(1, "a", "r1", "chr1", seq)], "rec_id long, asm_id string, header string, chrom string, seq string").write.parquet(f"{tmp_path}/records.parquet")
    built = [r.seq for r in query(spark, str(tmp_path)).collect()]
    rc = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for family in (hot, rare):
        assert any(family in x or rc(family) in x for x in built)


def test_only_the_fit_uses_a_sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8)) * np.arange(1, 9) + np.arange(8)
    y = (x[:, 0] + rng.normal(size=1200) > 0.8).astype(int)
    size = rng.integers(20, 400, 1200)
    grp = np.where(np.arange(1200) < 1000, "hot", "small")
    rows = [(i, str(grp[i]), int(y[i]), int(size[i]), *map(float, x[i])) for i in range(1200)] + [(2000 + i, "one label", 1, 50, *[1.0] * 8) for i in range(80)]
    df = spark.createDataFrame(rows, "cand_id long, grp string, label int, size long, " + ", ".join(f"{c} double" for c in models.FEATURES))
    got = {r.grp: r for r in models.train_groups(df, "grp", most=60).collect()}
    assert set(got) == {"hot", "small"}
    for g, r in got.items():
        own = grp == g
        assert r.rows == own.sum() and np.allclose(r.mu, x[own].mean(0)) and np.allclose(r.sd, x[own].std(0))
        p = 1 / (1 + np.exp(-((x[own] - r.mu) / r.sd @ r.w + r.b0)))
        weight, true = size[own], y[own] == 1
        f1 = [2 * weight[(p >= t / 40) & true].sum() / (weight[p >= t / 40].sum() + weight[true].sum()) for t in range(1, 40)]
        assert r.tau == (int(np.argmax(f1)) + 1) / 40


def test_offsets_tell_consensi_apart(spark):
    rng = np.random.default_rng(5)
    cons = rng.choice(["good", "bad"], 1500)
    y = (rng.random(1500) < np.where(cons == "good", 0.9, 0.1)).astype(int)
    x = rng.normal(size=(1500, 8))
    rows = [(i, "all", str(cons[i]), int(y[i]), 100, *map(float, x[i])) for i in range(1500)] + [(3000, "all", None, 1, 100, *[0.0] * 8)]
    df = spark.createDataFrame(rows, "cand_id long, grp string, consensus string, label int, size long, " + ", ".join(f"{c} double" for c in models.FEATURES))
    plain, own = models.train_groups(df, "grp").first(), models.train_groups(df, "grp", offset="consensus").first()
    assert plain.shifts == {"": 0.0} or not plain.shifts
    assert own.shifts["good"] > 1 and own.shifts["bad"] < -1 and set(own.shifts) == {"good", "bad", ""}


def test_model_file_and_cutoff(spark, tmp_path):
    from pyspark.sql import functions as F

    from helixframe.sources import text

    model = spark.createDataFrame([(g, [0.5] * 8, [1.0] * 8, [2.0] * 8, -0.25, 0.9) for g in ("a", "b")], "grp string, w array<double>, mu array<double>, sd array<double>, b0 double, tau double")
    groups = spark.createDataFrame([("c1", "a", 0.5)], "consensus string, grp string, shift double")
    thresholds = spark.createDataFrame([("c2", 17)], "consensus string, threshold int")
    lines = text.model_lines(model, groups, thresholds).coalesce(1).sortWithinPartitions("place").select(F.explode(F.split("value", "\n")).alias("value"))
    text.write_lines(text.set_tau(lines, 0.35), f"{tmp_path}/model")
    m, g, t = text.read_model_file(spark, f"{tmp_path}/model")
    assert sorted((r.grp, r.tau, r.b0, tuple(r.mu)) for r in m.collect()) == [(x, 0.35, -0.25, (1.0,) * 8) for x in "ab"]
    assert [tuple(r) for r in g.collect()] == [("c1", "a", 0.5)] and [tuple(r) for r in t.collect()] == [("c2", 17)]
