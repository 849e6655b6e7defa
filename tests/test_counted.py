"""Masks by the counts of the records' own seeds against an index that is looked up."""

from __future__ import annotations

import numpy as np
import pytest
from test_kernels import dna, mutated

from helixframe.functions.seq import SpacedSeed
from helixframe.operators import counted
from helixframe.operators import kmers as K
from helixframe.operators import masks as M


def test_numbers_packed_and_unpacked():
    for x in ([], [0, 0], [7], [255, 256, 0, 2**62], list(range(3000))):
        assert counted.unpacked_numbers(counted.packed_numbers(np.array(x, np.uint64))).tolist() == x


@pytest.mark.parametrize(("seed", "opts"), [(7, {"bins": 2, "buckets": 4}), (SpacedSeed("110101011"), {"chunk": 70, "bins": 3, "buckets": 2}), (31, {"chunk": 61, "bins": 5, "buckets": 16})])
def test_mask_by_counts(spark, seed, opts):
    base = dna(1, 300)
    seqs = [base + dna(2, 500) + mutated(base, 0.05, 3) + "NNNN" + base[:40].lower(), dna(4, 60), "", None, "ACG", mutated(base, 0.02, 5) * 2, "ACGT" * 80, dna(6, 900)]
    recs = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "rec_id long, seq string").repartition(3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    total = 0
    for low, high, gap, hits, density in ((2, 3, 60, 1, 0.0), (2, 4, 20, 5, 0.3), (1, 1, 5, 1, 0.0)):
        index = K.seed_counts(recs, seed).where("cnt >= 2")
        want = rows(M.link_hits(M.mask_indexed(recs, index, seed, low=low, high=high), gap=gap, min_len=20, min_hits=hits, min_density=density))
        assert rows(counted.mask_by_counts(recs, seed, low, high, gap, 20, hits, density, **opts)) == want
        assert rows(counted.mask_by_counts(recs, seed, low, high, gap, 20, hits, density, index, **opts)) == want
        total += len(want)
    assert total > 3


def test_seeds_are_not_looked_up_by_the_driver(spark, sf_dir, monkeypatch):
    from helixframe.plans import masking

    def fail(*_, **__):
        raise AssertionError("an index on the driver")

    monkeypatch.setattr(M, "look_up", fail)
    assert masking.mask_hysteresis(spark, sf_dir).count() > 0 and masking.mask_density_gate(spark, sf_dir).count() > 0


@pytest.mark.parametrize(("seed", "buckets"), [(7, 4), (SpacedSeed("110101011"), 0), (31, 2)])
def test_seed_index(spark, seed, buckets):
    recs = spark.createDataFrame([(1, dna(1, 300) + "N" + dna(1, 200).lower()), (2, dna(2, 400) * 2), (3, None), (4, "")], "rec_id long, seq string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for least in (1, 2):
        assert rows(counted.seed_index(recs, seed, least, buckets)) == rows(K.seed_counts(recs, seed).where(f"cnt >= {least}").select("kmer", "cnt")) != []


def test_stream_joins_no_seeds(spark, sf_dir, monkeypatch):
    from helixframe.plans import diagnostics, masking

    def fail(*_, **__):
        raise AssertionError("a row for each seed")

    want = sorted(tuple(r) for r in masking.mask_indexed(spark, sf_dir).collect())
    for name in ("seeds", "_seed_rows", "seed_counts"):
        monkeypatch.setattr(K, name, fail)
    monkeypatch.setattr("helixframe.streaming.masking.seeds", fail, raising=False)
    assert sorted(tuple(r) for r in diagnostics.mask_stream(spark, sf_dir).collect()) == want != []
