"""What consensus building does where the records are read, and for many seeds at once, against the plain way."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_kernels import dna, mutated

from helixframe.functions.seq import SpacedSeed
from helixframe.operators import consensus as C
from helixframe.operators import kmers as K

SEED = SpacedSeed("11011011")


@pytest.fixture(scope="module")
def records(spark):
    fam = dna(1, 60)
    seqs = ["".join(dna(10 + 9 * j + i, 40) + mutated(fam, 0.05, 9 * j + i) for i in range(6)) for j in range(8)]
    seqs = [*seqs[:6], seqs[6].lower(), seqs[7] + "NN" + seqs[7], "", "ACG", None]
    return spark.createDataFrame([(i * 7 - 5, s) for i, s in enumerate(seqs)], "rec_id long, seq string").repartition(3)


@pytest.mark.parametrize("per_seed", [3, 1000])
def test_occurrences_are_found_without_a_join(spark, records, monkeypatch, per_seed):
    monkeypatch.setattr(C, "PIECE", 100)
    pool = C.top_seeds(K.seed_counts(records, SEED), 60)
    got = C.occurrences_of(records, np.array([r.kmer for r in pool.collect()]), SEED, per_seed)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = C.occurrences(records, pool, SEED, per_seed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 60


def test_flanks_are_cut_without_a_join(spark, records):
    pool = C.top_seeds(K.seed_counts(records, SEED), 20)
    places = C.occurrences(records, pool, SEED, 50).join(pool, "kmer")
    got = C.flanks_of(records, places.toArrow(), SEED.span, 30)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = C.oriented_flanks(records, places, SEED.span, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 50


def test_groups_that_grow_together_dont_see_each_other():
    rng = random.Random(2)
    groups = []
    for i in range(40):
        fam = dna(100 + i, rng.choice([0, 30, 250]))
        own = [(mutated(fam, 0.1, 50 * i + j) + dna(5000 + 50 * i + j, 60)).encode()[: rng.choice([0, 5, 40, 400])] for j in range(rng.choice([1, 2, 3, 7, 20]))]
        groups.append(own + [rng.choice(own) for _ in own])  # some are equal
    for got, own in zip(C.extend_all(groups, 8, 40, 350), groups):
        seq, score = C.extend_all([own], 8, 40, 350)[0]
        assert got[0] == seq and (got[1] == score).all() and len(score) == len(own)
        plain, total = grown_plainly(own, 8, 40, 350)
        assert seq == plain and (np.maximum(score, 0) == np.maximum(total, 0)).all()


def grown_plainly(copies, band, lookahead, most):
    """extend, cell by cell."""
    none = -(10**9)
    cols = [{j: -3 * j for j in range(min(band, len(c)) + 1)} for c in copies]
    best, at, kept, out = 0, 0, [0] * len(copies), b""
    judge = [i % 3 == 2 and len(copies) >= 3 for i in range(len(copies))]
    for m in range(1, most + 1):
        tries = []
        for letter in b"ACGT":
            new = []
            for c, col in zip(copies, cols):
                here = {}
                for j in range(max(0, m - band), min(len(c), m + band) + 1):
                    here[j] = max(col.get(j, none) - 3, here.get(j - 1, none) - 3, col.get(j - 1, none) + (1 if c[j - 1] == letter else -1) if j else none)
                new.append(here)
            tries.append((letter, new, [max(h.values(), default=none) for h in new]))
        letter, cols, score = max(tries, key=lambda t: sum(max(0, s) for s, x in zip(t[2], judge) if not x))
        out += bytes([letter])
        if (judged := sum(max(0, s) for s, x in zip(score, judge) if x)) > best:
            best, at, kept = judged, m, score
        elif m - at >= lookahead:
            break
    return out[:at], np.array(kept)


@pytest.mark.parametrize("weight", [11, 14, 18])
def test_near_seeds(weight):
    rng = np.random.default_rng(weight)
    covered = rng.integers(0, 4**weight, 300).astype(np.uint64)
    kmers = np.concatenate([covered[:60], rng.integers(0, 4**weight, 60).astype(np.uint64)])
    for i in range(120):
        for at in rng.choice(weight, i % 5, replace=False):
            kmers[i] ^= np.uint64(int(rng.integers(1, 4)) << (2 * int(at)))
    kmers[::2] = C._reversed(kmers[::2], weight)
    assert C.near_any(kmers, covered, weight).tolist() == [C._near_covered(int(x), covered, weight) for x in kmers]


@pytest.mark.parametrize("n", [1, 7, 40, 1000])
def test_ranked_pool(spark, n):
    rows = [(i * 37 % 4**11, 3 + i % 4) for i in range(200)]
    got = C.ranked_pool(spark.createDataFrame(rows, "kmer long, cnt long"), n, 4, 11)
    want = sorted((r for r in rows if r[1] >= 4), key=lambda r: (-r[1], r[0]))[:n]
    assert [(r.kmer, r.cnt) for r in got.orderBy("rank").collect()] == want and [r.rank for r in got.orderBy("rank").collect()] == list(range(len(want)))
