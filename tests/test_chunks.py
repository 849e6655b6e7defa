"""Work in pieces of records gives what whole records give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import align, chunks, consensus, intervals, masks
from helixframe.operators import kmers as K


def dna(rng, n):
    return "".join(rng.choice(list("ACGTacgtN"), n, p=[0.2, 0.2, 0.2, 0.2, 0.04, 0.04, 0.04, 0.04, 0.04]))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    return [(i, dna(rng, int(n))) for i, n in enumerate([0, 1, 499, 500, 501, 1750, 4000])] + [(50, None), (51, "é" * 700 + "ACGT"), (3, dna(rng, 30))]


@pytest.fixture(scope="module")
def records(spark, data):
    return spark.createDataFrame(data, "rec_id long, seq string").repartition(3)


@pytest.mark.parametrize("before,after", [(0, 0), (7, 3), (600, 600)])
def test_chunks(records, data, before, after):
    got = sorted((r.rec_id, r.chunk_no, r.off, r.s) for r in chunks.chunk_records(records, 500, after, before=before).collect())
    want = [(i, n, max(0, 500 * n - before), s[max(0, 500 * n - before) : 500 * n + 500 + after]) for i, s in data if s is not None for n in range(max(1, -(-len(s) // 500)))]
    assert got == sorted(want)
    more = chunks.chunk_records(records.withColumnRenamed("rec_id", "name").withColumn("off", F.lit("x")), 500, rec_id="name", more=["name"])
    assert more.columns == ["rec_id", "name", "chunk_no", "off", "s"] and more.count() == len([0 for _, s in data if s is not None for _ in range(max(1, -(-len(s) // 500)))])


def test_windows(spark, records, data, monkeypatch):
    monkeypatch.setattr(chunks, "PIECE", 100)
    text = dict(x for x in data if x[0] != 3)
    places = [(i, p, p + n) for i, p, n in ((5, 0, 90), (5, 99, 90), (5, 1700, 90), (6, 3999, 1), (6, 250, 0), (50, 0, 9), (77, 0, 9))]
    df = spark.createDataFrame([(*p, "x") for p in places], "rec_id long, a long, b long, s string")
    got = {(r.rec_id, r.a): (r.w, r.s) for r in chunks.with_window(df, records.where("rec_id <> 3"), F.col("a"), F.col("b"), 90, "w").collect()}
    assert got == {(i, a): (text[i][a:b], "x") for i, a, b in places if text.get(i) is not None}


@pytest.mark.parametrize("how", ["soft", "hard"])
def test_masks_in_pieces(spark, records, data, how):
    regions = [(5, 10, 490), (5, 480, 1030), (5, 1700, 1 << 40), (6, 0, 500), (6, 1000, 1500), (3, 5, 20), (4, 500, 501), (1, 0, 0), (None, 1, 2), (4, None, 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in regions], "rec_id long, start_pos long, end_pos long, chunk_no int, s string")

    def plain(i, s):
        out = list(s)
        for r, a, b in regions:
            if r == i and a is not None:
                for p in range(a, min(b, len(s))):
                    out[p] = out[p].lower() if how == "soft" else "N"
        return "".join(out)

    rows = [x for x in data if x[0] != 51]
    got = sorted((r.rec_id, r.seq or "-") for r in masks.apply_mask(records.where("rec_id <> 51"), df, how, chunk=500).collect())
    assert got == sorted((i, "-" if s is None else plain(i, s) or "-") for i, s in rows)


def test_comparison_in_pieces(spark):
    rng = np.random.default_rng(3)
    ref, pred = [(1, dna(rng, 1300)), (2, dna(rng, 10)), (3, ""), (4, "AC")], [(1, dna(rng, 1450)), (2, dna(rng, 7)), (3, "A"), (4, None)]
    frame = lambda rows: spark.createDataFrame(rows, "rec_id long, seq string")
    got = {r.rec_id: (r.tp, r.fp, r.fn, r.tn) for r in masks.compare_masks(frame(ref), frame(pred), chunk=500).collect()}

    def counts(r, p):
        pairs = [(a not in "ACGT", b.islower()) for a, b in zip(r, p)]
        return tuple(sum(x == y for x in pairs) for y in ((True, True), (False, True), (True, False), (False, False)))

    assert got == {i: counts(dict(ref)[i], p) for i, p in pred if p is not None}
    with pytest.raises(ValueError):
        masks.compare_masks(frame(ref[:1]), frame(pred))


def test_long_records_as_short_ones(records):
    rows = lambda df: sorted(map(tuple, df.collect()))
    # a short period and a copy of each record, so that there is something to find
    made = records.where("rec_id NOT IN (3, 51)").withColumn("seq", F.concat("seq", F.repeat(F.lit("ACGTTAC"), 40), "seq"))
    assert rows(masks.mask_tandem(made, whole=300)) == rows(masks.mask_tandem(made)) != []
    assert rows(masks.frequent_positions(made, 12, 2, whole=300)) == rows(masks.frequent_positions(made, 12, 2)) != []


def test_kernels_in_pieces(records, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    made = records.where("rec_id < 50").withColumn("seq", F.concat("seq", F.repeat(F.lit("ACGTTAC"), 40), "seq"))
    whole = rows(masks.dust_windows(made, 64, 2.0))
    monkeypatch.setattr(masks, "PIECE", 100)  # goes with the kernel to the workers, which is a local function
    assert whole == rows(masks.dust_windows(made, 64, 2.0)) != []


def test_look_up_with_and_without_a_broadcast(records):
    rows = lambda df: sorted(map(tuple, df.collect()))
    good = records.where("rec_id NOT IN (3, 51)")
    index = K.seed_counts(good, 6).where("cnt > 2")
    assert sorted(map(tuple, index.collect())) == rows(K.count_seeds(K.seeds(good, 6)).where("cnt > 2"))
    assert rows(K.look_up(good, 6, index)) == rows(K.look_up(good, 6, index, most=0)) != []
    assert K.look_up(good, 6, index.where("false")).count() == 0
    half = K.seed_counts(good, 6, sample=4)
    assert 0 < half.count() < K.seed_counts(good, 6).count() and rows(K.look_up(good, 6, half, 4)) == rows(K.look_up(good, 6, half, 4, most=0))


def test_library_scan_by_blocks(spark):
    rng = np.random.default_rng(12)
    fam = "".join(rng.choice(list("ACGT"), 300))
    long = "".join("".join(rng.choice(list("ACGT"), 350)) + fam[i * 10 :] for i in range(8))
    df = spark.createDataFrame([(1, long), (2, long[:900])], "rec_id long, seq string")
    lib = spark.createDataFrame([("f", fam)], "consensus string, seq string")
    s = align.Settings(single_hit=True, gate=(-4, 2))
    got = sorted(map(tuple, align.library_candidates(df, lib, s, block=1000).collect()))
    seq = np.frombuffer(long.encode(), np.uint8)
    made = align.Library([("f", fam)], s.pattern)
    want = [(g - gb, g + gf) for at in range(0, len(seq), 1000) for g, _, _, _, _, _, _, _, _, gf, gb in align.scan(made, s, seq, at, min(at + 1000, len(seq)))]
    assert [(r[1], r[2]) for r in got if r[0] == 1] == sorted(want) and len(want) >= 8


def test_flanks_are_cut_without_the_record(spark):
    rng = np.random.default_rng(13)
    s = "".join(rng.choice(list("ACGT"), 9000))
    df = spark.createDataFrame([(1, s.lower())], "rec_id long, seq string")
    occ = spark.createDataFrame([(7, 1, p, f) for p in (0, 10, 4090, 8990) for f in (True, False)], "kmer long, rec_id long, pos long, forward boolean")
    rc = str.maketrans("ACGT", "TGCA")
    for r in consensus.oriented_flanks(df, occ, 10, 50).collect():
        before, mid, after = s[max(0, r.pos - 50) : r.pos], s[r.pos : r.pos + 10], s[r.pos + 10 : r.pos + 60]
        if not r.forward:
            before, mid, after = (x.translate(rc)[::-1] for x in (after, mid, before))
        assert (r.seed_seq, r.left, r.right) == (mid, before[::-1], after)


def test_runs_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TILE", 16)
    pos = sorted({int(x) for x in np.random.default_rng(14).integers(0, 300, 200)})
    df = spark.createDataFrame([(1, p) for p in pos] + [(1, pos[0]), (2, 5)], "k long, pos long")
    got = sorted((r.start_pos, r.end_pos) for r in intervals.set_runs(df, ["k"]).where("k = 1").collect())
    want, start = [], pos[0]
    for a, b in zip(pos, [*pos[1:], -1]):
        if b != a + 1:
            want.append((start, a + 1))
            start = b
    assert got == want


def test_named_union(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(k, int(s), int(s + n), str(rng.choice(["", "b", "a", "c"])) if rng.random() < 0.8 else None) for k in ("x", None) for s, n in zip(rng.integers(0, 900, 60), rng.integers(-2, 25, 60))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, start_pos long, end_pos long, name string, _s int")
    want = set()
    for k in ("x", None):
        runs: list[list] = []
        for s, e, n in sorted((s, e, n or "") for kk, s, e, n in rows if kk == k and e > s):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
                runs[-1][2].append((s, e, n))
            else:
                runs.append([s, e, [(s, e, n)]])
        want |= {(k, s, e, next((n for _, _, n in sorted(x for x in got if x[2])), "")) for s, e, got in runs}
    for tile in (8, 1 << 18):
        assert {(r.k, r.start_pos, r.end_pos, r.name) for r in intervals.union_named(df, ["k"], tile=tile).collect()} == want
