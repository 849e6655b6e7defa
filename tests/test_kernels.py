"""Kernels and relational operators against plain versions on small random data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import hashing, seq
from helixframe.operators import align, consensus, graph, intervals, masks, ordering
from helixframe.operators import kmers as K
from helixframe.operators.tuning import k_sets
from helixframe.sources import text

RC = str.maketrans("ACGT", "TGCA")


def dna(salt: int, n: int) -> str:
    x = hashing.splitmix64(np.arange(n, dtype=np.uint64) ^ np.uint64(salt << 32))
    return "".join("ACGT"[i] for i in (x % np.uint64(4)).tolist())


def mutated(s: str, rate: float, salt: int) -> str:
    rng = np.random.default_rng(salt)
    return "".join(rng.choice(list("ACGT")) if rng.random() < rate else c for c in s)


def records(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "rec_id long, seq string").repartition(2)


def test_splitmix_and_bloom_constants():
    assert int(hashing.splitmix64(np.array([0], np.uint64)).view(np.int64)[0]) == -2152535657050944081
    assert hashing.bloom_seeds(18) == (11203828482116970681, 2444625645988706621)
    d = hashing.Draws(42)
    assert all(0 <= d.below(10) < 10 for _ in range(200)) and 0 <= d.unit() < 1


@pytest.mark.parametrize("bad", ["", "1101", "0110", "1x1", "1" * 33])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        seq.SpacedSeed(bad)


@pytest.mark.parametrize("pattern", ["111", "1" * 18, "1" * 31, "11011011011", "101"])
def test_seeds_against_text(spark, pattern):
    s = dna(3, 60)[:30] + "NNn" + dna(4, 25).lower() + "X" + "ACG"
    p = seq.SpacedSeed(pattern)
    want = []
    for i in range(len(s) - p.span + 1):
        w = s[i : i + p.span].upper()
        if set(w) <= set("ACGT"):
            pick = lambda x: "".join(c for c, k in zip(x, pattern) if k == "1")
            want.append((i, min(pick(w), pick(w.translate(RC)[::-1]))))
    got = K.seeds(records(spark, s, None, "", "AC"), p).select("pos", seq.kmer_text(F.col("kmer"), p.weight).alias("t")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == want


def test_sampling_keeps_about_its_share_and_rejects_others(spark):
    got = spark.range(200_000).where(hashing.is_sampled(hashing.seed_hash_of("id"), 16)).count()
    assert 10_000 < got < 15_000
    with pytest.raises(ValueError):
        K.seeds(records(spark, "ACGT"), 3, sample=7)


def test_column_functions(spark):
    df = spark.createDataFrame([("AACGTNg",)], "s string")
    r = df.select(seq.revcomp(F.col("s")).alias("rc"), seq.gc_fraction(F.col("s")).alias("gc"), seq.trim_runs(F.lit("A" * 10 + "CGTACG" + "T" * 10)).alias("t"), seq.base_code(F.lit("g")).alias("c"), seq.base_letter(F.lit(3)).alias("b"), seq.kmer_packed(F.lit("ACG")).alias("p")).first()
    assert tuple(r) == ("cNACGTT", 3 / 7, "CGTACG", 2, "T", 6)
    b = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 12, 255, 256)], "c long").select(seq.log2_bucket(F.col("c")).alias("b")).collect()
    assert [x.b for x in b] == [0, 0, 1, 1, 2, 3, 7, 8]
    names = ["x_Alu_1#y", "Alu", "L1-a", "LTR ERVL-MaLR", "Tigger7_var3", "LINE_CR1_denovo", "zz"]
    f = spark.createDataFrame([(n,) for n in names], "n string").select(seq.family_of_name(F.col("n")).alias("f")).collect()
    assert [x.f for x in f] == ["Unknown", "SINE/Alu", "LINE/L1", "LTR/ERVL-MaLR", "DNA/TcMar", "LINE/CR1", "Unknown"]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100, 200: 200}


def test_components_mask(spark):
    unit = dna(9, 40)
    s = dna(1, 300) + "".join(unit + dna(20 + i, 50) for i in range(6)) + dna(2, 300)
    got = masks.mask_components(records(spark, s), 12, 3, least=30).collect()
    want = [s.index(unit, p) for p in range(len(s)) if s.startswith(unit, p)]
    # a base beside a copy may agree with others by chance
    assert all(any(p - 4 <= r.start_pos <= p and p + 40 <= r.end_pos <= p + 44 for r in got) for p in want) and len(want) == 6


def plain_xdrop(a, b, band, xdrop):
    low = -(10**9)
    best, bi, bj = 0, 0, 0
    prev = {j: -3 * j for j in range(0, min(band, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        cur, top = {}, low
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            v = max(prev.get(j - 1, low) + (1 if j and a[i - 1] == b[j - 1] else -1) if j else low, prev.get(j, low) - 3, cur.get(j - 1, low) - 3)
            cur[j] = v
            top = max(top, v)
            if v > best:
                best, bi, bj = v, i, j
        if top < best - xdrop:
            break
        prev = cur
    return best, bi, bj


@pytest.mark.parametrize("salt", range(12))
def test_xdrop_against_plain(salt):
    rng = np.random.default_rng(salt)
    a = dna(salt, 150)
    b = mutated(a, 0.15, salt)
    if salt % 3 == 0:
        cut = int(rng.integers(20, 100))
        b = b[:cut] + b[cut + 3 :]
    arr = lambda x: np.frombuffer(x.encode(), np.uint8)
    for band, xdrop in ((8, 30), (16, 40), (3, 10)):
        assert align.xdrop_extend(arr(a), arr(b), band, xdrop) == plain_xdrop(a, b, band, xdrop)
    assert align.xdrop_extend(arr(a), arr(a), 8, 30) == (150, 150, 150)
    assert align.xdrop_extend(arr(a), arr(dna(salt + 99, 150)), 8, 10)[0] < 20


@pytest.mark.parametrize("single", [False, True])
def test_library_finds_diverged_copies(spark, single):
    cons = dna(11, 300)
    s, places = "", []
    for i in range(6):
        s += dna(50 + i, 800)
        copy = mutated(cons, 0.15, i)
        places.append((len(s), len(s) + 300))
        s += copy if i % 2 else copy.translate(RC)[::-1]
    s += dna(60, 800)
    lib = spark.createDataFrame([("fam", cons)], "consensus string, seq string")
    settings = align.Settings(single_hit=single)
    got = align.library_candidates(records(spark, s, None), lib, settings).collect()
    for a, b in places:
        assert sum(max(0, min(b, r.end_pos) - max(a, r.start_pos)) for r in got) >= 0.8 * (b - a)
    assert sum(r.end_pos - r.start_pos for r in got) <= 6 * 300 + 360
    assert {r.strand for r in got} == {"+", "-"}
    with pytest.raises(ValueError):
        align.Settings(gate=(1, 2, 3))


def test_consensus_extension():
    cons = dna(21, 300)
    copies = [(mutated(cons, 0.2, i) + dna(300 + i, 200)).encode() for i in range(40)]
    got, scores = consensus.extend(copies, 16, 60, 600)
    assert 280 <= len(got) <= 320 and (scores > 0).sum() >= 35
    assert np.mean([a == b for a, b in zip(got.decode(), cons)]) >= 0.9
    none, _ = consensus.extend([dna(900 + i, 400).encode() for i in range(60)], 16, 60, 400)
    assert len(none) < 20
    assert consensus.extend(copies[:2], 16, 60, 600)[0] == b""
    assert consensus.is_tandem(b"ACGTG" * 40) and not consensus.is_tandem(dna(5, 200).encode())


def test_build_consensi(spark):
    cons = dna(31, 250)
    s = "".join(dna(400 + i, 300) + mutated(cons, 0.05, i) for i in range(20)) + dna(77, 300)
    recs = records(spark, s)
    got = consensus.build_consensi(recs, K.build_index(recs, 18, 1, 3), 18, min_seed_count=3, max_families=5, seed_pool=100, max_occ=30, flank=400, min_support=5).collect()
    assert got and 200 <= max(len(r.seq) for r in got) <= 300


@pytest.mark.parametrize("k,second,size", [(18, False, 4), (18, True, 7), ("11011011011011011011", True, 5)])
def test_rounds_change_nothing(spark, k, second, size):
    """build_consensi against the plain choice in order over all extensions."""
    p = k if isinstance(k, int) else seq.SpacedSeed(k)
    span, weight = (k, k) if isinstance(k, int) else (p.span, p.weight)
    fams = [dna(41, 220), dna(42, 150), dna(43, 90)]
    s = "".join(dna(500 + i, 120) + mutated(fams[i % 3] if i % 5 else fams[0], 0.06, i) for i in range(60)) + "ACGTTGA" * 30
    recs = records(spark, s[: len(s) // 2], s[len(s) // 2 :])
    opts = dict(min_seed_count=3, max_families=3, seed_pool=400, max_occ=20, flank=300, min_support=6)
    index = K.build_index(recs, p, 1, 3)
    got = consensus.build_consensi(recs, index, p, second_pass=second, second_min_support=3, size=size, **opts).collect()
    pool = consensus.top_seeds(index, 400, 3)
    found = consensus.occurrences(recs, pool, p, 20).join(pool, "kmer")
    all_grown = {r.kmer: r for r in consensus.extended(consensus.oriented_flanks(recs, found, span, 300), span, 20, 300, 16, 100, 3 if second else 6).collect()}
    n = {r.kmer: r["count"] for r in found.groupBy("kmer").count().collect()}
    order = sorted(all_grown.values(), key=lambda r: (-r.cnt, r.kmer))
    shape = seq.SpacedSeed.contiguous(k) if isinstance(k, int) else p
    covered, twelve, want, done = np.empty(0, np.uint64), set(), [], set()
    for turn, (most, length, least) in enumerate([(3, 50, 6), (500, 80, 3)][: 1 + second]):
        here = tries = 0
        for r in order:
            if here >= most or tries >= max(100, 20 * most):
                break
            if n[r.kmer] < least or r.kmer in done or consensus._near_covered(r.kmer, covered, weight):
                continue
            tries += 1
            own = set(consensus._seed_set(r.seq, seq.SpacedSeed.contiguous(12)).tolist())
            if len(r.seq) < length or r.support < least or r.tandem or own and 10 * len(own & twelve) >= 6 * len(own):
                continue
            here += 1
            done.add(r.kmer)
            covered = np.union1d(covered, np.append(consensus._seed_set(r.seq, shape), np.uint64(r.kmer)))
            twelve |= own
            want.append((r.seq, r.support, turn + 1))
    assert [(r.seq, r.support, r["pass"]) for r in got] == want and len(want) >= 2


def test_tandem_and_dust(spark):
    rnd = dna(41, 2000)
    s = rnd[:500] + "CA" * 40 + rnd[500:1000] + "ACGTTGCAAGTCCATGGCATTTCAGGATACCGATTAG" * 12 + rnd[1000:]
    got = masks.mask_tandem(records(spark, s), min_len=30).collect()
    cover = lambda a, b, rows: len(set().union(*[set(range(max(a, r.start_pos), min(b, r.end_pos))) for r in rows]))
    assert cover(500, 580, got) >= 72 and cover(1080, 1524, got) >= 355
    assert not masks.mask_tandem(records(spark, dna(43, 20_000)), min_len=30).collect()
    low = rnd[:300] + "AT" * 28 + rnd[300:600]
    d = masks.mask_dust(records(spark, low), 64, 3.0).collect()
    assert cover(300, 356, d) >= 45
    for w in (8, 64):
        codes = K.CODE[np.frombuffer((low[:200] + "N" + low[200:]).encode(), np.uint8)]
        scores = masks.low_complexity_scores(codes, w)
        for i in range(0, len(scores), 37):
            x = (low[:200] + "N" + low[200:])[i : i + w]
            t = [x[j : j + 3] for j in range(w - 2)]
            assert scores[i] == (-1 if "N" in x else sum(t.count(u) * (t.count(u) - 1) for u in set(t)))


def test_mask_edges(spark):
    recs = spark.createDataFrame([(1, "ACGTacgtNN"), (2, None), (3, "")], "rec_id long, seq string")
    regions = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 8, 99), (7, 0, 5)], "rec_id long, start_pos long, end_pos long")
    soft = {r.rec_id: r.seq for r in masks.apply_mask(recs, regions).collect()}
    hard = {r.rec_id: r.seq for r in masks.apply_mask(recs, regions, "hard").collect()}
    assert soft == {1: "ACgtacgtnn", 2: None, 3: ""} and hard[1] == "ACNNNNgtNN"
    assert sorted((r.start_pos, r.end_pos) for r in masks.case_runs(recs, "masked").collect()) == [(4, 10)]
    assert masks.mask_graph(recs.where("false"), 12, 2).count() == 0
    with pytest.raises(ValueError):
        masks.mask_windows(recs, 21, 3, 10)
    with pytest.raises(ValueError):
        masks.compare_masks(recs.where("rec_id = 2"), recs)


def test_intervals_small(spark):
    iv = lambda rows: spark.createDataFrame(rows, "c string, start_pos long, end_pos long")
    a, b = iv([("x", 0, 100), ("x", 200, 300)]), iv([("x", 50, 150), ("x", 250, 350), ("y", 0, 10)])
    m = intervals.evaluate(a, b, ["c"]).first()
    assert (m.truth_bases, m.pred_bases, m.both_bases) == (200, 210, 100)
    assert sorted((r.start_pos, r.end_pos) for r in intervals.subtract(a, b, ["c"]).collect()) == [(0, 50), (200, 250)]
    e = intervals.evaluate(a.where("false"), b.where("false"), ["c"]).first()
    assert (e.precision, e.recall, e.f1) == (0.0, 0.0, 0.0)
    p = spark.createDataFrame([(i, "x", i) for i in (0, 99, 100, 250, 300)] + [(9, "z", 1)], "i int, c string, pos long")
    assert {r.i: r.inside for r in intervals.point_in_interval(p, a, ["c"]).collect()} == {0: True, 99: True, 100: False, 250: True, 300: False, 9: False}
    runs = intervals.set_runs(spark.createDataFrame([(x,) for x in (1, 2, 3, 10, 18, 19, 19)], "pos long"), [])
    assert sorted((r.start_pos, r.end_pos) for r in runs.collect()) == [(1, 4), (10, 11), (18, 20)]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.n for r in ordering.numbered(df, ["k"], "n", 7).orderBy("k").collect()]
    assert got == list(range(1000))


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>one first\nACGT\n\nNNac\n>two\n>three x y\r\nAC\r\nGT\r\n")
    got = sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert ("one first", "one", "ACGTNNac") in got and ("three x y", "three", "ACGT") in got and ("two", "two", "") in got
    (tmp_path / "b.bed").write_text("# c\n\nx\t1\t2\ty\nx\t3\t4\nz\t5\n")
    assert sorted(tuple(r) for r in text.read_bed(spark, str(tmp_path / "b.bed")).collect()) == [("x", 1, 2, "y"), ("x", 3, 4, None)]
    (tmp_path / "c.bed").write_text("x\ta\t2\n")
    with pytest.raises(Exception):
        text.read_bed(spark, str(tmp_path / "c.bed")).collect()
    assert k_sets([1, 2, 3]) == [(1,), (2,), (3,), (1, 2, 3), (1, 2), (1, 3), (2, 3)]


def test_model_text(spark):
    m = spark.createDataFrame([("g", [0.5] * 8, [0.0] * 8, [1.0] * 8, 0.25, 0.5)], "grp string, w array<double>, mu array<double>, sd array<double>, b0 double, tau double")
    g = spark.createDataFrame([("c1", "g", 0.1)], "consensus string, grp string, shift double")
    t = spark.createDataFrame([("c2", 15)], "consensus string, threshold int")
    lines = [x for r in text.model_lines(m, g, t).orderBy("place").collect() for x in r.value.split("\n")]
    groups, members, thresholds = text.read_models(lines)
    assert groups[0]["w"] == [0.5] * 8 and groups[0]["tau"] == 0.5 and members == {"c1": ("g", 0.1)} and thresholds == {"c2": 15}


def test_tables_of_other_tools(spark):
    lines = ["#c", *["a"] * 3, "1\t600\t2000\t2600\t600\t600\t95.5\tx\tx", "1\t600\t2000\t2600\t600\t600\t95.5\tx\ty", "1\t60\t2000\t2060\t60\t60\t99\tx\tx", "1\t600\tz\t2600\t600\t600\t80\tx\tx", "short"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    assert [(r.s1, r.e2, r.identity) for r in text.parse_alignment_table(df).collect()] == [(1, 2600, 95.5)]
    hit = "chr1 - MIR - 1 99 900 801 x x 1000 - 1e-5 40.5 0.1 -"
    hits = spark.createDataFrame([("# " + hit,), (hit,), ("a b c",), (hit.replace("900", "nine"),), (hit.replace("40.5", "4"),)], "value string")
    assert [tuple(r) for r in text.parse_hit_table(hits, min_score=20, max_evalue=1e-3).collect()] == [("chr1", 800, 900, "SINE/MIR", 40.5, 1e-5)]


def test_chosen_rows_and_median(spark):
    from helixframe.operators.analysis import random_rows, upper_median

    df = spark.range(100)
    one, two = ([r.id for r in random_rows(x, "id", 7).collect()] for x in (df, df.repartition(5)))
    assert one == two and len(one) == 7
    assert upper_median(spark.createDataFrame([(x,) for x in (5, 1, 3, 9)], "n long"), "n").first().median == 5


@pytest.mark.parametrize("tile", [7, 64, 10_000])
def test_tiles_change_nothing(spark, tile):
    rng = np.random.default_rng(tile)
    pos = sorted(int(x) for x in rng.integers(0, 600, 70))
    chains, want = [], []
    for x in pos:
        if chains and x <= chains[-1][-1] + 5:
            chains[-1].append(x)
        else:
            chains.append([x])
    df = spark.createDataFrame([("a", x) for x in pos] + [("b", 3), ("b", None)], "k string, pos long").repartition(3)
    got = intervals.link_gaps(df, ["k"], "pos", 5, tile, n=("sum", F.lit(1)), top=("max", F.col("pos"))).collect()
    want = {("a", c[0], c[-1], len(c), c[-1]) for c in chains} | {("b", 3, 3, 1, 3)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    iv = lambda n: [("a", int(s), int(s + rng.integers(1, 40))) for s in rng.integers(0, 500, n)]
    left, right = iv(25), iv(25)
    a, b = (spark.createDataFrame(x, "k string, start_pos long, end_pos long") for x in (left, right))
    depth = lambda rows, p: sum(s <= p < e for _, s, e in rows)
    seg = intervals.depth_segments({"a": a, "b": b}, ["k"], tile).collect()
    assert all(r.a == depth(left, p) and r.b == depth(right, p) for r in seg for p in (r.start_pos, r.end_pos - 1))
    assert sum(r.end_pos - r.start_pos for r in seg if r.a and not r.b) == sum(depth(left, p) > 0 and not depth(right, p) for p in range(600))
    pts = spark.createDataFrame([("a", p) for p in range(0, 560, 3)] + [("a", None), ("z", 1)], "k string, pos long")
    inside = {r.pos: r.inside for r in intervals.point_in_interval(pts, a, ["k"], tile=tile).where("k = 'a' AND pos IS NOT NULL").collect()}
    for p, x in inside.items():
        last = max(((s, e) for _, s, e in left if s <= p and e > (p // tile) * tile), default=None)
        assert x == (last is not None and p < last[1])
