"""The numbered operators against brute force on small data, with nulls, empty input, ties, repeated rows and skew."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import cutoffs, frequent, mixing, packing, samples, spans
from helixframe.llm.tokens import RANK_FILE, TOKENIZER_DIR, _encoding, stretches, token_count

EXTRA = "value int, total int, kind int, _s int"


def test_frequent_against_counter(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v) if v % 11 else None, int(c) if c % 7 else None) for i, (v, c) in enumerate(zip(rng.zipf(1.6, 4000) % 900, rng.integers(1, 40, 4000)))]
    rows += [(4000 + i, 5, 9) for i in range(2500)]  # one value with a third of all rows
    rows += rows[100:700]  # sent again
    want = Counter()
    for _, v, c in set(rows):
        if v is not None and c is not None:
            want[v] += c
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"id long, v long, c long, {EXTRA}").repartition(5)
    order = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for k, parts in ((1, 1), (7, 3), (50, 16), (5000, 4)):
        assert [tuple(r) for r in frequent.frequent_values(df, "v", "c", "id", k, parts).collect()] == order[:k]
    total = sum(want.values())
    assert {tuple(r) for r in frequent.heavy_values(df, "v", "c", "id", 40, 9).collect()} == {(v, c) for v, c in order if c * 40 >= total}
    assert frequent.heavy_values(df.where("false"), "v", "c", "id", 40).count() == 0
    ties = spark.createDataFrame([(i, i % 10, 1) for i in range(100)], "id long, v long, c long")
    assert [r.value for r in frequent.frequent_values(ties, "v", "c", "id", 4, 6).collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("bins", [2, 256])
def test_cutoffs_against_sorting(spark, bins):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.choice([1, 2, 3, 4, 5], p=[0.7, 0.1, 0.1, 0.05, 0.05])), int(rng.integers(-40, 5000))) for i in range(3000)]
    rows += [(10_000 + i, 6, 77) for i in range(30)] + [(20_000, 7, None), (20_001, None, 5), (None, 1, 5)]
    rows += rows[:500]
    targets = [(1, 300), (2, 0), (3, 1000), (4, 1), (5, 999), (6, 500), (7, 500), (8, 500), (9, None), (1, 700), (2, 1001)]
    by = {}
    for i, s, v in set(rows):
        if i is not None and s is not None and v is not None:
            by.setdefault(s, []).append(v)
    want = []
    for s, pm in targets:
        vs = by.get(s, [])
        cut = next((c for c in sorted(set(vs), reverse=True) if pm is not None and sum(v >= c for v in vs) * 1000 >= pm * len(vs)), None)
        want.append((s, len(vs), cut, sum(v >= cut for v in vs) if cut is not None else 0))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, s int, v int, n int, lo int").repartition(4)
    t = spark.createDataFrame(targets, "s int, pm int")
    got = [tuple(r) for r in cutoffs.share_cutoffs(df, t, "s", "v", "id", "pm", bins).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert cutoffs.share_cutoffs(df.where("false"), t, "s", "v", "id", "pm").where("cutoff IS NOT NULL").count() == 0
    doubles = spark.createDataFrame([(i, 1, x) for i, x in enumerate([0.1, 0.2, 0.2, 1e9, float("nan")])], "id long, s int, v double")
    assert cutoffs.share_cutoffs(doubles, spark.createDataFrame([(1, 500)], "s int, pm int"), "s", "v", "id", "pm").first().cutoff == 0.2


def test_cutoffs_of_repeated_targets_and_wide_scores(spark):
    ten = spark.createDataFrame([(i, 1, float(i)) for i in range(10)], "id long, s int, v double")
    twice = spark.createDataFrame([(1, 300), (1, 300)], "s int, pm int")
    assert [tuple(r) for r in cutoffs.share_cutoffs(ten, twice, "s", "v", "id", "pm").collect()] == [(1, 10, 7.0, 3)] * 2
    wide = [float("inf"), float("inf"), 1.7e308, 5e-324, 0.0, -0.0, -5e-324, -1e-300, -1.7e308, float("-inf")]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(wide)], "id long, s int, v double")
    asked = spark.createDataFrame([(1, pm) for pm in range(0, 1001, 50)], "s int, pm int")
    for bins in (2, 256):
        got = {(r.cutoff, r.kept) for r in cutoffs.share_cutoffs(df, asked, "s", "v", "id", "pm", bins).collect()}
        assert got == {(c, sum(v >= c for v in wide)) for c in set(wide)}


PIECES = "piece long, key long, met long, got array<struct<rec:long,pos:int>>, piece_id int, u int"


def pieces(spark, data):
    return spark.createDataFrame([(p, k, m, None if o is None else [(p, x) for x in range(o)], 0, 0) for p, k, m, o in data], PIECES)


def test_samples_have_their_size_and_fair_shares(spark):
    # a capped piece that met half of all, and many small ones
    data = [(0, 1, 2000, 20)] + [(i, 1, 20, 20) for i in range(1, 101)] + [(900, 1, 0, 0), (901, 1, 5, None), (None, 1, 9, 3), (902, 2, None, 7), (903, None, 2, 2)]
    df = pieces(spark, data + data[:30]).repartition(4)
    hits, places = Counter(), Counter()
    for seed in range(12):
        got = samples.sample_occurrences(df, 200, None, "piece", "met", "got", seed).collect()
        assert len(got) == 200
        hits.update(r.piece_id == 0 for r in got)
        places.update(r.occ.pos for r in got if r.piece_id)
    share = hits[True] / sum(hits.values())
    assert abs(share - 2000 / 4009) < 4 * math.sqrt(0.25 / 2400)
    assert max(places[p] for p in range(20)) < 3 * min(places[p] for p in range(20))
    per = samples.sample_occurrences(df, 50, "key", "piece", "met", "got").collect()
    assert Counter(r.key for r in per) == {1: 50, 2: 7, None: 2}
    small = [r for r in per if r.key == 2]
    assert len({r.occ.pos for r in small}) == 7
    again = samples.sample_occurrences(df.repartition(2), 50, "key", "piece", "met", "got").collect()
    assert sorted(map(repr, per)) == sorted(map(repr, again))
    assert samples.sample_occurrences(df.where("false"), 10, None, "piece", "met", "got").count() == 0


def test_draws_are_order_statistics():
    n = 3000
    row, rank, u, _, _ = samples.piece_draws(np.arange(n), np.full(n, 1000), np.full(n, 10), 3, 1)
    by = np.zeros((n, 3))
    by[row, rank] = u
    assert abs(by[:, 0].mean() - 1 / 1001) < 1e-4 and abs(by[:, 2].mean() - 3 / 1001) < 2e-4
    row, rank, u, which, again = samples.piece_draws(np.array([5]), np.array([8]), np.array([3]), 100, 1)
    assert len(u) == 8 and (np.diff(u) > 0).all() and sorted(Counter(which.tolist()).values()) == [2, 3, 3] and again.tolist() == [0, 0, 0, 1, 1, 1, 2, 2]
    # a bound lets the same numbers pass that are under it
    piece, seen, kept = np.arange(50), np.full(50, 5000), np.full(50, 5000)
    whole = samples.piece_draws(piece, seen, kept, 4000, 3)
    part = samples.piece_draws(piece, seen, kept, 4000, 3, np.full(50, 0.01))
    pick = whole[2] < 0.01
    rows = lambda d, keep: sorted(zip(*(x[keep].tolist() for x in d)))
    assert rows(whole, pick) == rows(part, np.ones(len(part[0]), bool))


def test_buffers_stay_small_in_a_task_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(samples, "FRESH", 500)
    import pyarrow as pa

    out = pa.schema([("_key", pa.int64()), ("_piece", pa.int64()), ("_at", pa.int64()), ("_u", pa.float64()), ("_level", pa.int32()), ("again", pa.int64()), ("occ", pa.int64())])
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([None] * 40, pa.int64()), pa.array(range(40 * i, 40 * i + 40)), pa.array([20] * 40), pa.array([list(range(20))] * 40)], names=["k", "p", "s", "o"])
    got = list(samples._drawn(50, 1, out)(batch(i) for i in range(60)))
    assert 20 <= sum(b.num_rows for b in got) <= 50 and len(set(got[0].column("_level").to_pylist())) == 1
    # more tasks than are merged at once
    data = [(i, i % 3, 30, 30) for i in range(400)]
    df = pieces(spark, data + data[:50]).repartition(9)
    got = samples.sample_occurrences(df, 40, "key", "piece", "met", "got", fan_in=2).collect()
    assert Counter(r.key for r in got) == {0: 40, 1: 40, 2: 40} and len({(r.piece_id, r.occ.pos) for r in got}) == 120 and {r.again for r in got} == {0}


def brute_shared(rows):
    seqs = {}
    for r, s in rows:
        if r is not None and s is not None:
            seqs.setdefault(r, set()).add(s.upper())
    where = {}
    for r, ss in seqs.items():
        for s in ss:
            for i in range(len(s) - 63):
                w = s[i : i + 64]
                if not set(w) - set("ACGT"):
                    where.setdefault(w, set()).add(r)
    out = set()
    for r, ss in seqs.items():
        bases = {b for s in ss for i in range(len(s) - 63) if len(where.get(s[i : i + 64], ())) > 1 for b in range(i, i + 64)}
        for b in sorted(bases):
            if b - 1 not in bases:
                start = b
            if b + 1 not in bases:
                out.add((r, start, b + 1))
    return out


def dna(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


@pytest.mark.parametrize("hot_rows", [10_000, 5])
def test_spans_against_all_windows(spark, hot_rows):
    rng = np.random.default_rng(4)
    family = dna(rng, 300)
    rows = []
    for i in range(40):
        a = int(rng.integers(0, 200))
        piece = list(family[a : a + int(rng.integers(60, 300))])
        for _ in range(int(rng.integers(0, 4))):
            piece[int(rng.integers(0, len(piece)))] = str(rng.choice(list("ACGTN")))
        rows.append((i, dna(rng, int(rng.integers(0, 90))) + "".join(piece) + dna(rng, 50)))
    rows += [(100, "A" * 200), (101, "A" * 63), (102, "ca" * 40 + "A" * 70), (103, "AC" * 50), (104, None), (None, family), (105, ""), (106, "N" * 80), (107, family[:64].lower()), (108, dna(rng, 64)), (3, rows[3][1].lower()), (3, rows[3][1])]
    if hot_rows == 5:  # a third of all stretches has the same anchor
        rows += [(200 + i, "A" * int(rng.integers(64, 120))) for i in range(80)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "rec_id long, seq string, start_pos int, anchor int").repartition(6)
    if hot_rows == 5:
        assert len(spans.hot_anchors(df.select("rec_id", "seq").where("rec_id IS NOT NULL AND length(seq) >= 64"), 5)) >= 1
    got = [(r.rec_id, r.start_pos, r.end_pos) for r in spans.shared_spans(df, hot_rows=hot_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_shared(rows)
    texts = {}
    for r, q in rows:
        texts.setdefault(r, []).append((q or "").upper())
    for f in spans.shared_factors(df, hot_rows=hot_rows).collect():
        n = f.end_pos - f.start_pos
        own = {q[f.start_pos : f.end_pos] for q in texts[f.rec_id] if len(q) >= f.end_pos}
        there = {q[f.source_start : f.source_start + n] for q in texts[f.source_rec]}
        assert n >= 64 and f.source_rec != f.rec_id and own & there
    share = {r.rec_id: (r.bases, r.shared, r.shared_permille) for r in spans.shared_share(df, spans.shared_spans(df)).collect()}
    assert share[101] == (63, 0, 0) and share[105] == (0, 0, None) and share[104] == (0, 0, None) and share[107] == (64, 64, 1000)


def test_records_parsed_at_once(spark):
    rng = np.random.default_rng(6)
    shared = dna(rng, 900)
    rows = [(1, dna(rng, 500) + shared), (2, shared + dna(rng, 500))]
    whole = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, "rec_id long, seq string")).collect()}
    assert whole == brute_shared(rows)
    codes = spans._CODE[np.frombuffer(rows[0][1].encode(), np.uint8)]
    start, windows, _, _ = spans.stretches(codes, np.empty(0, np.int64))
    assert {int(s) + i for s, n in zip(start, windows) for i in range(int(n))} == set(range(len(codes) - 63))


def test_scan_and_parse_in_small_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spans, "PIECE", 700)
    monkeypatch.setattr(spans, "BLOCK_ROWS", 40)
    monkeypatch.setattr(spans, "BATCH_ROWS", 25)
    rng = np.random.default_rng(17)
    fam = dna(rng, 2000)
    rows = [(i, (dna(rng, 50) + fam[a : a + 400] + "N" + dna(rng, 30)).swapcase() if i % 2 else fam[a : a + 300] + dna(rng, 90)) for i, a in enumerate(rng.integers(0, 1700, 40).tolist())]
    batches = [pa.RecordBatch.from_arrays([pa.array([r for r, _ in part]), pa.array([q for _, q in part])], names=["rec_id", "seq"]) for part in (rows[:3], rows[3:30], rows[30:])]
    cut = pa.Table.from_batches(list(spans._stretch_rows(np.empty(0, np.uint64), False)(iter(batches)))).sort_by("bases")
    bases = set()
    for b in spans._parse_blocks(iter(cut.to_batches(max_chunksize=7))):
        for r, s, e, *_ in zip(*(c.to_pylist() for c in b.columns)):
            bases |= {(r, x) for x in range(s, e)}
    assert bases == {(r, x) for r, s, e in brute_shared(rows) for x in range(s, e)}


def test_factors_are_the_longest_matches():
    rng = np.random.default_rng(16)
    shared = dna(rng, 100)
    # the second record agrees with the first over 90 letters, the third over all 100
    rows = [dna(rng, 30) + shared + dna(rng, 30), dna(rng, 10) + shared[:90] + dna(rng, 40), dna(rng, 20) + shared + dna(rng, 20)]
    parts = []
    for i, q in enumerate(rows):
        start, windows, place, words = spans.stretches(spans._CODE[np.frombuffer(q.encode(), np.uint8)], np.empty(0, np.int64))
        six = words[spans._FRONT + place[:, None] + np.array([0, 32, 64, 96, -64, -32])]
        parts.append((np.full(len(start), i), start, windows, place - start, six))
    cols = [np.concatenate(x) for x in zip(*parts)]
    by = np.argsort(cols[4][:, 0] >> np.uint64(24), kind="stable")
    rec, start, end, source, _ = spans.parse(*(c[by] for c in cols))
    assert all(s == 2 for r, e, s in zip(rec, end, source) if r == 0 and e > 120)
    # factors hold each shared window once
    windows = sorted(int(w) for r, s, e in zip(rec, start, end) if r == 0 for w in range(s, e - 63))
    assert windows == list(range(windows[0], windows[-1] + 1)) and windows[0] <= 30 and windows[-1] >= 66


def test_best_fit_and_segment_tree():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 101, 600)
    placed = packing.best_fit_decreasing(sizes, 100)
    used = np.bincount(placed, weights=sizes)
    assert used.max() <= 100 and len(used) <= sizes.sum() / 100 * 11 / 9 + 1
    room, want = [], []  # plain best fit, the tightest open bin first
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = 100
            want.append(1)
        room.append(r - s)
    assert len(want) == len(used)
    assert packing.best_fit_decreasing(np.array([100, 100]), 100).tolist() == [0, 1]


def test_pack(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 2049), (None, 7), (6, 10), (6, 10)] + [(100 + i, 300) for i in range(50)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc long, size long, part int, container_id int")
    got = packing.pack_items(df, "doc", "size", 2048, 3).collect()
    by = Counter()
    for r in got:
        if r.container_id is not None:
            by[r.container_id] += r.tokens
    assert max(by.values()) <= 2048
    assert sorted((r.part, r.token_start, r.tokens) for r in got if r.doc == 1) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert sorted((r.part, r.tokens, r.container_id) for r in got if r.doc in (2, 3)) == [(0, 0, None), (0, 0, None)]
    assert {r.doc for r in got if r.part == 1} == {1, 5} and sum(r.doc == 6 for r in got) == 2 and sum(r.tokens for r in got) == sum(s or 0 for _, s in rows)
    assert packing.pack_items(df.where("false"), "doc", "size", 2048, 3).count() == 0
    assert packing.fill_report(packing.pack_items(df.where("false"), "doc", "size", 2048, 3), 2048).first().containers == 0


def test_tokens(spark):
    texts = ["", "a", " word " * 30_000, "漢字" * 60_000, "x" * 120_000, None, "tab\there\n\n  two"]
    assert all("".join(stretches(t)) == t for t in texts if t is not None)
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got[0] == 0 and got[5] is None and got[1] == 1 and all(n > 0 for n in got[2:5])


def test_tokens_of_stretches_are_those_of_the_text():
    rng = np.random.default_rng(9)
    mixed = "".join(rng.choice(list("ab1ก่漢。 \n'é٣"), 3000))
    whole = _encoding(f"{TOKENIZER_DIR}/{RANK_FILE}")
    han = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 8000, 200_000))
    for text, size in ((mixed, 7), (mixed, 100), (han, 50_000), (han[:1000] + "。" + han[1000:], 50_000), ("ส" * 100_000 + "ี" + "ว" * 100_000, 50_000), (" \n" * 500 + "x", 10), ("it's 5 o'clock\n\n  now " * 50, 9)):
        parts = list(stretches(text, size))
        assert "".join(parts) == text and sum(len(whole.encode_ordinary(x)) for x in parts) == len(whole.encode_ordinary(text))
    with pytest.raises(FileNotFoundError):
        _encoding("/no/such/file")


def test_permutations():
    for size in (1, 2, 3, 5, 64, 1000):
        a = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 12345))
        assert sorted(a.tolist()) == list(range(size))
    a, b = (mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_fair_shares():
    got = mixing.fair_shares(100, np.array([50.0, 30, 20, 0]), np.array([10.0, 1000, 1000, 1000]))
    assert got.tolist() == [10, 54, 36, 0]
    assert mixing.fair_shares(100, np.array([1.0, 1.0]), np.array([10.0, 20.0])).tolist() == [10, 20]
    assert mixing.fair_shares(0, np.array([1.0]), np.array([5.0])).tolist() == [0]


def test_mixture(spark):
    rng = np.random.default_rng(8)
    docs = [(i, "big", int(rng.integers(0, 4000))) for i in range(900)] + [(2000 + i, "small", 100) for i in range(30)] + [(3000 + i, None, 50) for i in range(20)] + [(4000, "none", 70)] + [(5000, "tiny", 40)]
    targets = [("big", 500, 1), ("small", 300, 3), ("tiny", 1, 10_000), ("absent", 199, 4), (None, 5, 5)]
    made = lambda fill: mixing.Mixture(spark.createDataFrame(docs, "doc_id long, source string, tokens long").repartition(4), spark.createDataFrame(targets, "source string, target_permille int, max_repeat int"), fill=fill)
    m = made(False)
    filled = made(True)
    total = sum(t for _, _, t in docs)
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += t
    shares = {r.source: r for r in m.shares().collect()}
    assert set(shares) == {"big", "small", "tiny", "absent"}
    assert {s for s, r in shares.items() if r.short} == {s for s, pm, k in targets if s and sizes[s] * k * 1000 < pm * total}
    assert abs(shares["big"].planned_permille - 500) < 40 and shares["small"].mixed_tokens == 3 * sizes["small"] and shares["absent"].mixed_tokens == 0
    rows = m.mix().collect()
    mixed = Counter()
    uses = Counter()
    for r in rows:
        mixed[r.source] += r.tokens
        uses[r.source, r.block, r.doc_id, r.token_start] += 1
    assert {s: r.mixed_tokens for s, r in shares.items() if r.mixed_tokens} == dict(mixed)
    limit = {s: k for s, _, k in targets}
    assert all(n <= limit[k[0]] for k, n in uses.items())
    blocks = Counter()
    for k in uses:
        blocks[k[0], k[1]] += next(r.tokens for r in rows if (r.source, r.block, r.doc_id, r.token_start) == k)
    assert max(blocks.values()) <= mixing.BLOCK_TOKENS
    # what the short sources leave goes to those with room, until all of them are used up
    more = {r.source: r for r in filled.shares().collect()}
    assert {s for s, r in more.items() if r.short} == {"small", "absent"} and more["small"].mixed_tokens == 3 * sizes["small"]
    slots = filled.slots.groupBy("source").count().rdd.collectAsMap()
    caps = {"big": -(-sizes["big"] // mixing.BLOCK_TOKENS), "tiny": 10_000, "small": 3 * -(-sizes["small"] // mixing.BLOCK_TOKENS)}
    assert sum(slots.values()) == filled.planned and all(n <= caps[s] for s, n in slots.items()) and slots["small"] == caps["small"]
    assert filled.slots.groupBy("shard").count().where(f"count > {mixing.SHARD_SLOTS}").count() == 0
    empty = mixing.Mixture(spark.createDataFrame([], "doc_id long, source string, tokens long"), spark.createDataFrame(targets, "source string, target_permille int, max_repeat int"))
    assert empty.mix().count() == 0 and {r.source: r.short for r in empty.shares().collect()} == dict.fromkeys(["big", "small", "tiny", "absent"], False)
