from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.operators import tiles


def brute(rows):
    """Periods and gaps of each key, one base after the other."""
    out = set()
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, set()).update(range(s, e))
    for k, bases in by.items():
        runs, at = [], sorted(bases)
        start = prev = at[0]
        for b in at[1:]:
            if b != prev + 1:
                runs.append((start, prev + 1))
                start = b
            prev = b
        runs.append((start, prev + 1))
        out |= {(k, tiles.PERIOD, s, e) for s, e in runs} | {(k, tiles.GAP, a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


def run(spark, rows, tile):
    df = spark.createDataFrame(rows, "k string, start_pos long, end_pos long").repartition(3)
    return {(r.k, r.kind, r.start_pos, r.end_pos) for r in tiles.interval_periods(df, ["k"], tile=tile).collect()}


@pytest.mark.parametrize("tile", [4, 16, 1000])
def test_periods_against_bases(spark, tile):
    rng = np.random.default_rng(tile)
    rows = []
    for _ in range(300):
        s = int(rng.integers(-50, 400))
        rows.append((rng.choice(["a", "b", None, ""], p=[0.7, 0.1, 0.1, 0.1]), s, s + int(rng.integers(-2, 30))))
    rows += [("a", None, 5), ("a", 5, None), ("c", 7, 7), ("d", 0, 100), ("d", 3, 4), ("d", 3, 4), ("e", 0, 16), ("e", 16, 32), ("e", 33, 40)]
    assert run(spark, rows, tile) == brute(rows)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, start_pos long, end_pos long")
    assert tiles.interval_periods(empty, ["k"]).count() == 0
    df = spark.createDataFrame([("x", 0, 5, 1, 2, 3)], "k string, start_pos long, end_pos long, kind int, _s int, _tile int")
    assert [tuple(r) for r in tiles.interval_periods(df, ["k"]).select("k", "kind", "start_pos", "end_pos").collect()] == [("x", 0, 0, 5)]


def test_one_long_interval_changes_no_width(spark):
    df = spark.createDataFrame([("x", 0, 10**12), ("x", 10**12 + 5, 10**12 + 9)], "k string, start_pos long, end_pos long")
    got = {(r.kind, r.start_pos, r.end_pos) for r in tiles.interval_periods(df, ["k"]).collect()}
    assert got == {(0, 0, 10**12), (1, 10**12, 10**12 + 5), (0, 10**12 + 5, 10**12 + 9)}
    far = spark.createDataFrame([("x", -(2**60), 2**60), ("x", 7, 9), ("y", 7, 9), (None, -5, 2**50)], "k string, start_pos long, end_pos long")
    assert {(r.k, r.kind, r.start_pos, r.end_pos) for r in tiles.interval_periods(far, ["k"]).collect()} == {("x", 0, -(2**60), 2**60), ("y", 0, 7, 9), (None, 0, -5, 2**50)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(0, 10**7)), min_size=1, max_size=5))
def test_blocks_are_the_range(ranges):
    low, high = (np.array(x) for x in zip(*[(min(a, b), max(a, b)) for a, b in ranges]))
    row, level, number = tiles.blocks(low, high)
    for i in range(len(low)):
        mine = sorted((int(n) << (tiles.RADIX * int(l)), int(n + 1) << (tiles.RADIX * int(l))) for r, l, n in zip(row, level, number) if r == i)
        assert len(mine) <= 2 * 128 * 4 and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        assert (mine[0][0], mine[-1][1]) == (low[i], high[i]) if mine else low[i] == high[i]


@pytest.mark.parametrize("radix,fan", [(1, 2), (2, 2), (2, 5)])
def test_long_intervals_against_bases(spark, monkeypatch, radix, fan):
    monkeypatch.setattr(tiles, "TILE", 4)
    monkeypatch.setattr(tiles, "MOST_TILES", 2)
    monkeypatch.setattr(tiles, "RADIX", radix)
    monkeypatch.setattr(tiles, "FAN", fan)
    rng = np.random.default_rng(radix * 10 + fan)
    rows = []
    for k, n, most in (("a", 60, 40), ("b", 10, 300), (None, 25, 120)):
        for _ in range(n):
            s = int(rng.integers(-300, 900))
            rows.append((k, s, s + int(rng.integers(1, most))))
    assert run(spark, rows, None) == brute(rows)
    df = spark.createDataFrame([r for r in rows if r[0]], "k string, start_pos long, end_pos long")
    got = {(r.k, r.kind, r.start_pos, r.end_pos) for r in tiles.interval_periods(df, ["k"], limit=700).collect()}
    assert got == brute([(k, max(0, s), min(700, e)) for k, s, e in rows if k])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(1, 12)), min_size=1, max_size=40))
def test_merge_runs(rows):
    g, s, n = (np.array(x) for x in zip(*rows))
    mg, ms, me = tiles.merge_runs(g, s, s + n)
    got = {(k, tiles.PERIOD, a, b) for k, a, b in zip(mg.tolist(), ms.tolist(), me.tolist())}
    assert got == {x for x in brute([(k, a, a + b) for k, a, b in rows]) if x[1] == tiles.PERIOD}


def test_overlap_pieces_sum_to_common_bases(spark):
    rng = np.random.default_rng(5)
    side = lambda n: [("a", int(s), int(s + rng.integers(1, 90))) for s in rng.integers(0, 500, n)]
    left, right = side(30), side(30)
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, k string, start_pos long, end_pos long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j int, k string, start_pos long, end_pos long")
    got = {(r.i, r.j): r.n for r in tiles.overlap_pieces(a, b, ["k"], 32).groupBy("i", "j").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("n")).collect()}
    want = {(i, j): min(x[2], y[2]) - max(x[1], y[1]) for i, x in enumerate(left) for j, y in enumerate(right) if min(x[2], y[2]) > max(x[1], y[1])}
    assert got == want
