"""Seed hits of a library, found where the records are read, against a plain search."""

from __future__ import annotations

from collections import Counter

import pytest
from test_kernels import dna

from helixframe.operators import align as A

PATTERN = "1101011"
RC = str.maketrans("ACGTacgt", "TGCAtgca")
LIBRARY = {"a": dna(1, 90), "b": dna(2, 40) + "N" + dna(3, 50).lower(), "c": "AC", "d": None}


@pytest.fixture(scope="module")
def consensi(spark):
    return spark.createDataFrame(list(LIBRARY.items()), "consensus string, seq string")


@pytest.fixture(scope="module")
def records(spark):
    seqs = [dna(4, 400) + LIBRARY["a"][10:70] + "nN" + LIBRARY["b"].translate(RC)[::-1].lower() + dna(5, 200), LIBRARY["b"] * 3, "", "ACG", None, LIBRARY["a"][:7]]
    return spark.createDataFrame(list(enumerate(seqs)), "rec_id long, seq string").repartition(2)


def plain(rows):
    """rec_id, pos, consensus, reverse, cpos and the letters before and after, by comparing every window with every window."""
    ones = [i for i, x in enumerate(PATTERN) if x == "1"]
    span = len(PATTERN)

    def windows(s):
        return [(i, "".join(s[i + j] for j in ones)) for i in range(len(s) - span + 1) if not set(s[i : i + span]) - set("ACGT")]

    fits = lambda w: sum(b in w for b in "ACGT") >= 3 and max(map(w.count, "ACGT")) <= len(ones) - 3
    for name, text in LIBRARY.items():
        for reverse in (False, True) if text else ():
            c = text.upper().translate(RC)[::-1] if reverse else text.upper()
            for r in rows:
                g = (r.seq or "").upper()
                mine = windows(g)
                for cpos, w in windows(c):
                    for pos in (p for p, x in mine if x == w and fits(w)):
                        left, right = min(A.FLANK, pos, cpos), min(A.FLANK, len(g) - pos - span, len(c) - cpos - span)
                        pairs = [list(zip(c[cpos - left : cpos], g[pos - left : pos])), list(zip(c[cpos + span : cpos + span + right], g[pos + span : pos + span + right]))]
                        yield (r.rec_id, pos, name, reverse, cpos), pairs


def test_seed_hits_are_found_without_a_shuffle(records, consensi):
    got = A.seed_hits(records, consensi, PATTERN)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(h for h, _ in plain(records.collect()))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hits_are_handed_out_in_parts(monkeypatch):
    import numpy as np

    lib = A.Library([(n, s) for n, s in LIBRARY.items() if s], PATTERN)
    data = np.frombuffer((LIBRARY["b"].upper() * 3 + dna(6, 300)).encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*lib.hits(data))]
    monkeypatch.setattr(A, "HITS", 3)
    monkeypatch.setattr(A, "PIECE", 50)
    monkeypatch.setattr(A, "MOST_TABLED", 3)
    again = A.Library([(n, s) for n, s in LIBRARY.items() if s], PATTERN)
    parts = list(again.hits(data))
    assert again.present is None and len(parts) > 20 and len(whole[0]) > 100
    assert all((x == np.concatenate(y)).all() for x, y in zip(whole, zip(*parts)))


def test_substitution_counts(records, consensi):
    got = A.seed_substitution_counts(records, consensi, PATTERN)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    n = Counter(p for _, sides in plain(records.collect()) for side in sides for p in side)
    assert {(r.cons_base, r.genome_base): r.n for r in got.collect()} == {p: n[p] for p in A.PAIRS if n[p]}


def test_gates_of_hits(records, consensi):
    got = A.seed_hit_gates(records, consensi, PATTERN)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted((*h, *[sum(1 if x == y else -1 for x, y in side) for side in sides]) for h, sides in plain(records.collect()))


def test_substitutions_of_hits(records, consensi):
    got = A.seed_hit_substitutions(records, consensi, PATTERN)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(*h, *[[x + y for side in sides for x, y in side].count(a + b) for a, b in A.PAIRS]) for h, sides in plain(records.collect())]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_pairs_on_a_diagonal(records, consensi):
    got = A.diagonal_pairs(A.seed_hits(records, consensi, PATTERN))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    before: dict[tuple, list] = {}
    want = []
    for rec, pos, name, reverse, cpos in sorted((h for h, _ in plain(records.collect())), key=lambda h: (h[0], h[2], h[3], h[1], h[4])):
        earlier = before.setdefault((rec, name, reverse), [])
        near = next((p for p, d in earlier[:-3:-1] if p < pos <= p + A.NEAR and abs(pos - cpos - d) <= A.DIAGONAL), None)
        want += [] if near is None else [(rec, name, reverse, pos, cpos, near)]
        earlier.append((pos, pos - cpos))
    assert len(want) > 20 and sorted(tuple(r) for r in got.select("rec_id", "consensus", "reverse", "pos", "cpos", "prev_pos").collect()) == sorted(want)
