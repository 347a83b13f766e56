"""Pairs that tie do so in all digits, so ranks go by names and depend on no order of rows or tasks."""

from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import colocation as C, semantics as S
from geoquarry.operators.pairs import Numbered, pair_sums


def test_pair_moments_are_rounded_once(spark):
    """Two pairs with the same strata in other orders, and a sum of many fractions, against exact fractions."""
    rng = np.random.default_rng(11)
    strata = [(int(n), int(rng.integers(1, n + 1)), int(rng.integers(1, n + 1))) for n in rng.integers(2, 60, 300)]
    rows = [(f"{w}{s:03d}", f"{w}_{c}", n, m) for w, own in (("p", strata), ("q", strata[::-1])) for s, (n, x, y) in enumerate(own) for c, m in (("a", x), ("b", y))]
    mean = float(sum(Fraction(x * y, n) for n, x, y in strata))
    variance = float(sum(Fraction(x * (n - x) * y * (n - y), n * n * (n - 1)) for n, x, y in strata))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "s string, category string, n long, m long").repartition(parts)
        assert {(r.mean, r.variance) for r in pair_sums(df, ["s"], Numbered(df)).collect()} == {(mean, variance)}


@pytest.fixture(scope="module")
def tied(spark):
    """(ranked pairs, the ranks by exact arithmetic): categories of even number in 70 blocks of many sizes, those of odd number in 70 blocks like them in reverse order."""
    rng = np.random.default_rng(4)
    blocks = [(i, [bool(rng.random() < 0.3) for _ in range(int(rng.integers(20, 64)))]) for i in range(70)]
    own = [((8 * at + k // 8, k % 8, 2 ** (i % 3)), i, at >= 70, f) for i, filled in blocks for at in (i, 139 - i) for k, f in enumerate(filled)]
    places = [p for p, *_ in own]
    names = [f"c{i:02d}" for i in range(20)]
    held = {c: [p for p, i, odd, f in own if f and odd == (int(c[1:]) % 2 == 1) and (c < "c10" or i % 5)] for c in names}
    order = rng.permutation(len(places)).tolist()
    all_cells = spark.createDataFrame([places[i] for i in order], "lat_idx long, lon_idx long, density long")
    rows = [(p[0], p[1], c) for c in names for p in held[c]]
    incident = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows)).tolist()], "lat_idx long, lon_idx long, category string").repartition(5)
    stratum = lambda p: (p[0] // 8, p[1] // 8, p[2])
    sizes = {}
    for p in places:
        sizes[stratum(p)] = sizes.get(stratum(p), 0) + 1
    counts = {c: Counter(map(stratum, held[c])) for c in names}
    scores = {}
    for a, b in combinations(names, 2):
        mean = variance = Fraction(0)
        for s, n in sizes.items():
            x, y = counts[a][s], counts[b][s]
            mean += Fraction(x * y, n)
            variance += Fraction(x * (n - x) * y * (n - y), n * n * max(1, n - 1))
        joint = len(set(held[a]) & set(held[b]))
        if joint:
            scores[a, b] = (joint - mean) ** 2 / variance
    want = {pair: k + 1 for k, pair in enumerate(sorted(scores, key=lambda p: (-scores[p], p)))}
    assert len(set(scores.values())) < 10
    return C.rank_pairs(C.pair_guard(C.pair_stats(all_cells, incident))), want


def test_ranks_of_ties_go_by_names(tied):
    ranked, want = tied
    assert {(r.a, r.b): r.rank for r in ranked.collect()} == want


def test_holm_orders_ties_by_rank(tied):
    ranked, want = tied
    rows = C.holm(ranked.select("a", "b", "rank", F.round(F.least(F.lit(1.0), 1 / (1 + F.col("z") * F.col("z"))), 6).alias("p")), "p", "rank").collect()
    assert {(r.a, r.b): r.rank for r in rows} == want
    at, m, reached = 0, len(rows), 0.0
    for r in sorted(rows, key=lambda r: (r.p, want[r.a, r.b])):
        reached = max(reached, min(1.0, (m - at) * r.p))
        assert r.holm_p == pytest.approx(reached)
        at += 1


@pytest.fixture(scope="module")
def evident(tied, spark):
    ranked, want = tied
    distances = spark.createDataFrame([(a, b, 0.9 if (int(a[1:]) // 2 + int(b[1:]) // 2) % 2 else 0.3) for a, b in want], "a string, b string, distance double")
    return S.evidence(ranked, S.percentiles(distances)), want


def test_evidence_keeps_the_ranks_of_ties(evident):
    evidence, want = evident
    assert {(r.a, r.b): r.rank for r in evidence.collect()} == want


def test_frontier_cuts_ties_by_names(evident):
    evidence, want = evident
    passing = [p for p in sorted(want, key=want.get) if (int(p[0][1:]) // 2 + int(p[1][1:]) // 2) % 2]
    assert len(passing) > C.FRONTIER
    assert [(r.a, r.b) for r in S.frontier(evidence).orderBy("place").collect()] == passing[: C.FRONTIER]
