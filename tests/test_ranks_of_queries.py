"""Steps after the ranks keep the order by names of pairs that tie, where the strata of tied pairs come in other orders."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import colocation as C, semantics as S

GROUPS, OF_ONE, STRATA = 8, 5, 40


@pytest.fixture(scope="module")
def tied(spark):
    """(ranked pairs, pairs by names): the categories of a group fill the same cells; groups have the same strata in other orders, so all pairs that meet tie."""
    rng = np.random.default_rng(7)
    strata = [rng.random(int(n)) < 0.3 for n in rng.integers(20, 64, STRATA)]
    names = [[f"c{i:02d}" for i in range(g, GROUPS * OF_ONE, GROUPS)] for g in range(GROUPS)]
    cells, rows = [], []
    for g in range(GROUPS):
        for at, s in enumerate(rng.permutation(STRATA).tolist()):
            for k, held in enumerate(strata[s].tolist()):
                cell = (8 * (g * STRATA + at) + k // 8, k % 8)
                cells.append((*cell, 1))
                rows += [(*cell, c) for c in names[g] if held]
    all_cells = spark.createDataFrame(cells, "lat_idx long, lon_idx long, density long")
    incident = spark.createDataFrame(rows, "lat_idx long, lon_idx long, category string")
    pairs = sorted(p for own in names for p in combinations(own, 2))
    ranked = spark.createDataFrame(C.rank_pairs(C.pair_guard(C.pair_stats(all_cells, incident))).toPandas())
    return ranked, pairs


def test_holm_keeps_the_names_of_ties(tied):
    ranked, pairs = tied
    rows = C.holm(ranked.select("a", "b", "rank", F.round(1 / (1 + F.col("z") * F.col("z")), 6).alias("p")), "p", "rank").collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r["rank"])] == pairs
    assert {round(r.holm_p, 9) for r in rows} == {round(min(1.0, len(pairs) * rows[0].p), 9)}


@pytest.fixture(scope="module")
def evident(tied, spark):
    ranked, pairs = tied
    distances = spark.createDataFrame([(a, b, 0.3 if (int(a[1:]) + int(b[1:])) % 5 == 0 else 0.9) for a, b in pairs], "a string, b string, distance double")
    return S.evidence(ranked, S.percentiles(distances)), pairs


def test_evidence_keeps_the_names_of_ties(evident):
    evidence, pairs = evident
    rows = evidence.orderBy("rank").collect()
    assert [(r.a, r.b) for r in rows] == pairs
    assert [r.passed for r in rows] == [(int(a[1:]) + int(b[1:])) % 5 != 0 for a, b in pairs]


def test_frontier_cuts_by_the_names_of_ties(evident):
    evidence, pairs = evident
    passing = [p for p in pairs if (int(p[0][1:]) + int(p[1][1:])) % 5]
    assert len(passing) > C.FRONTIER
    assert [(r.a, r.b) for r in S.frontier(evidence).orderBy("place").collect()] == passing[: C.FRONTIER]
