"""Pairs whose joint counts and means differ by the same amount have one z, and keep the order by names in all steps after the ranks."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.operators import colocation as C, semantics as S

GROUPS, OF_ONE, STRATA = 8, 5, 12


@pytest.fixture(scope="module")
def tied(spark):
    """(ranked pairs, pairs by names): groups with the same strata, and more and more cells beside them that all categories of the group fill, so means lie between other powers of two."""
    rng = np.random.default_rng(5)
    strata = [rng.random(int(n)) < 0.3 for n in rng.integers(20, 64, STRATA)]
    names = [[f"c{i:02d}" for i in range(GROUPS - 1 - g, GROUPS * OF_ONE, GROUPS)] for g in range(GROUPS)]
    cells, rows, block = [], [], 0
    for g in range(GROUPS):
        for held in (*(s.tolist() for s in strata), *[[True] * 11] * (2**g - 1)):
            for k, filled in enumerate(held):
                cell = (8 * block + k // 8, k % 8)
                cells.append((*cell, 1))
                rows += [(*cell, c) for c in names[g] if filled]
            block += 1
    all_cells = spark.createDataFrame(cells, "lat_idx long, lon_idx long, density long")
    incident = spark.createDataFrame(rows, "lat_idx long, lon_idx long, category string")
    pairs = sorted(p for own in names for p in combinations(own, 2))
    stats = spark.createDataFrame(C.rank_pairs(C.pair_guard(C.pair_stats(all_cells, incident))).toPandas())
    assert stats.select("mean").distinct().count() == GROUPS
    return stats, pairs


def test_holm_of_equal_scores(tied):
    ranked, pairs = tied
    rows = C.holm(ranked.select("a", "b", "rank", F.round(1 / (1 + F.col("z") * F.col("z")), 6).alias("p")), "p", "rank").collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r["rank"])] == pairs


@pytest.fixture(scope="module")
def evident(tied, spark):
    ranked, pairs = tied
    distances = spark.createDataFrame([(a, b, 0.3 if (int(a[1:]) + int(b[1:])) % 5 == 0 else 0.9) for a, b in pairs], "a string, b string, distance double")
    return S.evidence(ranked, S.percentiles(distances)), pairs


def test_frontier_of_equal_scores(evident):
    evidence, pairs = evident
    passing = [p for p in pairs if (int(p[0][1:]) + int(p[1][1:])) % 5]
    assert len(passing) > C.FRONTIER
    assert [(r.a, r.b) for r in S.frontier(evidence).orderBy("place").collect()] == passing[: C.FRONTIER]


def test_evidence_of_equal_scores(evident):
    evidence, pairs = evident
    rows = evidence.orderBy("rank").collect()
    assert [(r.a, r.b) for r in rows] == pairs
    assert [r.passed for r in rows] == [(int(a[1:]) + int(b[1:])) % 5 != 0 for a, b in pairs]
