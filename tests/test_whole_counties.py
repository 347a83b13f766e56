"""Counties of more places than the guard's bound are done whole."""

import pytest

from geoquarry import catalogue
from geoquarry.operators import colocation as C

SF = "/root/testdata/sf0.001"


def told_and_whole(spark, monkeypatch, name):
    """The rows beyond the bound on places, which are those within it, and a warning."""
    within = catalogue.QUERIES[name](spark, SF).collect()
    monkeypatch.setattr(C, "MAX_PLACES", 10)
    with pytest.warns(UserWarning, match="more than 10 places"):
        beyond = catalogue.QUERIES[name](spark, SF).collect()
    assert sorted(map(str, beyond)) == sorted(map(str, within))
    return beyond


def test_size_guard_counts_all_places(spark, monkeypatch):
    assert sum(r.n for r in told_and_whole(spark, monkeypatch, "size_guard")) > 1000
    with pytest.raises(ValueError, match="refused"):
        C.guarded_places(C.universe(catalogue_places(spark), "lee"))


def catalogue_places(spark):
    from geoquarry.sources.views import view

    return view(spark, SF, "places")


def test_analyze_pair_takes_all_places(spark, monkeypatch):
    assert told_and_whole(spark, monkeypatch, "analyze_pair")[0].n_cells > 0


def test_discover_county_takes_all_places(spark, monkeypatch):
    told_and_whole(spark, monkeypatch, "discover_county")
