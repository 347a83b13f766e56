"""Cells and occupancy come from sums over the places, which no stage of discovery writes."""

import pytest

from geoquarry import catalogue
from geoquarry.operators import colocation as C
from geoquarry.plans import colocation as P
from geoquarry.sources.views import view

SF = "/root/testdata/sf0.001"


def test_filled_cells_are_those_of_the_places(spark):
    own = C.universe(view(spark, SF, "places"), "lee")
    placed = C.gridded(own, C.grid_of(own))
    filled = C.filled(placed)
    assert set(C.cells(filled, "n").collect()) == set(C.cells(placed).collect())
    assert set(filled.where("category is not null").select("lat_idx", "lon_idx", "category").collect()) == set(C.occupancy(placed).collect())


def test_pairs_need_no_table_of_places(spark, monkeypatch):
    def written(*_):
        pytest.fail("the places were written")

    monkeypatch.setattr(P, "_grid", written)
    assert catalogue.QUERIES["pair_stats"](spark, SF).columns[:2] == ["a", "b"]
