"""Place queries on the eight-row table, with its known counts."""

import pytest

from geoquarry.operators import places as P

COLUMNS = "gers_id string, county_key string, name_primary string, taxonomy_primary string, taxonomy_hierarchy string, basic_category string, operating_status string, confidence double, longitude double, latitude double, address_freeform string, address_locality string, address_postcode string, address_region string, address_country string, brand_name string, is_hosted_service boolean, overture_release string, websites string, phones string, emails string"


def row(i, name, category, path, status, confidence, hosted, lon=-81.9, lat=26.6, county="lee"):
    return (f"gers-{i}", county, name, category, path, category, status, confidence, lon, lat, f"{i} Main St", "Fort Myers", "33901", "FL", "US", None, hosted, "2026-01", "w", "p", "e")


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        row(1, "Zed Nails", "nail_salon", "services/beauty/nail_salon", "open", 0.9, False),
        row(2, "Amber Nails", "nail_salon", "services/beauty/nail_salon", "open", 0.8, True),
        row(3, "Blue Diner", "diner", "food/restaurant/diner", "open", 0.95, False),
        row(4, "Cat Cafe", "cafe", "food/cafe", None, 0.7, False),
        row(5, "Big Grill", "grill", "food/Restaurant/grill", "closed", 0.6, None, lon=None),
        row(6, "ATM", "atm", "money/atm", "open", 0.99, True),
        row(7, "Corner Shop", "retail_store", "retail/retail_store", "open", 0.85, False),
        row(8, "ACME, Co.!", None, None, "open", None, None),
        row(9, "Other", "cafe", "food/cafe", "open", 0.9, False, county="collier"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def n(places, **parts):
    return P.count(places, P.PlaceFilter("lee", **parts)).first().n


def test_filters(places):
    assert n(places) == 8
    assert n(places, taxonomy=" NAIL_SALON ") == 2 and n(places, taxonomy="nail") == 0
    assert n(places, taxonomy="nail", contains=True) == 2 and n(places, taxonomy="n_il", contains=True) == 2
    assert n(places, hierarchy="restaurant") == 2 and n(places, hierarchy="rest") == 0
    assert n(places, name="nails", postcode="33901", locality="fort myers") == 2
    assert n(places, normalized_name="acme co") == 1 and n(places, normalized_name="Acme--CO") == 1
    assert n(places, hosted="exclude") == 6 and n(places, hosted="only", status="OPEN") == 2
    assert n(places, min_confidence=0.85) == 4
    assert n(places, name="' OR 1=1 --") == 0 and n(places, name="\\q") == 0


def test_groups_and_totals(places):
    groups = [(r.category, r.n) for r in P.group(places, P.PlaceFilter("lee")).collect()]
    assert groups == [("nail_salon", 2), ("atm", 1), ("cafe", 1), ("diner", 1), ("grill", 1), ("retail_store", 1), (None, 1)]
    assert tuple(P.totals(places, P.PlaceFilter("lee")).first()) == (8, 7)
    assert tuple(P.totals(places, P.PlaceFilter("nowhere")).first()) == (0, 0)
    with pytest.raises(ValueError):
        P.group(places, P.PlaceFilter("lee"), "emails")


def test_pages(places):
    page = P.page(places, P.PlaceFilter("lee"), "name_primary", limit=2, offset=1)
    assert [r.gers_id for r in page.collect()] == ["gers-6", "gers-2"]
    assert P.page(places, P.PlaceFilter("lee"), limit=10_000).count() == 8
    assert "emails" not in page.columns and page.columns[-1] == "normalized_name"
    with pytest.raises(ValueError):
        P.page(places, P.PlaceFilter("lee"), "emails")


def test_publication(places):
    assert P.publication(places).first().identity == "2026-01"


def test_the_county_filter_and_columns_reach_the_scan(spark, places, tmp_path):
    places.write.parquet(f"{tmp_path}/p")
    plan = P.count(spark.read.parquet(f"{tmp_path}/p"), P.PlaceFilter("lee", min_confidence=0.5))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(county_key,lee)" in plan and "GreaterThanOrEqual(confid" in plan and "emails" not in plan
