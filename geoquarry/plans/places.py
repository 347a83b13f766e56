"""Place queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions.text import county_key
from geoquarry.operators import places as P
from geoquarry.sources.views import sql, view

QUERIES, ORACLES = {}, {}
_COLUMNS = "gers_id, county_key, name_primary, taxonomy_primary, taxonomy_hierarchy, basic_category, operating_status, confidence, longitude, latitude, address_freeform, address_locality, address_postcode, address_region, address_country, brand_name, is_hosted_service, overture_release"
_NORMAL = "trim(regexp_replace(lower(coalesce(name_primary, '')), '[^a-z0-9]+', ' ', 'g'))"
_ROWS = f"{_COLUMNS}, {_NORMAL} AS normalized_name"


def _add(name, run, oracle):
    QUERIES[name] = lambda spark, sf, run=run: run(view(spark, sf, "places"))
    ORACLES[name] = f"WITH {sql('places')} {oracle}"


def _filtered(query, where, **parts):
    f = P.PlaceFilter("lee", **parts)
    _add(query, lambda p: P.rows(p, f), f"SELECT {_ROWS} FROM places WHERE county_key = 'lee' AND {where}")


_LEE = P.PlaceFilter("lee")
_add("places_rows", lambda p: P.rows(p, _LEE), f"SELECT {_ROWS} FROM places WHERE county_key = 'lee'")
_filtered("places_text_filter", "lower(taxonomy_primary) = 'red_widget' AND lower(address_locality) = 'city 3'", taxonomy=" Red_Widget ", locality="city 3")
_filtered("places_text_contains", "basic_category ILIKE '%i_g%'", basic_category="I_G", contains=True)
_filtered("places_hierarchy_rollup", "list_contains(string_split(lower(coalesce(taxonomy_hierarchy, '')), '/'), 'blue')", hierarchy="Blue")
_filtered("places_name_contains", "name_primary ILIKE '%hot gear%'", name="hot gear")
_filtered("places_normalized_name", f"contains({_NORMAL}, 'blue bolt co')", normalized_name="  Blue-Bolt, CO! ")
_filtered("places_postcode", "address_postcode = '33905'", postcode="33905")
_filtered("places_status", "lower(operating_status) = 'closed'", status="CLOSED")
_filtered("places_hosted", "is_hosted_service IS DISTINCT FROM TRUE", hosted="exclude")
_filtered("places_hosted_only", "is_hosted_service IS NOT DISTINCT FROM TRUE", hosted="only")
_filtered("places_confidence", "confidence >= 0.85", min_confidence=0.85)
_filtered(
    "places_all_filters",
    f"lower(taxonomy_primary) LIKE '%widget%' AND list_contains(string_split(lower(coalesce(taxonomy_hierarchy, '')), '/'), 'red') AND name_primary ILIKE '%widget%' AND contains({_NORMAL}, 'red') AND lower(operating_status) = 'open' AND is_hosted_service IS DISTINCT FROM TRUE AND confidence >= 0.6",
    taxonomy="widget", contains=True, hierarchy="red", name="widget", normalized_name="RED", status="open", hosted="exclude", min_confidence=0.6,
)
_add("places_count", lambda p: P.count(p, P.PlaceFilter("lee", status="open")), "SELECT count(*) AS n FROM places WHERE county_key = 'lee' AND lower(operating_status) = 'open'")
_add("places_totals", lambda p: P.totals(p, _LEE), "SELECT count(*) AS total_rows, count(DISTINCT taxonomy_primary) + coalesce(max(CASE WHEN taxonomy_primary IS NULL THEN 1 ELSE 0 END), 0) AS total_groups FROM places WHERE county_key = 'lee'")
_add("places_group", lambda p: P.group(p, _LEE), "SELECT taxonomy_primary AS category, count(*) AS n FROM places WHERE county_key = 'lee' GROUP BY 1")
_add(
    "places_group_page",
    lambda p: P.group(p, P.PlaceFilter("lee", hosted="exclude"), "address_locality", limit=7, offset=3),
    "SELECT address_locality AS category, count(*) AS n FROM places WHERE county_key = 'lee' AND is_hosted_service IS DISTINCT FROM TRUE GROUP BY 1 ORDER BY n DESC, category ASC NULLS LAST LIMIT 7 OFFSET 3",
)
_add(
    "places_deep_page",
    lambda p: P.page(p, P.PlaceFilter("lee"), "confidence", limit=500, offset=20_000),
    f"SELECT {_ROWS} FROM places WHERE county_key = 'lee' ORDER BY confidence ASC NULLS LAST, gers_id LIMIT 500 OFFSET 20000",
)
_add(
    "places_page",
    lambda p: P.page(p, P.PlaceFilter("lee", min_confidence=0.7), "name_primary", descending=True, limit=10_000, offset=25),
    f"SELECT {_ROWS} FROM places WHERE county_key = 'lee' AND confidence >= 0.7 ORDER BY name_primary DESC NULLS LAST, gers_id LIMIT 1000 OFFSET 25",
)
_add(
    "release_identity",
    P.publication,
    "SELECT min(overture_release) AS release_min, max(overture_release) AS release_max, count(DISTINCT overture_release) AS releases, count(*) FILTER (overture_release IS NULL) AS null_releases, concat_ws(';', min(overture_release), CASE WHEN max(overture_release) <> min(overture_release) THEN max(overture_release) END) AS identity FROM places",
)
_add(
    "county_key",
    lambda p: p.groupBy(county_key(F.concat(F.lit("  "), "address_locality", F.lit(" \t"), F.upper("basic_category"), F.lit(" "))).alias("county_key")).agg(F.count("*").alias("n")),
    "SELECT lower(regexp_replace(trim('  ' || address_locality || ' \t' || upper(basic_category) || ' '), '\\s+', '-', 'g')) AS county_key, count(*) AS n FROM places GROUP BY 1",
)
_add("scan_view", lambda p: _scan_view(p), "SELECT county_key, count(*) AS n, round(avg(confidence), 6) AS confidence FROM places GROUP BY 1")


def _scan_view(places):
    """Register the table as a stable view and query it by name."""
    places.createOrReplaceTempView("places")
    return places.sparkSession.sql("SELECT county_key, count(*) AS n, round(avg(confidence), 6) AS confidence FROM places GROUP BY county_key")
