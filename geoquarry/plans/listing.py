"""Geo selection, listing, lookup, documents, catalog, coverage and SQL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.operators import coverage as V, geo, listing as L, sqlguard
from geoquarry.sources import documents as D
from geoquarry.sources.scratch import scratch, stored
from geoquarry.sources.views import VIEWS, sql, view

QUERIES, ORACLES = {}, {}


def _add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"WITH {oracle}" if not oracle.startswith(("SELECT", "WITH")) else oracle


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PROPS, PERMITS = sql("properties"), sql("permits")

# -- areas -------------------------------------------------------------------------------------------------------------

_N = "cast(n_nationkey as double)"
_AREA = {
    "min_lat": f"CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey = 8 THEN cast(27 as double) ELSE cast(26 as double) + {_N} / 40 END END",
    "max_lat": f"CASE WHEN n_nationkey % 2 = 0 THEN cast(26.3 as double) + {_N} / 40 END",
    "min_lon": f"CASE WHEN n_nationkey % 2 = 0 THEN cast(-82 as double) + {_N} / 60 END",
    "max_lon": f"CASE WHEN n_nationkey % 2 = 0 THEN cast(-81.6 as double) + {_N} / 60 END",
}
_CORNERS = [("26", "-82"), ("26.9", "-81.7"), ("26.2", "-81.1"), ("26.1", "-81.6")]


def _areas(s, sf):
    point = lambda a, o: f"named_struct('lat', cast({a} as double) + {_N} / 50, 'lon', cast({o} as double) + {_N} / 90)"
    ring = f"CASE WHEN n_nationkey % 2 = 1 AND n_nationkey <> 11 THEN CASE WHEN n_nationkey = 7 THEN array({point(*_CORNERS[0])}, {point(*_CORNERS[1])}) ELSE array({', '.join(point(*c) for c in _CORNERS)}) END END"
    return _table(s, sf, "nation").selectExpr("n_nationkey AS area_id", *(f"{e} AS {n}" for n, e in _AREA.items()), f"{ring} AS ring")


_DPOINT = lambda a, o: f"{{'lat': cast({a} as double) + {_N} / 50, 'lon': cast({o} as double) + {_N} / 90}}"
_AREAS = f"""areas AS (SELECT n_nationkey AS area_id, {', '.join(f'{e} AS {n}' for n, e in _AREA.items())},
 CASE WHEN n_nationkey % 2 = 1 AND n_nationkey <> 11 THEN CASE WHEN n_nationkey = 7 THEN [{_DPOINT(*_CORNERS[0])}, {_DPOINT(*_CORNERS[1])}] ELSE [{', '.join(_DPOINT(*c) for c in _CORNERS)}] END END AS ring FROM nation),
checked AS (SELECT *, CASE WHEN min_lat IS NOT NULL AND (min_lat > max_lat OR min_lon > max_lon) THEN 'the box is inverted' WHEN min_lat IS NOT NULL THEN NULL WHEN ring IS NULL THEN 'no area is given' WHEN len(ring) < 3 THEN 'a polygon needs three vertices' END AS error FROM areas),
pts AS (SELECT * FROM properties),
edges AS (SELECT area_id, ring[i] AS p, ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END] AS q FROM checked, unnest(range(1, 5)) t(i) WHERE error IS NULL AND min_lat IS NULL AND i <= len(ring)),
poly AS (SELECT area_id, property_id FROM edges, pts WHERE (p.lat > latitude) <> (q.lat > latitude) AND longitude < (q.lon - p.lon) * (latitude - p.lat) / (q.lat - p.lat) + p.lon GROUP BY 1, 2 HAVING count(*) % 2 = 1),
boxed AS (SELECT area_id, property_id FROM checked, pts WHERE error IS NULL AND min_lat IS NOT NULL AND latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon),
met AS (SELECT * FROM poly UNION ALL SELECT * FROM boxed)"""
_add("geo_area_validate", lambda s, sf: geo.validate_areas(_areas(s, sf)).select("area_id", "error"), f"{PROPS}, {_AREAS} SELECT area_id, error FROM checked")
_add("geo_polygon", lambda s, sf: geo.area_join(view(s, sf, "properties"), _areas(s, sf).where("area_id = 3")).select("property_id"), f"{PROPS}, {_AREAS} SELECT property_id FROM met WHERE area_id = 3")
_add("geo_area_join", lambda s, sf: geo.area_join(view(s, sf, "properties"), _areas(s, sf)).select("area_id", "property_id"), f"{PROPS}, {_AREAS} SELECT area_id, property_id FROM met")
_add("geo_sum", lambda s, sf: geo.area_sums(view(s, sf, "properties"), _areas(s, sf), "avm_value").withColumn("total", F.round("total", 2)), f"{PROPS}, {_AREAS} SELECT area_id, round(coalesce(sum(avm_value), 0), 2) AS total, count(property_id) AS n FROM checked LEFT JOIN met USING (area_id) LEFT JOIN properties USING (property_id) WHERE error IS NULL GROUP BY 1")

# -- properties --------------------------------------------------------------------------------------------------------

_ADDRESS = "nullif(concat_ws(', ', nullif(trim(address_street), ''), nullif(trim(address_city), ''), nullif(trim(address_zip), '')), '')"
_add("list_properties", lambda s, sf: L.list_properties(view(s, sf, "properties"), 900, 40), f"{PROPS} SELECT parcel_identifier, property_id, cid, {_ADDRESS} AS address, avm_value FROM properties ORDER BY parcel_identifier LIMIT 500 OFFSET 40")
_KEYS = "o_orderkey AS request_id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN lpad(cast(o_custkey as string), 10, '0') END AS parcel, CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'prop-' || cast(o_custkey * 2 as string) END AS property, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 8 = 2 THEN 'bafy' || md5('Customer#' || lpad(cast(o_custkey as string), 9, '0')) END AS key_cid"
_add(
    "lookup_cid", lambda s, sf: L.lookup(_table(s, sf, "orders").selectExpr(*_split_columns(_KEYS)), view(s, sf, "properties")),
    f"{PROPS}, k AS (SELECT {_KEYS} FROM orders), g AS (SELECT *, (parcel IS NOT NULL)::INT + (property IS NOT NULL)::INT + (key_cid IS NOT NULL)::INT AS given FROM k), "
    "h AS (SELECT g.*, p.property_id, p.cid FROM g LEFT JOIN properties p ON given = 1 AND (p.parcel_identifier = g.parcel OR p.property_id = g.property OR p.cid = g.key_cid)), "
    "e AS (SELECT *, CASE WHEN given <> 1 THEN 'exactly one key is needed' WHEN property_id IS NULL THEN 'not found' WHEN cid IS NULL THEN 'no content id' END AS error FROM h) SELECT request_id, CASE WHEN error IS NULL THEN cid END AS cid, error FROM e",
)


def _split_columns(text: str) -> list[str]:
    """Splits a select list at commas outside parentheses."""
    out, depth, own = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += ch
    return [*out, own]


_add("get_property", lambda s, sf: (lambda p: L.lookup(_table(s, sf, "orders").selectExpr("o_orderkey AS request_id", "lpad(cast(o_custkey as string), 10, '0') AS parcel", "cast(null as string) AS property", "cast(null as string) AS key_cid"), p).join(p.where("cid is not null"), "cid").select("request_id", "cid", "owner_name", "market_value"))(view(s, sf, "properties")), f"{PROPS} SELECT o_orderkey AS request_id, cid, owner_name, market_value FROM orders JOIN properties ON parcel_identifier = lpad(cast(o_custkey as string), 10, '0') WHERE cid IS NOT NULL")
_SHARDS = "shards AS (SELECT (c_custkey // 64)::INT AS shard_index, min(parcel_identifier) AS from_parcel, max(parcel_identifier) AS to_parcel, count(*) AS count, CASE WHEN c_custkey // 64 % 9 = 4 THEN NULL ELSE 'shard-' || c_custkey // 64 END AS shard_cid FROM (SELECT *, cast(parcel_identifier as bigint) AS c_custkey FROM properties) GROUP BY c_custkey // 64)"


#: Entries that one JSON document of a fixture holds at most.
DOCUMENT = 1024


def _bounded(number: str) -> F.Column:
    """Groups of DOCUMENT neighbouring numbers, so that no document grows with the table."""
    return F.floor(F.col(number).cast("long") / DOCUMENT).alias("part")


def _layouts(s, sf):
    """Manifests of several counties in one folder: flat ones, sharded ones, and ones without either."""
    number, entry, ref = F.col("n_nationkey"), F.struct(F.col("n_name").alias("propertyId")), F.struct(F.col("n_nationkey").cast("int").alias("shardIndex"))
    path = scratch(s, "layouts")
    _table(s, sf, "nation").select(F.col("n_name").alias("county"), F.when(number % 3 == 0, F.array(ref)).alias("shards"), F.when(number % 3 == 1, F.array(entry, entry)).alias("entries")).write.json(path)
    return D.layouts(D.read(s, path, "manifest_or_index")).select("county", "layout", F.coalesce(F.size("shards"), F.lit(0)).alias("shards"), F.coalesce(F.size("entries"), F.lit(0)).alias("entries"))


def _shards(s, sf):
    """Range shards of parcels, written as a JSON index and read back."""
    own = view(s, sf, "properties").withColumn("shardIndex", F.expr("cast(cast(parcel_identifier as bigint) div 64 as int)"))
    refs = own.groupBy("shardIndex").agg(F.min("parcel_identifier").alias("fromParcel"), F.max("parcel_identifier").alias("toParcel"), F.count("*").cast("int").alias("count")).withColumn("shardCid", F.when(F.col("shardIndex") % 9 != 4, F.concat(F.lit("shard-"), "shardIndex")))
    docs = refs.groupBy(_bounded("shardIndex")).agg(F.collect_list(F.struct("shardIndex", "fromParcel", "toParcel", "count", "shardCid")).alias("shards")).select(F.lit("lee").alias("county"), "shards")
    path = scratch(s, "shard-index")
    docs.write.json(path)
    # a county that publishes the flat layout beside it
    s.createDataFrame([("collier", [("p1", "1", "c1")])], "county string, entries array<struct<propertyId: string, parcelIdentifier: string, cid: string>>").write.mode("append").json(path)
    return D.rows(D.layouts(D.read(s, path, "manifest_or_index")).where("layout = 'sharded'").drop("layout", "entries"), "shard_index").select(F.col("shardIndex").alias("shard_index"), F.col("fromParcel").alias("from_parcel"), F.col("toParcel").alias("to_parcel"), F.col("count").cast("long").alias("count"), F.col("shardCid").alias("shard_cid"))


_add("shard_scan", _shards, f"{PROPS}, {_SHARDS} SELECT * FROM shards")
_add("manifest_layouts", _layouts, "SELECT n_name AS county, CASE n_nationkey % 3 WHEN 0 THEN 'sharded' WHEN 1 THEN 'flat' ELSE 'unknown' END AS layout, (n_nationkey % 3 = 0)::INT AS shards, CASE WHEN n_nationkey % 3 = 1 THEN 2 ELSE 0 END AS entries FROM nation")
_add("shard_range_join", lambda s, sf: L.shard_of(_table(s, sf, "orders").select("o_orderkey", F.lpad((F.col("o_custkey") * 2).cast("string"), 10, "0").alias("parcel")), _shards(s, sf), "parcel"), f"{PROPS}, {_SHARDS} SELECT o_orderkey, parcel, shard_index FROM (SELECT o_orderkey, lpad(cast(o_custkey * 2 as string), 10, '0') AS parcel FROM orders) LEFT JOIN shards ON parcel BETWEEN from_parcel AND to_parcel")
_add("shard_page_slices", lambda s, sf: L.page_slices(_shards(s, sf), 500, 100), f"{PROPS}, {_SHARDS}, b AS (SELECT *, coalesce(sum(count) OVER (ORDER BY shard_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shards) SELECT shard_index, greatest(100 - before, 0)::BIGINT AS start, least(600 - before, count)::BIGINT AS end FROM b WHERE before < 600 AND before + count > 100 AND shard_cid IS NOT NULL")


def _manifest(s, sf):
    """A flat manifest with sizes and digests, written as JSON and read back."""
    entry = F.struct(F.col("property_id").alias("propertyId"), F.col("parcel_identifier").alias("parcelIdentifier"), F.concat("property_id", F.lit(".json")).alias("filePath"), F.sha2("owner_name", 256).alias("sha256"), "cid", F.length("owner_name").cast("long").alias("fileSizeBytes"))
    docs = view(s, sf, "properties").groupBy(F.lower("county_name").alias("county"), "address_city", _bounded("parcel_identifier")).agg(F.collect_list(entry).alias("entries")).select("county", "entries")
    path = scratch(s, "manifest")
    docs.write.json(path)
    return D.rows(D.read(s, path, "manifest"), "manifest")


_add("manifest_scan", lambda s, sf: _manifest(s, sf).select("county", "propertyId", "sha256", "fileSizeBytes"), f"{PROPS} SELECT lower(county_name) AS county, property_id AS \"propertyId\", sha256(owner_name) AS sha256, length(owner_name) AS \"fileSizeBytes\" FROM properties")
_add("manifest_lookup", lambda s, sf: view(s, sf, "permits").where("property_id is not null").join(_manifest(s, sf).select(F.col("propertyId").alias("property_id"), "filePath"), "property_id").select("permit_number", F.col("filePath").alias("file_path")), f"{PROPS}, {PERMITS} SELECT permit_number, p.property_id || '.json' AS file_path FROM permits p JOIN properties USING (property_id)")


def _integrity(s, sf):
    """Files of nations against a manifest that is wrong about some."""
    nation = _table(s, sf, "nation")
    path = scratch(s, "files")
    nation.where("n_nationkey % 7 <> 5").select("n_name", F.col("n_name").alias("file")).repartition(4).write.partitionBy("file").text(path)
    files = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    named = files.select(F.regexp_extract("path", "file=([^/]+)", 1).alias("path"), "content", "length")
    line = F.concat("n_name", F.lit("\n"))
    manifest = nation.select(F.col("n_name").alias("filePath"), F.when(F.col("n_nationkey") % 5 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(line, 256)).alias("sha256"), (F.length(line) + (F.col("n_nationkey") % 6 == 2).cast("int")).cast("long").alias("fileSizeBytes"))
    return D.integrity_audit(named, manifest).select(F.col("filePath").alias("file_path"), "status")


_add("integrity_audit", _integrity, "SELECT n_name AS file_path, CASE WHEN n_nationkey % 7 = 5 THEN 'missing' WHEN n_nationkey % 6 = 2 THEN 'size' WHEN n_nationkey % 5 = 1 THEN 'digest' ELSE 'ok' END AS status FROM nation")


def _geo_index(s, sf):
    entry = F.struct(F.col("parcel_identifier").alias("parcelIdentifier"), "latitude", "longitude", F.col("avm_value").alias("currentAvmValue"), F.col("property_type").alias("propertyType"))
    path = scratch(s, "geo-index")
    view(s, sf, "properties").groupBy(F.col("county_name").alias("county"), "address_city", _bounded("parcel_identifier")).agg(F.collect_list(entry).alias("entries")).select("county", "entries").write.json(path)
    return D.rows(D.read(s, path, "geo_index"), "geo_index")


_add("geo_index_scan", lambda s, sf: _geo_index(s, sf).groupBy("county", "propertyType").agg(F.count("*").alias("n"), F.round(F.sum("currentAvmValue"), 2).alias("value")), f'{PROPS} SELECT county_name AS county, property_type AS "propertyType", count(*) AS n, round(sum(avm_value), 2) AS value FROM properties GROUP BY 1, 2')


def _fallback(s, sf):
    """Table rows of one county, index rows where the table has none, manifest rows where neither has."""
    own = view(s, sf, "properties")
    table = own.where("county_name = 'Lee' and property_type = 'Condo'").select("address_city", "property_id")
    index = own.where("address_city <> 'MACHINERY'").select("address_city", "property_id")
    manifest = own.select("address_city", "property_id")
    return L.prioritised([table.where("address_city in ('BUILDING', 'HOUSEHOLD')"), index, manifest], "address_city")


_add("list_properties_fallback", _fallback, f"{PROPS} SELECT address_city, property_id, CASE WHEN address_city IN ('BUILDING', 'HOUSEHOLD') THEN 0 WHEN address_city <> 'MACHINERY' THEN 1 ELSE 2 END AS priority FROM properties WHERE address_city NOT IN ('BUILDING', 'HOUSEHOLD') OR county_name = 'Lee' AND property_type = 'Condo'")
_REG = "lower(replace(n_name, '_', '-'))"
_add(
    "resolve_tables",
    lambda s, sf: L.resolve_tables(_table(s, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, None).when(F.col("c_custkey") % 6 == 1, F.lit(" Lee ")).otherwise(F.concat(F.lit(" Nation "), F.col("c_nationkey").cast("string"))).alias("county")), _table(s, sf, "nation").where("n_regionkey <> 2").select(F.lower(F.translate("n_name", "_", "-")).alias("county_key"), F.concat(F.lit("t/"), "n_name").alias("location")), "t/single", "lee"),
    f"k AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN ' Lee ' ELSE ' Nation ' || c_nationkey END AS county FROM customer), r AS (SELECT {_REG} AS key, 't/' || n_name AS location FROM nation WHERE n_regionkey <> 2) SELECT c_custkey, county, CASE WHEN county IS NULL THEN 't/single' ELSE coalesce(location, CASE WHEN lower(trim(county)) = 'lee' THEN 't/single' END) END AS location FROM k LEFT JOIN r ON r.key = replace(lower(trim(county)), ' ', '-')",
)

# -- permits, coverage, catalog ----------------------------------------------------------------------------------------

_add("permit_coverage", lambda s, sf: V.permit_coverage(view(s, sf, "permits")), f"{PERMITS} SELECT source_system, count(*) AS n, min(completion_date) AS first_date, max(completion_date) AS last_date FROM permits GROUP BY 1")
_add("permit_total", lambda s, sf: V.permit_coverage(view(s, sf, "permits")).agg(F.sum("n").alias("total")), f"{PERMITS} SELECT count(*) AS total FROM permits")


def _permit_cache(s, sf):
    """Cache documents of all parcels with permits; some lack their parcel, do not parse, or hold permits without a number."""
    permit = F.struct(F.when(F.col("source_system") != "tyler", F.col("permit_number")).alias("permitNumber"), F.col("completion_date").alias("completionDate"))
    docs = view(s, sf, "permits").groupBy("parcel_identifier").agg(F.collect_list(permit).alias("permits"))
    path = scratch(s, "permit-cache")
    text = F.to_json(F.struct(F.when(F.col("parcel_identifier").cast("long") % 5 != 1, F.col("parcel_identifier")).alias("parcelId"), "permits"))
    docs.select(F.when(F.col("parcel_identifier").cast("long") % 7 == 2, F.concat(F.lit("{"), text)).otherwise(text).alias("value")).write.text(path)
    return D.valid_permits(stored(D.read(s, path, "permit_cache"), "parsed"))


_CACHE = f"{PERMITS}, cache AS (SELECT parcel_identifier, count(*) FILTER (source_system <> 'tyler') AS permits FROM permits WHERE cast(parcel_identifier as bigint) % 5 <> 1 GROUP BY 1)"
_add("permit_cache_scan", _permit_cache, f"{_CACHE} SELECT * FROM cache WHERE cast(parcel_identifier as bigint) % 7 <> 2")
_add("permit_lookup", lambda s, sf: L.requested_permits(view(s, sf, "properties").select("parcel_identifier"), _permit_cache(s, sf)), f"{_CACHE}, {PROPS}, hit AS (SELECT * FROM cache WHERE cast(parcel_identifier as bigint) % 7 <> 2) SELECT p.parcel_identifier, CASE WHEN hit.parcel_identifier IS NULL THEN 'enqueued' ELSE 'cached' END AS status, permits, CASE WHEN hit.parcel_identifier IS NULL THEN '{{\"parcelId\":\"' || p.parcel_identifier || '\",\"action\":\"harvest\"}}' END AS message FROM properties p LEFT JOIN hit ON hit.parcel_identifier = p.parcel_identifier")
_ENTRIES = "customer JOIN orders ON c_custkey = o_custkey"


def _coverage(s, sf):
    """A snapshot for each nation, written as JSON and read back."""
    joined = _table(s, sf, "customer").join(_table(s, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    n = F.count("*")
    entries = joined.groupBy("c_nationkey", F.concat(F.lit("source-"), "o_orderstatus").alias("source")).agg(n.alias("ingested_count"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_loaded_at"))
    entries = entries.withColumn("expected_count", F.when(F.col("c_nationkey") % 4 == 0, None).when(F.col("c_nationkey") % 4 == 1, 0).otherwise(F.col("ingested_count") + F.col("c_nationkey") * 3).cast("long"))
    docs = entries.groupBy(F.concat(F.lit(" Nation "), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("county")).agg(F.collect_list(F.struct("source", "ingested_count", "expected_count", "first_loaded_at")).alias("datasets"))
    path = scratch(s, "coverage")
    docs.write.json(path)
    return D.read(s, path, "coverage")


_COVER = "entries AS (SELECT c_nationkey, 'source-' || o_orderstatus AS source, count(*) AS ingested_count, cast(min(o_orderdate)::DATE as string) AS first_loaded_at, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 0 ELSE count(*) + c_nationkey * 3 END AS expected_count FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)"
_add("coverage_entries", lambda s, sf: D.coverage_of(_coverage(s, sf), "nation-7").select("source", "ingested_count", "expected_count", "first_loaded_at"), f"{_COVER} SELECT source, ingested_count, expected_count, first_loaded_at FROM entries WHERE c_nationkey = 7")
_add("coverage_percent", lambda s, sf: V.coverage_percent(D.rows(_coverage(s, sf), "coverage").withColumn("source", F.concat_ws("/", F.trim("county"), "source"))), f"{_COVER} SELECT 'Nation ' || c_nationkey || '/' || source AS source, ingested_count, expected_count, CASE WHEN expected_count > 0 THEN floor(ingested_count / expected_count * 100 + 0.5)::BIGINT END AS percent FROM entries")
_add(
    "dataset_info",
    lambda s, sf: L.dataset_info(view(s, sf, "properties").groupBy(F.concat(F.lit("nation-"), (F.col("parcel_identifier").cast("long") % 20).cast("string")).alias("county_key")).agg(F.count("*").alias("live_count")), D.rows(_coverage(s, sf), "coverage").groupBy(F.regexp_replace(F.lower(F.trim("county")), " ", "-").alias("county_key")).agg(F.count("*").alias("sources"))),
    f"{_COVER}, {PROPS}, b AS (SELECT 'nation-' || cast(parcel_identifier as bigint) % 20 AS county_key, count(*) AS live_count FROM properties GROUP BY 1), c AS (SELECT 'nation-' || c_nationkey AS county_key, count(*) AS sources FROM entries GROUP BY 1) SELECT county_key, live_count AS record_count, live_count IS NOT NULL AS has_table, coalesce(sources, 0) AS sources FROM b FULL JOIN c USING (county_key)",
)
_add("dataset_count", lambda s, sf: view(s, sf, "properties").agg(F.count("*").alias("n"), F.min("county_name").alias("county"), F.min("state_code").alias("state")), f"{PROPS} SELECT count(*) AS n, min(county_name) AS county, min(state_code) AS state FROM properties")


def _catalog(s, sf):
    """Supplier regions as a catalog: some keys are malformed, some codes repeat."""
    own = _table(s, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 10 == 7, F.concat(F.lit("Bad Key "), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("county-"), F.col("s_suppkey").cast("string"))).alias("countyKey"),
        F.when(F.col("s_suppkey") % 11 == 3, "fl").otherwise("FL").alias("stateCode"),
        F.lpad((F.col("s_suppkey") - (F.col("s_suppkey") % 13 == 5).cast("int")).cast("string"), 5, "1").alias("countyFips"),
        "s_suppkey",
    )
    path = scratch(s, "catalog")
    own.groupBy("stateCode", _bounded("s_suppkey")).agg(F.collect_list(F.struct("countyKey", "stateCode", "countyFips")).alias("counties")).select(F.lit("r").alias("revision"), "counties").write.json(path)
    return D.rows(D.read(s, path, "catalog"), "catalog").select(F.col("countyKey").alias("county_key"), F.col("stateCode").alias("state_code"), F.col("countyFips").alias("county_fips"))


_CATALOG = "counties AS (SELECT CASE WHEN s_suppkey % 10 = 7 THEN 'Bad Key ' || s_suppkey ELSE 'county-' || s_suppkey END AS county_key, CASE WHEN s_suppkey % 11 = 3 THEN 'fl' ELSE 'FL' END AS state_code, lpad((s_suppkey - (s_suppkey % 13 = 5)::INT)::VARCHAR, 5, '1') AS county_fips FROM supplier)"
_add("catalog_validate", lambda s, sf: V.validate_catalog(_catalog(s, sf)), f"{_CATALOG}, n AS (SELECT *, count(*) OVER (PARTITION BY county_key) AS nk, count(*) OVER (PARTITION BY county_fips) AS nf FROM counties) SELECT county_key, state_code, county_fips, CASE WHEN NOT regexp_matches(county_key, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'bad key' WHEN NOT regexp_matches(state_code, '^[A-Z]{{2}}$') THEN 'bad state' WHEN nk > 1 THEN 'key repeats' WHEN nf > 1 THEN 'code repeats' END AS problem FROM n".replace("{{2}}", "{2}"))
_add("catalog_revision", lambda s, sf: V.catalog_revision(_catalog(s, sf)), f"{_CATALOG} SELECT count(*) AS count, sha256(string_agg('{{\"county_key\":\"' || county_key || '\",\"state_code\":\"' || state_code || '\",\"county_fips\":\"' || county_fips || '\"}}', chr(10) ORDER BY county_key)) AS revision FROM counties")
_DESCRIPTIONS = {"property_id": "identifier of the property", "market_value": "assessed market value"}
_CONTACTS = ("websites", "phones", "emails")


def _describe_sql(name: str, descriptions: dict[str, str], hidden: tuple[str, ...] = ()) -> str:
    columns = VIEWS[name][2]
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS name, (SELECT CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof({c})) END FROM {name} LIMIT 1) AS type, {repr(descriptions[c]) if c in descriptions else 'NULL'} AS description, {c not in hidden} AS default_projection, {len(columns)} AS column_count"
        for c in columns
    )
    return f"{sql(name)} {rows}"


_add("describe_table", lambda s, sf: D.describe(view(s, sf, "properties"), _DESCRIPTIONS), _describe_sql("properties", _DESCRIPTIONS))
_add("describe_places", lambda s, sf: D.describe(view(s, sf, "places"), {"gers_id": "identifier of the place"}, _CONTACTS), _describe_sql("places", {"gers_id": "identifier of the place"}, _CONTACTS))
_add(
    "publication_meta",
    lambda s, sf: D.publication_meta(_table(s, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.lit("2026").alias("updatedAt"), F.struct(F.col("o_orderstatus").alias("release")).alias("source")))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"release":"'), "o_orderpriority", F.lit('","licenses":["a",3,"b"]}'))).otherwise("broken").alias("doc")), "doc"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2026' END AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS release, CASE WHEN o_orderkey % 3 = 1 THEN 'a,b' END AS licenses FROM orders",
)

# -- SQL ---------------------------------------------------------------------------------------------------------------


def _session(s, sf):
    for name in ("properties", "permits"):
        view(s, sf, name).createOrReplaceTempView(name)
    return s


ROOFS = "WITH last AS (SELECT property_id, max(cast(completion_date AS date)) AS d FROM permits WHERE improvement_type = 'Roofing' AND completion_date IS NOT NULL AND property_id IS NOT NULL GROUP BY property_id) SELECT count(*) AS roofs, count(*) FILTER (WHERE d < date '2001-08-01' - INTERVAL '2' YEAR) AS old, round(count(*) FILTER (WHERE d < date '2001-08-01' - INTERVAL '2' YEAR) * 100.0 / count(*), 3) AS share FROM last"
TOP = "SELECT property_id, market_value FROM properties ORDER BY market_value DESC NULLS LAST, property_id LIMIT 5"
_add("guarded_sql", lambda s, sf: sqlguard.run(_session(s, sf), "SELECT address_city, count(*) AS n, 'drop; -- no' AS note FROM properties /* update */ WHERE owner_name ILIKE '%1%' GROUP BY address_city;"), f"{PROPS} SELECT address_city, count(*) AS n, 'drop; -- no' AS note FROM properties WHERE owner_name ILIKE '%1%' GROUP BY 1")
_add("guarded_sql_cap", lambda s, sf: sqlguard.run(_session(s, sf), "SELECT property_id FROM properties", 5000).agg(F.count("*").alias("n")), f"{PROPS} SELECT least(count(*), 1000) AS n FROM properties")
_add("param_sql", lambda s, sf: sqlguard.run_trusted(_session(s, sf), "SELECT address_city, count(*) AS n FROM properties WHERE market_value >= :least AND county_name = :county GROUP BY address_city", least=2500.0, county="Lee"), f"{PROPS} SELECT address_city, count(*) AS n FROM properties WHERE market_value >= 2500 AND county_name = 'Lee' GROUP BY 1")
_add("roof_age", lambda s, sf: sqlguard.run(_session(s, sf), ROOFS).withColumn("share", F.col("share").cast("double")), f"{PERMITS}, q AS ({ROOFS}) SELECT roofs, old, share::DOUBLE AS share FROM q")
_add("sql_exemplars", lambda s, sf: sqlguard.run(_session(s, sf), TOP), f"{PROPS}, q AS ({TOP}) SELECT * FROM q")
_add("sql_exemplar_counts", lambda s, sf: sqlguard.run(_session(s, sf), "SELECT count(*) FILTER (WHERE owner_name ILIKE '%99%') AS owners, count(*) FILTER (WHERE address_city = 'BUILDING') AS in_city, count(*) FILTER (WHERE market_value > 9000) AS dear FROM properties"), f"{PROPS} SELECT count(*) FILTER (WHERE owner_name ILIKE '%99%') AS owners, count(*) FILTER (WHERE address_city = 'BUILDING') AS in_city, count(*) FILTER (WHERE market_value > 9000) AS dear FROM properties")
