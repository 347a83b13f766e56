"""Place, property and permit tables derived from the given tables by fixed arithmetic.

Every expression is written so that Spark SQL and DuckDB read it alike; ``sql(name)`` states the same view for
DuckDB, and ``view(name)`` gives it as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: name -> (tables, join and filter, columns)
VIEWS: dict[str, tuple[tuple[str, ...], str, dict[str, str]]] = {
    "places": (
        ("lineitem", "part"),
        "lineitem JOIN part ON l_partkey = p_partkey",
        {
            "gers_id": "cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string)",
            "county_key": "CASE WHEN l_orderkey % 50 = 0 THEN 'collier' ELSE 'lee' END",
            "name_primary": "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE p_brand || ', ' || p_name || ' Co.' END",
            "taxonomy_primary": "CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE replace(p_name, ' ', '_') END",
            "taxonomy_hierarchy": "CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/' || replace(p_name, ' ', '_') END",
            "basic_category": "split_part(p_name, ' ', 2)",
            "operating_status": "CASE WHEN l_returnflag = 'A' THEN 'open' WHEN l_returnflag = 'R' THEN 'Closed' END",
            "confidence": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE cast(50 + l_partkey % 50 as double) / cast(100 as double) END",
            "longitude": "CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE cast(-82.10 as double) + cast(length(p_name) * 10 + l_orderkey % 12 as double) * cast(0.0081 as double) + cast(0.001 as double) END",
            "latitude": "CASE WHEN l_orderkey % 223 = 0 THEN cast(91 as double) ELSE cast(26.30 as double) + cast((l_orderkey * 7 + l_suppkey * 13) % 60 as double) * cast(0.0072 as double) + cast(0.001 as double) END",
            "address_freeform": "cast(l_orderkey % 999 as string) || ' Main St'",
            "address_locality": "'City ' || cast(l_suppkey % 20 as string)",
            "address_postcode": "cast(33900 + l_suppkey % 40 as string)",
            "address_region": "'FL'",
            "address_country": "'US'",
            "brand_name": "p_brand",
            "is_hosted_service": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN true WHEN l_returnflag = 'N' THEN false END",
            "overture_release": "CASE WHEN l_orderkey % 997 = 1 THEN NULL WHEN l_orderkey % 499 = 2 THEN '2026-02' ELSE '2026-01' END",
            "websites": "'https://' || cast(l_partkey as string) || '.example.com'",
            "phones": "'+1' || cast(l_orderkey as string)",
            "emails": "'p' || cast(l_partkey as string) || '@example.com'",
        },
    ),
    "properties": (
        ("customer",),
        "customer",
        {
            "property_id": "'prop-' || cast(c_custkey as string)",
            "parcel_identifier": "lpad(cast(c_custkey as string), 10, '0')",
            "cid": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'bafy' || md5(c_name) END",
            "owner_name": "c_name",
            "address_street": "CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE cast(c_custkey % 500 as string) || ' Oak Ave' END",
            "address_city": "c_mktsegment",
            "address_zip": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE cast(33000 + c_nationkey as string) END",
            "county_name": "CASE WHEN c_nationkey % 5 = 0 THEN 'Collier' ELSE 'Lee' END",
            "state_code": "'FL'",
            "property_type": "CASE WHEN c_nationkey % 3 = 0 THEN 'SingleFamily' WHEN c_nationkey % 3 = 1 THEN 'Condo' END",
            "market_value": "c_acctbal",
            "avm_value": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal * 2 END",
            "latitude": "cast(26 as double) + cast((c_custkey * 37) % 1000 as double) / cast(1000 as double)",
            "longitude": "cast(-82 as double) + cast((c_custkey * 91) % 1000 as double) / cast(1000 as double)",
        },
    ),
    "permits": (
        ("orders",),
        "orders",
        {
            "permit_number": "'BLD-' || cast(o_orderkey as string)",
            "property_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'prop-' || cast(o_custkey as string) END",
            "parcel_identifier": "lpad(cast(o_custkey as string), 10, '0')",
            "improvement_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Roofing' WHEN o_orderpriority = '2-HIGH' THEN 'Pool' ELSE 'General' END",
            "source_system": "CASE WHEN o_orderstatus = 'O' THEN 'accela' WHEN o_orderstatus = 'F' THEN 'tyler' ELSE 'energov' END",
            "completion_date": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL ELSE cast(cast(o_orderdate as date) as string) END",
            "estimated_job_value": "o_totalprice",
        },
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, _, columns = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
    if name == "places":
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        source = source.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return source.selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def sql(name: str) -> str:
    """The view as a common table expression for DuckDB."""
    _, body, columns = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {body})"
