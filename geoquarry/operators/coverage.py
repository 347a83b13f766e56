"""Coverage of permits and data sets, and the county catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def permit_coverage(permits: DataFrame) -> DataFrame:
    """Permits and their completion dates by source system."""
    return permits.groupBy("source_system").agg(F.count("*").alias("n"), F.min("completion_date").alias("first_date"), F.max("completion_date").alias("last_date"))


def coverage_percent(entries: DataFrame) -> DataFrame:
    """Ingested of expected, rounded half up; null without a positive expectation."""
    expected = F.col("expected_count")
    percent = F.when(expected > 0, F.floor(F.col("ingested_count") / expected * 100 + 0.5))
    return entries.select("source", "ingested_count", "expected_count", percent.cast("long").alias("percent")).orderBy("source")


def validate_catalog(counties: DataFrame) -> DataFrame:
    """``problem`` of each county: bad key, state or FIPS code, or a key or code that repeats; null if fit."""
    keys = counties.groupBy("county_key").agg(F.count("*").alias("n_key"))
    codes = counties.groupBy("county_fips").agg(F.count("*").alias("n_fips"))
    problem = (
        F.when(~F.coalesce(F.col("county_key").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "bad key")
        .when(~F.coalesce(F.col("state_code").rlike("^[A-Z]{2}$"), F.lit(False)), "bad state")
        .when(~F.coalesce(F.col("county_fips").rlike("^[0-9]{5}$"), F.lit(False)), "bad code")
        .when(F.col("n_key") > 1, "key repeats")
        .when(F.col("n_fips") > 1, "code repeats")
    )
    return counties.join(keys, "county_key", "left").join(codes, "county_fips", "left").select("county_key", "state_code", "county_fips", problem.alias("problem")).orderBy("county_key")


def catalog_revision(counties: DataFrame) -> DataFrame:
    """Count and SHA-256 of the catalog's rows in key order, one JSON line each; catalogs are small by nature."""
    line = F.to_json(F.struct("county_key", "state_code", "county_fips"))
    lines = F.array_sort(F.collect_list(F.struct("county_key", line.alias("line"))))
    return counties.agg(F.count("*").alias("count"), F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("revision"))
