"""JSON documents with explicit schemas: coverage snapshots, geo indexes, manifests, shards, permit caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.functions.text import county_key

SCHEMAS = {
    "coverage": "county string, exportedAt string, datasets array<struct<source: string, ingested_count: long, expected_count: long, first_loaded_at: string, last_loaded_at: string>>",
    "geo_index": "county string, entries array<struct<parcelIdentifier: string, latitude: double, longitude: double, currentAvmValue: double, propertyType: string>>",
    "manifest": "county string, entries array<struct<propertyId: string, parcelIdentifier: string, filePath: string, sha256: string, cid: string, fileSizeBytes: long>>",
    "shard_index": "county string, shards array<struct<shardIndex: int, fromParcel: string, toParcel: string, count: int, shardCid: string>>",
    "manifest_or_index": "county string, shards array<struct<shardIndex: int, fromParcel: string, toParcel: string, count: int, shardCid: string>>, entries array<struct<propertyId: string, parcelIdentifier: string, cid: string>>",
    "shard": "shardIndex int, entries array<struct<propertyId: string, parcelIdentifier: string, cid: string, fileSizeBytes: long>>",
    "permit_cache": "parcelId string, harvestedAt string, permits array<struct<permitNumber: string, completionDate: string>>, _corrupt string",
    "catalog": "revision string, counties array<struct<countyKey: string, stateCode: string, countyFips: string>>",
}
_ROWS = {"coverage": "datasets", "geo_index": "entries", "manifest": "entries", "shard_index": "shards", "shard": "entries", "permit_cache": "permits", "catalog": "counties"}


def read(spark: SparkSession, path: str, kind: str, multiline: bool = False) -> DataFrame:
    """Documents of one kind; broken ones keep their text in ``_corrupt`` where the schema has it."""
    reader = spark.read.schema(SCHEMAS[kind]).option("multiLine", multiline)
    if "_corrupt" in SCHEMAS[kind]:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def rows(docs: DataFrame, kind: str) -> DataFrame:
    """One row for each entry of each document."""
    own = [c for c in docs.columns if c not in (_ROWS[kind], "_corrupt")]
    return docs.select(*own, F.inline(_ROWS[kind]))


def coverage_of(docs: DataFrame, county: str) -> DataFrame:
    """Entries of the snapshots for one county; snapshots of other counties are ignored."""
    return rows(docs.where(county_key(F.col("county")) == county), "coverage")


def layouts(docs: DataFrame) -> DataFrame:
    """Documents read as ``manifest_or_index`` with their layout: sharded where they list shards, else flat where they list entries, else unknown."""
    return docs.withColumn("layout", F.when(F.col("shards").isNotNull(), "sharded").when(F.col("entries").isNotNull(), "flat").otherwise("unknown"))


def valid_permits(docs: DataFrame) -> DataFrame:
    """Cache documents that parse and name a parcel, one row each with the number of valid permits."""
    fit = docs.where("_corrupt is null and parcelId is not null")
    return fit.select(F.col("parcelId").alias("parcel_identifier"), F.size(F.filter(F.coalesce("permits", F.array().cast("array<struct<permitNumber:string,completionDate:string>>")), lambda p: p["permitNumber"].isNotNull())).cast("long").alias("permits"))


def describe(df: DataFrame, descriptions: dict[str, str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """name, type, description (null if unknown), default_projection, column_count of a table's columns; from the schema alone, no row is read."""
    columns = [(f.name, f.dataType.simpleString(), descriptions.get(f.name), f.name not in hidden, len(df.schema)) for f in df.schema]
    return df.sparkSession.createDataFrame(columns, "name string, type string, description string, default_projection boolean, column_count long")


def integrity_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """filePath, status of every file that a manifest names: ok, missing, size or digest; files are binaryFile rows."""
    seen = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("filePath"), F.sha2("content", 256).alias("found"), F.col("length").alias("size"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("size") != F.col("fileSizeBytes"), "size").when(F.col("found") != F.lower("sha256"), "digest").otherwise("ok")
    return manifest.join(seen, "filePath", "left").select("filePath", status.alias("status"))


def publication_meta(docs: DataFrame, column: str) -> DataFrame:
    """Typed publication fields from JSON text or null; the release falls back to a nested field; only text members of arrays stay."""
    parsed = docs.select("*", F.from_json(column, "updatedAt string, release string, source struct<release: string>, licenses array<string>").alias("m"))
    return parsed.select(*(c for c in docs.columns if c != column), F.col("m.updatedAt").alias("updated_at"), F.coalesce("m.release", "m.source.release").alias("release"), F.array_join(F.filter("m.licenses", lambda x: x.isNotNull() & ~x.rlike(r"^[0-9{\[]")), ",").alias("licenses"))
