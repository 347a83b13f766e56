"""Published property listings in two levels: an index of key ranges, and one file of entries for each range.

The files lie below one folder, each in a folder named by its content id (``shardCid=...``), so a filter on the id
chooses which are opened. Lookups and pages first find the ids they need from the index alone, then read those files
only. Counties that publish one flat list of entries are answered from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoquarry.operators.listing import page_slices, shard_of
from geoquarry.sources.documents import SCHEMAS
from geoquarry.sources.scratch import stored

#: Ids that are named to the file listing; of more files, all are listed and met with the ids by a join.
NAMED_FILES = 10_000
ENTRY = ("propertyId", "parcelIdentifier", "cid", "fileSizeBytes")


def write_files(entries: DataFrame, path: str) -> None:
    """entries (shardIndex, shardCid and those of ENTRY) as one document for each shard, in order of parcel; shards without an id are not published."""
    own = F.array_sort(F.collect_list(F.struct(F.col("parcelIdentifier").alias("at"), F.struct(*ENTRY).alias("entry"))))
    docs = entries.where("shardCid is not null").groupBy("shardCid", "shardIndex").agg(F.transform(own, lambda x: x["entry"]).alias("entries"))
    docs.write.partitionBy("shardCid").json(path)


def open_files(spark: SparkSession, path: str, wanted: DataFrame | None = None, named: int = NAMED_FILES) -> DataFrame:
    """shardCid, shardIndex, position and the fields of ENTRY of all shard files, or of those whose ids ``wanted`` (shardCid) names."""
    files = spark.read.schema(SCHEMAS["shard"] + ", shardCid string").json(path)
    if wanted is not None:
        ids = [r[0] for r in wanted.where("shardCid is not null").distinct().limit(named + 1).collect()]
        # the names prune the listing; a join would open every file
        files = files.where(F.col("shardCid").isin(ids)) if len(ids) <= named else files.join(wanted.distinct(), "shardCid", "left_semi")
    return files.select("shardCid", "shardIndex", F.posexplode("entries").alias("position", "e")).select("shardCid", "shardIndex", "position", *(F.col(f"e.{c}").alias(c) for c in ENTRY))


def page(spark: SparkSession, index: DataFrame, path: str, limit: int, offset: int) -> DataFrame:
    """shard_index, position, fields of the entries of one page over the concatenated shards; only the files it touches are opened."""
    slices = stored(page_slices(index, limit, offset).join(index.select("shard_index", F.col("shard_cid").alias("shardCid")), "shard_index"), "slices")
    rows = open_files(spark, path, slices.select("shardCid")).join(F.broadcast(slices.drop("shard_index")), "shardCid")
    return rows.where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("end"))).select(F.col("shardIndex").alias("shard_index"), "position", *ENTRY)


def _key(county: Column | str, value: Column | str) -> Column:
    """Sorts by county, then by value."""
    return F.concat(county, F.lit("\x01"), value)


def lookup(requests: DataFrame, index: DataFrame, path: str, flat: DataFrame, default_county: str, named: int = NAMED_FILES) -> DataFrame:
    """request_id, cid, error of requests (request_id, county, parcel, property: exactly one of the last two set).

    ``index`` has county and the columns of a shard index, ``flat`` has county, position and the fields of ENTRY for
    counties that publish one list. A county without either is not served; none means the default one. Parcels open the one
    file whose range holds them; property ids look through all files of their county, and the first shard whose first
    such entry has a content id counts. Each key is looked up once, however many requests ask for it.
    """
    asked = requests.select("request_id", "parcel", "property", F.lower(F.trim(F.coalesce("county", F.lit(default_county)))).alias("county"))
    asked = stored(asked.withColumn("fit", (F.col("parcel").isNull() != F.col("property").isNull())), "asked")
    sharded = index.select(F.lower("county").alias("county")).distinct().withColumn("layout", F.lit("sharded"))
    layouts = sharded.unionByName(flat.select(F.lower("county").alias("county")).distinct().join(sharded, "county", "left_anti").withColumn("layout", F.lit("flat")))
    keys = asked.where("fit").select("county", "parcel", "property").distinct().join(layouts, "county")
    keys = stored(keys, "keys")

    ranges = index.select(*(_key(F.lower("county"), c).alias(c) for c in ("from_parcel", "to_parcel")), F.struct("shard_cid").alias("shard_index"))
    parcels = shard_of(keys.where("layout = 'sharded' and parcel is not null").withColumn("__key", _key("county", "parcel")), ranges, "__key")
    parcels = stored(parcels.select("county", "parcel", F.col("shard_index.shard_cid").alias("shardCid")), "parcels")
    names = keys.where("layout = 'sharded' and property is not null").select("county", "property")
    of_county = index.where("shard_cid is not null").select(F.lower("county").alias("county"), F.col("shard_cid").alias("shardCid"))
    scanned = of_county.join(names.select("county").distinct(), "county")

    spark = requests.sparkSession
    by_parcel = open_files(spark, path, parcels.select("shardCid"), named).withColumnRenamed("parcelIdentifier", "parcel").join(parcels, ["shardCid", "parcel"])
    by_parcel = by_parcel.groupBy("county", "parcel").agg(F.min_by(F.struct("cid"), "position").alias("hit"))
    by_name = open_files(spark, path, scanned.select("shardCid"), named).withColumnRenamed("propertyId", "property").join(scanned, "shardCid").join(names, ["county", "property"])
    by_name = by_name.groupBy("county", "property", "shardIndex").agg(F.min_by(F.struct("cid"), "position").alias("first")).where("first.cid is not null").groupBy("county", "property").agg(F.min_by("first", "shardIndex").alias("hit"))
    listed = flat.withColumn("county", F.lower("county"))
    flat_parcel = listed.groupBy("county", F.col("parcelIdentifier").alias("parcel")).agg(F.min_by(F.struct("cid"), "position").alias("hit"))
    flat_name = listed.groupBy("county", F.col("propertyId").alias("property")).agg(F.min_by(F.struct("cid"), "position").alias("hit"))
    of_flat = keys.where("layout = 'flat'")
    hits = [
        by_parcel.select("county", "parcel", F.lit(None).cast("string").alias("property"), "hit"),
        by_name.select("county", F.lit(None).cast("string").alias("parcel"), "property", "hit"),
        of_flat.where("parcel is not null").join(flat_parcel, ["county", "parcel"]).select("county", "parcel", "property", "hit"),
        of_flat.where("property is not null").join(flat_name, ["county", "property"]).select("county", "parcel", "property", "hit"),
    ]
    found = hits[0].unionByName(hits[1]).unionByName(hits[2]).unionByName(hits[3])
    found = found.select("county", F.coalesce(F.concat(F.lit("p"), "parcel"), F.concat(F.lit("n"), "property")).alias("key"), "hit.cid")
    out = asked.withColumn("key", F.coalesce(F.concat(F.lit("p"), "parcel"), F.concat(F.lit("n"), "property"))).join(layouts, "county", "left").join(found, ["county", "key"], "left")
    error = F.when(~F.col("fit"), "exactly one key is needed").when(F.col("layout").isNull(), "county not served").when(F.col("cid").isNull(), F.concat(F.lit("not found in the "), F.when(F.col("layout") == "flat", "manifest").otherwise("index")))
    return out.select("request_id", F.when(error.isNull(), F.col("cid")).alias("cid"), error.alias("error"))
