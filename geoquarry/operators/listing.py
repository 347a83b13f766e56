"""Key lookup and paging over property tables, range shards and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.operators.ranks import last_before, page, running_sum

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


def text_or_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number_or_null(c: str) -> Column:
    return F.col(c).try_cast("double")


def list_properties(properties: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page by parcel, with the address joined from its parts that are not blank."""
    address = F.nullif(F.concat_ws(", ", *(text_or_null(c) for c in ("address_street", "address_city", "address_zip"))), F.lit(""))
    rows = page(properties, [F.asc("parcel_identifier"), F.asc("property_id")], max(1, min(limit, MAX_LIMIT)), max(0, offset))
    return rows.select("parcel_identifier", "property_id", text_or_null("cid").alias("cid"), address.alias("address"), number_or_null("avm_value").alias("avm_value"))


def lookup(keys: DataFrame, properties: DataFrame) -> DataFrame:
    """keys (request_id, parcel, property, cid: exactly one set) -> cid or an error; the first row by property_id counts."""
    given = sum((F.col(c).isNotNull().cast("int") for c in ("parcel", "property", "key_cid")), F.lit(0))
    tried = keys.withColumn("given", given)
    found = []
    for key, column in (("parcel", "parcel_identifier"), ("property", "property_id"), ("key_cid", "cid")):
        one = properties.groupBy(F.col(column).alias(key)).agg(F.min(F.struct("property_id", "cid")).alias("hit")).where(F.col(key).isNotNull())
        found.append(tried.where((F.col("given") == 1) & F.col(key).isNotNull()).join(one, key, "left").select("request_id", "hit"))
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    error = F.when(F.col("given") != 1, "exactly one key is needed").when(F.col("hit").isNull(), "not found").when(F.col("hit.cid").isNull(), "no content id")
    return tried.join(hits, "request_id", "left").select("request_id", F.when(error.isNull(), F.col("hit.cid")).alias("cid"), error.alias("error"))


def shard_of(keys: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """Keys with the shard whose range [from_parcel, to_parcel] holds them, in the order of the texts' bytes; null where none does.

    Keys and range starts are sorted together over many partitions, and each key takes the last range that starts before it,
    from an earlier partition if need be. So where ranges overlap, a range ends where the next one starts, and of ranges with
    one start the last by end and number counts. Null keys are in no shard.
    """
    own = F.struct(F.col("from_parcel").alias("low"), F.col("to_parcel").alias("high"), F.col("shard_index").alias("number"))
    starts = shards.where("from_parcel is not null").select(F.col("from_parcel").alias("__at"), own.alias("__range"))
    asked = keys.select(F.col(key).alias("__at"), F.struct(*keys.columns).alias("__asked"))
    both = starts.unionByName(asked, allowMissingColumns=True)
    met = last_before(both, "__range", [F.col("__at").asc_nulls_first(), F.col("__range").asc_nulls_last()], "__last")
    return met.where("__asked is not null").select("__asked.*", F.when(F.col("__at") <= F.col("__last.high"), F.col("__last.number")).alias("shard_index"))


def page_slices(shards: DataFrame, limit: int, offset: int) -> DataFrame:
    """shard_index, start, end of the rows that a page takes from each shard; shards without content still count."""
    placed = running_sum(shards, "count", [F.col("shard_index").asc()], name="reached").withColumn("before", F.col("reached") - F.coalesce("count", F.lit(0)))
    start, end = F.greatest(F.lit(offset) - F.col("before"), F.lit(0)), F.least(F.lit(offset + limit) - F.col("before"), F.col("count"))
    return placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("count") > offset) & F.col("shard_cid").isNotNull()).select("shard_index", start.cast("long").alias("start"), end.cast("long").alias("end"))


def prioritised(sources: list[DataFrame], by: str) -> DataFrame:
    """For every value of ``by`` the rows of the first source that has any."""
    tagged = [s.withColumn("__p", F.lit(k)) for k, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    best = union.groupBy(by).agg(F.min("__p").alias("__p"))
    return union.join(best, [by, "__p"], "left_semi").withColumnRenamed("__p", "priority")


def resolve_tables(requests: DataFrame, registry: DataFrame, single: str | None, default_county: str) -> DataFrame:
    """requests (county or null) -> location: the registry's, else the single one for no county or the default county, else null."""
    from geoquarry.functions.text import county_key

    keyed = requests.withColumn("key", county_key(F.col("county")))
    joined = keyed.join(registry.select(F.col("county_key").alias("key"), "location"), "key", "left")
    location = F.coalesce("location", F.when(F.col("key").isNull() | (F.col("key") == default_county), F.lit(single)))
    return joined.select(*requests.columns, F.when(F.col("county").isNull(), F.lit(single)).otherwise(location).alias("location"))


def requested_permits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A cached row for each request that the cache holds, and a work item with its message for every other."""
    hit = requests.join(cache.select("parcel_identifier", "permits"), "parcel_identifier").select("parcel_identifier", F.lit("cached").alias("status"), "permits", F.lit(None).cast("string").alias("message"))
    miss = requests.join(cache, "parcel_identifier", "left_anti")
    message = F.to_json(F.struct(F.col("parcel_identifier").alias("parcelId"), F.lit("harvest").alias("action")))
    return hit.unionByName(miss.select("parcel_identifier", F.lit("enqueued").alias("status"), F.lit(None).cast("long").alias("permits"), message.alias("message")))


def dataset_info(base: DataFrame, coverage: DataFrame) -> DataFrame:
    """County data sets from live counts and from coverage; coverage alone gives no count and a false flag."""
    out = base.join(coverage, "county_key", "full")
    return out.select("county_key", F.when(F.col("live_count").isNotNull(), F.col("live_count")).alias("record_count"), F.col("live_count").isNotNull().alias("has_table"), F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))
