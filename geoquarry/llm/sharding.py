"""Proportional stratified interleaving into shards, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash, ranked, and given the fractional rank (rank - u) / n, where
n is the source's size and u a seeded number of the source in (0, 1]. In the order of fractional ranks every source
is spread evenly, so cutting it into equal runs gives shards that all match the mixture. The law is ``rows``: shard
sizes in rows differ by one at most.

Neither step sorts a source, or the table, in one task: hashes and fractional ranks are first cut into many
buckets of bounded size, ranks are taken within a bucket, and the counts of the buckets before are added. A source
that holds a third of all rows is spread over a third of the buckets.

Rows with a null source are one more stratum; null texts have size 1 and the checksum of no bytes. Rows that agree
in id, text and source are interchangeable; other ties go by id, then checksum. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from geoquarry.llm.common import stash, table, unstash

SHARDS, SEED = 16, "shards-1"
#: Rows that one bucket may be expected to hold.
BUCKET_ROWS = 20_000
#: Buckets that even a small table is cut into.
LEAST_BUCKETS = 256


def _fraction(*parts: Column | str) -> Column:
    """A seeded number in (0, 1], from 52 bits of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def _before(counts: DataFrame, by: list[str], at: str) -> DataFrame:
    """The sum of ``n`` over the buckets before each, per ``by``. ``counts`` has one row for each bucket."""
    window = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))


def interleave(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text, source)."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    flat = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("stratum"),
    )
    flat = stash(flat.withColumn("key", _fraction(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))), "rows")
    total = flat.count()
    # no task is to hold more than its share, however small the table
    buckets = max(total // bucket_rows + 1, LEAST_BUCKETS)
    keyed = flat.withColumn("b", F.least(F.floor(F.col("key") * buckets), F.lit(buckets - 1)))
    # at most (sources seen) x (buckets) counts: a stratum never has more of them than rows
    counts = keyed.groupBy("stratum", "b").agg(F.count("*").alias("n"))
    offset = _before(counts, ["stratum"], "b").withColumn("stratum_rows", F.sum("n").over(Window.partitionBy("stratum"))).drop("n")
    order = Window.partitionBy("stratum", "b").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("r", F.row_number().over(order)).join(offset, ["stratum", "b"])
    # u is 1 for the whole table's sake only where a source holds all rows; ranks start at 1, so f is in [0, 1)
    spread = ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "key", ((F.col("before") + F.col("r") - _fraction(F.lit("u"), F.col("stratum"))) / F.col("stratum_rows")).alias("f"))
    spread = stash(spread.withColumn("b", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1))), "spread")
    # one row for each bucket: as many as total / bucket_rows, summed once over all
    prior = _before(spread.groupBy("b").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "b").select("b", "before")
    placed = spread.join(F.broadcast(prior) if buckets <= 1_000_000 else prior, "b").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("f", "stratum", "key", "doc_id", "text_crc32", "size")) - 1)
    unstash(flat)
    # the first (total mod shards) shards get one row more
    base, more = divmod(total, shards)
    edge = more * (base + 1)
    shard = F.when(F.col("at") < edge, F.floor(F.col("at") / (base + 1))).otherwise(more + F.floor((F.col("at") - edge) / max(base, 1)))
    first = F.when(F.col("shard") < more, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - more) * base)
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("at") - first).cast("long"))
    return out.select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def op4_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = r"""
WITH c0 AS (SELECT i, i::BIGINT AS v FROM range(256) t(i)),
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM c0),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
  coalesce('s' || source, '') AS stratum FROM documents, tab),
k AS (SELECT *, (('0x' || substr(md5('shards-1|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496 AS key,
  (('0x' || substr(md5('shards-1|u|' || stratum), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496 AS u FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM k),
f AS (SELECT *, (r - u) / n AS f FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, total // 16 AS base, total % 16 AS more FROM p),
g AS (SELECT *, CASE WHEN pos < more * (base + 1) THEN pos // (base + 1) ELSE more + (pos - more * (base + 1)) // greatest(base, 1) END AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (pos - CASE WHEN shard < more THEN shard * (base + 1) ELSE more * (base + 1) + (shard - more) * base END)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g
"""
