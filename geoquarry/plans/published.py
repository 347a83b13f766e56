"""Published shard files and incremental indexing runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.functions.text import county_key
from geoquarry.operators import indexing as I, shards as P
from geoquarry.sources import documents as D
from geoquarry.sources.scratch import scratch, stored
from geoquarry.sources.views import sql, view

QUERIES, ORACLES = {}, {}


def _add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"WITH {oracle}"


# -- shard files ---------------------------------------------------------------------------------------------------

#: Parcels of one shard.
SHARD = 256
_SHARD = f"cast(cast(parcel_identifier as bigint) div {SHARD} as int)"


def _publish(s: SparkSession, sf: str) -> tuple[DataFrame, str, DataFrame]:
    """Lee's index (read back from its JSON documents) and folder of shard files; Collier's flat list. Every fifth shard has no id."""
    own = view(s, sf, "properties").withColumn("shardIndex", F.expr(_SHARD)).withColumn("shardCid", F.when(F.col("shardIndex") % 5 != 3, F.concat(F.lit("shard-"), "shardIndex")))
    entries = own.select("county_name", "shardIndex", "shardCid", F.col("property_id").alias("propertyId"), F.col("parcel_identifier").alias("parcelIdentifier"), "cid", F.length("owner_name").cast("long").alias("fileSizeBytes"))
    lee = entries.where("county_name = 'Lee'")
    files = scratch(s, "shard-files")
    P.write_files(lee, files)
    refs = lee.groupBy("shardIndex", "shardCid").agg(F.min("parcelIdentifier").alias("fromParcel"), F.max("parcelIdentifier").alias("toParcel"), F.count("*").cast("int").alias("count"))
    path = scratch(s, "published")
    # an index document holds references to a bounded number of shards
    refs.groupBy(F.floor(F.col("shardIndex") / 1024).alias("part")).agg(F.collect_list(F.struct("shardIndex", "fromParcel", "toParcel", "count", "shardCid")).alias("shards")).select(F.lit("Lee").alias("county"), "shards").write.json(path)
    flat = entries.where("county_name = 'Collier'").groupBy("shardIndex").agg(F.array_sort(F.collect_list(F.struct("parcelIdentifier", "propertyId", "cid"))).alias("entries")).select(F.lit("Collier").alias("county"), "entries")
    flat.write.mode("append").json(path)
    docs = D.layouts(D.read(s, path, "manifest_or_index"))
    index = D.rows(docs.where("layout = 'sharded'").drop("layout", "entries"), "shard_index").select("county", F.col("shardIndex").alias("shard_index"), F.col("fromParcel").alias("from_parcel"), F.col("toParcel").alias("to_parcel"), F.col("count").cast("long").alias("count"), F.col("shardCid").alias("shard_cid"))
    listed = docs.where("layout = 'flat'").select("county", F.posexplode("entries").alias("at", "e")).select("county", F.struct("e.parcelIdentifier", "at").alias("position"), "e.*")
    return index, files, listed


_PUBLISHED = (
    f"{sql('properties')}, lee AS (SELECT *, (cast(parcel_identifier as bigint) // {SHARD})::INT AS sh FROM properties WHERE county_name = 'Lee'), "
    "ix AS (SELECT sh AS shard_index, count(*) AS count, min(parcel_identifier) AS from_parcel, max(parcel_identifier) AS to_parcel, CASE WHEN sh % 5 <> 3 THEN 'shard-' || sh END AS shard_cid FROM lee GROUP BY sh), "
    "entry AS (SELECT shard_cid, sh, (row_number() OVER (PARTITION BY sh ORDER BY parcel_identifier) - 1)::INT AS position, property_id, parcel_identifier, cid, length(owner_name) AS size FROM lee JOIN ix ON sh = shard_index)"
)
_ENTRY = 'position, property_id AS "propertyId", parcel_identifier AS "parcelIdentifier", cid, size AS "fileSizeBytes"'
_add("shard_files_scan", lambda s, sf: P.open_files(s, _publish(s, sf)[1]), f'{_PUBLISHED} SELECT shard_cid AS "shardCid", sh AS "shardIndex", {_ENTRY} FROM entry WHERE shard_cid IS NOT NULL')
_add(
    "shard_page", lambda s, sf: (lambda p: P.page(s, p[0], p[1], 300, 200))(_publish(s, sf)),
    f"{_PUBLISHED}, b AS (SELECT shard_index, coalesce(sum(count) OVER (ORDER BY shard_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ix) SELECT sh AS shard_index, {_ENTRY} FROM entry JOIN b ON sh = shard_index WHERE shard_cid IS NOT NULL AND before + position BETWEEN 200 AND 499",
)
_COUNTY = "CASE WHEN o_orderkey % 8 < 3 THEN 'Lee' WHEN o_orderkey % 8 < 5 THEN ' COLLIER ' WHEN o_orderkey % 8 = 5 THEN 'Orange' END"
_PARCEL = "CASE WHEN o_custkey % 3 = 0 OR o_custkey % 6 = 2 THEN lpad(cast(o_custkey + o_orderkey % 2 * 400 as string), 10, '0') END"
_PROPERTY = "CASE WHEN o_custkey % 3 = 1 OR o_custkey % 6 = 2 THEN 'prop-' || cast(o_custkey + o_orderkey % 2 * 400 as string) END"


def _shard_lookup(s, sf):
    index, files, flat = _publish(s, sf)
    requests = s.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS request_id", f"{_COUNTY} AS county", f"{_PARCEL} AS parcel", f"{_PROPERTY} AS property")
    return P.lookup(requests.withColumn("county", county_key(F.col("county"))), index, files, flat, "lee")


_add(
    "shard_lookup", _shard_lookup,
    f"{_PUBLISHED}, q AS (SELECT o_orderkey AS request_id, lower(trim(coalesce({_COUNTY}, 'lee'))) AS county, {_PARCEL} AS parcel, {_PROPERTY} AS property FROM orders), "
    "p AS (SELECT 'lee' AS county, parcel_identifier, property_id, cid FROM entry WHERE shard_cid IS NOT NULL UNION ALL SELECT 'collier', parcel_identifier, property_id, cid FROM properties WHERE county_name = 'Collier'), "
    "h AS (SELECT q.*, (parcel IS NULL) <> (property IS NULL) AS fit, coalesce(a.cid, b.cid) AS cid FROM q LEFT JOIN p a ON a.county = q.county AND a.parcel_identifier = q.parcel LEFT JOIN p b ON b.county = q.county AND b.property_id = q.property), "
    "e AS (SELECT *, CASE WHEN NOT fit THEN 'exactly one key is needed' WHEN county NOT IN ('lee', 'collier') THEN 'county not served' WHEN cid IS NULL THEN 'not found in the ' || CASE WHEN county = 'collier' THEN 'manifest' ELSE 'index' END END AS error FROM h) SELECT request_id, CASE WHEN error IS NULL THEN cid END AS cid, error FROM e",
)

# -- incremental indexing ------------------------------------------------------------------------------------------

#: What happened to a repository, by its number: a new clone, a full rescan, changed files, a new commit without changed files, nothing, and a clone whose files all fail.
CASES = 6
_DOCS = (
    f"SELECT source AS repo, cast(substr(source, 4) as int) % {CASES} AS kind, doc_id, doc_id DIV 4 AS f, text, "
    "source || '/' || cast(doc_id DIV 4 as string) || CASE (doc_id DIV 20) % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' WHEN 3 THEN '.tsx' ELSE '.mjs' END AS file_path FROM documents"
)


def _functions_of(path: str, content: str) -> list[tuple[str, str]]:
    """A stand-in parser: files are JSON lists of functions."""
    return [(x["name"], x.get("code")) for x in json.loads(content)]


def _run(s, sf):
    """One indexing run over all repositories: (syncs, rules, targets, old index, extracted, saved, states)."""
    docs = s.sql(_DOCS.replace("FROM documents", "FROM {documents}"), documents=s.read.parquet(f"{sf}/documents.parquet"))
    repos = docs.select("repo", "kind").distinct()
    syncs = repos.select("repo", F.lit("head").alias("head"), F.col("kind").isin(0, 5).alias("new_clone"), (F.col("kind") == 1).alias("full_rescan"))
    states = repos.where("kind <> 0").select("repo", F.when(F.col("kind").isin(1, 4), "head").otherwise("old").alias("commit"))
    gone = (F.col("kind") == 2) & (F.col("f") % 11 == 5)
    changed = docs.where("kind = 2 and f % 3 = 1").select("repo", "file_path").distinct()
    listed = docs.where(~gone).select("repo", "file_path").distinct()
    old = docs.where("doc_id % 9 <> 4 and kind <> 0").select("repo", "file_path", F.col("doc_id").cast("int").alias("position"), F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("// old "), F.coalesce("text", F.lit(""))).alias("code"))
    ruled = stored(I.rules(syncs, changed, states), "rules")
    targets = stored(I.plan(ruled, changed, listed), "targets")
    function = F.struct("doc_id", F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("code"))
    contents = docs.groupBy("repo", "kind", "f", "file_path").agg(F.to_json(F.array_sort(F.collect_list(function))).alias("content"))
    contents = contents.select("repo", "file_path", F.when(gone, None).when((F.col("f") % 7 == 3) | (F.col("kind") == 5), "broken").otherwise(F.col("content")).alias("content"))
    extracted = I.extract(contents.join(targets, ["repo", "file_path"], "left_semi"), _functions_of)
    return syncs, ruled, targets, old, extracted, I.inserts(extracted), states


_RUN = (
    f"d AS ({_DOCS.replace('DIV', '//')}), touched AS (SELECT DISTINCT repo, file_path FROM d WHERE kind = 2 AND f % 3 = 1 AND (f // 5) % 5 <> 0), "
    "ruled AS (SELECT DISTINCT repo, kind, CASE WHEN kind IN (0, 5) THEN 'clone' WHEN kind = 1 THEN 'rescan' WHEN repo IN (SELECT repo FROM touched) THEN 'changed' WHEN kind IN (2, 3) THEN 'commit' END AS rule FROM d), "
    "targets AS (SELECT DISTINCT d.repo, file_path, rule, f % 7 = 3 OR d.kind = 5 OR d.kind = 2 AND f % 11 = 5 AS failed FROM d JOIN ruled r ON r.repo = d.repo WHERE CASE WHEN rule = 'changed' THEN file_path IN (SELECT file_path FROM touched) ELSE rule IS NOT NULL AND (f // 5) % 5 <> 0 AND NOT (d.kind = 2 AND f % 11 = 5) END), "
    "old AS (SELECT repo, file_path, 'fn_' || doc_id AS name, '// old ' || coalesce(text, '') AS code FROM d WHERE doc_id % 9 <> 4 AND kind <> 0), "
    "saved AS (SELECT d.repo, d.file_path, 'fn_' || doc_id AS name, text AS code FROM d JOIN targets t ON t.repo = d.repo AND t.file_path = d.file_path WHERE NOT failed AND trim(coalesce(text, '')) <> '')"
)
_add(
    "index_run", lambda s, sf: I.outcome(*_run(s, sf)),
    f"{_RUN} SELECT r.repo, coalesce(rule, 'none') AS rule, (SELECT count(*) FROM targets t WHERE t.repo = r.repo) AS files, (SELECT count(*) FROM old o JOIN targets t USING (repo, file_path) WHERE o.repo = r.repo) AS deleted, (SELECT count(*) FROM saved s WHERE s.repo = r.repo) AS saved, "
    "(SELECT count(*) FROM targets t WHERE t.repo = r.repo AND failed) AS failed, CASE WHEN (SELECT count(*) FROM saved s WHERE s.repo = r.repo) > 0 THEN 'head' WHEN kind IN (1, 4) THEN 'head' WHEN kind <> 0 THEN 'old' END AS commit FROM ruled r",
)
_add(
    "index_run_rows", lambda s, sf: (lambda r: I.apply(r[3], r[2], r[5]).select("repo", "file_path", "name", F.md5("code").alias("code")))(_run(s, sf)),
    f"{_RUN} SELECT repo, file_path, name, md5(code) AS code FROM old o WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.repo = o.repo AND t.file_path = o.file_path) UNION ALL SELECT repo, file_path, name, md5(code) FROM saved",
)
