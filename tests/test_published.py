"""Shard files with file pruning, page slices, range lookups over many partitions; the indexing planner."""

import pytest
from pyspark.sql import functions as F

from geoquarry.operators import indexing as I, listing as L, shards as P


@pytest.fixture(autouse=True)
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """A county of 40 shards of 10 parcels, numbers 3 and 7 without an id; another one with a flat list."""
    path = str(tmp_path_factory.mktemp("shards") / "files")
    rows = [(k // 10, None if k // 10 in (3, 7) else f"c{k // 10}", f"n{k % 200}", f"{k:05d}", None if k % 11 == 5 else f"cid{k}", k) for k in range(400)]
    entries = spark.createDataFrame(rows, "shardIndex int, shardCid string, propertyId string, parcelIdentifier string, cid string, fileSizeBytes long")
    P.write_files(entries, path)
    index = entries.groupBy(F.col("shardIndex").alias("shard_index"), F.col("shardCid").alias("shard_cid")).agg(F.min("parcelIdentifier").alias("from_parcel"), F.max("parcelIdentifier").alias("to_parcel"), F.count("*").alias("count")).withColumn("county", F.lit("Lee"))
    flat = spark.createDataFrame([("Collier", 0, "a", "1", "first"), ("Collier", 1, "a", "1", "second"), ("Collier", 2, "b", "2", None)], "county string, position int, propertyId string, parcelIdentifier string, cid string")
    return path, index, flat


def opened(df):
    """Files that a plan reads, as its scans report after the run."""
    return df.select("shardCid").distinct().count()


def test_only_named_files_are_opened(spark, published):
    path, index, _ = published
    wanted = spark.createDataFrame([("c1",), ("c5",), ("c1",), (None,), ("gone",)], "shardCid string")
    some = P.open_files(spark, path, wanted)
    assert opened(some) == 2 and some.count() == 20
    scan = [line for line in some._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert scan and all("c5" in line for line in scan)
    # beyond the bound the ids are met by a join, with the same rows
    more = P.open_files(spark, path, wanted, named=1)
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, some.collect()))
    assert P.open_files(spark, path).count() == 380
    page = P.page(spark, index, path, 25, 15)
    # shards 1 to 3; the last one is not published
    assert sorted(r.parcelIdentifier for r in page.collect()) == [f"{k:05d}" for k in range(15, 30)]


@pytest.mark.parametrize("named", [1000, 0])
def test_lookup(spark, published, named):
    path, index, flat = published
    asked = [
        (1, "lee", "00012", None, "cid12", None), (2, None, "00012", None, "cid12", None), (3, "lee", "00035", None, None, "not found in the index"),
        (4, "lee", "00999", None, None, "not found in the index"), (5, "lee", "00005", None, None, "not found in the index"), (6, "lee", None, "n12", "cid12", None),
        # in the first shard the entry has no content id (5), in the later one it has (205)
        (7, "lee", None, "n5", "cid205", None), (8, "lee", None, "nope", None, "not found in the index"), (9, "LEE ", "00012", "n12", None, "exactly one key is needed"),
        (10, "lee", None, None, None, "exactly one key is needed"), (11, "collier", "1", None, "first", None), (12, "Collier", None, "b", None, "not found in the manifest"), (13, "orange", "1", None, None, "county not served"),
    ]
    requests = spark.createDataFrame([r[:4] for r in asked], "request_id int, county string, parcel string, property string")
    got = {r.request_id: (r.cid, r.error) for r in P.lookup(requests, index, path, flat, "lee", named).collect()}
    assert got == {r[0]: r[4:] for r in asked}


def test_ranges_over_many_partitions(spark):
    """A hot key is spread; ranges are carried over partition borders; overlaps end at the next start."""
    keys = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 == 0, "0500").when(F.col("id") % 11 == 4, None).otherwise(F.format_string("%04d", "id")).alias("parcel"))
    shards = spark.createDataFrame([("0000", "0099", 1), ("0100", "2500", 2), ("0300", "0400", 3), ("2700", "2800", 4), (None, None, 5)], "from_parcel string, to_parcel string, shard_index int")
    out = L.shard_of(keys, shards, "parcel")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")

    def want(p):
        return None if p is None else 1 if p < "0100" else 2 if p < "0300" else (3 if p <= "0400" else None) if p < "2700" else 4 if p <= "2800" else None

    rows = out.collect()
    assert len(rows) == 3000 and all(r.shard_index == want(r.parcel) for r in rows)
    assert L.shard_of(keys, shards.limit(0), "parcel").where("shard_index is null").count() == 3000 and L.shard_of(keys.limit(0), shards, "parcel").count() == 0


def test_planner_rules(spark):
    syncs = spark.createDataFrame([("clone", "h", True, False), ("rescan", "h", False, True), ("changed", "h", False, False), ("commit", "h", False, None), ("same", "h", None, False), ("new", "h", False, False), ("failed", "h", True, False), ("docs", "h", False, False)], "repo string, head string, new_clone boolean, full_rescan boolean")
    states = spark.createDataFrame([("rescan", "h"), ("changed", "old"), ("commit", "old"), ("same", "h"), ("failed", "old"), ("docs", "h")], "repo string, commit string")
    listed = spark.createDataFrame([(r.repo, f) for r in syncs.collect() for f in (f"{r.repo}/a.ts", f"{r.repo}/b.js", f"{r.repo}/c.md", f"{r.repo}/.git/d.ts")], "repo string, file_path string")
    changed = spark.createDataFrame([("changed", "changed/b.js"), ("changed", "changed/gone.ts"), ("docs", "docs/c.md")], "repo string, file_path string")
    ruled = I.rules(syncs, changed, states)
    targets = I.plan(ruled, changed, listed)
    got = {}
    for r in targets.collect():
        got.setdefault(r.repo, set()).add((r.rule, r.file_path.split("/")[1]))
    both = {"a.ts", "b.js"}
    assert got == {**{r: {(r, f) for f in both} for r in ("clone", "rescan", "commit")}, "changed": {("changed", "b.js"), ("changed", "gone.ts")}, "new": {("commit", f) for f in both}, "failed": {("clone", f) for f in both}}

    def parse(path, content):
        if path.startswith("failed"):
            raise RuntimeError("no parser")
        return [(f"{path}#{k}", code) for k, code in enumerate(content.split(";"))]

    files = listed.withColumn("content", F.lit("x; ;y")).unionByName(spark.createDataFrame([("changed", "changed/gone.ts", None)], "repo string, file_path string, content string"))
    extracted = I.extract(files.join(targets, ["repo", "file_path"], "left_semi"), parse)
    saved = I.inserts(extracted)
    index = spark.createDataFrame([(r, f"{r}/{f}", 0, "old", "old") for r in ("clone", "changed", "same", "failed") for f in ("a.ts", "b.js")] + [("changed", "changed/gone.ts", 0, "old", "old")], "repo string, file_path string, position int, name string, code string")
    rows = {r.repo: tuple(r)[1:] for r in I.outcome(syncs, ruled, targets, index, extracted, saved, states).collect()}
    assert rows == {
        "clone": ("clone", 2, 2, 4, 0, "h"), "rescan": ("rescan", 2, 0, 4, 0, "h"), "changed": ("changed", 2, 2, 2, 1, "h"), "commit": ("commit", 2, 0, 4, 0, "h"),
        # nothing was saved: the state stays
        "same": ("none", 0, 0, 0, 0, "h"), "new": ("commit", 2, 0, 4, 0, "h"), "failed": ("clone", 2, 2, 0, 2, "old"), "docs": ("none", 0, 0, 0, 0, "h"),
    }
    left = {(r.file_path, r.name) for r in I.apply(index, targets, saved).collect()}
    assert ("changed/a.ts", "old") in left and ("changed/gone.ts", "old") not in left and ("failed/a.ts", "old") not in left and ("clone/a.ts", "clone/a.ts#2") in left


def test_functions_before_an_error_are_saved(spark):
    rows = [("r", "f", 0, "a", "x", None), ("r", "f", 1, None, None, "embedding failed"), ("r", "f", 2, "c", "z", None), ("r", "g", 0, "d", None, None)]
    assert [r.name for r in I.inserts(spark.createDataFrame(rows, I.EXTRACTED)).collect()] == ["a"]
