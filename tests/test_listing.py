"""SQL guard, listing, catalog and corpus operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry import catalogue
from geoquarry.operators import corpus as K, listing as L, sqlguard as G
from geoquarry.sources.views import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["SELECT 1", "with a as (select 1) select * from a;", "SELECT 'drop table x' AS y", 'SELECT "update" FROM t', "SELECT 1 -- delete\n", "SELECT regexp_replace(a, 'b', 'c') FROM t", "SELECT /* insert */ `set` FROM t", "SELECT 'it''s; fine'", r"SELECT 'a\'; drop'"])
def test_accepted(spark, query):
    G.validate(spark, query)


@pytest.mark.parametrize("query", ["", "DROP TABLE x", "SELECT 1; SELECT 2", "(SELECT 1)", "SELECT replace(a, 'b', 'c') FROM t", "WITH a AS (SELECT 1) INSERT INTO b SELECT 1", "SELECT 'open", "SELECT 1 /* open", "SELECT reflect('a', 'b')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM `parquet`.`/etc`", "explain select 1"])
def test_refused(spark, query):
    with pytest.raises(G.QueryRejected):
        G.validate(spark, query)


_CALL = "reflect('java.lang.System', 'getProperty', 'user.home')"


@pytest.mark.parametrize(
    "query",
    [
        rf"SELECT r'\', {_CALL} AS x -- '", rf'SELECT R"\", {_CALL} AS x -- "', f"SELECT * FROM many WHERE id IN (SELECT {_CALL} FROM many)", f"WITH a AS (SELECT {_CALL} AS x) SELECT * FROM a", f"SELECT system.builtin.{_CALL}", f"SELECT (SELECT (SELECT {_CALL}))",
        "SELECT try_reflect('java.lang.System', 'exit', 1)", "SELECT * FROM many WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)", "WITH a AS (SELECT * FROM json.`/etc/passwd`) SELECT * FROM a", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "/* a /* b */ DROP TABLE t */ DROP TABLE t",
        "FROM many INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *", "WITH a AS (SELECT 1) FROM a INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *", "SELECT TRANSFORM(id) USING 'cat' FROM many", "SELECT * FROM other.many", "SELECT * FROM read_files('/etc')",
    ],
)
def test_ways_around_the_guard(spark, query):
    spark.range(20).createOrReplaceTempView("many")
    with pytest.raises(G.QueryRejected):
        G.run(spark, query)


def test_queries_of_every_make_run(spark):
    spark.range(20).createOrReplaceTempView("many")
    for query in (
        "WITH a AS (SELECT * FROM many) SELECT count(*) FILTER (WHERE id > 1) AS n FROM a GROUP BY id % 2 HAVING count(*) > 0 ORDER BY 1 LIMIT 3;", "SELECT id FROM many WHERE id IN (SELECT id FROM many) AND EXISTS (SELECT 1 FROM many) UNION ALL SELECT 1",
        "SELECT rank() OVER w AS r FROM many WINDOW w AS (ORDER BY id)", "SELECT * FROM (VALUES (1, 2)) AS v(a, b)", "SELECT a.id FROM many a JOIN many b ON a.id = b.id WHERE a.id > (SELECT avg(id) FROM many)", "SELECT id FROM many LATERAL VIEW explode(array(1, 2)) x AS y",
        "SELECT DISTINCT id FROM many EXCEPT SELECT 1", r"SELECT 'it\'s', r'\' AS b FROM many",
    ):
        assert G.run(spark, query).count() > 0, query


def test_cap(spark):
    spark.range(2000).createOrReplaceTempView("many")
    assert G.run(spark, "SELECT * FROM many", 5000).count() == 1000
    assert G.run(spark, "SELECT * FROM many", -3).count() == 1
    assert G.run(spark, "SELECT * FROM many").count() == 100


def test_page_slices(spark):
    shards = spark.createDataFrame([(0, 10, "a"), (1, 5, None), (2, 10, "c")], "shard_index int, count long, shard_cid string")
    assert [tuple(r) for r in L.page_slices(shards, 12, 8).orderBy("shard_index").collect()] == [(0, 8, 10), (2, 0, 5)]
    assert L.page_slices(shards, 5, 100).count() == 0


def test_lookup_errors(spark):
    props = spark.createDataFrame([("p1", "1", "c1"), ("p2", "2", None)], "property_id string, parcel_identifier string, cid string")
    keys = spark.createDataFrame([(1, "1", None, None), (2, "2", None, None), (3, "9", None, None), (4, None, None, None), (5, "1", "p1", None), (6, None, None, "c1")], "request_id int, parcel string, property string, key_cid string")
    got = {r.request_id: (r.cid, r.error) for r in L.lookup(keys, props).collect()}
    assert got == {1: ("c1", None), 2: (None, "no content id"), 3: (None, "not found"), 4: (None, "exactly one key is needed"), 5: (None, "exactly one key is needed"), 6: ("c1", None)}


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "w " * 9000), (2, "  "), (3, None), (4, "one two")], "id int, text string")
    got = K.chunks(docs, "text").collect()
    assert [(r.id, r.chunk_index, len(r.chunk.split())) for r in sorted(got)] == [(1, 0, 4500), (1, 1, 4500), (4, 0, 2)]


def test_embedder_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    assert K.embed_batches(df, "text", lambda t: np.ones((len(t), 3)), 3).count() == 2
    with pytest.raises(Exception, match="embedder gave"):
        K.embed_batches(df, "text", lambda t: np.ones((len(t), 2)), 3).count()
    with pytest.raises(Exception, match="blank"):
        K.embed_batches(df.select(F.lit(" ").alias("text")), "text", lambda t: np.ones((len(t), 3)), 3).count()


def test_nearest(spark):
    vectors = [(k, 0, [((i + s) % 100) / 100 for i in range(32)]) for k, s in enumerate((0, 25, 50))]
    chunks = spark.createDataFrame(vectors, "function_id long, chunk_index int, vector array<double>")
    functions = spark.createDataFrame([(k, f"f{k}") for k in range(3)], "id long, name string")
    assert K.nearest(chunks, functions, vectors[0][2], 1).first().name == "f0"
    assert K.nearest(chunks, functions, vectors[0][2], 500).count() == 3
    batch = K.nearest_batch(chunks, chunks.select(F.col("function_id").alias("query_id"), F.col("vector").alias("query")), 1).collect()
    assert {(r.query_id, r.function_id) for r in batch} == {(0, 0), (1, 1), (2, 2)}


def test_views(spark):
    for name in ("places", "properties", "permits"):
        assert view(spark, SF, name).limit(1).count() == 1


def test_every_oracle_names_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_the_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_shards_in_one_partition_and_over_several(spark):
    shards = spark.createDataFrame([("0010", "0019", 1), ("0030", "0039", 3), ("é", "é9", 7), ("0020", "0020", 2)], "from_parcel string, to_parcel string, shard_index int")
    keys = spark.createDataFrame([(k,) for k in ("0005", "0010", "0019", "00195", "0020", "0029", "0039", "é", "é5", "ê", "", None, "0030")], "parcel string")
    want = {"0005": None, "0010": 1, "0019": 1, "00195": None, "0020": 2, "0029": None, "0039": 3, "é": 7, "é5": 7, "ê": None, "": None, None: None, "0030": 3}
    assert {r.parcel: r.shard_index for r in L.shard_of(keys, shards, "parcel").collect()} == want
    assert {r.shard_index for r in L.shard_of(keys, shards.limit(0), "parcel").collect()} == {None}
    # ranges are carried over from one partition to the next
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.parcel: r.shard_index for r in L.shard_of(keys, shards, "parcel").collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
