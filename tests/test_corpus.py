"""Scans and batch searches whose files and rows must not grow with a group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoquarry.operators import corpus as K
from geoquarry.plans import corpus as P


def test_scanned_files_are_bounded(spark, tmp_path, monkeypatch):
    rows = [(i, "one\ntwo" if i % 3 else "", "large" if i % 10 else "small") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    scan, lines = K.scan, []

    def seen(*args):
        found = scan(*args)
        lines.extend(r.n for r in found.selectExpr("length(code) - length(replace(code, '\n', '')) as n").collect())
        return found

    monkeypatch.setattr(K, "scan", seen)
    got = {r.source: (r.n, r.chars) for r in P.QUERIES["corpus_scan"](spark, str(tmp_path)).collect()}
    assert got == {s: (sum(x[2] == s for x in rows), sum(len(x[1]) for x in rows if x[2] == s)) for s in ("large", "small")}
    assert sum(lines) == 2000 and max(lines) <= 256


def test_batches_of_any_size(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i // 3, i % 3, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(600)]
    chunks = spark.createDataFrame(rows, "function_id long, chunk_index int, vector array<double>").repartition(3)
    queries = chunks.select((F.col("function_id") * 3 + F.col("chunk_index")).alias("query_id"), F.col("vector").alias("query")).where("query_id % 4 = 0")

    def distance(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / n, 12) if n else math.inf

    want = {(q, p + 1): (f, c) for q in range(0, 600, 4) for p, (_, f, c) in enumerate(sorted((distance(rows[q][2], v), f, c) for f, c, v in rows)[:5])}
    for limit, cells in ((100_000, 1 << 22), (40, 1000)):
        monkeypatch.setattr(K, "BROADCAST_QUERIES", limit)
        monkeypatch.setattr(K, "CELLS", cells)
        assert {(r.query_id, r.place): (r.function_id, r.chunk_index) for r in K.nearest_batch(chunks, queries, 5).collect()} == want


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    functions = spark.createDataFrame([(1, "a", "x = 1", "f.ts"), (2, "b", " ", "f.ts")], "id long, name string, code string, file_path string")
    chunks = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], "function_id long, chunk_index int, vector array<double>")
    first = K.write(functions, chunks, str(tmp_path), 2)
    assert [r.id for r in K.read(spark, str(tmp_path))[0].collect()] == [1]
    # a second version whose chunks and entry are missing
    functions.write.parquet(f"{tmp_path}/half/functions")
    assert [r.function_id for r in K.read(spark, str(tmp_path))[1].collect()] == [1]
    second = K.write(functions.withColumn("id", F.col("id") + 10), chunks.withColumn("function_id", F.col("function_id") + 10), str(tmp_path), 2)
    assert first != second and [r.id for r in K.read(spark, str(tmp_path))[0].collect()] == [11]


def test_properties_are_found_in_nested_combinators(spark):
    from geoquarry.operators import schemas as J

    deep = '{"anyOf": [{"allOf": [{"oneOf": [{"properties": {"Area": {"deprecated": true, "enum": ["a", "b"]}}}]}]}], "properties": {"x": {}}}'
    both = '{"oneOf": [{"properties": {"AREA": {"enum": ["late"]}}, "allOf": [{"properties": {"area": {"enum": ["later"]}}}]}], "properties": {"area": {"enum": ["own"]}}}'
    docs = spark.createDataFrame([("1", deep), ("2", both), ("3", "{}"), ("4", None)], "cid string, schema string")
    got = {r.cid: (r.property, r.deprecated, r.enum) for r in J.property_schema(docs, " area ").collect()}
    assert got == {"1": ("Area", True, "a,b"), "2": ("area", False, "own")}


def test_property_answers(spark):
    from geoquarry.operators import schemas as J

    def wrap(inner, depth):
        for k in range(depth):
            c = ("oneOf", "allOf", "anyOf")[k % 3]
            inner = '{"%s": [{"properties": {"x%d": {}}}, %s]}' % (c, k, inner)
        return inner

    area = '{"properties": {"Area ": {"enum": ["a", "b", 3], "deprecated_enum_values": %s}}}'
    docs = [("deep", wrap(area % '["b"]', 12)), ("keys", area % '{"a": "old", "3": 1}'), ("old", wrap('{"properties": {"area": {"deprecated": true, "enum": ["a"]}}}', 3)), ("none", "{}"), ("null", None), ("broken", "{"), ("plain", '{"properties": {"area": {"description": "d"}}, "oneOf": {"not": "a list"}}')]
    # depth first: the later member of the first combinator wins over the first member of a later one
    docs.append(("order", '{"anyOf": [{"properties": {"area": {"enum": ["z"]}}}], "oneOf": [{"properties": {"x": {}}}, {"allOf": [{"properties": {"area": {"enum": ["y"]}}}]}]}'))
    df = spark.createDataFrame(docs, "cid string, schema string")
    got = {r.cid: (r.enum, r.error) for r in J.property_answer(df, " AREA").collect()}
    assert got == {"deep": ("a,3", None), "keys": ("b", None), "old": (None, "deprecated"), "none": (None, "not found"), "null": (None, "not found"), "broken": (None, "not found"), "plain": (None, None), "order": ("y", None)}
    kinds = spark.createDataFrame([("1", '{"properties": {"property_type": {"enum": ["old"]}}}'), ("2", '{"properties": {"Property_Type": {"enum": ["own"]}}}')], "cid string, schema string")
    assert {r.cid: r.enum for r in J.property_answer(kinds, "property_type").collect()} == {"1": "LandParcel,Building,Unit,ManufacturedHome", "2": "own"}
    assert J.walk(df.limit(0)).count() == 0


def test_two_writers_on_one_version(spark, tmp_path):
    path = str(tmp_path)
    chunks = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(4)], "function_id long, chunk_index int, vector array<double>")
    functions = spark.createDataFrame([(i, "n", "c", "f") for i in range(4)], "id long, name string, code string, file_path string")
    assert K.head(spark, path) == (0, None)
    first = K.write(functions, chunks, path, 2)
    parent, name = K.head(spark, path)
    assert (parent, name) == (1, first)
    before = K.read(spark, path)
    # two writers build on the first version; the second to commit is refused and readers see the other's rows alone
    second = K.write(functions.where("id > 0"), chunks, path, 2, parent)
    with pytest.raises(K.Conflict):
        K.write(functions.where("id > 1"), chunks, path, 2, parent)
    assert K.head(spark, path) == (2, second)
    assert sorted(r.id for r in K.read(spark, path)[0].collect()) == [1, 2, 3] and sorted(r.function_id for r in K.read(spark, path)[1].collect()) == [1, 2, 3]
    K.delete_version(spark, path, functions.where("id = 3").select("id"), 2)
    assert sorted(r.function_id for r in K.read(spark, path)[1].collect()) == [1, 2] and K.head(spark, path)[0] == 3
    # who reads an earlier version keeps it
    assert before[0].count() == 4 and K.read(spark, path, second)[0].count() == 3
