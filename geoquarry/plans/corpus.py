"""Corpus, vector and schema-catalog queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.operators import corpus as K, schemas as J
from geoquarry.sources.scratch import scratch

#: Texts in one file of a scanned folder; a file is read as one string, so it must not grow with its source.
BUNDLE = 256
QUERIES, ORACLES = {}, {}


def _add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _functions(s, sf):
    """Documents as functions; every eleventh has no name."""
    return _table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 3, F.concat(F.lit("fn_"), F.col("doc_id").cast("string"))).alias("name"), F.col("text").alias("code"), F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts")).alias("file_path"))


def _chunks(s, sf):
    """Embeddings as chunks, three for each function id; every thirteenth vector is short."""
    v = F.col("embedding").cast("array<double>")
    return _table(s, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("function_id"), (F.col("vec_id") % 3).cast("int").alias("chunk_index"), F.when(F.col("vec_id") % 13 == 7, F.slice(v, 1, 5)).otherwise(v).alias("vector"))


_FUNCTIONS = "functions AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 3 THEN 'fn_' || doc_id END AS name, text AS code, source || '/' || doc_id % 50 || '.ts' AS file_path FROM documents)"
_CHUNKS = "chunks AS (SELECT vec_id // 3 AS function_id, (vec_id % 3)::INT AS chunk_index, CASE WHEN vec_id % 13 = 7 THEN embedding[1:5] ELSE embedding END::DOUBLE[] AS vector, vec_id FROM embeddings)"


def _corpus_scan(s, sf):
    """Texts written to files of at most BUNDLE lines below the folder of their source, scanned again."""
    path = scratch(s, "corpus")
    docs = _table(s, sf, "documents").select(F.col("source"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    docs.write.option("maxRecordsPerFile", BUNDLE).partitionBy("source").text(path)
    found = K.scan(s, path, ("txt",))
    return found.select(F.explode(F.split(F.regexp_replace("code", "\n\\z", ""), "\n")).alias("line"), F.regexp_extract("file_path", "source=([^/]+)/", 1).alias("source")).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


_add("corpus_scan", _corpus_scan, r"SELECT source, count(*) AS n, sum(length(regexp_replace(text, '[\r\n]+', ' ', 'g')))::BIGINT AS chars FROM documents GROUP BY 1")
_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents)"
_add(
    "chunk_documents", lambda s, sf: K.chunks(_table(s, sf, "documents").select("doc_id", "text"), "text", 256).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("chunk")),
    f"WITH {_WORDS}, n AS (SELECT *, CASE WHEN len(w) <= 256 THEN 1 ELSE (2 ** ceil(log2(len(w) / 256)))::INT END AS n FROM w WHERE len(w) > 0), k AS (SELECT *, ceil(len(w) / n)::INT AS k FROM n), e AS (SELECT doc_id, w, k, unnest(range(n)) AS i FROM k) SELECT doc_id, i AS chunk_index, md5(array_to_string(w[i * k + 1:(i + 1) * k], ' ')) AS chunk FROM e WHERE i * k < len(w)",
)


def _letter_embedder(texts: list[str]) -> np.ndarray:
    """A stand-in embedder: shares of the letters a-h and a constant."""
    return np.array([[t.count(c) / len(t) for c in "abcdefgh"] + [1.0] for t in texts])


_add(
    "embed_batches", lambda s, sf: K.embed_batches(K.chunks(_table(s, sf, "documents").select("doc_id", "text"), "text", 256), "chunk", _letter_embedder, 9).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round(F.get("vector", 0), 6).alias("a"), F.round(F.get("vector", 4), 6).alias("e")),
    f"WITH {_WORDS}, n AS (SELECT *, CASE WHEN len(w) <= 256 THEN 1 ELSE (2 ** ceil(log2(len(w) / 256)))::INT END AS n FROM w WHERE len(w) > 0), k AS (SELECT *, ceil(len(w) / n)::INT AS k FROM n), e AS (SELECT doc_id, w, k, unnest(range(n)) AS i FROM k), c AS (SELECT doc_id, i, array_to_string(w[i * k + 1:(i + 1) * k], ' ') AS t FROM e WHERE i * k < len(w)) SELECT doc_id, i AS chunk_index, round((length(t) - length(replace(t, 'a', ''))) / length(t), 6) AS a, round((length(t) - length(replace(t, 'e', ''))) / length(t), 6) AS e FROM c",
)


def _written(s, sf):
    path = scratch(s, "index")
    K.write(_functions(s, sf), _chunks(s, sf), path, 64)
    return K.read(s, path)


_GOOD = f"{_FUNCTIONS}, {_CHUNKS}, fit AS (SELECT function_id FROM chunks GROUP BY 1 HAVING count(*) = count(*) FILTER (len(vector) = 64)), good AS (SELECT * FROM functions WHERE name IS NOT NULL AND trim(coalesce(code, '')) <> '' AND id IN (SELECT function_id FROM fit))"
_add("corpus_write", lambda s, sf: (lambda w: w[1].groupBy("function_id").agg(F.count("*").alias("n")))(_written(s, sf)), f"WITH {_GOOD} SELECT function_id, count(*) AS n FROM chunks WHERE function_id IN (SELECT id FROM good) GROUP BY 1")
_add("corpus_by_file", lambda s, sf: (lambda w: K.by_file(*w).where("file_path like 'src1/%'").select("id", "file_path", F.size("vectors").alias("n"), F.round(F.get(F.get("vectors", 0), 0), 6).alias("first")))(_written(s, sf)), f"WITH {_GOOD} SELECT id, file_path, count(*)::INT AS n, round(arg_min(vector[1], chunk_index), 6) AS first FROM good JOIN chunks ON function_id = id WHERE file_path LIKE 'src1/%' GROUP BY 1, 2")
_add("corpus_delete", lambda s, sf: (lambda t: t[1].groupBy("function_id").agg(F.count("*").alias("n")))(K.delete(_functions(s, sf), _chunks(s, sf), _functions(s, sf).where("id % 5 = 0").select("id"))), f"WITH {_CHUNKS} SELECT function_id, count(*) AS n FROM chunks WHERE function_id % 5 <> 0 OR function_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1")



def _versions(s, sf):
    """A first version, and one on top of it without every fifth function; the last is read."""
    path = scratch(s, "index")
    K.write(_functions(s, sf), _chunks(s, sf), path, 64)
    K.delete_version(s, path, _functions(s, sf).where("id % 5 = 0").select("id"), 64)
    return K.read(s, path)


_add("corpus_versions", lambda s, sf: _versions(s, sf)[1].groupBy("function_id").agg(F.count("*").alias("n")), f"WITH {_GOOD} SELECT function_id, count(*) AS n FROM chunks WHERE function_id IN (SELECT id FROM good WHERE id % 5 <> 0) GROUP BY 1")
_add("vector_width_check", lambda s, sf: K.width_check(_chunks(s, sf), 64), f"WITH {_CHUNKS} SELECT count(*) AS n, count(*) FILTER (len(vector) <> 64) AS wrong, count(*) FILTER (len(vector) <> 64) > 0 AS rebuild FROM chunks")
_add(
    "incremental_index",
    lambda s, sf: K.incremental(_functions(s, sf).where("id % 9 <> 4"), _functions(s, sf).withColumn("code", F.when(F.col("id") % 17 == 2, F.lit("  ")).otherwise(F.concat(F.lit("// "), "code"))), _functions(s, sf).where("id % 50 in (3, 7, 12)").select("file_path").distinct()).select("id", "file_path", F.md5("code").alias("code"), "error"),
    f"WITH {_FUNCTIONS}, ch AS (SELECT DISTINCT file_path FROM functions WHERE id % 50 IN (3, 7, 12)) SELECT id, file_path, md5(code) AS code, NULL AS error FROM functions WHERE id % 9 <> 4 AND file_path NOT IN (FROM ch) UNION ALL SELECT id, file_path, md5(CASE WHEN id % 17 = 2 THEN '  ' ELSE '// ' || code END), CASE WHEN id % 17 = 2 OR trim('// ' || code) = '' THEN 'no code' END FROM functions WHERE file_path IN (FROM ch)",
)
_add("index_state", lambda s, sf: K.index_state(_table(s, sf, "events").select(F.col("event_type").alias("repo"), F.col("event_id").cast("string").alias("commit"), F.struct("ts", "event_id").alias("updated_at"))).select("repo", "commit"), "SELECT event_type AS repo, arg_max(event_id::VARCHAR, struct_pack(ts := ts, id := event_id)) AS commit FROM events GROUP BY 1")
_QUERY = [((i * 7) % 13 - 6) / 10 for i in range(64)]
_DIST = "1 - list_cosine_similarity(vector, {q})"
_FULL = f"{_CHUNKS}, fullc AS (SELECT * FROM chunks WHERE len(vector) = 64)"
_add("vector_topk", lambda s, sf: K.nearest(_chunks(s, sf).where("size(vector) = 64"), _functions(s, sf), _QUERY, 20).select("function_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("distance", 6).alias("distance"), "name"), f"WITH {_FULL}, {_FUNCTIONS}, t AS (SELECT *, {_DIST.format(q=f'{_QUERY}::DOUBLE[]')} AS distance FROM fullc ORDER BY distance, function_id, chunk_index LIMIT 20) SELECT function_id, chunk_index, round(distance, 6) AS distance, name FROM t JOIN functions ON id = function_id")
_add("vector_topk_batch", lambda s, sf: K.nearest_batch(_chunks(s, sf).where("size(vector) = 64"), _chunks(s, sf).where("size(vector) = 64 and (function_id * 3 + chunk_index) % 100 = 0").select((F.col("function_id") * 3 + F.col("chunk_index")).alias("query_id"), F.col("vector").alias("query")), 5).select("query_id", "place", F.round("distance", 6).alias("distance")), f"WITH {_FULL}, d AS (SELECT q.vec_id AS query_id, c.function_id, c.chunk_index, 1 - list_cosine_similarity(c.vector, q.vector) AS distance FROM fullc q, fullc c WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, function_id, chunk_index) AS place FROM d) SELECT query_id, place, round(distance, 6) AS distance FROM r WHERE place <= 5")

# -- schema catalog ----------------------------------------------------------------------------------------------------

_KEY = "CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_has_') WHEN p_partkey % 7 = 1 THEN replace(p_name, ' ', '_to_') || '_to_x' WHEN p_partkey % 7 = 2 THEN 'fact_sheet_to_' || split_part(p_name, ' ', 2) WHEN p_partkey % 7 = 3 THEN upper(split_part(p_name, ' ', 1)) ELSE p_name END"
_TYPE = "CASE WHEN p_partkey % 7 < 3 THEN 'relationship' WHEN p_partkey % 7 = 3 THEN 'class' ELSE 'dataGroup' END"


def _manifest(s, sf):
    """Parts as manifests of names, one for each brand, as JSON text."""
    entries = _table(s, sf, "part").selectExpr("p_brand", f"{_KEY} AS name", f"{_TYPE} AS type").distinct()
    entries = entries.groupBy("p_brand", "name").agg(F.min("type").alias("type"))
    docs = entries.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.concat(F.lit("cid-"), F.lower("name")).alias("ipfsCid"), "type"))))).alias("doc"))
    return J.manifest_rows(docs, "doc").distinct()


_MANIFEST = f"m AS (SELECT DISTINCT name, 'cid-' || lower(name) AS cid, type FROM (SELECT p_brand, {_KEY} AS name, min({_TYPE}) AS type FROM part GROUP BY 1, 2))"
_add("schema_manifest_scan", _manifest, f"WITH {_MANIFEST} SELECT * FROM m")
_SPLIT = "CASE WHEN instr(name, '_has_') > 0 THEN string_split(name, '_has_')[1:2] WHEN instr(name, '_to_') > 0 THEN string_split(name, '_to_')[1:2] END"
_add("relation_classes", lambda s, sf: _manifest(s, sf).select("name", F.array_join(J.relation_classes("name"), ",").alias("classes")), f"WITH {_MANIFEST} SELECT name, array_to_string({_SPLIT}, ',') AS classes FROM m")


def _schemas(s, sf):
    """A JSON schema for each class word, its properties drawn from the parts that carry it."""
    part = _table(s, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "p_type", "p_partkey", "p_size").groupBy("word", F.lower("p_type").alias("property")).agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("size"))
    info = F.struct(F.when(F.col("k") % 3 != 0, F.concat(F.lit("about "), "property")).otherwise(F.lit("")).alias("description"), (F.col("k") % 5 == 1).alias("deprecated"), F.array(F.lit("x"), F.col("size").cast("string")).alias("enum"))
    node = lambda c: F.map_from_entries(F.collect_list(F.when(c, F.struct("property", info.alias("p")))))
    other = F.map_from_entries(F.collect_list(F.struct("property", F.struct(F.lit("from a combinator").alias("description")).alias("p"))))
    body = part.groupBy("word").agg(node(F.col("k") % 2 == 0).alias("properties"), F.array(F.struct(other.alias("properties"))).alias("anyOf"))
    return body.select(F.concat(F.lit("cid-"), "word").alias("cid"), F.to_json(F.struct(F.when(F.length("word") % 2 == 0, F.concat(F.lit("The "), "word")).alias("title"), "properties", "anyOf")).alias("schema"))


_PARTS = "q AS (SELECT split_part(p_name, ' ', 1) AS word, lower(p_type) AS property, min(p_partkey) AS k, min(p_size) AS size FROM part GROUP BY 1, 2), words AS (SELECT DISTINCT word FROM q)"
_add(
    "list_classes", lambda s, sf: J.classes(_manifest(s, sf), _schemas(s, sf)),
    f"WITH {_MANIFEST}, {_PARTS}, c AS (SELECT DISTINCT lower(trim(unnest({_SPLIT}))) AS class FROM m WHERE type = 'relationship'), e AS (SELECT lower(trim(name)) AS class, cid FROM m WHERE type = 'class') SELECT c.class, cid, coalesce(CASE WHEN length(word) % 2 = 0 THEN 'The ' || word END, c.class) AS display FROM c JOIN e USING (class) LEFT JOIN words ON 'cid-' || word = cid WHERE c.class NOT IN ('fact_sheet', 'factsheet')",
)
_add(
    "list_schema_properties", lambda s, sf: J.properties(_schemas(s, sf)).select("cid", "property", "description"),
    f"WITH {_PARTS} SELECT 'cid-' || word AS cid, property, CASE WHEN k % 2 = 0 AND k % 5 <> 1 AND k % 3 <> 0 THEN 'about ' || property ELSE 'from a combinator' END AS description FROM q",
)
_add(
    "get_property_schema", lambda s, sf: J.property_schema(_deep(_schemas(s, sf)), " Economy "),
    f"WITH {_PARTS} SELECT 'cid-' || word AS cid, property, CASE WHEN k % 2 = 0 THEN k % 5 = 1 ELSE false END AS deprecated, CASE WHEN k % 2 = 0 THEN 'x,' || size END AS enum FROM q WHERE property = 'economy'",
)
_add(
    "property_answer", lambda s, sf: J.property_answer(_deep(_schemas(s, sf)), "economy"),
    f"WITH {_PARTS}, h AS (SELECT * FROM words LEFT JOIN (SELECT * FROM q WHERE property = 'economy') USING (word)), e AS (SELECT *, CASE WHEN property IS NULL THEN 'not found' WHEN k % 2 = 0 AND k % 5 = 1 THEN 'deprecated' END AS error FROM h) "
    "SELECT 'cid-' || word AS cid, property, CASE WHEN error IS NULL AND k % 2 = 0 THEN 'x,' || size END AS enum, error FROM e",
)


def _deep(schemas: DataFrame) -> DataFrame:
    """Every third schema lies twelve combinators deep, each beside a member with other properties."""
    wrapped = F.concat(F.repeat(F.lit('{"allOf":[{"properties":{"other":{"deprecated":true}}},'), F.lit(12)), "schema", F.repeat(F.lit("]}"), F.lit(12)))
    return schemas.withColumn("schema", F.when(F.length("cid") % 3 == 1, wrapped).otherwise(F.col("schema")))


_add(
    "enum_filter",
    lambda s, sf: _enum(s, sf),
    "WITH v AS (SELECT DISTINCT p_brand, p_type FROM part), l AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 37 = 0), k AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 41 = 0) SELECT b.p_brand, coalesce(string_agg(v.p_type, ',' ORDER BY v.p_type) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.p_brand = v.p_brand AND l.p_type = v.p_type) AND NOT EXISTS (SELECT 1 FROM k WHERE k.p_brand = v.p_brand AND k.p_type = v.p_type)), '') AS \"values\" FROM (SELECT DISTINCT p_brand FROM v) b JOIN v USING (p_brand) GROUP BY 1",
)


def _enum(s, sf):
    """Types of each brand as an enumeration; a list and an object name deprecated ones."""
    rows = _table(s, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("v"), F.collect_set(F.when(F.col("p_partkey") % 37 == 0, F.col("p_type"))).alias("d"), F.collect_set(F.when(F.col("p_partkey") % 41 == 0, F.col("p_type"))).alias("k"))
    rows = rows.withColumn("m", F.map_from_arrays("k", F.transform("k", lambda x: F.lit("old"))))
    return rows.select("p_brand", F.array_join(J.enum_filter("v", "d", "m"), ",").alias("values"))
