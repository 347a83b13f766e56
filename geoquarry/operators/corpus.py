"""A corpus of texts: chunks, embeddings, incremental index, nearest chunks.

Tables: functions (id, name, code, file_path) and chunks (function_id, chunk_index, vector).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from geoquarry.functions.vectors import store_distance
from geoquarry.sources import log
from geoquarry.sources.scratch import scratch

MAX_TOKENS = 8192
MAX_K = 50
EXTENSIONS = ("js", "mjs", "cjs", "ts", "tsx")
#: Queries, and bytes of their vectors, that a batch search sends out at once, and distances that a task holds at once.
BROADCAST_QUERIES, QUERY_BYTES = 100_000, 32 << 20
CELLS = 1 << 22


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """file_path, code of the files below a folder with one of the extensions; folders named .git are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("code")).where(~F.col("file_path").contains("/.git/"))


def chunks(docs: DataFrame, text: str, limit: int = MAX_TOKENS, tokens: Column | None = None) -> DataFrame:
    """Equal chunks of at most ``limit`` tokens: the number doubles until they fit. Tokens default to words; blank chunks go."""
    words = tokens if tokens is not None else F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    sized = docs.withColumn("__w", words).where(F.size("__w") > 0)
    parts = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.size("__w") / float(limit)) - 1e-12), F.lit(0))).cast("int")
    # doubling stops at the first count whose chunks fit
    sized = sized.withColumn("__n", parts).withColumn("__k", F.ceil(F.size("__w") / F.col("__n")).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: i * F.col("__k") < F.size("__w"))
    pieces = F.transform(starts, lambda i: F.array_join(F.slice(F.col("__w"), i * F.col("__k") + 1, F.col("__k")), " "))
    own = [c for c in docs.columns if c != text]
    return sized.select(*own, F.posexplode(pieces).alias("chunk_index", "chunk")).where(F.trim("chunk") != "")


def embed_batches(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], width: int) -> DataFrame:
    """``vector`` for every row by batches of a pluggable embedder; blank texts and vectors of another width are errors."""
    from pyspark.sql.types import ArrayType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (batch[text].fillna("").str.strip() == "").any():
                raise ValueError("blank text")
            vectors = np.asarray(embed(batch[text].tolist()), dtype=float)
            if vectors.shape != (len(batch), width):
                raise ValueError(f"the embedder gave {vectors.shape}, not {(len(batch), width)}")
            yield batch.assign(vector=list(vectors))

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def valid_rows(functions: DataFrame, own_chunks: DataFrame, width: int) -> DataFrame:
    """Functions with name, code and path and at least one chunk, all of whose vectors have the width and numbers only."""
    fit = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & (F.size("vector") == width)
    per = own_chunks.groupBy("function_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(fit, F.lit(False))).alias("fit")).where("n = fit")
    named = functions.where("trim(coalesce(name, '')) <> '' and trim(coalesce(code, '')) <> '' and trim(coalesce(file_path, '')) <> ''")
    return named.join(per.select(F.col("function_id").alias("id")), "id", "left_semi")


class Conflict(Exception):
    """Another writer has put a version on top of the one that a commit builds on."""


def head(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and name of the last version below ``path``; (0, None) if there is none."""
    return log.head(spark, f"{path}/log")


def write(functions: DataFrame, own_chunks: DataFrame, path: str, width: int, parent: int | None = None) -> str:
    """Both tables as one new version below ``path``, on top of version number ``parent`` (the last one if none is given).

    The tables are written first; then the version takes the next number of the log, which only one writer can. A writer
    that comes too late gets ``Conflict`` and has changed nothing that readers see.
    """
    version, spark = uuid.uuid4().hex, functions.sparkSession
    parent = head(spark, path)[0] if parent is None else parent
    good = valid_rows(functions, own_chunks, width)
    good.write.parquet(f"{path}/{version}/functions")
    kept = spark.read.schema(good.schema).parquet(f"{path}/{version}/functions")
    own_chunks.join(kept.select(F.col("id").alias("function_id")), "function_id", "left_semi").write.parquet(f"{path}/{version}/chunks")
    if not log.append(spark, f"{path}/log", parent + 1, version):
        raise Conflict(f"version {parent + 1} is there already; read the last version and build on it")
    return version


def read(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Functions and chunks of one version, the last that was written whole if none is named; half-written ones are never seen."""
    version = version or head(spark, path)[1]
    return tuple(spark.read.parquet(f"{path}/{version}/{name}") for name in ("functions", "chunks"))


def delete_version(spark: SparkSession, path: str, ids: DataFrame, width: int) -> str:
    """A version without the functions ``ids`` (id) and their chunks, on top of the last one; the versions before keep theirs."""
    parent, version = head(spark, path)
    return write(*delete(*read(spark, path, version), ids), path, width, parent)


def width_check(own_chunks: DataFrame, width: int) -> DataFrame:
    """n, wrong: a wrong width calls for a rebuild."""
    return own_chunks.agg(F.count("*").alias("n"), F.count_if(F.size("vector") != width).alias("wrong")).withColumn("rebuild", F.col("wrong") > 0)


def by_file(functions: DataFrame, own_chunks: DataFrame) -> DataFrame:
    """Functions with their vectors in chunk order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "vector"))), lambda x: x["vector"])
    return functions.join(own_chunks.groupBy(F.col("function_id").alias("id")).agg(ordered.alias("vectors")), "id", "left")


def delete(functions: DataFrame, own_chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the functions ``ids`` (id)."""
    return functions.join(ids, "id", "left_anti"), own_chunks.join(ids.select(F.col("id").alias("function_id")), "function_id", "left_anti")


def incremental(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The next version: rows of unchanged files stay, rows of changed files come from ``new``; those without code carry an ``error``, and ``write`` leaves them out."""
    kept = old.join(changed, "file_path", "left_anti")
    fresh = new.join(changed, "file_path", "left_semi").withColumn("error", F.when(F.trim(F.coalesce("code", F.lit(""))) == "", "no code"))
    return kept.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)


def index_state(states: DataFrame) -> DataFrame:
    """The latest commit of each repository."""
    return states.groupBy("repo").agg(F.max_by("commit", "updated_at").alias("commit"), F.max("updated_at").alias("updated_at"))


def nearest(own_chunks: DataFrame, functions: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k chunks nearest to one vector, with their functions; a function may come more than once."""
    target = own_chunks.withColumn("__q", F.array(*(F.lit(float(x)) for x in query)))
    top = target.withColumn("distance", store_distance("vector", "__q")).orderBy(F.asc_nulls_last("distance"), "function_id", "chunk_index").limit(max(1, min(k, MAX_K)))
    return top.select("function_id", "chunk_index", "distance").join(functions.withColumnRenamed("id", "function_id"), "function_id")


def _sides(found: pa.Table) -> tuple[list, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids of queries, and for each width which of them have it, with their vectors as one matrix; values that are null are no numbers."""
    vectors = found["query"].combine_chunks()
    widths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    values, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
    sides = {}
    for width in np.unique(widths[widths > 0]).tolist():
        which = np.flatnonzero(widths == width)
        sides[width] = (which, values[starts[which][:, None] + np.arange(width)])
    return found["query_id"].to_pylist(), sides


def _k_best(shared: Broadcast, n: int, k: int, types: list[pa.DataType]) -> Callable:
    """For mapInArrow: the k nearest rows of a partition to each of the ``n`` queries, kept while the partition streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, sides = shared.value
        q, d, f, c = np.zeros(0, int), np.zeros(0), None, None
        worst = np.full(n, np.inf)
        step = max(1, CELLS // max(n, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own_f, own_c = (np.array(part.column(i).to_pylist()) for i in (0, 1))
                vectors = part.column(2).to_pylist()
                distance = np.full((n, part.num_rows), np.inf)
                for width, (which, side) in sides.items():
                    rows = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width], int)
                    if len(rows):
                        x = np.array([[np.nan if e is None else e for e in vectors[i]] for i in rows], float)
                        with np.errstate(all="ignore"):
                            found = 1 - side @ x.T / (np.sqrt((side * side).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1)))
                        distance[np.ix_(which, rows)] = np.where(np.isfinite(found), np.round(found, 12), np.inf)
                limit = np.minimum(worst, np.partition(distance, min(k, part.num_rows) - 1, axis=1)[:, min(k, part.num_rows) - 1]) if part.num_rows >= k else worst
                qi, ri = np.nonzero(distance <= limit[:, None])
                if not len(qi):
                    continue
                q, d = np.concatenate([q, qi]), np.concatenate([d, distance[qi, ri]])
                f, c = (own_f[ri], own_c[ri]) if f is None else (np.concatenate([f, own_f[ri]]), np.concatenate([c, own_c[ri]]))
                order = np.lexsort((c, f, d, q))
                q, d, f, c = q[order], d[order], f[order], c[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, d, f, c, place = (x[place < k] for x in (q, d, f, c, place))
                worst[q[place == k - 1]] = d[place == k - 1]
        if f is not None:
            ids = [queries[i] for i in q.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, d.tolist(), f.tolist(), c.tolist()), types, strict=True)], ["query_id", "distance", "function_id", "chunk_index"])

    return run


def nearest_batch(own_chunks: DataFrame, queries: DataFrame, k: int, query_bytes: int | None = None) -> DataFrame:
    """query_id, function_id, chunk_index, distance, place of the k nearest chunks of each query (query_id, query).

    Queries go out in blocks, one after another, as broadcast matrices of about BROADCAST_QUERIES rows and QUERY_BYTES at most. Each task keeps its own k best while its
    rows stream by, so what is held and moved is partitions x queries x k rows. Distances count to 12 digits; a pair
    without one (zero vectors, other widths, values that are no numbers) is infinitely far.
    """
    k, query_bytes = max(1, min(k, MAX_K)), query_bytes or QUERY_BYTES
    spark = own_chunks.sparkSession
    own, asked = own_chunks.select("function_id", "chunk_index", F.col("vector").cast("array<double>")), queries.select("query_id", F.col("query").cast("array<double>"))
    fields = [asked.schema["query_id"], StructField("distance", DoubleType()), own.schema["function_id"], own.schema["chunk_index"]]
    types, schema = [to_arrow_type(f.dataType) for f in fields], StructType([StructField(f.name, f.dataType) for f in fields])

    size = asked.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("width")).first()
    blocks = max(1, -(-size["n"] // BROADCAST_QUERIES), -(-size["n"] * 8 * max(size["width"] or 1, 1) // query_bytes))

    def search(block: DataFrame) -> DataFrame:
        found = block.toArrow()
        hits = own.mapInArrow(_k_best(spark.sparkContext.broadcast(_sides(found)), found.num_rows, k, types), schema)
        placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "function_id", "chunk_index")))
        return placed.where(F.col("place") <= k).select("query_id", "function_id", "chunk_index", "distance", "place")

    if blocks == 1:
        return search(asked)
    path = scratch(spark, "nearest")
    for b in range(blocks):
        search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
