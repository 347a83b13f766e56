"""Near-duplicate groups by SetSketch banding with exact confirmation on the full shingle sets.

1. Each row becomes its set of 5-word shingles and 192 SetSketch registers; equal sets become one class, numbered
   by its smallest doc_id, so exact copies cost nothing later, however many there are.
2. Registers are banded. In each bucket every class is paired with the bucket's smallest class only (a star,
   never all pairs); the joint likelihood estimate drops hopeless pairs and full sets confirm the rest.
3. Buckets that still hold classes of several components may hide links that no star tested. Their classes go
   through an exact prefix join: shingles are ordered from rare to common, two sets at 0.75 must share one of
   their first quarter, and the positions bound the overlap, so frequent boilerplate yields no pairs. Under each
   shingle the component with most classes meets the others only, never itself.
4. Confirmed links are closed into components, named by their smallest doc_id.

Defined results: documents without words are linked with nothing and kept; rows with a null doc_id are returned
with a null component_id and kept. Rows that repeat a doc_id are placed by their own texts: each is in the component
of its set, and kept where the doc_id names the component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoquarry.llm import setsketch
from geoquarry.llm.common import fresh, release_worker_cache, small, small_batches, stash, table, unstash
from geoquarry.llm.components import connected_components
from geoquarry.llm.shingles import WORDS, shingle_set

#: A link needs 100 * |a & b| >= PERCENT * |a | b|.
PERCENT = 75
#: Pairs whose estimate lies this far under the threshold are not verified: over five standard errors.
SLACK = 0.19


def _identity(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over the distinct shingles: with the set's size, they identify it."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(((s ^ (s >> np.uint64(29))) * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_worker_cache()
    for batch in batches:
        ids, of_text, sizes, high, low, regs = batch.column("doc_id"), batch.column("of_text"), [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            k1, k2 = _identity(s)
            high.append(k1)
            low.append(k2)
            regs.append(setsketch.registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), of_text, pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "of_text", "n_shingles", "k1", "k2", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, of_text (hash of the text), n_shingles, k1, k2 (identity of the set), regs (SetSketch registers, null for an empty set)."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("of_text")).mapInArrow(_sketch, "doc_id long, of_text long, n_shingles long, k1 long, k2 long, regs binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            regs = np.frombuffer(b"".join(x.as_py() for x in part.column("regs")), np.uint16).reshape(-1, setsketch.REGISTERS)
            rep = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), setsketch.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(setsketch.band_keys(regs).ravel()), pa.array(rep, pa.int64())], ["bucket", "rep"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            a, b = (np.frombuffer(b"".join(x.as_py() for x in part.column(c)), np.uint16).reshape(-1, setsketch.REGISTERS) for c in ("regs_a", "regs_b"))
            n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            keep = setsketch.estimate(a, b, n_a, n_b) >= PERCENT / 100 - SLACK
            yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            sets = [shingle_set(x.as_py()) for x in part.column("text")]
            # a row that repeats the doc_id of a class may hold another set
            keep = np.array([_identity(s) == k for s, k in zip(sets, zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True), strict=True)], bool)
            own = [s.view(np.int64) for s, k in zip(sets, keep, strict=True) if k]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *own]))
            yield pa.RecordBatch.from_arrays([part.column("rep").filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), values)], ["rep", "shingles"])


def _full_sets(docs: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """The full shingle sets of the given classes (rep, doc_id, k1, k2)."""
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(classes, "doc_id").select("rep", "k1", "k2", "text").mapInArrow(_sets, "rep long, shingles array<long>")
    return sets.dropDuplicates(["rep"]) if repeats else sets


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(right, "b").join(left, "a").where(100 * common >= PERCENT * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _prefix_pairs(sets: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of different components in ``member`` (rep, component) that the exact prefix and position filters admit."""
    token = sets.join(member, "rep").select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    count = token.groupBy("token").agg(F.count("*").alias("df"))
    ranked = token.join(count, "token").withColumn("pos", F.row_number().over(Window.partitionBy("rep").orderBy("df", "token")))
    head = ranked.where((F.col("df") > 1) & (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (PERCENT / 100) - 1e-9) + 1)).select("token", "rep", "component", "n", "pos")
    head = stash(head, "heads")
    # under each token of several components, the one with most members meets the others but not itself
    held = head.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("big"), F.count("*").alias("components")).where("components > 1").select("token", "big")
    head = head.join(held, "token")
    x, y = (head.select("token", "big", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "pos"))) for s in ("a", "b"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (PERCENT / (100 + PERCENT)) - 1e-9)
    reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) + 1
    ok = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("big")) | (F.col("component_a") < F.col("component_b"))) & (reach >= need)
    pairs = x.where("component_a <> big").join(y.drop("big"), "token").where(ok)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, of_text, n_shingles, component (its number, null without words or doc_id), component_id for every row of ``docs`` (doc_id, text)."""
    rows = stash(sketches(docs), "sketches")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"))
    repeats = rows.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count() > 0
    if repeats:  # further classes of one doc_id get numbers under all doc_ids, fixed by writing them
        low = rows.agg(F.least(F.min("doc_id"), F.lit(0))).first()[0] - 1
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_shingles", "k1", "k2")) == 1
        classes = classes.withColumn("rep", F.when(first, F.col("doc_id")).otherwise(low - F.monotonically_increasing_id()))
    else:
        classes = classes.withColumn("rep", F.col("doc_id"))
    reps = stash(classes, "classes")
    bands = reps.select("rep", "regs").mapInArrow(_bands, "bucket long, rep long")
    heads = bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("bucket", "head")
    shared = stash(bands.join(heads, "bucket").select("bucket", "head", "rep"), "buckets")
    stars = shared.where("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    a = reps.select(F.col("rep").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("regs").alias("regs_b"), F.col("n_shingles").alias("n_b"))
    sized = stars.join(b, "b").join(a, "a").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    likely = stash(sized.mapInArrow(_likely, "a long, b long"), "likely")
    # full sets of every class that shares a bucket, from one more pass over the texts
    wanted = reps.select("rep", "doc_id", "k1", "k2").join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = stash(_full_sets(docs, wanted, repeats), "sets")
    links = stash(_confirm(likely, sets), "links")
    found = connected_components(links)
    placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    member = stash(placed.join(mixed, "bucket", "left_semi").select("rep", "component").distinct(), "mixed")
    late = stash(_confirm(_prefix_pairs(sets, member), sets), "late")
    if late.limit(1).count():
        found = connected_components(links.unionByName(late))
    for x in (shared, sets, member, likely, links, late):
        unstash(x)
    owner = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "k1", "k2", "doc_id", F.coalesce("component", "rep").alias("component"))
    if repeats:
        owner = owner.join(owner.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    else:  # the smallest number of a component is its smallest doc_id
        owner = owner.withColumn("component_id", F.col("component"))
    owner = owner.select("n_shingles", "k1", "k2", "component", "component_id")
    out = rows.select("doc_id", "of_text", "n_shingles", "k1", "k2").join(owner, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "of_text", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, and every row without words or without a doc_id.

    The row that stays has the group's smallest doc_id and, among those, the smallest hash of the text; rows that agree
    in both collapse to one.
    """
    small_batches(spark)
    placed = stash(_placed(docs.select("doc_id", "text")).where("doc_id is not null and n_shingles > 0"), "placed")
    # two key columns of our own, so that columns of docs with such names stay as they are
    doc, of_text = fresh(docs, "doc"), fresh(docs, "of_text")
    keys = [F.col("doc_id").alias(doc), F.col("of_text").alias(of_text)]
    # by number: where doc_ids repeat, two components may share their smallest one
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "of_text")).alias("first"))
    gone = stash(placed.join(first, "component").where(F.struct("doc_id", "of_text") != F.col("first")).select(*keys).distinct(), "gone")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(doc), F.xxhash64("text").alias(of_text))
    left = keyed.join(small(gone), [doc, of_text], "left_anti")
    twice = stash(placed.groupBy(*keys).count().where("count > 1").select(doc, of_text), "twice")
    if twice.limit(1).count():
        left = left.join(small(twice), [doc, of_text], "left_anti").unionByName(left.join(small(twice), [doc, of_text], "left_semi").dropDuplicates([doc, of_text]))
    return left.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
c AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
r AS (SELECT g, min(doc_id) AS rep, any_value(n) AS n FROM c WHERE n > 0 GROUP BY g),
t AS (SELECT rep, n, unnest(g) AS x FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
k(node, low) AS (SELECT rep, rep FROM r UNION SELECT e.b, k.low FROM k JOIN e ON e.a = k.node WHERE k.low < e.b),
m AS (SELECT node, min(low) AS component FROM k GROUP BY node)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, coalesce(m.component, c.doc_id) AS component_id, coalesce(m.component, c.doc_id) = c.doc_id AS kept
FROM c LEFT JOIN r ON c.g = r.g AND c.n > 0 LEFT JOIN m ON m.node = r.rep
"""
