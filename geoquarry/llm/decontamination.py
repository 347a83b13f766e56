"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask keeps four of up to seven neighbouring words and ignores the others, so a substituted word breaks only the
seeds that look at it. Seeds of whole training texts meet seeds of the benchmark items on their hash; a hit fixes
an item and a diagonal (offset of the text against the item). Around each hit the words of the item are compared
with the words of the text on that diagonal: a text is contaminated by an item when at least 75 % of the item's
words stand there. Short shared fragments therefore leave a text alone. The masks are chosen so that whatever quarter
of an item's words is substituted, some seed is left; items of fewer than eight words have one mask of neighbouring
words each, with the same property. Words that are inserted or dropped end a diagonal and are not bridged.

Words are runs without white space, lower-cased. Texts with hits are compared once for all their copies, and ids may
repeat or be null. Null and empty texts, and an empty benchmark, give contaminated = false; items without words are
never found; extra columns are kept under any names. Ties between items go to the smallest item_id; an item_id that
repeats stands for all its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoquarry.llm import common
from geoquarry.llm.common import fresh, small, stash, stash_bytes, table, unstash

#: The word positions that each mask looks at: the first three for items of LONG words or more, the others for short ones.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6), (0, 1, 2), (0, 1), (0,))
LONG, SHORT = 8, {1: 5, 2: 4, 3: 3, 4: 4, 5: 4, 6: 3, 7: 3}
#: Share of an item's words that must stand in the text, in percent.
PERCENT = 75
_BLANKS, _WHITE = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def _hashes(text: str) -> Column:
    """One hash for each word of a text."""
    body = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANKS))
    return F.when(body == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(body, _WHITE), lambda w: F.xxhash64(w)))


def _seeds(df: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """keep, seed, pos: one row for each of the masks and start in the word hashes ``wh``; plain expressions, so that they compile."""
    at = df.select(*keep, "wh", F.posexplode("wh").alias("pos", "first"))

    def seed(k: int) -> Column:
        return F.when(F.col("pos") + MASKS[k][-1] < F.size("wh"), F.xxhash64(F.lit(k), *(F.get("wh", F.col("pos") + o) for o in MASKS[k])))

    return at.select(*keep, "pos", F.explode(F.array(*map(seed, masks))).alias("seed")).where("seed is not null")


def _mask_of(n: Column, k: int) -> Column:
    """Whether an item of n words uses mask k."""
    return n >= LONG if k < 3 else n.isin(*(length for length, mask in SHORT.items() if mask == k))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """k1, k2 (identity of a text), item_id, matched, item_words: each distinct text and item that it contains."""
    items = stash(benchmark.select("item_id", _hashes("text").alias("wh")).where(F.size("wh") > 0), "items")
    used = items.agg(*(F.coalesce(F.max(_mask_of(F.size("wh"), k)), F.lit(False)).alias(str(k)) for k in range(len(MASKS)))).first()
    masks = [k for k in range(len(MASKS)) if used[k]]
    per_mask = [_seeds(items.where(_mask_of(F.size("wh"), k)), [k], "item_id") for k in masks]
    own = items.select("item_id").limit(0).selectExpr("item_id", "0L as seed", "0 as item_pos")
    for x in per_mask:
        own = own.unionByName(x.withColumnRenamed("pos", "item_pos"))
    item_seeds = stash(own.distinct(), "item-seeds")
    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("k1"), F.crc32(F.col("text").cast("binary")).alias("k2"), "text")
    words = keyed.select("k1", "k2", _hashes("text").alias("wh"))
    # a benchmark of more seeds than one broadcast may hold is met block by block, each in one pass without a shuffle of the texts
    blocks = stash_bytes(item_seeds) // common.BROADCAST_BYTES + 1 if common.BROADCAST_BYTES > 0 else 1
    hits = None
    for b in range(blocks if masks else 0):
        block = F.broadcast(item_seeds.where(F.pmod("seed", F.lit(blocks)) == b)) if blocks > 1 else small(item_seeds)
        found = _seeds(words, masks, "k1", "k2").join(block, "seed").select("k1", "k2", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, item_id long, matched int, item_words int")
    hits = stash(hits.distinct(), "hits")
    hit_texts = stash(hits.select("k1", "k2").distinct(), "hit-texts")
    texts = keyed.join(small(hit_texts), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text")).select("k1", "k2", _hashes("text").alias("wh"))
    owned = items.withColumnRenamed("wh", "iwh")
    owned._stash_path = items._stash_path
    same = F.size(F.filter(F.sequence(F.lit(0), F.size("iwh") - 1), lambda j: (j + F.col("diagonal") >= 0) & F.coalesce(F.get("iwh", j) == F.get("wh", F.greatest(j + F.col("diagonal"), F.lit(0))), F.lit(False))))
    checked = texts.join(hits, ["k1", "k2"]).join(small(owned), "item_id").select("k1", "k2", "item_id", same.alias("matched"), F.size("iwh").alias("item_words"))
    best = checked.where(100 * F.col("matched") >= PERCENT * F.col("item_words")).groupBy("k1", "k2", "item_id").agg(F.max(F.struct("matched", "item_words")).alias("best"))
    out = stash(best.select("k1", "k2", "item_id", "best.*"), "contaminated")
    for x in (items, item_seeds, hits, hit_texts):
        unstash(x)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` and contaminated, n_items, item_id, matched, item_words (of the smallest item found)."""
    found = contaminated_texts(docs, benchmark).groupBy("k1", "k2").agg(F.countDistinct("item_id").alias("n"), F.min(F.struct("item_id", "matched", "item_words")).alias("first"))
    # columns of our own, so that columns of docs with such names stay as they are
    k1, k2, n, first = (fresh(docs, c) for c in ("k1", "k2", "n", "first"))
    flagged = stash(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(n), F.col("first").alias(first)), "flagged")
    keyed = docs.select("*", F.xxhash64("text").alias(k1), F.crc32(F.col("text").cast("binary")).alias(k2))
    own = [c for c in docs.columns if c not in ("contaminated", "n_items", "item_id", "matched", "item_words")]
    return keyed.join(small(flagged), [k1, k2], "left").select(
        *own, F.col(n).isNotNull().alias("contaminated"), F.coalesce(n, F.lit(0).cast("long")).alias("n_items"), *(F.col(f"{first}.{c}").alias(c) for c in ("item_id", "matched", "item_words"))
    )


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", "item_id", "matched", "item_words")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; all others stay as they are."""
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    flagged = stash(contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "flagged")
    keyed = docs.select("*", F.xxhash64("text").alias(k1), F.crc32(F.col("text").cast("binary")).alias(k2))
    return keyed.join(small(flagged), [k1, k2], "left_anti").select(*docs.columns)


def _sql_seeds(key: str, source: str, of_item: bool) -> str:
    def one(k: int) -> str:
        seed = " || ' ' || ".join(f"ws[i + {o + 1}]" for o in MASKS[k])
        lengths = f"len(ws) >= {LONG}" if k < 3 else f"len(ws) IN ({', '.join(str(n) for n, mask in SHORT.items() if mask == k)})"
        return f"SELECT {key}, i AS pos, '{k}:' || {seed} AS seed FROM (SELECT *, unnest(range(0, len(ws) - {MASKS[k][-1]})) AS i FROM {source} WHERE len(ws) > {MASKS[k][-1]}{f' AND {lengths}' if of_item else ''})"

    return " UNION ALL ".join(map(one, range(len(MASKS))))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
ds AS ({_sql_seeds("doc_id", "d", False)}),
bs AS ({_sql_seeds("item_id", "b", True)}),
h AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS diagonal FROM ds JOIN bs USING (seed)),
m AS (SELECT h.doc_id, h.item_id, len(b.ws) AS item_words,
  len(list_filter(range(1, len(b.ws) + 1), lambda j: j + h.diagonal >= 1 AND j + h.diagonal <= len(d.ws) AND b.ws[j] = d.ws[j + h.diagonal])) AS matched
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT doc_id, item_id, max(matched) AS matched, any_value(item_words) AS item_words FROM m WHERE 100 * matched >= 75 * item_words GROUP BY doc_id, item_id),
g AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS item_id, arg_min(matched, item_id) AS matched, arg_min(item_words, item_id) AS item_words FROM f GROUP BY doc_id)
SELECT documents.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(g.n_items, 0)::BIGINT AS n_items, g.item_id, g.matched::INTEGER AS matched, g.item_words::INTEGER AS item_words
FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id
"""
