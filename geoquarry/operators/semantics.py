"""Distances between categories: reference distribution, guards, digests, and the last steps of discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoquarry.functions.vectors import category_gloss, cosine_distance, float64_hex
from geoquarry.operators import colocation as C
from geoquarry.operators.ranks import running_sum
from geoquarry.sources.scratch import stored

QUANTILES = (0.0, 0.2, 0.5, 0.8, 0.9, 0.95, 1.0)


def canonical_pairs(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Unordered pairs in one order; equal ends are an error."""
    same = F.when(F.col(x) == F.col(y), F.raise_error(F.concat(F.lit("a pair of one category: "), x)).cast("string"))
    own = [c for c in pairs.columns if c not in (x, y)]
    return pairs.select(F.coalesce(same, F.least(x, y)).alias("a"), F.greatest(x, y).alias("b"), *own)


def pair_distances(vectors: DataFrame) -> DataFrame:
    """a < b, distance of all pairs of categories; their number was checked against MAX_CATEGORIES."""
    a, b = (vectors.select(F.col("category").alias(c), F.col("vector").alias(f"vector_{c}")) for c in ("a", "b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", cosine_distance("vector_a", "vector_b").alias("distance"))


def to_reference(embeddings: DataFrame, reference: int = 0) -> DataFrame:
    """Distance of every vector to one."""
    one = embeddings.where(F.col("vec_id") == reference).select(F.col("embedding").alias("reference")).limit(1)
    return embeddings.join(F.broadcast(one)).select("vec_id", F.round(cosine_distance("embedding", "reference"), 6).alias("distance"))


def percentiles(distances: DataFrame) -> DataFrame:
    """Inclusive empirical distribution with ties: ``reached`` pairs are no farther, of ``pairs``.

    Counts of distinct distances are summed over range partitions, so ties are one row and no task holds all distances.
    """
    counts = distances.groupBy("distance").agg(F.count("*").alias("n"))
    running = running_sum(counts, "n", [F.col("distance").asc()])
    total = counts.agg(F.sum("n").alias("pairs"))
    return distances.join(running, "distance").join(F.broadcast(total)).select("a", "b", "distance", "reached", "pairs", (F.col("reached") / F.col("pairs")).alias("percentile"))


def quantiles(distances: DataFrame) -> DataFrame:
    """Nearest-rank quantiles in one row."""
    return distances.agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY distance)").alias(f"p{int(q * 100)}") for q in QUANTILES))


def guard(percentile: DataFrame) -> DataFrame:
    return percentile.where((F.col("distance") >= C.MIN_DISTANCE) & (F.col("percentile") >= C.MIN_PERCENTILE))


def evidence(ranked: DataFrame, percentile: DataFrame) -> DataFrame:
    """Ranked pairs with their reference distance and whether they pass the guard."""
    out = ranked.join(percentile.select("a", "b", "distance", "percentile"), ["a", "b"])
    return out.withColumn("passed", (F.col("distance") >= C.MIN_DISTANCE) & (F.col("percentile") >= C.MIN_PERCENTILE))


def frontier(evidence: DataFrame) -> DataFrame:
    """The first FRONTIER passing pairs in rank order; the first FAMILY of them are the family."""
    first = evidence.where("passed").orderBy("rank").limit(C.FRONTIER)
    # a window over FRONTIER rows
    return first.withColumn("place", F.row_number().over(Window.orderBy("rank"))).withColumn("family", F.col("place") <= C.FAMILY)


def _digest(rows: DataFrame, line: list, keys: list[str]) -> F.Column:
    """SHA-256 of JSON lines in locale order of the keys."""
    lines = F.array_sort(F.collect_list(F.struct(*(F.collate(k, "UNICODE").alias(f"k{i}") for i, k in enumerate(keys)), F.to_json(F.array(*(F.col(c).cast("string") for c in line))).alias("line"))))
    return F.sha2(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")), 256)


def corpus_digest(hashed: DataFrame, records: DataFrame) -> DataFrame:
    """Digest over (category, gloss, vector hash); at most MAX_CATEGORIES rows."""
    rows = hashed.join(records.select("category", category_gloss("category", "path").alias("gloss")), "category")
    return rows.agg(F.count("*").alias("categories"), _digest(rows, ["category", "gloss", "hash"], ["category"]).alias("digest"))


def ledger_digest(percentile: DataFrame, hashed: DataFrame) -> DataFrame:
    """Digest over the pairs with both vector hashes, the distance's bits and its rank; at most MAX_PAIRS rows."""
    rows = percentile
    for c in ("a", "b"):
        rows = rows.join(hashed.select(F.col("category").alias(c), F.col("hash").alias(f"hash_{c}")), c)
    rows = rows.withColumn("bits", float64_hex("distance"))
    return rows.agg(F.count("*").alias("pairs"), _digest(rows, ["a", "b", "hash_a", "hash_b", "bits", "reached", "pairs"], ["a", "b"]).alias("digest"))


def reference(spark: SparkSession, distances: DataFrame, hashed: DataFrame, records: DataFrame) -> DataFrame:
    """Quantiles and both digests in one row; a category without a gloss fails closed."""
    if records.where("path is null").limit(1).count():
        raise ValueError("a category has no hierarchy path, so no gloss")
    corpus = corpus_digest(hashed, records).withColumnRenamed("digest", "corpus_digest")
    ledger = ledger_digest(percentiles(distances), hashed).withColumnRenamed("digest", "ledger_digest")
    return quantiles(distances).join(corpus).join(ledger)


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """i, log_factorial for i from 0 to ``most``: one cumulative table, summed over range partitions."""
    logs = spark.range(most + 1).select(F.col("id").alias("i"), F.when(F.col("id") > 1, F.log(F.col("id").cast("double"))).otherwise(0.0).alias("log"))
    return running_sum(logs, "log", [F.col("i").asc()], name="log_factorial").drop("log")


#: Numbers up to which the table of log-factorials is one broadcast array (8 bytes each).
TABLE_NUMBERS = 100_000


def pmf_rows(cells: DataFrame, broadcast_numbers: int = TABLE_NUMBERS) -> DataFrame:
    """stratum, overlap, probability on the support of each stratum, from one cumulative table of log-factorials.

    The table goes out as one array where it has at most ``broadcast_numbers`` numbers; a larger one is joined, once for each
    number that a stratum or a row of its support needs.
    """
    sizes = cells.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("has_a").alias("a"), F.count_if("has_b").alias("b"))
    strata = stored(sizes, "strata")
    most = strata.agg(F.max("n")).first()[0] or 0
    table = log_factorials(cells.sparkSession, most)
    if most < broadcast_numbers:
        held = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "log_factorial"))), lambda x: x["log_factorial"]).alias("__logs"))
        strata = strata.join(F.broadcast(held))

    def met(rows: DataFrame, names: dict[str, F.Column]) -> DataFrame:
        if most < broadcast_numbers:
            return rows.withColumns({name: F.get("__logs", number.cast("int")) for name, number in names.items()})
        for name, number in names.items():
            rows = rows.withColumn("i", number.cast("long")).join(table.withColumnRenamed("log_factorial", name), "i").drop("i")
        return rows

    n, a, b, k = (F.col(c) for c in ("n", "a", "b", "overlap"))
    rows = met(strata, {"__n": n, "__b": b, "__nb": n - b, "__a": a, "__na": n - a}).select("*", F.explode(F.sequence(F.greatest(F.lit(0), a + b - n), F.least("a", "b"))).alias("overlap"))
    rows = met(rows, {"__k": k, "__ak": a - k, "__bk": b - k, "__rest": n - a - b + k})
    # C(a, k) C(n - a, b - k) / C(n, b)
    log = F.col("__a") - F.col("__k") - F.col("__ak") + F.col("__na") - F.col("__bk") - F.col("__rest") - F.col("__n") + F.col("__b") + F.col("__nb")
    return rows.select("stratum", "n", "a", "b", "overlap", F.exp(log).alias("probability"))


def magnitude(pairs: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Guards on all cells: joint of at least max(50, 2 % of the cells), lift of at least 2."""
    floor = all_cells.agg(F.greatest(F.lit(C.FULL_JOINT).cast("long"), F.ceil(F.count("*") * C.FULL_SHARE).cast("long")).alias("floor"))
    return pairs.join(F.broadcast(floor)).withColumns({"joint_passed": F.col("joint") >= F.col("floor"), "lift_passed": F.coalesce(F.col("lift") >= C.MIN_LIFT, F.lit(False))})


def full_universe(tested: DataFrame, pairs: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Tested pairs with the counts and guards on all cells."""
    full = magnitude(pairs.select("a", "b", "joint", "lift"), all_cells).select("a", "b", F.col("joint").alias("full_joint"), F.col("lift").alias("full_lift"), "floor", "joint_passed", "lift_passed")
    return tested.join(full, ["a", "b"], "left")


def census(all_cells: DataFrame, categories: DataFrame, ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of every stage in one row, and why a family is empty."""
    out = all_cells.agg(F.count("*").alias("cells")).join(categories.agg(F.count("*").alias("categories"))).join(ranked.agg(F.count("*").alias("guarded_pairs"))).join(evidence.agg(F.count("*").alias("evaluated_pairs"), F.count_if("passed").alias("passing_pairs")))
    k = F.col("categories")
    reason = F.when(k < 2, "too few categories").when(F.col("guarded_pairs") == 0, "no pair met the guards").when(F.col("passing_pairs") == 0, "no pair met the distance guard")
    return out.select("cells", "categories", F.when(k < 2, 0).otherwise(F.floor(k * (k - 1) / 2)).alias("pairs"), "guarded_pairs", "evaluated_pairs", "passing_pairs", F.least(F.lit(C.FRONTIER), "passing_pairs").alias("frontier_pairs"), F.least(F.lit(C.FAMILY), "passing_pairs").alias("family_pairs"), reason.alias("reason"))
