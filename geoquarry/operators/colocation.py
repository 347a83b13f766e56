"""Co-location of categories on a grid: cells, pair statistics, permutation and exact nulls, discovery.

A cell's density counts all its places, also those without a category; occupancy counts categories that are not
blank. Strata are parent cells of 8 x 8 by the power of two of the density. All stages are tables; only the one-row
preflight and size guards reach the driver.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoquarry.functions.geometry import Grid, grid_definition, stratum_id, valid_coordinate
from geoquarry.operators.pairs import Numbered, pair_sums, scored
from geoquarry.operators.ranks import ranked, running_sum
from geoquarry.sources.scratch import stored

# Bounds and names that enter results.
PERMUTATIONS = 199
MIN_CELLS, MIN_JOINT, MIN_LIFT = 50, 20, 2.0
MIN_DISTANCE, MIN_PERCENTILE = 0.35, 0.8
FRONTIER, FAMILY = 32, 5
FULL_JOINT, FULL_SHARE = 50, 0.02
MAX_PLACES, MAX_CELLS, MAX_CATEGORIES, MAX_PAIRS = 100_000, 20_000, 256, 32_640
MAX_STATES, MAX_TRANSITIONS, EPSILON = 20_001, 5_000_000, 1e-12
#: Distributions shorter than this are convolved directly, and so many at a time.
DIRECT, FAN = 256, 16
SPLIT_VERSION = "stratified-sha256-cell-split-v1"
SEED_VERSION = "place-colocation-candidate-discovery-v1"


def seed_of(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


# -- preflight and cells -------------------------------------------------------------------------------------------


def _category() -> Column:
    return F.nullif(F.trim("taxonomy_primary"), F.lit(""))


def universe(places: DataFrame, county: str, hosted: bool = False, status: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """The places that an analysis looks at, valid coordinates or not."""
    out = places.where(F.col("county_key") == county)
    if not hosted:
        out = out.where(~F.col("is_hosted_service").eqNullSafe(True))
    if status is not None:
        out = out.where(F.lower("operating_status") == status.lower())
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def preflight(own: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One pass, one row: what there is to analyse."""
    ok = valid_coordinate()
    measures = [
        F.count("*").alias("places"),
        F.count_if(ok).alias("with_coordinates"),
        F.count_if(_category().isNull()).alias("without_category"),
        F.min(F.when(ok, F.col("latitude"))).alias("min_latitude"),
        F.max(F.when(ok, F.col("latitude"))).alias("max_latitude"),
        F.min("overture_release").alias("release_min"),
        F.max("overture_release").alias("release_max"),
        F.count_distinct("overture_release").alias("releases"),
    ]
    for name, category in (("a", a), ("b", b)):
        if category is not None:
            own_rows = F.col("taxonomy_primary") == category
            measures += [F.count_if(own_rows).alias(f"places_{name}"), F.count_if(own_rows & ok).alias(f"placed_{name}"), F.min(F.when(own_rows, F.col("confidence"))).alias(f"min_confidence_{name}")]
    return own.agg(*measures)


def size_guard(df: DataFrame, limit: int, what: str, refuse: bool = True) -> DataFrame:
    """Refuse, never truncate: an error beyond ``limit`` rows; without ``refuse`` a warning, and all rows go on."""
    found = df.limit(limit + 1).count()
    if found > limit:
        if refuse:
            raise ValueError(f"refused: more than {limit} {what}; nothing was left out")
        warnings.warn(f"more than {limit} {what}: beyond what one process would take, done whole", stacklevel=2)
    return df


def guarded_places(own: DataFrame, refuse: bool = True) -> DataFrame:
    """The places of an analysis, refused beyond MAX_PLACES with valid coordinates, or told of by a warning where places are only aggregated."""
    size_guard(own.where(valid_coordinate()), MAX_PLACES, "places with coordinates", refuse)
    return own


def guarded_stages(all_cells: DataFrame, categories: DataFrame) -> None:
    """Refuse more than MAX_CELLS cells or MAX_CATEGORIES categories, whose pairs are MAX_PAIRS at most."""
    size_guard(all_cells, MAX_CELLS, "cells")
    size_guard(categories, MAX_CATEGORIES, f"categories ({MAX_PAIRS} pairs)")


def grid_of(own: DataFrame, size: int = 800) -> Grid:
    bounds = own.where(valid_coordinate()).agg(F.min("latitude"), F.max("latitude")).first()
    return grid_definition(size, bounds[0], bounds[1])


def gridded(own: DataFrame, grid: Grid) -> DataFrame:
    """Places with valid coordinates and their cell."""
    return own.where(valid_coordinate()).withColumns({"lat_idx": grid.lat_index(), "lon_idx": grid.lon_index()})


def filled(own: DataFrame) -> DataFrame:
    """lat_idx, lon_idx, category, n: gridded places by cell and category; those of a blank one have a null."""
    return own.groupBy("lat_idx", "lon_idx", _category().alias("category")).agg(F.count("*").alias("n"))


def cells(own: DataFrame, counted: str | None = None) -> DataFrame:
    """lat_idx, lon_idx, density from gridded places, or from rows that each count ``counted`` of them."""
    return own.groupBy("lat_idx", "lon_idx").agg((F.sum(counted) if counted else F.count("*")).alias("density"))


def occupancy(own: DataFrame) -> DataFrame:
    """Distinct (cell, category), blank categories left out."""
    return own.select("lat_idx", "lon_idx", _category().alias("category")).where("category is not null").distinct()


def eligible(occupied: DataFrame, least: int = MIN_CELLS) -> DataFrame:
    """category, n_cells of the categories in enough cells."""
    return occupied.groupBy("category").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)


def incidence(occupied: DataFrame, categories: DataFrame) -> DataFrame:
    return occupied.join(categories.select("category"), "category", "left_semi")


def pair_cells(own: DataFrame, a: str, b: str) -> DataFrame:
    """Cells with density, counts of both categories, and which they hold."""
    counts = [F.count("*").alias("density")] + [F.count_if(F.col("taxonomy_primary") == c).alias(f"n_{k}") for k, c in (("a", a), ("b", b))]
    return own.groupBy("lat_idx", "lon_idx").agg(*counts).withColumns({"has_a": F.col("n_a") > 0, "has_b": F.col("n_b") > 0})


def modal_paths(own: DataFrame) -> DataFrame:
    """category, path with most support (ties: the smallest), support, coverage over all placed rows, ambiguity (other paths that tie)."""
    paths = own.where(_category().isNotNull()).groupBy(_category().alias("category"), F.col("taxonomy_hierarchy").alias("path")).agg(F.count("*").alias("support"))
    by = Window.partitionBy("category")
    ranked = paths.withColumns({"total": F.sum("support").over(by), "top": F.max(F.when(F.col("path").isNotNull(), F.col("support"))).over(by)})
    tied = (F.col("support") == F.col("top")) & F.col("path").isNotNull()
    out = ranked.groupBy("category").agg(F.min(F.when(tied, F.col("path"))).alias("path"), F.max("top").alias("support"), F.max("total").alias("total"), F.greatest(F.count_if(tied) - 1, F.lit(0)).alias("ambiguity"))
    return out.withColumn("coverage", F.col("support") / F.col("total"))


def category_records(own: DataFrame, categories: DataFrame) -> DataFrame:
    """Eligible categories with their cells, path, coverage and ambiguity; categories without a path stay."""
    return categories.join(modal_paths(own.withColumn("taxonomy_primary", _category()).join(categories.select(F.col("category").alias("taxonomy_primary")), "taxonomy_primary", "left_semi")), "category", "left").select("category", "n_cells", "path", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("ambiguity", F.lit(0)).cast("long").alias("ambiguity"))


def cell_records(all_cells: DataFrame, incident: DataFrame) -> DataFrame:
    """Cells with each eligible category in them; cells without any stay."""
    return all_cells.join(incident, ["lat_idx", "lon_idx"], "left").select("lat_idx", "lon_idx", "density", "category")


# -- one pair ------------------------------------------------------------------------------------------------------


def observed(own_cells: DataFrame) -> DataFrame:
    """Counts, the expectation A * B / N and the lift joint * N / (A * B) of one pair."""
    n, a, b = F.col("n_cells"), F.col("cells_a"), F.col("cells_b")
    counts = own_cells.agg(F.count("*").alias("n_cells"), F.count_if("has_a").alias("cells_a"), F.count_if("has_b").alias("cells_b"), F.count_if(F.col("has_a") & F.col("has_b")).alias("joint"))
    return counts.withColumns({"expected": F.when(n > 0, a * b / n), "lift": F.when((a > 0) & (b > 0), F.col("joint") * n / (a * b))})


def permutation_null(own_cells: DataFrame, seed: str, rounds: int = PERMUTATIONS) -> DataFrame:
    """Mean, deviation, one-sided p and conditioned lift of the joint count when B is dealt anew within strata.

    In each round the first B cells of a stratum by hash hold B. Strata whose overlap cannot vary add a constant and
    are never expanded. Rounds are dealt where a stratum's cells are, and a task sums each round before anything is
    shuffled: what moves are the cells once, and one number for each round and task.
    """
    cell = own_cells.withColumns({"stratum": stratum_id(), "cell": F.concat_ws(":", "lat_idx", "lon_idx")})
    strata = cell.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("has_a").alias("a"), F.count_if("has_b").alias("b"), F.count_if(F.col("has_a") & F.col("has_b")).alias("ab"))
    least = F.greatest(F.lit(0), F.col("a") + F.col("b") - F.col("n"))
    strata = strata.withColumns({"least": least, "varies": least < F.least("a", "b")})
    # a stratum is one row with its cells (a block of 8 x 8 at most); it deals all rounds from them and tells each round's count
    loose = cell.groupBy("stratum").agg(F.collect_list(F.struct("cell", "has_a")).alias("cells")).join(strata.where("varies").select("stratum", "b"), "stratum")
    # a stratum is a small row and much work, so rows are dealt by number and not by size
    loose = loose.repartition(int(own_cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stratum")

    def moved(number: Column) -> Column:
        hashed = F.transform("cells", lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), number.cast("string"), F.col("stratum"), c["cell"]), 256).alias("hash"), c["cell"].alias("cell"), c["has_a"].alias("has_a")))
        return F.size(F.filter(F.slice(F.array_sort(hashed), 1, F.col("b").cast("int")), lambda c: c["has_a"]))

    dealt = loose.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), moved)).alias("round", "moved"))
    joint = dealt.groupBy("round").agg(F.sum("moved").alias("moved"))
    # one row of constants, and one row for each round
    fixed = strata.agg(F.coalesce(F.sum(F.when(~F.col("varies"), F.col("least"))), F.lit(0)).alias("fixed"), F.count_if("varies").alias("permutable"), F.count_if(~F.col("varies")).alias("fixed_strata"), F.coalesce(F.sum("ab"), F.lit(0)).alias("observed"))
    counts = own_cells.sparkSession.range(rounds).withColumnRenamed("id", "round").join(joint, "round", "left").join(F.broadcast(fixed)).withColumn("null_joint", F.coalesce("moved", F.lit(0)) + F.col("fixed"))
    out = counts.agg(
        F.avg("null_joint").alias("null_mean"), F.stddev_pop("null_joint").alias("null_deviation"), F.count_if(F.col("null_joint") >= F.col("observed")).alias("reached"), F.max("observed").alias("observed"), F.max("permutable").alias("permutable"), F.max("fixed_strata").alias("fixed_strata")
    )
    return out.select("observed", "null_mean", "null_deviation", F.when(F.col("permutable") > 0, (1 + F.col("reached")) / (rounds + 1)).alias("p_value"), F.when(F.col("null_mean") != 0, F.col("observed") / F.col("null_mean")).alias("conditioned_lift"), "permutable", "fixed_strata")


# -- all pairs -----------------------------------------------------------------------------------------------------


def joint_counts(incident: DataFrame, categories: Numbered | None = None) -> DataFrame:
    """a < b, joint: cells that hold both, by blocks of categories. ``categories`` are those of ``incident`` if none are given."""
    ones = incident.select("lat_idx", "lon_idx", "category", F.lit(1).alias("n"), F.lit(1).alias("m"))
    return pair_sums(ones, ["lat_idx", "lon_idx"], categories or Numbered(incident)).select("a", "b", "joint")


def _pair_moments(all_cells: DataFrame, incident: DataFrame, categories: Numbered) -> DataFrame:
    """As ``pair_moments``, with exact_mean and exact_variance."""
    cell = all_cells.select("lat_idx", "lon_idx", stratum_id().alias("stratum"))
    strata = cell.groupBy("stratum").agg(F.count("*").alias("n"))
    marginal = incident.join(cell, ["lat_idx", "lon_idx"]).groupBy("stratum", "category").agg(F.count("*").alias("m")).join(strata, "stratum")
    return pair_sums(marginal, ["stratum"], categories).drop("joint")


def pair_moments(all_cells: DataFrame, incident: DataFrame, categories: Numbered | None = None) -> DataFrame:
    """a < b, mean and variance of the joint count under independence within strata, summed over strata."""
    return _pair_moments(all_cells, incident, categories or Numbered(incident)).select("a", "b", "mean", "variance")


def pair_stats(all_cells: DataFrame, incident: DataFrame) -> DataFrame:
    """Marginals, joint, lift, mean, variance, z (null at variance 0) and the zero-variance excess of each pair that meets."""
    n = all_cells.agg(F.count("*").alias("n_cells"))
    # a category table: a few numbers for each category
    marginal = stored(incident.groupBy("category").agg(F.count("*").alias("m")), "marginals")
    a, b = (marginal.select(F.col("category").alias(c), F.col("m").alias(f"cells_{c}")) for c in ("a", "b"))
    numbered = Numbered(marginal)
    out = joint_counts(incident, numbered).join(a, "a").join(b, "b").join(_pair_moments(all_cells, incident, numbered), ["a", "b"]).join(F.broadcast(n))
    return scored(out).withColumns(
        {
            "lift": F.col("joint") * F.col("n_cells") / (F.col("cells_a") * F.col("cells_b")),
            "zero_variance_excess": (F.col("variance") == 0) & (F.col("joint") > F.col("mean")),
        }
    ).select("a", "b", "joint", "cells_a", "cells_b", "mean", "variance", "lift", "z", "zero_variance_excess")


def pair_guard(pairs: DataFrame, joint: int = MIN_JOINT, lift: float = MIN_LIFT) -> DataFrame:
    return pairs.where((F.col("joint") >= joint) & F.col("lift").isNotNull() & (F.col("lift") >= lift))


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Rank by z, zero-variance excess first, then names in locale order; pairs are ranked over range partitions."""
    score = F.when(F.col("zero_variance_excess"), F.lit(float("inf"))).otherwise(F.coalesce("z", F.lit(float("-inf"))))
    placed = ranked(pairs, [score.desc(), F.collate("a", "UNICODE").asc(), F.collate("b", "UNICODE").asc()], name="rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def split(all_cells: DataFrame, seed: str) -> DataFrame:
    """Cells with stratum and ``half``: in each stratum the first half by hash is ``discovery``; a single cell goes by the parity of its first hash byte."""
    cell = all_cells.withColumns({"stratum": stratum_id(), "cell": F.concat_ws(":", "lat_idx", "lon_idx")})
    cell = cell.withColumn("hash", F.sha2(F.concat_ws("|", F.lit(seed), F.lit(SPLIT_VERSION), "stratum", "cell"), 256))
    by = Window.partitionBy("stratum")
    cell = cell.withColumns({"n": F.count("*").over(by), "r": F.row_number().over(by.orderBy("hash", "cell"))})
    even = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % 2 == 0
    first = F.when(F.col("n") == 1, even).otherwise(F.col("r") <= F.floor(F.col("n") / 2))
    return cell.withColumn("half", F.when(first, "discovery").otherwise("validation")).drop("hash", "n", "r", "cell")


def check_split(halves: DataFrame) -> DataFrame:
    """An error where one side of a split is empty."""
    row = halves.agg(F.count("*").alias("n"), F.count_distinct("half").alias("sides")).first()
    if row.n and row.sides < 2:
        raise ValueError("the split is degenerate: one side has no cells")
    return halves


def split_balance(halves: DataFrame) -> DataFrame:
    by_stratum = halves.groupBy("stratum").agg(F.count_if(F.col("half") == "discovery").alias("d"), F.count_if(F.col("half") == "validation").alias("v"))
    out = by_stratum.agg(F.sum("d").alias("discovery_cells"), F.sum("v").alias("validation_cells"), F.count("*").alias("strata"), F.count_if(F.col("d") > 0).alias("discovery_strata"), F.count_if(F.col("v") > 0).alias("validation_strata"), F.count_if(F.col("d") + F.col("v") == 1).alias("single_strata"), F.max(F.abs(F.col("d") - F.col("v"))).alias("max_imbalance"))
    return out.withColumns({"discovery_fraction": F.col("discovery_cells") / (F.col("discovery_cells") + F.col("validation_cells")), "imbalance": F.abs(F.col("discovery_cells") - F.col("validation_cells"))})


# -- exact null ----------------------------------------------------------------------------------------------------


def pmf(n: int, a: int, b: int) -> np.ndarray:
    """Probabilities of overlaps 0..min(a, b) of a hypergeometric draw."""
    from math import lgamma

    def choose(x: int, y: int) -> float:
        return lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)

    out = np.zeros(min(a, b) + 1)
    for k in range(max(0, a + b - n), min(a, b) + 1):
        out[k] = np.exp(choose(a, k) + choose(n - a, b - k) - choose(n, b))
    return out


def convolve_null(strata: list[tuple[int, int, int]], joint: int, states: int = MAX_STATES, transitions: int = MAX_TRANSITIONS) -> tuple[float | None, float | None, int, int, str | None]:
    """(raw p, conservative p, states, transitions, reason) of a few strata (n, a, b), folded one after another; what ``exact_null`` has to agree with."""
    distribution, used = np.ones(1), 0
    for n, a, b in strata:
        own = pmf(n, a, b)
        used += len(distribution) * int((own > 0).sum())
        if len(distribution) + len(own) - 1 > states or used > transitions:
            return None, None, len(distribution), used, "the exact null is over its computation cap"
        distribution = np.convolve(distribution, own)
    total = float(distribution.sum())
    if not np.isfinite(total) or total <= 0 or abs(1 - total) > 1e-9:
        return None, None, len(distribution), used, "the exact null does not sum to one"
    raw = float(distribution[joint:].sum()) / total
    return raw, min(1.0, raw + EPSILON), len(distribution), used, None


def convolved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distribution of a sum; by FFT where both are long."""
    if min(len(x), len(y)) < DIRECT:
        return np.convolve(x, y)
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:n], 0)


def powered(x: np.ndarray, times: int) -> np.ndarray:
    """The distribution of the sum of ``times`` draws of one."""
    out = np.ones(1)
    while times:
        if times & 1:
            out = convolved(out, x)
        x, times = (convolved(x, x), times >> 1) if times > 1 else (x, 0)
    return out


def stratum_marginals(all_cells: DataFrame, incident: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, stratum, n, m_a, m_b for each of the (few) pairs and each stratum."""
    cell = all_cells.select("lat_idx", "lon_idx", stratum_id().alias("stratum"))
    strata = cell.groupBy("stratum").agg(F.count("*").alias("n"))
    marginal = incident.join(cell, ["lat_idx", "lon_idx"]).groupBy("stratum", "category").agg(F.count("*").alias("m"))
    out = pairs.select("a", "b").join(strata)
    for c in ("a", "b"):
        out = out.join(marginal.select("stratum", F.col("category").alias(c), F.col("m").alias(f"m_{c}")), ["stratum", c], "left")
    return out.select("a", "b", "stratum", "n", *(F.coalesce(f"m_{c}", F.lit(0)).alias(f"m_{c}") for c in "ab"))


def null_costs(strata: DataFrame, max_states: int = MAX_STATES, max_transitions: int = MAX_TRANSITIONS) -> DataFrame:
    """a, b, states, transitions, reason (null within the caps) of folding each pair's strata one after another, without folding them.

    Before a stratum there are 1 + (sum of the largest overlaps before) states; it adds one transition for each of them and each
    overlap of its support. The first is a running sum in the order of the strata. The first stratum over a cap ends the
    fold; where it lies is looked for in pairs over a cap alone.
    """
    n, a, b = F.col("n"), F.col("m_a"), F.col("m_b")
    largest = F.least(a, b)
    rows = strata.withColumns({"largest": largest, "support": largest - F.greatest(F.lit(0), a + b - n) + 1})
    rows = running_sum(rows, "largest", [F.col("stratum").asc()], ["a", "b"], "upto").withColumn("step", (F.col("upto") - F.col("largest") + 1) * F.col("support"))
    totals = stored(rows.groupBy("a", "b").agg((F.max("upto") + 1).alias("states"), F.sum("step").alias("transitions")), "totals")
    beyond = (F.col("states") > max_states) | (F.col("transitions") > max_transitions)
    within = totals.where(~beyond).withColumn("reason", F.lit(None).cast("string"))
    if not totals.where(beyond).limit(1).count():
        return within
    late = running_sum(rows.join(totals.where(beyond).select("a", "b"), ["a", "b"], "left_semi"), "step", [F.col("stratum").asc()], ["a", "b"], "transitions")
    over = (F.col("upto") + 1 > max_states) | (F.col("transitions") > max_transitions)
    stops = late.where(over).groupBy("a", "b").agg(F.min(F.struct("transitions", (F.col("upto") - F.col("largest") + 1).alias("states"))).alias("stop"))
    return within.unionByName(stops.select("a", "b", "stop.states", "stop.transitions", F.lit("the exact null is over its computation cap").alias("reason")))


def null_distributions(strata: DataFrame, fan: int = FAN) -> DataFrame:
    """a, b, shift, probs: the distribution of the joint count of each pair (a, b, stratum, n, m_a, m_b), from ``shift`` on.

    A stratum whose overlap cannot vary only shifts. Of the others, those that agree in (n, m_a, m_b) are one power;
    powers are dealt into groups of about ``fan`` and convolved, and what they give again, level by level, so no group holds
    all strata of a pair.
    """
    n, a, b = F.col("n"), F.col("m_a"), F.col("m_b")
    low = F.greatest(F.lit(0), a + b - n)
    shifts = strata.groupBy("a", "b").agg(F.sum(low).alias("shift"))
    alike = stored(strata.where(low < F.least(a, b)).groupBy("a", "b", "n", "m_a", "m_b").agg(F.count("*").alias("times")), "alike")
    most = alike.groupBy("a", "b").count().agg(F.max("count")).first()[0] or 0

    def power(group: pd.DataFrame) -> pd.DataFrame:
        out = np.ones(1)
        for r in group.sort_values(["n", "m_a", "m_b"]).itertuples():
            out = convolved(out, powered(pmf(r.n, r.m_a, r.m_b)[max(0, r.m_a + r.m_b - r.n) :], r.times))
        return pd.DataFrame([[group["a"].iloc[0], group["b"].iloc[0], group["slot"].iloc[0], out]], columns=["a", "b", "slot", "probs"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out = np.ones(1)
        for probs in group.sort_values("slot")["probs"]:
            out = convolved(out, np.asarray(probs))
        return pd.DataFrame([[group["a"].iloc[0], group["b"].iloc[0], group["slot"].iloc[0] // fan, out]], columns=["a", "b", "slot", "probs"])

    schema, left = "a string, b string, slot long, probs array<double>", max(1, -(-most // fan))
    slots = alike.withColumn("slot", F.pmod(F.xxhash64("n", "m_a", "m_b"), F.lit(left)))
    level = slots.groupBy("a", "b", "slot").applyInPandas(power, schema)
    while left > 1:
        level = stored(level, "folded").groupBy("a", "b", F.floor(F.col("slot") / fan)).applyInPandas(fold, schema)
        left = -(-left // fan)
    return shifts.join(level.drop("slot"), ["a", "b"], "left").select("a", "b", "shift", F.coalesce("probs", F.array(F.lit(1.0))).alias("probs"))


def exact_null(all_cells: DataFrame, incident: DataFrame, pairs: DataFrame, max_states: int = MAX_STATES, max_transitions: int = MAX_TRANSITIONS) -> DataFrame:
    """Exact tail of the joint count under independence within strata for pairs (a, b, joint); a pair over the caps has no p, and a reason."""
    strata = stored(stratum_marginals(all_cells, incident, pairs), "strata")
    costs = stored(null_costs(strata, max_states, max_transitions), "costs")
    fit = strata.join(costs.where("reason is null").select("a", "b"), ["a", "b"], "left_semi")
    rows = pairs.select("a", "b", F.col("joint").cast("long").alias("joint")).join(costs, ["a", "b"], "left").join(null_distributions(fit), ["a", "b"], "left")
    rows = rows.withColumn("total", F.aggregate("probs", F.lit(0.0), lambda s, x: s + x))
    tail = F.aggregate(F.slice("probs", F.greatest(F.lit(1), (F.col("joint") - F.col("shift") + 1).cast("int")), F.greatest(F.lit(0), (F.size("probs") - F.greatest(F.lit(0), F.col("joint") - F.col("shift"))).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    whole = F.abs(F.col("total") - 1) <= 1e-9
    raw = F.when(whole, tail / F.col("total"))
    reason = F.coalesce("reason", F.when(~whole, "the exact null does not sum to one"))
    return rows.select("a", "b", "joint", raw.alias("raw_p"), F.when(raw.isNotNull(), F.least(F.lit(1.0), raw + EPSILON)).alias("p"), F.coalesce("states", F.lit(1)).cast("long").alias("states"), F.coalesce("transitions", F.lit(0)).cast("long").alias("transitions"), reason.alias("reason"))


def holm(tests: DataFrame, p: str, order: str) -> DataFrame:
    """``holm_p``: running maximum of min(1, (m - rank) * p); nulls enter as 1, ties by ``order``. A family is a few rows."""
    value = F.coalesce(F.col(p), F.lit(1.0))
    ranked = tests.withColumns({"__r": F.row_number().over(Window.orderBy(value, order)) - 1, "__m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__r")) * value)
    return ranked.withColumn("holm_p", F.max(step).over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")
