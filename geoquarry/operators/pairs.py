"""Sums over all pairs of categories that meet, by blocks of categories instead of a join of rows with rows.

Categories get numbers in their order and are cut into blocks of BLOCK. Each key (a cell, a stratum) keeps one list for each
block of categories that it holds; lists of one key meet each other, blocks with blocks, and every task multiplies
the resulting slabs of rows as matrices. A task gives one sum for each pair and n that it saw, so what is shuffled does
not grow with rows x pairs. With up to BLOCK categories no two rows ever meet.

Sums for one n are whole numbers, and the fractions of all n are added over a common denominator, so moments are the
exact values rounded once: they depend on no order of rows or tasks. Scores are roots of exact fractions, so pairs that
tie do so in all digits, also where their joint counts and moments differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import copysign, lcm, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geoquarry.operators.ranks import ranked
from geoquarry.sources.scratch import stored

#: Categories of one block; a matrix of sums has BLOCK x BLOCK numbers.
BLOCK = 256
#: Rows of one slab, and pairs of blocks (for each n) whose sums a task holds before it gives them out.
SLAB, HELD = 4096, 32
_SUMS = "a long, b long, n long, joint long, spread double"
_MOMENTS = "ia long, ib long, joint long, mean double, variance double, exact_mean string, exact_variance string"


def _slab(ids: pa.Array, values: pa.Array, rows: int) -> np.ndarray:
    out = np.zeros((rows, BLOCK))
    ends = np.diff(ids.offsets.to_numpy())
    out[np.repeat(np.arange(rows), ends), ids.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int, int], list[np.ndarray]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (x, y, of), (joint, spread) in held.items():
            i, j = np.nonzero(joint)
            keep = slice(None) if x != y else i < j
            i, j = i[keep], j[keep]
            columns = [x * BLOCK + i, y * BLOCK + j, np.full(len(i), of), joint[i, j].astype(np.int64), spread[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n", "joint", "spread"])
        held.clear()

    for batch in batches:
        # slabs of one pair of blocks and one n, so that products of counts stay whole numbers
        x, y, n = (batch.column(c).to_numpy() for c in ("x", "y", "n"))
        order = np.lexsort((n, y, x))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(n[order]) != 0)]))
        for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
            for at in range(start, end, SLAB):
                part = batch.take(pa.array(order[at : min(at + SLAB, end)]))
                of = int(n[order[at]])
                left, right = (_slab(part.column(f"ids_{s}"), part.column(f"m_{s}"), part.num_rows) for s in "xy")
                key = (int(x[order[at]]), int(y[order[at]]), of)
                if key not in held and len(held) >= HELD:
                    yield from given()
                joint, spread = held.setdefault(key, [np.zeros((BLOCK, BLOCK)) for _ in range(2)])
                joint += left.T @ right
                if of > 1:
                    spread += (left * (of - left)).T @ (right * (of - right))
    yield from given()


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of pairs whose whole sums for each n are lists: exact fractions, rounded once."""
    for batch in batches:
        ia, ib, sums = (batch.column(c).to_pylist() for c in ("ia", "ib", "sums"))
        sizes = {s["n"] for own in sums for s in own}
        whole, square = lcm(*sizes), lcm(*(n * n * (n - 1) for n in sizes if n > 1))
        parts = {n: (whole // n, square // (n * n * (n - 1)) if n > 1 else 0) for n in sizes}
        joint = [sum(s["joint"] for s in own) for own in sums]
        mean = [sum(s["joint"] * parts[s["n"]][0] for s in own) for own in sums]
        variance = [sum(int(s["spread"]) * parts[s["n"]][1] for s in own) for own in sums]
        rounded = [pa.array([x / of for x in xs], pa.float64()) for xs, of in ((mean, whole), (variance, square))]
        exact = [pa.array([f"{x:x}/{of:x}" for x in xs], pa.string()) for xs, of in ((mean, whole), (variance, square))]
        yield pa.RecordBatch.from_arrays([pa.array(ia, pa.int64()), pa.array(ib, pa.int64()), pa.array(joint, pa.int64()), *rounded, *exact], ["ia", "ib", "joint", "mean", "variance", "exact_mean", "exact_variance"])


def _fraction(text: str) -> Fraction:
    return Fraction(*(int(x, 16) for x in text.split("/")))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = []
        for joint, mean, variance in zip(*(batch.column(c).to_pylist() for c in ("joint", "exact_mean", "exact_variance")), strict=True):
            off, spread = joint - _fraction(mean), _fraction(variance)
            z.append(copysign(sqrt(off * off / spread), off) if spread else None)
        yield batch.append_column("z", pa.array(z, pa.float64()))


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (joint, exact_mean, exact_variance) with z = (joint - mean) / sqrt(variance), from one exact fraction; null at variance 0."""
    return pairs.mapInArrow(_scores, StructType([*pairs.schema.fields, StructField("z", DoubleType())]))


class Numbered:
    """Categories with numbers from 0 in their order, and whether they fill more than one block."""

    def __init__(self, categories: DataFrame, block: int = BLOCK) -> None:
        """``block`` below BLOCK is for tests."""
        self.block = block
        own = stored(categories.select("category").distinct(), "categories")
        self.several = own.limit(block + 1).count() > block
        if self.several:
            self.table = stored(ranked(own, [F.col("category").asc()], name="id"), "numbers")
        else:  # a window over one block at most
            self.table = own.withColumn("id", (F.row_number().over(Window.orderBy("category")) - 1).cast("long"))


def pair_sums(rows: DataFrame, keys: list[str], categories: Numbered) -> DataFrame:
    """a < b, joint, mean, variance, exact_mean, exact_variance (fractions as hex text) over rows (keys, category, n, m): the category's count m of the key's n.

    joint sums m_a m_b; mean sums m_a m_b / n and variance m_a (n - m_a) m_b (n - m_b) / (n n (n - 1)), the moments of
    overlaps of independent draws. Categories without a number do not count.
    """
    named, block = categories.table, categories.block
    placed = rows.join(named, "category").withColumns({"x": F.floor(F.col("id") / block), "at": (F.col("id") % block).cast("int")})
    # dealt by key at a fixed number of parts: the lists are small, the work on them is not
    placed = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    lists = placed.groupBy(*keys, "n", "x").agg(F.collect_list(F.struct("at", F.col("m").cast("long").alias("m"))).alias("own"))
    lists = lists.select(*keys, "n", "x", F.col("own.at").alias("ids"), F.col("own.m").alias("m"))
    sides = [lists.select(*keys, "n", *(F.col(c).alias(f"{c}_{s}") for c in ("x", "ids", "m"))) for s in "xy"]
    if categories.several:
        both = sides[0].join(sides[1].drop("n"), keys).where("x_x <= x_y")
    else:  # every list meets itself alone
        both = sides[0].withColumns({f"{c}_y": F.col(f"{c}_x") for c in ("x", "ids", "m")})
    both = both.select(F.col("n").cast("long").alias("n"), F.col("x_x").alias("x"), F.col("x_y").alias("y"), "ids_x", "m_x", "ids_y", "m_y")
    sums = both.mapInArrow(_products, _SUMS)
    # numbers in a task count in blocks of BLOCK; with smaller blocks the rest of each stays empty
    number = lambda c: F.floor(F.col(c) / BLOCK) * block + F.col(c) % BLOCK
    by_n = sums.groupBy(number("a").alias("ia"), number("b").alias("ib"), "n").agg(F.sum("joint").alias("joint"), F.sum("spread").alias("spread"))
    # a pair's list has one entry for each n
    total = by_n.groupBy("ia", "ib").agg(F.collect_list(F.struct("n", "joint", "spread")).alias("sums")).mapInArrow(_moments, _MOMENTS)
    a, b = (named.select(F.col("id").alias(f"i{c}"), F.col("category").alias(c)) for c in "ab")
    return total.join(a, "ia").join(b, "ib").select("a", "b", "joint", "mean", "variance", "exact_mean", "exact_variance")
