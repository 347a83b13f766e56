"""Distances and digests of vectors, taxonomy distance, glosses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _scaled(v: Column) -> Column:
    top = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: x / top)


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine over doubles scaled by their largest entry, in [0, 1]; an error for unfit vectors."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")

    def unfit(v: Column) -> Column:
        return v.isNull() | (F.size(v) == 0) | F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists(v, lambda e: e != 0)

    bad = unfit(x) | unfit(y) | (F.size(x) != F.size(y))
    p, q = _scaled(x), _scaled(y)
    cosine = _dot(p, q) / (F.sqrt(_dot(p, p)) * F.sqrt(_dot(q, q)))
    return F.when(bad, F.raise_error(F.lit("vectors must be non-empty, of one length, finite and not zero")).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine)))


def store_distance(a: str, b: str) -> Column:
    """1 - cosine as a vector store gives it: not clamped, null for a zero vector."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    return 1 - _dot(x, y) / F.nullif(F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)), F.lit(0.0))


@F.pandas_udf(StringType())
def vector_hash(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256, as hex, over big-endian doubles with -0 as 0; Spark has no function from doubles to bytes."""
    import hashlib

    for s in vectors:
        held = s.notna().to_numpy()
        own = [np.asarray(v, dtype="f8") for v in s[held]]
        flat = memoryview((np.concatenate([np.zeros(0), *own]) + 0.0).astype(">f8").tobytes())
        ends = 8 * np.cumsum([0, *map(len, own)])
        out = np.full(len(s), None, object)
        out[held] = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        yield pd.Series(out)


@F.pandas_udf(StringType())
def float64_hex(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sixteen hex digits of a big-endian double."""
    for s in values:
        digits = s.to_numpy(">f8").tobytes().hex()
        yield pd.Series([digits[i : i + 16] for i in range(0, len(digits), 16)], dtype=object).where(s.notna().to_numpy(), None)


def taxonomy_distance(a: str, b: str) -> Column:
    """1 - 2 * (common beginning) / (both depths) of two paths; null paths, and paths without segments, give null."""
    x, y = (F.filter(F.split(F.col(p), "/"), lambda s: s != "") for p in (a, b))
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda s, t: s == t)
    common = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, s: F.struct((acc["on"] & s).alias("on"), (acc["n"] + (acc["on"] & s).cast("int")).alias("n")), lambda acc: acc["n"])
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 1 - 2 * common / (F.size(x) + F.size(y)))


def category_gloss(category: str, path: str) -> Column:
    """The text that stands for a category; null without a path. The wording is a fixed value."""
    return F.concat(F.lit("Overture category label: "), F.translate(category, "_", " "), F.lit(". Full taxonomy hierarchy: "), F.col(path), F.lit("."))
