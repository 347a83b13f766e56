"""Structured place queries: one conjunctive predicate, counts, groups and deterministic pages.

Rules for nulls: a null operating status is unspecified and matches no status; excluding hosted services keeps rows
whose flag is null; a null confidence never meets a minimum; null categories form one group, listed last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.operators import ranks

#: Contact lists stay out of the default projection.
CONTACT_COLUMNS = ("websites", "phones", "emails")
SORT_FIELDS = ("name_primary", "taxonomy_primary", "basic_category", "confidence", "address_locality", "address_postcode", "gers_id")
GROUP_FIELDS = ("taxonomy_primary", "basic_category", "address_locality", "operating_status")
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET = 100, 1000, 1_000_000


@dataclass(frozen=True)
class PlaceFilter:
    """All parts are optional but the county; text parts match exactly or, with ``contains``, as ILIKE patterns."""

    county: str
    taxonomy: str | None = None
    basic_category: str | None = None
    locality: str | None = None
    contains: bool = False
    hierarchy: str | None = None
    name: str | None = None
    normalized_name: str | None = None
    postcode: str | None = None
    status: str | None = None
    hosted: str = "include"  # include, exclude or only
    min_confidence: float | None = None


def normalized(name: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def _normal_text(value: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", value.lower()).strip(" ")


def _like(column: str, value: str) -> Column:
    # wildcards in the value stay wildcards; a backslash stands for itself
    return F.col(column).ilike("%" + value.replace("\\", "\\\\") + "%")


def _text(column: str, value: str, contains: bool) -> Column:
    value = value.strip()
    return _like(column, value) if contains else F.lower(column) == value.lower()


def predicate(f: PlaceFilter) -> Column:
    parts = [F.col("county_key") == f.county]
    parts += [_text(c, v, f.contains) for c, v in (("taxonomy_primary", f.taxonomy), ("basic_category", f.basic_category), ("address_locality", f.locality)) if v is not None]
    if f.hierarchy is not None:
        parts.append(F.array_contains(F.split(F.lower(F.coalesce("taxonomy_hierarchy", F.lit(""))), "/"), f.hierarchy.strip().lower()))
    if f.name is not None:
        parts.append(_like("name_primary", f.name.strip()))
    if f.normalized_name is not None:
        parts.append(normalized(F.col("name_primary")).contains(_normal_text(f.normalized_name)))
    if f.postcode is not None:
        parts.append(F.col("address_postcode") == f.postcode)
    if f.status is not None:
        parts.append(F.lower("operating_status") == f.status.lower())
    if f.hosted == "exclude":
        parts.append(~F.col("is_hosted_service").eqNullSafe(True))
    elif f.hosted == "only":
        parts.append(F.col("is_hosted_service").eqNullSafe(True))
    if f.min_confidence is not None:
        parts.append(F.col("confidence") >= f.min_confidence)
    return reduce(and_, parts)


def rows(places: DataFrame, f: PlaceFilter) -> DataFrame:
    """The default projection with the derived name; filters and columns reach the scan."""
    own = [c for c in places.columns if c not in CONTACT_COLUMNS]
    return places.where(predicate(f)).select(*own, normalized(F.col("name_primary")).alias("normalized_name"))


def count(places: DataFrame, f: PlaceFilter) -> DataFrame:
    return places.where(predicate(f)).agg(F.count("*").alias("n"))


def totals(places: DataFrame, f: PlaceFilter, by: str = "taxonomy_primary") -> DataFrame:
    """Rows and groups; nulls form one group."""
    null_group = F.coalesce(F.max(F.col(by).isNull().cast("int")), F.lit(0))
    return places.where(predicate(f)).agg(F.count("*").alias("total_rows"), (F.count_distinct(by) + null_group).alias("total_groups"))


def group(places: DataFrame, f: PlaceFilter, by: str = "taxonomy_primary", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Groups by size, then name, nulls last; paged where a limit is given."""
    if by not in GROUP_FIELDS:
        raise ValueError(f"cannot group by {by}")
    out = places.where(predicate(f)).groupBy(F.col(by).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category"))
    return out if limit is None else out.offset(_offset(offset)).limit(_limit(limit))


def page(places: DataFrame, f: PlaceFilter, sort: str = "gers_id", descending: bool = False, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page of rows; nulls last, ties by gers_id."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort}")
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return ranks.page(rows(places, f), [first, F.asc("gers_id")], _limit(limit), _offset(offset))


def _limit(n: int) -> int:
    return max(1, min(n, MAX_LIMIT))


def _offset(n: int) -> int:
    return max(0, min(n, MAX_OFFSET))


def publication(places: DataFrame) -> DataFrame:
    """Identity of a release: extremes, distinct and null counts, and the joined text."""
    return places.agg(
        F.min("overture_release").alias("release_min"),
        F.max("overture_release").alias("release_max"),
        F.count_distinct("overture_release").alias("releases"),
        F.count_if(F.col("overture_release").isNull()).alias("null_releases"),
    ).withColumn("identity", F.concat_ws(";", "release_min", F.when(F.col("release_max") != F.col("release_min"), F.col("release_max"))))
