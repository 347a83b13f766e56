"""Text keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def county_key(name: Column) -> Column:
    """Trimmed of all white space, lower-cased, inner white space one hyphen."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\s+", "-")


def seed_hash(*parts: Column | str) -> Column:
    """SHA-256, as hex, of the parts joined by bars; null parts are left out."""
    return F.sha2(F.concat_ws("|", *parts), 256)
