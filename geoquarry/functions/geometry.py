"""Coordinates, areas and grid cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

METERS_PER_LATITUDE_DEGREE = 111_320.0
GRID_SIZES = (400, 800, 1600)
POLAR_COSINE = 1e-6


def valid_coordinate(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Present, finite and in range; NaN and infinities fail ``between``."""
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180), F.lit(False))


def in_box(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Inclusive on all sides."""
    return F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon)


def in_polygon(ring: Column, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Even-odd ray cast over a ring of (lat, lon) structs, closed implicitly, edges half open."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + n - 1) % n)
        spans = (a["lat"] > F.col(lat)) != (b["lat"] > F.col(lat))
        # division by zero cannot be reached where the edge spans the latitude
        at = (b["lon"] - a["lon"]) * (F.col(lat) - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return spans & (F.col(lon) < at)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


@dataclass(frozen=True)
class Grid:
    """Steps of a global grid of square cells at a reference latitude."""

    size: int
    reference_latitude: float
    lat_step: float
    lon_step: float

    def lat_index(self, lat: str = "latitude") -> Column:
        return F.floor((F.col(lat) + 90) / self.lat_step)

    def lon_index(self, lon: str = "longitude") -> Column:
        return F.floor((F.col(lon) + 180) / self.lon_step)


def grid_definition(size: int, min_lat: float | None, max_lat: float | None) -> Grid:
    """Refuses polar or missing bounds."""
    if size not in GRID_SIZES:
        raise ValueError(f"grid sizes are {GRID_SIZES}")
    if min_lat is None or max_lat is None:
        raise ValueError("no latitude to build a grid on")
    middle = (min_lat + max_lat) / 2
    cosine = math.cos(middle * math.pi / 180)
    if not -90 <= middle <= 90 or abs(cosine) <= POLAR_COSINE:
        raise ValueError("polar or degenerate latitude bounds")
    return Grid(size, middle, size / METERS_PER_LATITUDE_DEGREE, size / (METERS_PER_LATITUDE_DEGREE * cosine))


def stratum_id(lat_idx: str = "lat_idx", lon_idx: str = "lon_idx", density: str = "density") -> Column:
    """Parent cell of 8 x 8 and the power of two of the density."""
    return F.concat_ws(":", F.floor(F.col(lat_idx) / 8).cast("string"), F.floor(F.col(lon_idx) / 8).cast("string"), (F.length(F.bin(density)) - 1).cast("string"))
