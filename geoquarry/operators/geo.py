"""Selection and sums by box or polygon, one area or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoquarry.functions.geometry import in_box, in_polygon, valid_coordinate
from geoquarry.sources.scratch import stored

#: Degrees of the finest grid's cells.
CELL = 1 / 64
#: Points of one cell that may meet its areas in one task.
HOT_CELL = 100_000


def validate_areas(areas: DataFrame) -> DataFrame:
    """``error`` (null if fit) for areas (area_id, min_lat, max_lat, min_lon, max_lon, ring); a box wins over a ring."""
    box = F.col("min_lat").isNotNull() & F.col("max_lat").isNotNull() & F.col("min_lon").isNotNull() & F.col("max_lon").isNotNull()
    error = (
        F.when(box & ((F.col("min_lat") > F.col("max_lat")) | (F.col("min_lon") > F.col("max_lon"))), "the box is inverted")
        .when(box, F.lit(None))
        .when(F.col("ring").isNull(), "no area is given")
        .when(F.size("ring") < 3, "a polygon needs three vertices")
    )
    return areas.withColumns({"is_box": box, "error": error})


def _bounds(areas: DataFrame) -> DataFrame:
    """Areas with the box that holds them."""
    out = validate_areas(areas).where("error is null")
    ring = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    return out.withColumns({f"{'lo' if f is F.array_min else 'hi'}_{k}": F.when(F.col("is_box"), F.col(f"{'min' if f is F.array_min else 'max'}_{k}")).otherwise(ring(f, k)) for f in (F.array_min, F.array_max) for k in ("lat", "lon")})


def area_join(points: DataFrame, areas: DataFrame, hot: int = HOT_CELL) -> DataFrame:
    """Points (latitude, longitude, ...) with the id of every area that holds them.

    Areas and points meet on grids whose cells double from CELL on: an area is on the grid where it covers four cells at
    most, and a point on every grid that has areas (a few dozen exist), so no pair is tried that shares no cell. A cell of
    more than ``hot`` points is split: its points are dealt over parts of about ``hot``, and its areas are in every part.
    """
    own = points.where(valid_coordinate())
    span = F.greatest(F.col("hi_lat") - F.col("lo_lat"), F.col("hi_lon") - F.col("lo_lon"))
    bounded = _bounds(areas).withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(CELL)) / CELL))).cast("int"))
    levels = [r[0] for r in bounded.select("__level").distinct().collect()]

    def cell(c: str) -> F.Column:
        return F.floor(F.col(c) / (CELL * F.pow(F.lit(2.0), F.col("__level"))))

    celled = bounded.withColumn("__lat", F.explode(F.sequence(cell("lo_lat"), cell("hi_lat")))).withColumn("__lon", F.explode(F.sequence(cell("lo_lon"), cell("hi_lon"))))
    inside = in_box(F.col("lo_lat"), F.col("hi_lat"), F.col("lo_lon"), F.col("hi_lon")) & (F.col("is_box") | in_polygon(F.col("ring")))
    placed = own.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"__lat": cell("latitude"), "__lon": cell("longitude")})
    # cells of areas that hold many points, counted before anything is dealt: fewer than one for every ``hot`` points and grid
    cells = celled.select("__level", "__lat", "__lon").distinct()
    counts = placed.groupBy("__level", "__lat", "__lon").agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    crowded = stored(counts.join(cells, ["__level", "__lat", "__lon"], "left_semi").withColumn("__parts", F.ceil(F.col("__n") / hot).cast("int")).drop("__n"), "crowded")
    if crowded.limit(1).count():
        # by the row's own values, so that a repeated task deals it to the same part
        values = [c for c, t in points.dtypes if "map<" not in t and "variant" not in t]
        dealt = F.pmod(F.xxhash64(*values), F.coalesce("__parts", F.lit(1)))
        placed = placed.join(crowded, ["__level", "__lat", "__lon"], "left").withColumn("__part", dealt.cast("int")).drop("__parts")
        celled = celled.join(crowded, ["__level", "__lat", "__lon"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
        return placed.join(celled, ["__level", "__lat", "__lon", "__part"]).where(inside).select("area_id", *points.columns)
    return placed.join(celled, ["__level", "__lat", "__lon"]).where(inside).select("area_id", *points.columns)


def area_sums(points: DataFrame, areas: DataFrame, value: str) -> DataFrame:
    """area_id, total (nulls count 0), n for every fit area, empty ones too."""
    sums = area_join(points, areas).groupBy("area_id").agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total"), F.count("*").alias("n"))
    return _bounds(areas).select("area_id").join(sums, "area_id", "left").select("area_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
