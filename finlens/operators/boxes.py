"""Regions by a table of bounding boxes (D8, E42): a grid index, an equi-join
and the box of the smallest priority.

A box belongs to the finest of ``LEVELS`` grids whose cells are as large as
the box, so it covers four cells at most, however large it is.  A coordinate
falls in one cell of every grid that has boxes; (grid, cell) is the join key,
the exact bounds are tested on the pairs found, and each coordinate keeps its
smallest priority.  Equal coordinates are one row before the join, so a place
with a third of all rows is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 14
SPAN = 360.0
BOX_SCHEMA = "priority bigint, region string, lat_low double, lat_high double, lon_low double, lon_high double"
OTHER = "Other"


def box_table(spark: SparkSession, boxes: Iterable[tuple]) -> DataFrame:
    """Boxes in order of their priority: (region, lat_low, lat_high, lon_low,
    lon_high); a coordinate is inside when lat_low < lat < lat_high and
    lon_low <= lon < lon_high, None being no bound."""
    return spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], BOX_SCHEMA)


def _cell(value: Column, level: Column) -> Column:
    """Cell of a degree in -180 .. 180; what lies outside counts as the edge."""
    size = F.lit(SPAN) / F.pow(F.lit(2.0), level)
    index = F.floor((F.least(F.greatest(value, F.lit(-180.0)), F.lit(180.0)) + 180.0) / size)
    return index.cast("int")


def _boxes_by_cell(boxes: DataFrame) -> DataFrame:
    sides = {c: F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in
             (("lat_low", -180.0), ("lat_high", 180.0), ("lon_low", -180.0), ("lon_high", 180.0))}
    rows = boxes.select("priority", "region", "lat_low", "lat_high", "lon_low", "lon_high",
                        *[F.least(F.greatest(x, F.lit(-180.0)), F.lit(180.0)).alias(f"_{c}") for c, x in sides.items()])
    rows = rows.where("_lat_low <= _lat_high AND _lon_low <= _lon_high")
    widest = F.greatest(F.col("_lat_high") - F.col("_lat_low"), F.col("_lon_high") - F.col("_lon_low"), F.lit(SPAN / 2**LEVELS))
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(SPAN) / widest)))).cast("int"))
    cells = {c: F.sequence(_cell(F.col(f"_{c}_low"), F.col("level")), _cell(F.col(f"_{c}_high"), F.col("level")))
             for c in ("lat", "lon")}
    rows = rows.withColumn("cell_lat", F.explode(cells["lat"]))
    rows = rows.withColumn("cell_lon", F.explode(cells["lon"]))
    return rows.select("level", "cell_lat", "cell_lon", "priority", "region", "lat_low", "lat_high", "lon_low", "lon_high")


def coordinate_regions(coordinates: DataFrame, boxes: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(lat, lon, region, priority) of the distinct coordinates that a box
    holds; a null longitude counts as 0, a null latitude is in no box."""
    points = coordinates.select(F.col(lat).cast("double").alias("lat"), F.coalesce(F.col(lon).cast("double"), F.lit(0.0)).alias("lon"))
    points = points.where("lat IS NOT NULL").distinct()
    indexed = _boxes_by_cell(boxes)
    # the grids that hold boxes: at most LEVELS + 1 numbers
    used = indexed.agg(F.sort_array(F.collect_set("level")).alias("l")).scalar()
    points = points.withColumn("level", F.explode(used))
    points = points.select("lat", "lon", "level", _cell(F.col("lat"), F.col("level")).alias("cell_lat"),
                           _cell(F.col("lon"), F.col("level")).alias("cell_lon"))
    met = points.join(indexed, ["level", "cell_lat", "cell_lon"])
    inside = ((F.col("lat_low").isNull() | (F.col("lat") > F.col("lat_low")))
              & (F.col("lat_high").isNull() | (F.col("lat") < F.col("lat_high")))
              & (F.col("lon_low").isNull() | (F.col("lon") >= F.col("lon_low")))
              & (F.col("lon_high").isNull() | (F.col("lon") < F.col("lon_high"))))
    first = met.where(inside).groupBy("lat", "lon").agg(F.min(F.struct("priority", "region")).alias("b"))
    return first.select("lat", "lon", "b.region", "b.priority")


def region_totals(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """E42 over a box table: deals and committed value (null as 0) per region,
    'Other' for coordinates in no box; rows without a valid latitude are
    skipped."""
    valid = rows.where(F.col("latitude").between(-90, 90)).select(
        F.col("latitude").cast("double").alias("lat"), F.coalesce(F.col("longitude").cast("double"), F.lit(0.0)).alias("lon"),
        F.coalesce(F.col("committed_usd"), F.lit(0.0)).alias("value"))
    places = valid.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("deals"), F.sum("value").alias("value"))
    known = coordinate_regions(places, boxes, "lat", "lon")
    return (
        places.join(known, ["lat", "lon"], "left")
        .groupBy(F.coalesce("region", F.lit(OTHER)).alias("region"))
        .agg(F.sum("deals").alias("deals"), F.sum("value").alias("committed_usd"))
        .orderBy(F.col("committed_usd").desc(), F.col("region"))
    )
