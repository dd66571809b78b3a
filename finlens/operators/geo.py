"""Geography: centroids, coordinate resolution with fallbacks, region
rollups and shares, bounding-box regions and zone assignment (D4, D5, D7,
D8, E30-E33, E42).

Dimension tables (report rows, aliases, fallback coordinates, region
totals) are inputs; the ones below are the fixed lists the browser app
carries.  Only those fixed lists are broadcast explicitly (their size is
known); dimension inputs are equi-joined and left to AQE's runtime size
check.  The
per-sector numbering of D7 uses the skew-safe ranking, not a window over a
whole sector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.functions.text import title_case_words
from finlens.operators.ranking import row_number_within

RATIO_DIGITS = 6
# sums of amounts in billions are exact multiples of 1e-9 up to float noise
BILLIONS_DIGITS = 9
NOT_SPECIFIED = "Not Specified"
OTHER_ZONE = "Other"

# --- fixed values: synthetic investment zones per sector (sector, slot, lat, lon)
ZONES = [
    ("Metals", 0, -2.85, 121.97), ("Metals", 1, 0.37, 127.83), ("Metals", 2, -1.53, 127.63),
    ("Metals", 3, -4.0, 121.6), ("Metals", 4, -3.5, 122.1),
    ("Energy", 0, -1.2, 116.8), ("Energy", 1, -6.9, 110.4), ("Energy", 2, 1.5, 104.4),
    ("Energy", 3, -1.5, 121.4), ("Energy", 4, -8.6, 116.3),
    ("Transport", 0, -6.2, 106.85), ("Transport", 1, -7.25, 112.75), ("Transport", 2, -6.57, 107.75),
    ("Transport", 3, -6.33, 107.16), ("Transport", 4, -6.97, 110.42),
    ("Technology", 0, -6.21, 106.82), ("Technology", 1, -6.91, 107.61), ("Technology", 2, -6.3, 106.64),
    ("Technology", 3, 1.05, 104.03),
    ("Real Estate", 0, -6.18, 106.83), ("Real Estate", 1, -8.65, 115.22), ("Real Estate", 2, -6.74, 106.8),
    ("Real Estate", 3, -6.18, 106.63),
    ("Finance", 0, -6.23, 106.81), ("Finance", 1, -6.21, 106.82), ("Finance", 2, -6.24, 106.83),
    ("Agriculture", 0, -0.5, 117.0), ("Agriculture", 1, 2.0, 99.8), ("Agriculture", 2, -1.3, 120.8),
    ("Agriculture", 3, -7.5, 110.0),
    ("Logistics", 0, -6.1, 106.88), ("Logistics", 1, -7.2, 112.73), ("Logistics", 2, -6.4, 107.9),
    ("Logistics", 3, 3.35, 99.42),
    ("Chemicals", 0, -6.0, 106.05), ("Chemicals", 1, -7.16, 112.65), ("Chemicals", 2, -6.9, 112.05),
    ("Chemicals", 3, 5.18, 97.15),
    ("Other", 0, -6.2, 106.85), ("Other", 1, -6.4, 106.1), ("Other", 2, -6.3, 107.3),
]


def box_region(lat: Column, lon: Column) -> Column:
    """First matching box wins, else 'Other'; a missing longitude counts
    as 0.  Fixed boxes of the browser app, in priority order."""
    lng = F.coalesce(lon, F.lit(0.0))
    return (
        F.when((lat > -7) & (lat < 7) & (lng < 108), "Sumatra")
        .when((lat > -9) & (lat < -5) & (lng >= 105) & (lng < 115), "Java")
        .when((lat > -5) & (lat < 5) & (lng >= 108) & (lng < 118), "Kalimantan")
        .when((lat > -6) & (lat < 3) & (lng >= 118) & (lng < 128), "Sulawesi")
        .when((lat > -10) & (lat < -7) & (lng >= 115) & (lng < 125), "Nusa Tenggara")
        .when((lng >= 125) & (lng < 136), "Maluku")
        .when(lng >= 136, "Papua")
        .otherwise("Other")
    )
# ------------------------------------------------------------------------------


def zones_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone_sector string, slot int, zone_lat double, zone_lon double")


def province_centroids(projects: DataFrame) -> DataFrame:
    """Mean latitude / longitude per normalised province (lower, trim,
    blank dropped) over rows that have both coordinates."""
    key = F.nullif(F.lower(F.trim(F.col("province"))), F.lit(""))
    return (
        projects.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(key.alias("province_key"), "latitude", "longitude")
        .where(F.col("province_key").isNotNull())
        .groupBy("province_key")
        .agg(
            F.round(F.avg("latitude"), RATIO_DIGITS).alias("lat"),
            F.round(F.avg("longitude"), RATIO_DIGITS).alias("lon"),
            F.count(F.lit(1)).alias("projects"),
        )
    )


def resolve_report_coordinates(report: DataFrame, centroids: DataFrame, aliases: DataFrame,
                               province_fallback: DataFrame, region_fallback: DataFrame) -> DataFrame:
    """Report row -> (lat, lon) by alias -> data centroid -> province
    fallback -> region fallback; ``coordinate_source`` says which one won.

    ``report``: region, province_name, ...; ``aliases``: name_key, alias_key;
    ``province_fallback``: province_name, lat, lon; ``region_fallback``:
    region, lat, lon.  All lookups are left equi-joins; AQE broadcasts a
    dimension side when its runtime size is under the threshold.
    """
    key = F.lower(F.trim(F.col("province_name")))
    r = report.withColumn("_name_key", key)
    a = aliases.select(F.col("name_key").alias("_name_key"), F.col("alias_key").alias("_alias"))
    c = centroids.select(F.col("province_key").alias("_lookup"), F.col("lat").alias("_c_lat"),
                         F.col("lon").alias("_c_lon"))
    pf = province_fallback.select(F.col("province_name").alias("_pf_name"), F.col("lat").alias("_p_lat"),
                                  F.col("lon").alias("_p_lon"))
    rf = region_fallback.select(F.col("region").alias("_rf_region"), F.col("lat").alias("_r_lat"),
                                F.col("lon").alias("_r_lon"))
    out = (
        r.join(a, "_name_key", "left")
        .withColumn("_lookup", F.coalesce(F.col("_alias"), F.col("_name_key")))
        .join(c, "_lookup", "left")
        .join(pf, F.col("province_name") == F.col("_pf_name"), "left")
        .join(rf, F.col("region") == F.col("_rf_region"), "left")
    )
    source = (F.when(F.col("_c_lat").isNotNull(), F.lit("centroid"))
              .when(F.col("_p_lat").isNotNull(), F.lit("province_fallback"))
              .when(F.col("_r_lat").isNotNull(), F.lit("region_fallback")))
    lat = F.when(F.col("_c_lat").isNotNull(), F.col("_c_lat")).when(F.col("_p_lat").isNotNull(), F.col("_p_lat")) \
        .otherwise(F.col("_r_lat"))
    lon = F.when(F.col("_c_lat").isNotNull(), F.col("_c_lon")).when(F.col("_p_lat").isNotNull(), F.col("_p_lon")) \
        .otherwise(F.col("_r_lon"))
    keep = [c for c in report.columns]
    return out.select(*keep, lat.alias("lat"), lon.alias("lon"), source.alias("coordinate_source"))


def region_rollup(report: DataFrame) -> DataFrame:
    """Project value and count summed per region, largest first."""
    return (
        report.groupBy("region")
        .agg(F.round(F.sum("project_value_b"), BILLIONS_DIGITS).alias("project_value_b"),
             F.sum("project_count").alias("project_count"))
        .orderBy(F.col("project_value_b").desc(), F.col("region"))
    )


def region_shares(capex: DataFrame, include_unspecified: bool = False) -> DataFrame:
    """E32 + E33 + C10: per region its China CAPEX and share of all-source
    CAPEX, with portfolio-level columns: total, the 'Not Specified' amount
    and share, and the top specified region with its share of specified.

    The totals are one aggregate and the top region a one-row TakeOrdered
    (ties go to the alphabetically first region), both attached as scalar
    subqueries.
    """
    is_ns = F.col("region") == F.lit(NOT_SPECIFIED)
    china = F.col("china_capex_b")
    spec_value = F.when(~is_ns, china)
    totals = capex.agg(
        F.round(F.sum(china), BILLIONS_DIGITS).alias("total_china_capex_b"),
        F.round(F.sum(F.when(is_ns, china)), BILLIONS_DIGITS).alias("not_specified_capex_b"),
        F.sum(spec_value).alias("_spec_total"),
    )
    top = (capex.where(~is_ns & china.isNotNull()).orderBy(china.desc(), F.col("region")).limit(1)
           .select(F.struct("region", "china_capex_b")).scalar())
    t = totals.select(F.struct(*totals.columns)).scalar()
    rows = capex if include_unspecified else capex.where(~is_ns)
    return rows.select(
        "region",
        "china_capex_b",
        "all_source_capex_b",
        F.round(china / F.nullif(F.col("all_source_capex_b"), F.lit(0.0)), RATIO_DIGITS).alias(
            "china_share_of_all_sources"),
        t["total_china_capex_b"].alias("total_china_capex_b"),
        t["not_specified_capex_b"].alias("not_specified_capex_b"),
        F.round(F.coalesce(F.lit(100.0) * t["not_specified_capex_b"]
                           / F.nullif(t["total_china_capex_b"], F.lit(0.0)), F.lit(0.0)),
                RATIO_DIGITS).alias("not_specified_share_pct"),
        top["region"].alias("top_region"),
        F.round(F.coalesce(F.lit(100.0) * top["china_capex_b"] / F.nullif(t["_spec_total"], F.lit(0.0)),
                           F.lit(0.0)), RATIO_DIGITS).alias("top_region_share_pct"),
    )


def region_points(capex: DataFrame, region_coords: DataFrame) -> DataFrame:
    """Regions with a known coordinate (inner join; unmatched dropped)."""
    return capex.join(region_coords.select("region", "lat", "lon"), "region", "inner")


def box_regions(rows: DataFrame) -> DataFrame:
    """D8 + E42: deals and committed value (null as 0) per bounding-box
    region; rows without a valid latitude are skipped."""
    lat = F.col("latitude")
    valid = rows.where(lat.isNotNull() & (lat <= 90) & (lat >= -90))
    return (
        valid.select(box_region(lat, F.col("longitude")).alias("region"), "committed_usd")
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("deals"),
             F.coalesce(F.sum(F.coalesce(F.col("committed_usd"), F.lit(0.0))), F.lit(0.0)).alias("committed_usd"))
        .orderBy(F.col("committed_usd").desc(), F.col("region"))
    )


def assign_zones(rows: DataFrame, zones: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """D7 + W2: the k-th project (by project_id) of each sector label goes to
    zone ``k mod n`` of that sector's zone list ('Other' zones when the
    sector has none).  Coordinates are synthetic (``is_synthetic``); the
    browser's random jitter is not reproduced.

    Numbering within a sector is the skew-safe ``row_number_within`` (one
    sector may hold a third of all rows)."""
    spark = rows.sparkSession
    # our own list has a fixed size; a caller's list is left to the planner
    z = zones if zones is not None else F.broadcast(zones_frame(spark))
    counts = z.groupBy("zone_sector").agg(F.count(F.lit(1)).alias("n_zones"))
    if zones is None:
        counts = F.broadcast(counts)
    label = F.coalesce(F.nullif(title_case_words("sector"), F.lit("")), F.lit(OTHER_ZONE))
    labelled = rows.select("project_id", "sector", label.alias("sector_label"), *keep)
    with_set = labelled.join(counts.select(F.col("zone_sector").alias("sector_label"), "n_zones"),
                             "sector_label", "left")
    with_set = with_set.withColumn("zone_sector", F.when(F.col("n_zones").isNotNull(), F.col("sector_label"))
                                   .otherwise(F.lit(OTHER_ZONE)))
    numbered = row_number_within(with_set.drop("n_zones"), ["sector_label"], ["project_id"], "sector_rank")
    sized = numbered.join(counts, "zone_sector")
    slotted = sized.withColumn("slot", F.pmod(F.col("sector_rank") - 1, F.col("n_zones")).cast("int"))
    return slotted.join(z, ["zone_sector", "slot"]).select(
        "project_id",
        "sector_label",
        F.col("sector_rank").cast("bigint").alias("sector_rank"),
        "zone_sector",
        "slot",
        F.col("zone_lat").alias("latitude"),
        F.col("zone_lon").alias("longitude"),
        F.lit(True).alias("is_synthetic"),
        *keep,
    )


def report_top_provinces(report: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` report provinces by project value and by
    per-capita value (a missing per-capita value sorts as 0).  Two bounded
    TakeOrdered selections, unioned."""
    from pyspark.sql.window import Window

    def head(score: Column, label: str) -> DataFrame:
        ranked = (report.select("province_name", score.alias("score"))
                  .orderBy(F.col("score").desc(), F.col("province_name")).limit(top))
        w = Window.orderBy(F.col("score").desc(), F.col("province_name"))
        return ranked.select(F.lit(label).alias("ranking"), F.row_number().over(w).cast("int").alias("position"),
                             "province_name", "score")

    return head(F.col("project_value_b"), "value").unionByName(
        head(F.coalesce(F.col("per_capita_usd"), F.lit(0.0)), "per_capita"))
