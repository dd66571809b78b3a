"""Driver queries over the geography operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlens.operators import boxes as X
from finlens.operators import browser as B
from finlens.operators import geo as G
from finlens.plans.browser_queries import BROWSER_BASE
from finlens.plans.registry import register
from finlens.sources.dimensions import dimension, dimension_sql
from finlens.sources.fixtures import projects, with_projects
from finlens.sources.tables import read_table

CENTROID_SQL = """
SELECT lower(trim(province)) AS province_key, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon,
       count(*) AS projects
FROM projects WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND nullif(lower(trim(province)), '') IS NOT NULL
GROUP BY 1"""


@register("province_centroid", ["E30"], with_projects(CENTROID_SQL))
def province_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean project coordinates per province."""
    return G.province_centroids(projects(spark, sf_dir))


def _dims_cte(*names: str) -> str:
    return ",\n".join(f"{n} AS ({dimension_sql(n)})" for n in names)


@register("province_coordinates", ["D4", "E30", "A11"], with_projects(f"""
WITH {_dims_cte('province_report', 'aliases', 'province_fallback', 'region_fallback')},
c AS ({CENTROID_SQL}),
k AS (SELECT r.*, coalesce(a.alias_key, lower(trim(r.province_name))) AS lookup
      FROM province_report r LEFT JOIN aliases a ON a.name_key = lower(trim(r.province_name)))
SELECT k.region, k.province_name, k.project_value_b, k.project_count, k.per_capita_usd,
       CASE WHEN c.lat IS NOT NULL THEN c.lat WHEN pf.lat IS NOT NULL THEN pf.lat ELSE rf.lat END AS lat,
       CASE WHEN c.lat IS NOT NULL THEN c.lon WHEN pf.lat IS NOT NULL THEN pf.lon ELSE rf.lon END AS lon,
       CASE WHEN c.lat IS NOT NULL THEN 'centroid' WHEN pf.lat IS NOT NULL THEN 'province_fallback'
            WHEN rf.lat IS NOT NULL THEN 'region_fallback' END AS coordinate_source
FROM k LEFT JOIN c ON c.province_key = k.lookup
LEFT JOIN province_fallback pf ON pf.province_name = k.province_name
LEFT JOIN region_fallback rf ON rf.region = k.region"""))
def province_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report provinces placed by alias -> centroid -> province fallback ->
    region fallback."""
    return G.resolve_report_coordinates(
        dimension(spark, sf_dir, "province_report"),
        G.province_centroids(projects(spark, sf_dir)),
        dimension(spark, sf_dir, "aliases"),
        dimension(spark, sf_dir, "province_fallback"),
        dimension(spark, sf_dir, "region_fallback"),
    )


@register("region_rollup", ["E31", "A11"], with_projects(f"""
WITH {_dims_cte('province_report')}
SELECT region, round(sum(project_value_b), 9) AS project_value_b, CAST(sum(project_count) AS BIGINT) AS project_count
FROM province_report GROUP BY region"""))
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report value and project count per region."""
    return G.region_rollup(dimension(spark, sf_dir, "province_report"))


@register("region_unspecified_share", ["E32", "E33", "C10"], with_projects(f"""
WITH {_dims_cte('region_capex')},
t AS (SELECT round(sum(china_capex_b), 9) AS total_china_capex_b,
             round(sum(CASE WHEN region = 'Not Specified' THEN china_capex_b END), 9) AS not_specified_capex_b,
             sum(CASE WHEN region <> 'Not Specified' THEN china_capex_b END) AS spec_total FROM region_capex),
top AS (SELECT region AS top_region, china_capex_b AS top_value FROM region_capex
        WHERE region <> 'Not Specified' AND china_capex_b IS NOT NULL ORDER BY china_capex_b DESC, region LIMIT 1),
s AS (SELECT total_china_capex_b, not_specified_capex_b,
             round(coalesce(100.0 * not_specified_capex_b / nullif(total_china_capex_b, 0), 0.0), 6) AS not_specified_share_pct,
             top_region, round(coalesce(100.0 * top_value / nullif(spec_total, 0), 0.0), 6) AS top_region_share_pct
      FROM t LEFT JOIN top ON true)
SELECT region, china_capex_b, all_source_capex_b,
       round(china_capex_b / nullif(all_source_capex_b, 0), 6) AS china_share_of_all_sources, s.*
FROM region_capex CROSS JOIN s WHERE region <> 'Not Specified'"""))
def region_unspecified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional CAPEX shares with the unspecified bucket summarised."""
    return G.region_shares(dimension(spark, sf_dir, "region_capex"))


@register("region_map_points", ["D5"], with_projects(f"""
WITH {_dims_cte('region_capex', 'region_coords')}
SELECT c.region, c.included_provinces, c.china_capex_b, c.all_source_capex_b, k.lat, k.lon
FROM region_capex c JOIN region_coords k ON k.region = c.region"""))
def region_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a map coordinate (unmatched regions dropped)."""
    return G.region_points(dimension(spark, sf_dir, "region_capex"), dimension(spark, sf_dir, "region_coords"))


BOX_SQL = """
CASE WHEN latitude > -7 AND latitude < 7 AND coalesce(longitude, 0) < 108 THEN 'Sumatra'
     WHEN latitude > -9 AND latitude < -5 AND coalesce(longitude, 0) >= 105 AND coalesce(longitude, 0) < 115 THEN 'Java'
     WHEN latitude > -5 AND latitude < 5 AND coalesce(longitude, 0) >= 108 AND coalesce(longitude, 0) < 118 THEN 'Kalimantan'
     WHEN latitude > -6 AND latitude < 3 AND coalesce(longitude, 0) >= 118 AND coalesce(longitude, 0) < 128 THEN 'Sulawesi'
     WHEN latitude > -10 AND latitude < -7 AND coalesce(longitude, 0) >= 115 AND coalesce(longitude, 0) < 125 THEN 'Nusa Tenggara'
     WHEN coalesce(longitude, 0) >= 125 AND coalesce(longitude, 0) < 136 THEN 'Maluku'
     WHEN coalesce(longitude, 0) >= 136 THEN 'Papua' ELSE 'Other' END"""


def _zones_values() -> str:
    return ", ".join(f"('{s}', {slot}, CAST({lat!r} AS DOUBLE), CAST({lon!r} AS DOUBLE))" for s, slot, lat, lon in G.ZONES)


ZONES_SQL = BROWSER_BASE + f""",
z AS (SELECT * FROM (VALUES {_zones_values()}) v(zone_sector, slot, zone_lat, zone_lon)),
n AS (SELECT zone_sector, count(*) AS n_zones FROM z GROUP BY 1),
f AS (SELECT project_id, coalesce(nullif(sector, ''), 'Other') AS sector_label FROM d WHERE finance_type = 'FDI'),
l AS (SELECT f.*, CASE WHEN n.zone_sector IS NULL THEN 'Other' ELSE f.sector_label END AS zone_sector,
             row_number() OVER (PARTITION BY f.sector_label ORDER BY f.project_id) AS sector_rank
      FROM f LEFT JOIN n ON n.zone_sector = f.sector_label),
s AS (SELECT l.*, CAST((sector_rank - 1) % n.n_zones AS INTEGER) AS slot FROM l JOIN n ON n.zone_sector = l.zone_sector)"""


@register("zone_assignment", ["D7", "W2", "B13"], with_projects(ZONES_SQL + """
SELECT s.project_id, s.sector_label, CAST(s.sector_rank AS BIGINT) AS sector_rank, s.zone_sector, s.slot,
       z.zone_lat AS latitude, z.zone_lon AS longitude, true AS is_synthetic
FROM s JOIN z ON z.zone_sector = s.zone_sector AND z.slot = s.slot"""))
def zone_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin zone coordinates for FDI projects per sector label."""
    return G.assign_zones(B.browser_filter(projects(spark, sf_dir), finance_type="FDI"))


@register("region_boxes", ["D8", "E42", "D7"], with_projects(ZONES_SQL + f""",
a AS (SELECT z.zone_lat AS latitude, z.zone_lon AS longitude, d.committed_usd
      FROM s JOIN z ON z.zone_sector = s.zone_sector AND z.slot = s.slot
      JOIN d ON d.project_id = s.project_id AND d.finance_type = 'FDI')
SELECT {BOX_SQL} AS region, count(*) AS deals, coalesce(sum(coalesce(committed_usd, 0.0)), 0.0) AS committed_usd
FROM a WHERE latitude IS NOT NULL AND latitude BETWEEN -90 AND 90 GROUP BY 1"""))
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals and value per bounding-box region: FDI rows placed by the
    round-robin zones, then classified (browser rules)."""
    deals = B.browser_filter(projects(spark, sf_dir), finance_type="FDI")
    return G.box_regions(G.assign_zones(deals, keep=("committed_usd",)))


# a derived box table: one box per customer, of many sizes, overlapping
BOXES_SQL = """SELECT c_custkey AS priority, 'R' || CAST(c_custkey % 97 AS STRING) AS region,
       CASE WHEN c_custkey % 11 > 0 THEN (c_custkey * 37 % 1900 - 1100 - (1 + c_custkey % 17) * 5) / CAST(100 AS DOUBLE) END AS lat_low,
       (c_custkey * 37 % 1900 - 1100 + (1 + c_custkey % 17) * 5) / CAST(100 AS DOUBLE) AS lat_high,
       (c_custkey * 91 % 4600 + 9500 - (1 + c_custkey % 13) * 7) / CAST(100 AS DOUBLE) AS lon_low,
       CASE WHEN c_custkey % 19 > 0 THEN (c_custkey * 91 % 4600 + 9500 + (1 + c_custkey % 13) * 7) / CAST(100 AS DOUBLE) END AS lon_high
FROM {customer}"""


@register("region_box_table", ["D8", "E42"], with_projects(f"""
WITH boxes AS ({BOXES_SQL.format(customer='customer')}),
places AS (SELECT latitude, coalesce(longitude, 0) AS longitude, count(*) AS deals, sum(coalesce(committed_usd, 0.0)) AS value
           FROM projects WHERE latitude BETWEEN -90 AND 90 GROUP BY 1, 2),
hit AS (SELECT p.latitude, p.longitude, min_by(b.region, b.priority) AS region
        FROM places p JOIN boxes b ON (b.lat_low IS NULL OR p.latitude > b.lat_low) AND p.latitude < b.lat_high
             AND p.longitude >= b.lon_low AND (b.lon_high IS NULL OR p.longitude < b.lon_high)
        GROUP BY 1, 2)
SELECT coalesce(h.region, 'Other') AS region, CAST(sum(p.deals) AS BIGINT) AS deals, sum(p.value) AS committed_usd
FROM places p LEFT JOIN hit h ON h.latitude = p.latitude AND h.longitude = p.longitude GROUP BY 1"""))
def region_box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals and value per region of a table of overlapping boxes, the box of
    the smallest priority deciding."""
    boxes = spark.sql(BOXES_SQL, customer=read_table(spark, sf_dir, "customer", ["c_custkey"]))
    return X.region_totals(projects(spark, sf_dir), boxes)


@register("report_top_provinces", ["G10", "A11"], with_projects(f"""
WITH {_dims_cte('province_report')},
v AS (SELECT 'value' AS ranking, province_name, project_value_b AS score,
             row_number() OVER (ORDER BY project_value_b DESC, province_name) AS position FROM province_report),
c AS (SELECT 'per_capita' AS ranking, province_name, coalesce(per_capita_usd, 0.0) AS score,
             row_number() OVER (ORDER BY coalesce(per_capita_usd, 0.0) DESC, province_name) AS position
      FROM province_report)
SELECT ranking, CAST(position AS INTEGER) AS position, province_name, score FROM v WHERE position <= 3
UNION ALL
SELECT ranking, CAST(position AS INTEGER), province_name, score FROM c WHERE position <= 3"""))
def report_top_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three report provinces by value and by per-capita value."""
    return G.report_top_provinces(dimension(spark, sf_dir, "province_report"), 3)
