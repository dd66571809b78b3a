"""Driver queries with the browser app's null rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.functions.text import title_case_words, unknown_if_blank
from finlens.operators import browser as B
from finlens.plans.registry import register
from finlens.sources.fixtures import projects, with_projects

TITLE_SQL = (
    "CASE WHEN sector IS NULL THEN NULL ELSE array_to_string(list_transform("
    "regexp_extract_all(lower(regexp_replace(trim(sector), '\\s+', ' ', 'g')), '([a-z0-9_]+|[^a-z0-9_]+)', 1), "
    "lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x END), '') END"
)
SECTOR_KEY_SQL = "CASE WHEN sector IS NULL OR sector = '' OR sector = '0' THEN 'Unknown' ELSE sector END"
YEAR_KEY_SQL = "CASE WHEN year IS NULL OR year = 0 THEN 'Unknown' ELSE CAST(year AS VARCHAR) END"
ZSUM_COMMITTED = "coalesce(sum(coalesce(committed_usd, 0.0)), 0.0)"

BROWSER_BASE = f"""
WITH b AS (SELECT * REPLACE ({TITLE_SQL} AS sector) FROM projects),
yb AS (SELECT min(CASE WHEN year <> 0 THEN year END) AS lo, max(CASE WHEN year <> 0 THEN year END) AS hi FROM b),
d AS (SELECT b.* FROM b, yb WHERE b.year BETWEEN yb.lo AND yb.hi)"""


def _home_kpis_sql(rows: str) -> str:
    return f""",
t AS (SELECT count(*) AS projects, {ZSUM_COMMITTED} AS committed_usd,
             coalesce(sum(coalesce(disbursed_usd, 0.0)), 0.0) AS disbursed_usd,
             count(*) FILTER (WHERE finance_type = 'DF') AS df_projects,
             count(*) FILTER (WHERE finance_type = 'FDI') AS fdi_projects,
             count(DISTINCT year) + coalesce(max(CASE WHEN year IS NULL THEN 1 ELSE 0 END), 0) AS years,
             count(DISTINCT {SECTOR_KEY_SQL}) AS sectors FROM {rows}),
s AS (SELECT {SECTOR_KEY_SQL} AS sector, {ZSUM_COMMITTED} AS value FROM {rows} GROUP BY 1
      ORDER BY value DESC, sector LIMIT 3),
s3 AS (SELECT string_agg(sector, ', ' ORDER BY value DESC, sector) AS top3_sectors, sum(value) AS v FROM s)
SELECT projects, committed_usd, disbursed_usd, df_projects, fdi_projects,
       round(CASE WHEN committed_usd > 0 THEN disbursed_usd / committed_usd ELSE 0.0 END, 6) AS realization_rate,
       CAST(years AS BIGINT) AS years, sectors, top3_sectors,
       round(coalesce(v, 0.0) / CASE WHEN committed_usd <> 0 THEN committed_usd ELSE 1.0 END, 6) AS top3_share
FROM t CROSS JOIN s3"""


@register("home_kpis", ["E35", "B13", "C5", "G8"], with_projects(BROWSER_BASE + _home_kpis_sql("d")))
def home_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser home KPIs over the default year range."""
    return B.home_kpis(B.browser_filter(projects(spark, sf_dir)))


@register("range_filtered_kpis", ["C5", "C9", "E35"], with_projects(BROWSER_BASE + """,
r AS (SELECT * FROM b WHERE finance_type = 'DF' AND year BETWEEN 1996 AND 1999 AND committed_usd > 0)"""
                                                                      + _home_kpis_sql("r")))
def range_filtered_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser KPIs for DF projects in 1996-1999 with zero-value rows dropped."""
    d = B.browser_filter(projects(spark, sf_dir), finance_type="DF", year_min=1996, year_max=1999,
                         drop_zero_value=True)
    return B.home_kpis(d)


@register("peak_year", ["E36"], with_projects(BROWSER_BASE + f""",
y AS (SELECT year, {ZSUM_COMMITTED} AS value FROM d WHERE finance_type = 'DF' GROUP BY {YEAR_KEY_SQL}, year),
best AS (SELECT * FROM y WHERE value > 0 ORDER BY value DESC, year NULLS LAST LIMIT 1)
SELECT coalesce(CAST(best.year AS INTEGER), 0) AS peak_year, coalesce(best.value, 0.0) AS peak_committed_usd
FROM (SELECT 1 AS z) s LEFT JOIN best ON true"""))
def peak_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak commitment year of development finance."""
    return B.peak_year(B.browser_filter(projects(spark, sf_dir), finance_type="DF"))


@register("mean_deal_and_completion", ["E37", "E43"], with_projects(BROWSER_BASE + f""",
a AS (SELECT count(*) AS df_projects, count(*) FILTER (WHERE status = 'Completion') AS completed
      FROM d WHERE finance_type = 'DF'),
f AS (SELECT count(*) AS fdi_deals, {ZSUM_COMMITTED} AS fdi_committed_usd FROM d WHERE finance_type = 'FDI')
SELECT df_projects, completed,
       round(CASE WHEN df_projects > 0 THEN completed / df_projects END, 6) AS completed_share,
       fdi_deals, fdi_committed_usd,
       round(CASE WHEN fdi_deals > 0 THEN fdi_committed_usd / fdi_deals ELSE 0.0 END, 6) AS mean_deal_usd
FROM a CROSS JOIN f"""))
def mean_deal_and_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DF completion share and FDI mean deal size."""
    base = B.browser_filter(projects(spark, sf_dir))
    return B.completion_and_mean_deal(
        base.where(F.col("finance_type") == "DF"), base.where(F.col("finance_type") == "FDI")
    )


@register("status_by_year_pivot", ["E38", "R3"], with_projects(BROWSER_BASE + """
SELECT CAST(year AS INTEGER) AS year,
       count(*) FILTER (WHERE status = 'Completion') AS completion,
       count(*) FILTER (WHERE status = 'Implementation') AS implementation,
       count(*) FILTER (WHERE status = 'Pipeline: Commitment') AS pipeline_commitment,
       count(*) FILTER (WHERE status = 'Pipeline: Pledge') AS pipeline_pledge,
       count(*) FILTER (WHERE status = 'Suspended') AS suspended
FROM d WHERE finance_type = 'DF' AND year IS NOT NULL GROUP BY 1"""))
def status_by_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status x year counts (development finance)."""
    return B.status_by_year(B.browser_filter(projects(spark, sf_dir), finance_type="DF"))


@register("sector_by_year_pivot", ["E39", "R3"], with_projects(BROWSER_BASE + f""",
dd AS (SELECT * FROM d WHERE finance_type = 'DF'),
top AS (SELECT {SECTOR_KEY_SQL} AS sector, {ZSUM_COMMITTED} AS value FROM dd GROUP BY 1
        ORDER BY value DESC, sector LIMIT 6),
rk AS (SELECT sector, CAST(row_number() OVER (ORDER BY value DESC, sector) AS INTEGER) AS sector_rank FROM top),
yrs AS (SELECT DISTINCT CAST(year AS INTEGER) AS year FROM dd WHERE year IS NOT NULL),
sums AS (SELECT CAST(year AS INTEGER) AS year, sector, {ZSUM_COMMITTED} AS committed_usd
         FROM dd WHERE sector IN (SELECT sector FROM rk) GROUP BY 1, 2)
SELECT yrs.year, rk.sector_rank, rk.sector, coalesce(sums.committed_usd, 0.0) AS committed_usd
FROM yrs CROSS JOIN rk LEFT JOIN sums ON sums.year = yrs.year AND sums.sector = rk.sector"""))
def sector_by_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed by year for the top six sectors (development finance)."""
    return B.sector_by_year(B.browser_filter(projects(spark, sf_dir), finance_type="DF"), 6)


@register("deals_and_value_by_year", ["E40"], with_projects(BROWSER_BASE + f"""
SELECT {YEAR_KEY_SQL} AS year, count(*) AS deals, {ZSUM_COMMITTED} AS committed_usd
FROM d WHERE finance_type = 'FDI' GROUP BY 1"""))
def deals_and_value_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FDI deals and value per year."""
    return B.deals_and_value_by_year(B.browser_filter(projects(spark, sf_dir), finance_type="FDI"))


@register("largest_deals", ["E41", "G9"], with_projects(BROWSER_BASE + f""",
f AS (SELECT * FROM d WHERE finance_type = 'FDI'),
h AS (SELECT project_id, project_name, year, sector, committed_usd, coalesce(committed_usd, 0.0) AS v
      FROM f ORDER BY v DESC, project_id LIMIT 3),
tot AS (SELECT {ZSUM_COMMITTED} AS total FROM f)
SELECT CAST(row_number() OVER (ORDER BY v DESC, project_id) AS INTEGER) AS deal_rank,
       project_id, project_name, year, sector, committed_usd,
       round((SELECT sum(v) FROM h) / CASE WHEN total <> 0 THEN total ELSE 1.0 END, 6) AS top_share
FROM h CROSS JOIN tot"""))
def largest_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest three FDI deals and their share."""
    return B.largest_deals(B.browser_filter(projects(spark, sf_dir), finance_type="FDI"), 3)


@register("sector_labels", ["B12", "B13", "E45"], with_projects(f"""
SELECT sector, {TITLE_SQL} AS sector_label, coalesce(nullif(trim(sector), ''), 'Unknown') AS sector_clean,
       count(*) AS projects
FROM projects GROUP BY sector"""))
def sector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sector, browser label, dashboard clean label and row count."""
    p = projects(spark, sf_dir)
    return p.groupBy("sector").agg(F.count(F.lit(1)).alias("projects")).select(
        "sector",
        title_case_words("sector").alias("sector_label"),
        unknown_if_blank("sector").alias("sector_clean"),
        "projects",
    )
