"""Facet cube: the dashboard's measures per combination of facet values.

A cell is one combination of year, finance type, sector, province and status.
Its measures add up: counts, sums, and the day counts an exact median needs
(days -> rows, bounded by the calendar).  Facet queries filter and add cells;
their cost follows the number of combinations, not of projects.

Cells are built with two partial aggregations, by (facets, days) and by
facets, so a combination with a third of all rows is reduced inside every
task.  The stored cube is partitioned by year; ``refresh_cube`` rebuilds the
years a new load touched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.functions.measures import implementation_days, realization_rate, risk_exposure, risk_weight

CELL_FACETS = ["year", "finance_type", "sector", "province", "status"]
SUMS = ["projects", "committed_usd", "disbursed_usd", "rate_sum", "rate_count", "risk", "exposure"]
CELL_SCHEMA = (
    "finance_type string, sector string, province string, status string, projects bigint, committed_usd double, "
    "disbursed_usd double, rate_sum double, rate_count bigint, risk double, exposure double, days map<int,bigint>, year int"
)
RATIO_DIGITS = 6


def build_cells(projects: DataFrame) -> DataFrame:
    """One row per facet combination that occurs, with its measures."""
    rate, exposure = realization_rate(), risk_exposure()
    by_day = projects.groupBy(*CELL_FACETS, implementation_days().alias("day")).agg(
        F.count(F.lit(1)).alias("projects"), F.sum("committed_usd").alias("committed_usd"),
        F.sum("disbursed_usd").alias("disbursed_usd"), F.sum(rate).alias("rate_sum"), F.count(rate).alias("rate_count"),
        F.sum(risk_weight() * exposure).alias("risk"), F.sum(exposure).alias("exposure"))
    day = F.when(F.col("day").isNotNull(), F.struct("day", "projects"))
    cells = by_day.groupBy(*CELL_FACETS).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.map_from_entries(F.collect_list(day)).alias("days"))
    return _in_order(cells)


def _in_order(cells: DataFrame) -> DataFrame:
    return cells.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in CELL_SCHEMA.split(", ")])


def write_cube(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("year").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).parquet(path).where("projects > 0")


def refresh_cube(projects: DataFrame, path: str, years: Iterable[int | None]) -> None:
    """Rebuild the cells of some years from the projects of those years; other
    partitions stay.  A year without projects any more gets one empty cell."""
    spark = projects.sparkSession
    touched = spark.createDataFrame([(y,) for y in set(years)], "year int")
    cells = build_cells(projects.join(F.broadcast(touched), projects["year"].eqNullSafe(touched["year"]), "left_semi"))
    empty = touched.select("year", F.lit(0).alias("projects"))
    cells = _in_order(cells.unionByName(empty, allowMissingColumns=True))
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def median_days(cells: DataFrame) -> DataFrame:
    """One row: the exact median of the day counts (a row per calendar
    distance meets in the window)."""
    days = cells.select(F.explode("days").alias("day", "n")).groupBy("day").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = days.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy())})
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)

    def day_of(rank):
        return F.min(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("day")))

    return placed.agg(((day_of(low) + day_of(high)) / 2).alias("median_days"))


def _kpi_columns(median) -> list:
    return [
        "projects", "df_projects", "fdi_projects", "committed_usd", "disbursed_usd",
        F.round(F.col("disbursed_usd") / F.nullif("committed_usd", F.lit(0.0)), RATIO_DIGITS).alias("portfolio_realization_rate"),
        F.round(F.col("rate_sum") / F.nullif("rate_count", F.lit(0)), RATIO_DIGITS).alias("avg_project_realization_rate"),
        median.cast("double").alias("median_implementation_days"),
        F.round(F.lit(100.0) * F.col("risk") / F.nullif("exposure", F.lit(0.0)), RATIO_DIGITS).alias("status_risk_index"),
    ]


def _typed(cells: DataFrame) -> DataFrame:
    kind = F.upper("finance_type")
    return cells.withColumns({f"{t.lower()}_projects": F.when(kind == t, F.col("projects")).otherwise(0) for t in ("DF", "FDI")})


def cell_kpis(cells: DataFrame) -> DataFrame:
    """E21 from cells: the portfolio KPIs of all projects in them."""
    counts = ["projects", "df_projects", "fdi_projects"]
    totals = _typed(cells).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
                               *[F.sum(c).alias(c) for c in SUMS if c != "projects"])
    return totals.select(*_kpi_columns(median_days(cells).scalar()))


def each_cell_kpis(cells: DataFrame) -> DataFrame:
    """The KPIs of every cell on its own; its median is read off its sorted
    day counts."""
    days = F.array_sort(F.map_entries("days"))
    rows = _typed(cells).withColumn("sorted", days).withColumn("n", F.expr("aggregate(sorted, 0L, (a, x) -> a + x.value)"))

    def day_of(rank: str) -> str:
        return (f"aggregate(sorted, struct(0L as upto, cast(null as int) as day), (a, x) -> struct(a.upto + x.value as upto, "
                f"if(a.day is null and a.upto + x.value >= {rank}, x.key, a.day) as day), a -> a.day)")

    median = F.expr(f"({day_of('(n + 1) div 2')} + {day_of('n div 2 + 1')}) / 2")
    return rows.select(*CELL_FACETS, *_kpi_columns(median))
