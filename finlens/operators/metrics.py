"""Portfolio metrics over the canonical ``projects`` table.

Every function is a lazy plan.  Aggregates are hash aggregates with map-side
partial combine, so a hot group key (one province holding a third of the rows)
is pre-reduced in every task before the shuffle.  Shares and thresholds are
windows over the already-aggregated rows (one row per group), so the fact
rows are scanned and shuffled once; no window or cross join runs over fact
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.functions.measures import (
    active_exposure,
    implementation_days,
    realization_rate,
    risk_exposure,
    risk_weight,
)
from finlens.schema import FUNNEL_STAGES

RATIO_DIGITS = 6


def _ratio(c: Column) -> Column:
    return F.round(c, RATIO_DIGITS)


def _col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A present column, or an all-null column of ``dtype`` when absent."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_realization_rate(projects: DataFrame) -> DataFrame:
    """Per-row disbursed / committed, null when committed is 0 or null."""
    return projects.withColumn(
        "realization_rate",
        realization_rate(_col_or_null(projects, "committed_usd", "double"),
                         _col_or_null(projects, "disbursed_usd", "double")),
    )


def with_implementation_days(projects: DataFrame) -> DataFrame:
    """Whole days from approval to operation (null if either is null)."""
    return projects.withColumn(
        "time_to_implementation_days",
        implementation_days(_col_or_null(projects, "approval_date", "date"),
                            _col_or_null(projects, "operation_date", "date")),
    )


def realization_by_project(projects: DataFrame) -> DataFrame:
    return with_realization_rate(projects).select(
        "project_id", _ratio(F.col("realization_rate")).alias("realization_rate")
    )


def delay_distribution(projects: DataFrame) -> DataFrame:
    """Implementation days per project, nulls dropped."""
    return (
        with_implementation_days(projects)
        .select("project_id", "time_to_implementation_days")
        .where(F.col("time_to_implementation_days").isNotNull())
    )


def overall_realization(projects: DataFrame) -> DataFrame:
    """sum(disbursed) / sum(committed) over all rows (one row).

    Totals are not restricted to rows that have both values; null when the
    committed total is null or 0, or the disbursed total is null.
    """
    agg = projects.agg(
        F.sum(F.col("committed_usd").cast("double")).alias("committed_total"),
        F.sum(F.col("disbursed_usd").cast("double")).alias("disbursed_total"),
    )
    return agg.select(
        "committed_total",
        "disbursed_total",
        _ratio(F.col("disbursed_total") / F.nullif(F.col("committed_total"), F.lit(0.0))).alias(
            "overall_realization_rate"
        ),
    )


def resolved_year(projects: DataFrame) -> Column:
    """Source year, else the approval year."""
    return F.coalesce(
        _col_or_null(projects, "year", "int").cast("int"),
        F.year(_col_or_null(projects, "approval_date", "date")),
    )


def province_year_exposure(projects: DataFrame) -> DataFrame:
    """Active disbursed USD per (province, year).

    Cancelled / stalled rows contribute 0 but keep their group; a null status
    is active; rows without province or resolvable year are dropped.
    """
    frame = projects.select(
        F.col("province").cast("string").alias("province"),
        resolved_year(projects).alias("year"),
        active_exposure("disbursed_usd", "status").alias("exposure"),
    ).where(F.col("province").isNotNull() & F.col("year").isNotNull())
    return (
        frame.groupBy("province", "year")
        .agg(F.sum("exposure").alias("province_year_exposure"))
        .orderBy("province", "year")
    )


def sector_concentration(projects: DataFrame, value_column: str = "committed_usd") -> DataFrame:
    """Per-sector sum of ``value_column`` and its share of the total.

    Group sums are null when every value is null; the share is null when the
    total is null or 0.  Ordered by share desc, nulls last, sector.
    """
    grouped = (
        projects.where(F.col("sector").isNotNull())
        .groupBy("sector")
        .agg(F.sum(F.col(value_column).cast("double")).alias("value"))
    )
    # the total is a window over the per-sector aggregate (one row per
    # sector), so the fact rows are scanned and shuffled once
    total = grouped.withColumn("_total", F.sum("value").over(Window.partitionBy()))
    return (
        total
        .select(
            "sector",
            "value",
            _ratio(F.col("value") / F.nullif(F.col("_total"), F.lit(0.0))).alias("share"),
        )
        .orderBy(F.col("share").desc_nulls_last(), F.col("sector"))
    )


def _risk_parts(projects: DataFrame, weights: dict[str, float] | None) -> tuple[Column, Column]:
    exposure = risk_exposure(_col_or_null(projects, "committed_usd", "double"))
    weight = risk_weight(_col_or_null(projects, "status"), weights)
    return weight * exposure, exposure


def risk_index_global(projects: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """100 * sum(weight * exposure) / sum(exposure), one row."""
    component, exposure = _risk_parts(projects, weights)
    agg = projects.agg(F.sum(component).alias("_rc"), F.sum(exposure).alias("_exp"))
    return agg.select(
        _ratio(F.lit(100.0) * F.col("_rc") / F.nullif(F.col("_exp"), F.lit(0.0))).alias("status_risk_index")
    )


def risk_index_by(projects: DataFrame, group_col: str = "province",
                  weights: dict[str, float] | None = None) -> DataFrame:
    """E5: the risk index per group value; null group values are dropped."""
    component, exposure = _risk_parts(projects, weights)
    return (
        projects.where(F.col(group_col).isNotNull())
        .groupBy(F.col(group_col).cast("string").alias(group_col))
        .agg(F.sum(component).alias("_rc"), F.sum(exposure).alias("_exp"))
        .select(
            group_col,
            _ratio(F.when(F.col("_exp") > 0, F.lit(100.0) * F.col("_rc") / F.col("_exp"))).alias(
                "status_risk_index"
            ),
        )
        .orderBy(group_col)
    )


def lifecycle_funnel(projects: DataFrame) -> DataFrame:
    """Independent non-null counts of the four stage dates, one pass."""
    counts = projects.agg(
        *[F.count(_col_or_null(projects, col, "date")).alias(f"s{i}") for i, (_, col) in enumerate(FUNNEL_STAGES)]
    )
    stack = ", ".join(f"{i + 1}, '{stage}', s{i}" for i, (stage, _) in enumerate(FUNNEL_STAGES))
    return counts.selectExpr(
        f"stack({len(FUNNEL_STAGES)}, {stack}) AS (stage_order, stage, projects)"
    ).select(
        F.col("stage_order").cast("int").alias("stage_order"),
        "stage",
        F.col("projects").cast("bigint").alias("projects"),
    )


def approval_cohorts(projects: DataFrame) -> DataFrame:
    """Per approval year: rows, committed and disbursed sums (0 when all
    null), mean per-row realization, median implementation days.

    The median buffer is keyed by distinct day counts, which a calendar range
    bounds, so a hot cohort does not grow it with the row count.
    """
    frame = with_implementation_days(with_realization_rate(projects)).select(
        F.year("approval_date").alias("approval_year"),
        F.col("committed_usd").cast("double").alias("committed_usd"),
        F.col("disbursed_usd").cast("double").alias("disbursed_usd"),
        "realization_rate",
        "time_to_implementation_days",
    ).where(F.col("approval_year").isNotNull())
    return (
        frame.groupBy("approval_year")
        .agg(
            F.count(F.lit(1)).alias("projects"),
            F.coalesce(F.sum("committed_usd"), F.lit(0.0)).alias("committed_usd"),
            F.coalesce(F.sum("disbursed_usd"), F.lit(0.0)).alias("disbursed_usd"),
            _ratio(F.avg("realization_rate")).alias("avg_realization_rate"),
            F.median("time_to_implementation_days").cast("double").alias(
                "median_time_to_implementation_days"
            ),
        )
        .orderBy("approval_year")
    )


def status_mix(projects: DataFrame) -> DataFrame:
    """Rows per non-null status (case preserved), most frequent first."""
    return (
        projects.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("projects"))
        .orderBy(F.col("projects").desc(), F.col("status"))
    )


def risk_weight_col(weights: dict[str, float] | None = None) -> Column:
    return risk_weight(F.col("status"), weights)


def risk_exposure_col() -> Column:
    return risk_exposure(F.col("committed_usd").cast("double"))


def province_friction(projects: DataFrame, weights: dict[str, float] | None = None,
                      rounded: bool = True) -> DataFrame:
    """One ``groupBy(province)`` computing exposure, mean realization and the
    risk index together (replaces three scans and two joins).

    Exposure only sums rows with a resolvable year and a province is kept
    only if it has at least one such row; the other two use all its rows.
    """
    component, exposure = _risk_parts(projects, weights)
    year_ok = resolved_year(projects).isNotNull()
    rnd = _ratio if rounded else (lambda c: c)
    return (
        projects.where(F.col("province").isNotNull())
        .groupBy(F.col("province").cast("string").alias("province"))
        .agg(
            F.sum(F.when(year_ok, active_exposure("disbursed_usd", "status"))).alias("total_exposure"),
            F.count_if(year_ok).alias("_with_year"),
            F.avg(realization_rate()).alias("_avg_rr"),
            F.sum(component).alias("_rc"),
            F.sum(exposure).alias("_exp"),
        )
        .where(F.col("_with_year") > 0)
        .select(
            "province",
            "total_exposure",
            rnd(F.col("_avg_rr")).alias("avg_realization_rate"),
            rnd(F.when(F.col("_exp") > 0, F.lit(100.0) * F.col("_rc") / F.col("_exp"))).alias(
                "status_risk_index"
            ),
        )
    )


def with_exposure_median(per_province: DataFrame) -> DataFrame:
    """The median province exposure attached to every province row.  The
    window runs over the per-province aggregate (one row per province), not
    over fact rows, so the facts are scanned once."""
    return per_province.withColumn("_median", F.median("total_exposure").over(Window.partitionBy()))


def exposure_vs_friction(projects: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Province exposure, realization, risk and a High/Low exposure band
    split at the median province exposure (>= median is High)."""
    return (
        with_exposure_median(province_friction(projects, weights))
        .withColumn(
            "exposure_band",
            F.when(F.col("total_exposure") >= F.col("_median"), F.lit("High Exposure")).otherwise(
                F.lit("Low Exposure")
            ),
        )
        .drop("_median")
        .orderBy(F.col("total_exposure").desc(), F.col("province"))
    )
