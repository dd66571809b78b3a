"""Dashboard report queries over ``projects``.

Top-k results use ``orderBy(...).limit(k)`` (TakeOrderedAndProject: each task
keeps k rows, no full sort) with a unique final sort key so ties are
deterministic.  Portfolio-level scalars are one-row aggregates attached as
scalar subqueries; totals over a handful of aggregated rows are windows over
those rows.  No window or cross join runs over un-aggregated fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.functions.text import blank_to_null, unknown_if_blank
from finlens.operators import metrics as M
from finlens.operators.selection import exact_quantile

RATIO_DIGITS = M.RATIO_DIGITS
OTHER_SECTORS = "Other sectors"
HISTOGRAM_BINS = 30


def lock_finance_type(projects: DataFrame, finance_type: str) -> DataFrame:
    """Keep one finance type (case-insensitive)."""
    return projects.where(F.upper(F.col("finance_type")) == F.lit(finance_type.upper()))


def analysis_frame(projects: DataFrame) -> DataFrame:
    """Numeric casts plus ``sector_clean`` (null / blank -> 'Unknown')."""
    return projects.withColumn("sector_clean", unknown_if_blank("sector"))


def exposure_band_summary(projects: DataFrame) -> DataFrame:
    """E11 + R2: per exposure band: provinces, mean exposure, then the mean
    risk index and mean realization unpivoted to (metric, value) rows."""
    banded = M.with_exposure_median(M.province_friction(projects, rounded=False)).withColumn(
        "exposure_band",
        F.when(F.col("total_exposure") >= F.col("_median"), F.lit("High Exposure")).otherwise(
            F.lit("Low Exposure")
        ),
    )
    summary = banded.groupBy("exposure_band").agg(
        F.count("province").alias("provinces"),
        F.avg("total_exposure").alias("avg_exposure"),
        F.round(F.avg("status_risk_index"), RATIO_DIGITS).alias("avg_risk_index"),
        F.round(F.avg("avg_realization_rate"), RATIO_DIGITS).alias("avg_realization_rate"),
    )
    return summary.unpivot(
        ["exposure_band", "provinces", "avg_exposure"],
        ["avg_risk_index", "avg_realization_rate"],
        "metric",
        "value",
    )


def province_table(projects: DataFrame, top: int = 10) -> DataFrame:
    """E12 + G7: rows, committed and disbursed (0 when all null) per province;
    the ``top`` provinces by disbursed."""
    return (
        projects.where(F.col("province").isNotNull())
        .groupBy("province")
        .agg(
            F.count(F.lit(1)).alias("projects"),
            F.coalesce(F.sum("committed_usd"), F.lit(0.0)).alias("committed_usd"),
            F.coalesce(F.sum("disbursed_usd"), F.lit(0.0)).alias("disbursed_usd"),
        )
        .orderBy(F.col("disbursed_usd").desc(), F.col("province"))
        .limit(top)
    )


def yearly_trend(projects: DataFrame) -> DataFrame:
    """Committed and disbursed sums (null when all null) per trend year.

    Trend year is the source year, except that when *no* row has a year every
    row uses its approval year (a table-level, not row-level, fallback).
    One pass over the facts: aggregate by (year, approval year) pairs, decide
    the fallback with a window over that small aggregate, re-aggregate.
    """
    pairs = projects.groupBy(
        F.col("year").cast("int").alias("_y"), F.year("approval_date").alias("_ay")
    ).agg(F.sum("committed_usd").alias("_c"), F.sum("disbursed_usd").alias("_d"))
    flagged = pairs.withColumn("_any_year", F.max(F.col("_y").isNotNull()).over(Window.partitionBy()))
    chosen = flagged.select(
        F.when(F.col("_any_year"), F.col("_y")).otherwise(F.col("_ay")).alias("year"), "_c", "_d")
    return (
        chosen.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.sum("_c").alias("committed_usd"), F.sum("_d").alias("disbursed_usd"))
    )


def yearly_trend_long(projects: DataFrame) -> DataFrame:
    """E13 + R1: the yearly trend melted to (year, metric, usd); null sums stay."""
    return yearly_trend(projects).unpivot(
        ["year"], ["committed_usd", "disbursed_usd"], "metric", "usd"
    ).orderBy("year", "metric")


def yearly_sums(projects: DataFrame) -> DataFrame:
    """Committed and disbursed sums per (non-null) year."""
    return (
        projects.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.sum("committed_usd").alias("committed_usd"), F.sum("disbursed_usd").alias("disbursed_usd"))
        .orderBy("year")
    )


def yearly_counts(projects: DataFrame) -> DataFrame:
    """E15 + E16: rows per year and the committed sum (null for years whose
    committed values are all null, which the committed chart drops)."""
    return (
        projects.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("projects"), F.sum("committed_usd").alias("committed_usd"))
        .orderBy("year")
    )


def sectors_by_committed(projects: DataFrame, top: int | None = 15) -> DataFrame:
    """Committed sum per clean sector, all-null sectors dropped, largest
    first; ``top=None`` keeps all."""
    ranked = (
        analysis_frame(projects)
        .groupBy("sector_clean")
        .agg(F.sum("committed_usd").alias("committed_usd"))
        .where(F.col("committed_usd").isNotNull())
        .orderBy(F.col("committed_usd").desc(), F.col("sector_clean"))
    )
    return ranked.limit(top) if top else ranked


def sectors_by_count(projects: DataFrame, top: int = 15) -> DataFrame:
    """Rows per clean sector, top ``top``."""
    return (
        analysis_frame(projects)
        .groupBy("sector_clean")
        .agg(F.count(F.lit(1)).alias("projects"))
        .orderBy(F.col("projects").desc(), F.col("sector_clean"))
        .limit(top)
    )


def top3_sector_share(projects: DataFrame, pool: int = 15) -> DataFrame:
    """Share of the top-3 sectors in the committed total of the top
    ``pool`` sectors (not of the portfolio); null with fewer than 3 sectors."""
    top = sectors_by_committed(projects, pool)
    ranked = top.select(
        "committed_usd",
        F.row_number().over(Window.orderBy(F.col("committed_usd").desc(), F.col("sector_clean"))).alias("_rn"),
    )
    agg = ranked.agg(
        F.count(F.lit(1)).alias("sectors"),
        F.sum(F.when(F.col("_rn") <= 3, F.col("committed_usd"))).alias("top3_committed"),
        F.sum("committed_usd").alias("pool_committed"),
    )
    return agg.select(
        F.col("sectors").cast("bigint").alias("sectors"),
        "top3_committed",
        "pool_committed",
        F.round(
            F.when(
                F.col("sectors") >= 3,
                F.coalesce(
                    F.lit(100.0) * F.col("top3_committed") / F.nullif(F.col("pool_committed"), F.lit(0.0)),
                    F.lit(0.0),
                ),
            ),
            RATIO_DIGITS,
        ).alias("top3_share_pct"),
    )


def sector_share_with_other(sector_values: DataFrame, top: int = 6,
                            sector_col: str = "sector", value_col: str = "value") -> DataFrame:
    """The ``top`` sectors by value plus one 'Other sectors' row holding
    the rest (added only when that rest is > 0), each with its share %.

    ``sector_values`` holds one row per sector (its scope is the caller's
    choice); it is computed once, ranked, and its tail folded into one row.
    The ranking sees per-sector rows only, never fact rows.
    """
    base = sector_values.select(
        F.col(sector_col).alias("sector"), F.col(value_col).cast("double").alias("committed_usd")
    ).where(F.col("committed_usd").isNotNull())
    place = F.row_number().over(Window.orderBy(F.col("committed_usd").desc(), F.col("sector")))
    ranked = base.withColumn("position", F.least(place, F.lit(top + 1)))
    label = F.when(F.col("position") > top, F.lit(OTHER_SECTORS)).otherwise(F.col("sector"))
    rows = ranked.groupBy("position", label.alias("sector")).agg(F.sum("committed_usd").alias("committed_usd")).where(
        (F.col("position") <= top) | (F.col("committed_usd") > 0))
    # at most ``top + 1`` rows: the total is a window over them
    total = F.sum("committed_usd").over(Window.partitionBy())
    return rows.select(
        F.col("position").cast("int").alias("position"),
        "sector",
        "committed_usd",
        F.round(F.lit(100.0) * F.col("committed_usd") / F.nullif(total, F.lit(0.0)), RATIO_DIGITS).alias(
            "share_pct"
        ),
    )


def portfolio_kpis(projects: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of portfolio KPIs in a single aggregate."""
    ft = F.upper(F.col("finance_type"))
    rr = M.realization_rate()
    days = F.datediff(F.col("operation_date"), F.col("approval_date"))
    component = M.risk_weight_col(weights) * M.risk_exposure_col()
    agg = projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(ft == "DF").alias("df_projects"),
        F.count_if(ft == "FDI").alias("fdi_projects"),
        F.sum("committed_usd").alias("committed_usd"),
        F.sum("disbursed_usd").alias("disbursed_usd"),
        F.avg(rr).alias("_avg_rr"),
        F.median(days).alias("_median_days"),
        F.sum(component).alias("_rc"),
        F.sum(M.risk_exposure_col()).alias("_exp"),
    )
    return agg.select(
        "projects",
        "df_projects",
        "fdi_projects",
        "committed_usd",
        "disbursed_usd",
        F.round(
            F.col("disbursed_usd") / F.nullif(F.col("committed_usd"), F.lit(0.0)), RATIO_DIGITS
        ).alias("portfolio_realization_rate"),
        F.round(F.col("_avg_rr"), RATIO_DIGITS).alias("avg_project_realization_rate"),
        F.col("_median_days").cast("double").alias("median_implementation_days"),
        F.round(F.lit(100.0) * F.col("_rc") / F.nullif(F.col("_exp"), F.lit(0.0)), RATIO_DIGITS).alias(
            "status_risk_index"
        ),
    )


def investment_kpis(projects: DataFrame) -> DataFrame:
    """Rows, committed total, exact median deal, year range, and the
    largest clean sector with its share of the committed total.

    The median of a continuous measure is selected exactly behind a quantile
    sketch, without a sort and without a single-task value buffer.
    """
    a = analysis_frame(projects)
    totals = a.agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum("committed_usd").alias("committed_usd"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )
    median = exact_quantile(a, "committed_usd", 0.5, "m").scalar()
    top = sectors_by_committed(projects, 1).select(F.struct("sector_clean", "committed_usd")).scalar()
    return (
        totals.withColumn("median_committed_usd", median)
        .withColumn("top_sector", top["sector_clean"])
        .withColumn("_top_value", top["committed_usd"])
        .select(
            "projects",
            "committed_usd",
            F.col("median_committed_usd").cast("double").alias("median_committed_usd"),
            F.col("min_year").cast("int").alias("min_year"),
            F.col("max_year").cast("int").alias("max_year"),
            "top_sector",
            F.round(
                F.when(
                    F.col("top_sector").isNotNull(),
                    F.coalesce(
                        F.lit(100.0) * F.col("_top_value") / F.nullif(F.col("committed_usd"), F.lit(0.0)),
                        F.lit(0.0),
                    ),
                ),
                RATIO_DIGITS,
            ).alias("top_sector_share_pct"),
        )
    )


def status_counts_gated(projects: DataFrame, min_coverage_pct: float = 40.0) -> DataFrame:
    """E23 + C13: status counts ('Unknown' for null / blank), produced only
    when at least ``min_coverage_pct`` % of rows (rounded to 1 decimal) have a
    status.  The gate is a one-row aggregate joined into the plan."""
    counts = projects.groupBy(unknown_if_blank("status").alias("status")).agg(
        F.count(F.lit(1)).alias("projects"),
        F.count(blank_to_null("status")).alias("_with_status"),
    )
    # coverage from the per-status aggregate (one row per status value)
    everything = Window.partitionBy()
    pct = F.round(F.lit(100.0) * F.sum("_with_status").over(everything) / F.sum("projects").over(everything), 1)
    return (
        counts.withColumn("_pct", pct)
        .where(F.col("_pct") >= F.lit(min_coverage_pct))
        .drop("_pct", "_with_status")
        .orderBy(F.col("projects").desc(), F.col("status"))
    )


def histogram(values: DataFrame, value_col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of ``value_col`` between its min and max.

    bin = least(floor((v - min) * bins / (max - min)) + 1, bins); when
    min = max everything is bin 1.  All ``bins`` bins are returned, empty
    ones with 0 rows.  The min/max come from a one-row aggregate used as a
    scalar subquery.
    """
    v = values.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = bounds.select(F.struct("lo", "hi")).scalar()
    lo, hi = b["lo"], b["hi"]
    width = hi - lo
    binned = v.select(
        F.when(
            width > 0,
            F.least(F.floor((F.col("v") - lo) * F.lit(bins) / width).cast("int") + 1, F.lit(bins)),
        ).otherwise(F.lit(1)).alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("projects"))
    skeleton = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi"
    )
    return (
        skeleton.join(counts, "bin", "left")
        .select(
            F.col("bin").cast("int").alias("bin"),
            (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("bin_start"),
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("bin_end"),
            F.coalesce(F.col("projects"), F.lit(0)).cast("bigint").alias("projects"),
        )
        .orderBy("bin")
    )


def top_deals_share(projects: DataFrame, top: int = 20) -> DataFrame:
    """E34 + G4: the ``top`` deals by committed value, with the top deals'
    share of the committed total (0 when the total is 0 or null)."""
    deals = projects.where(F.col("committed_usd").isNotNull()).select(
        "project_id", "project_name", "year", "sector", "province", "status", "committed_usd"
    )
    head = deals.orderBy(F.col("committed_usd").desc(), F.col("project_id")).limit(top)
    total = projects.agg(F.sum("committed_usd")).scalar()
    head_total = F.sum("committed_usd").over(Window.partitionBy())  # over the ``top`` rows
    share = F.round(F.coalesce(F.lit(100.0) * head_total / F.nullif(total, F.lit(0.0)), F.lit(0.0)), RATIO_DIGITS)
    return head.withColumn("top_share_pct", share)


def longest_implementation(projects: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` projects by implementation days (nulls last)."""
    frame = M.with_implementation_days(M.with_realization_rate(projects)).select(
        "project_id",
        "project_name",
        "province",
        "status",
        "time_to_implementation_days",
        F.round("realization_rate", RATIO_DIGITS).alias("realization_rate"),
    )
    return frame.orderBy(F.col("time_to_implementation_days").desc_nulls_last(), F.col("project_id")).limit(top)


def risk_ranking(projects: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` provinces by status risk index (nulls last)."""
    return (
        M.exposure_vs_friction(projects)
        .orderBy(F.col("status_risk_index").desc_nulls_last(), F.col("province"))
        .limit(top)
    )


def plotting_date(projects: DataFrame) -> Column:
    """Approval date, else Jan 1 of the year."""
    return F.coalesce(
        F.col("approval_date"), F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1))
    )


def timeline_by_period(projects: DataFrame) -> DataFrame:
    """Projects per calendar year of the plotting date."""
    return (
        projects.select(F.trunc(plotting_date(projects), "year").alias("period"))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("projects"))
        .orderBy("period")
    )


def counts_with_unknown(projects: DataFrame) -> DataFrame:
    """Rows per sector and per status, null as 'Unknown', in one pass
    (both dimensions stacked, then one grouped count)."""
    stacked = projects.select(
        F.explode(
            F.array(
                F.struct(F.lit("sector").alias("dimension"), F.coalesce("sector", F.lit("Unknown")).alias("value")),
                F.struct(F.lit("status").alias("dimension"), F.coalesce("status", F.lit("Unknown")).alias("value")),
            )
        ).alias("d")
    ).select("d.dimension", "d.value")
    return stacked.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("projects"))


def coordinate_validity(projects: DataFrame) -> DataFrame:
    """C8 + E46: coordinate coverage under both rules — both coordinates
    present (dashboard) and latitude present within ±90 (browser)."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(both).alias("with_coordinates"),
        F.round(F.lit(100.0) * F.avg(both.cast("double")), RATIO_DIGITS).alias("coordinate_coverage_pct"),
        F.count_if(F.col("latitude").between(-90, 90)).alias("browser_mappable"),
    )


def yoy_change(projects: DataFrame) -> DataFrame:
    """E48 + W3: committed change of the last trend year over the one before
    (null when the previous value is null or 0).  The window runs over the
    two-row tail of the yearly aggregate only."""
    tail = yearly_trend(projects).orderBy(F.col("year").desc()).limit(2)
    w = Window.orderBy("year")
    with_prev = tail.select(
        "year",
        "committed_usd",
        F.lag("year").over(w).alias("previous_year"),
        F.lag("committed_usd").over(w).alias("previous_committed_usd"),
    )
    return with_prev.where(F.col("previous_year").isNotNull()).select(
        F.col("previous_year").cast("int").alias("previous_year"),
        F.col("year").cast("int").alias("year"),
        "previous_committed_usd",
        "committed_usd",
        F.round(
            F.lit(100.0)
            * (F.col("committed_usd") - F.col("previous_committed_usd"))
            / F.nullif(F.col("previous_committed_usd"), F.lit(0.0)),
            RATIO_DIGITS,
        ).alias("change_pct"),
    )


def fallback_top_projects(projects: DataFrame, top: int = 20, max_coverage_pct: float = 40.0) -> DataFrame:
    """C13 + G4: the fallback "top projects" view, produced only when the
    share of rows with both coordinates is below ``max_coverage_pct`` (the
    map cannot be drawn).  Top ``top`` by committed value (nulls last), with
    'Unnamed Project' / 'Unknown' for missing names and statuses.  The gate
    is a one-row aggregate attached as a scalar subquery."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    coverage = projects.agg(F.lit(100.0) * F.avg(both.cast("double"))).scalar()
    rows = projects.select(
        "project_id",
        F.coalesce(F.col("project_name"), F.lit("Unnamed Project")).alias("project_name"),
        "finance_type",
        "year",
        "committed_usd",
        F.coalesce(F.col("status"), F.lit("Unknown")).alias("status"),
    )
    head = rows.orderBy(F.col("committed_usd").desc_nulls_last(), F.col("project_id")).limit(top)
    return head.where(coverage < F.lit(max_coverage_pct))
