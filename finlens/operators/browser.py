"""Report queries with the static browser app's null rules.

Differences from the dashboard regime, kept on purpose:
  * group keys that are null, '' or 0 become 'Unknown';
  * sums treat null as 0 ("zsum");
  * sector labels are title-cased (B13) — applied after a first aggregation
    by the raw value wherever only label groups are needed, so the regex
    work runs once per distinct sector, not once per row;
  * the year-range filter drops rows without a year;
  * ties in top-k are broken by the group key / project id (deterministic,
    where the browser keeps first-seen order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.functions.text import title_case_words
from finlens.schema import BROWSER_STATUSES

RATIO_DIGITS = 6
UNKNOWN = "Unknown"


def group_key(col: str) -> Column:
    """Browser grouping key: null / '' / 0 -> 'Unknown', else the value as text."""
    return group_key_expr(F.col(col))


def group_key_expr(c: Column) -> Column:
    text = c.cast("string")
    falsy = c.isNull() | (text == "") | (text == "0")
    return F.when(falsy, F.lit(UNKNOWN)).otherwise(text)


def zsum(col: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(col).cast("double"), F.lit(0.0))), F.lit(0.0))


def browser_filter(
    projects: DataFrame,
    finance_type: str = "all",
    sector: str = "all",
    status: str = "all",
    year_min: int | None = None,
    year_max: int | None = None,
    drop_zero_value: bool = False,
) -> DataFrame:
    """C5 (+ C9): single-select equality facets and an inclusive year range.

    A null year fails the range test (as in the browser), so it is dropped.
    An unset bound defaults to the smallest or largest non-zero year of the
    data, which every row with such a year meets: no scan for bounds, and the
    predicates reach the Parquet scan.
    """
    df = projects
    if finance_type != "all":
        df = df.where(F.col("finance_type") == F.lit(finance_type))
    if sector != "all":
        df = df.where(title_case_words("sector") == F.lit(sector))
    if status != "all":
        df = df.where(F.col("status") == F.lit(status))
    df = df.where(F.col("year").isNotNull())
    if year_min is None or year_max is None:
        df = df.where(F.col("year") != 0)
    if year_min is not None:
        df = df.where(F.col("year") >= year_min)
    if year_max is not None:
        df = df.where(F.col("year") <= year_max)
    if drop_zero_value:
        df = df.where(F.col("committed_usd") > 0)
    return df


def top_sectors(d: DataFrame, n: int) -> DataFrame:
    """topN over sector groups by zsum(committed): (rank, sector, value)."""
    from pyspark.sql.window import Window

    grouped = sector_groups(d).groupBy("sector").agg(F.sum("_value").alias("value"))
    head = grouped.orderBy(F.col("value").desc(), F.col("sector")).limit(n)
    return head.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("sector")))
    )


def sector_groups(d: DataFrame, *keys: str) -> DataFrame:
    """Committed zsum and rows per (keys, raw sector), then the browser group
    label of the sector: the per-row work is a partial aggregate, the
    title-casing runs on distinct (keys, raw sector) rows only."""
    raw = d.groupBy(*keys, "sector").agg(zsum("committed_usd").alias("_value"), F.count(F.lit(1)).alias("_rows"))
    return raw.withColumn("sector", group_key_expr(title_case_words("sector")))


def home_kpis(d: DataFrame) -> DataFrame:
    """Totals, type counts, realization (0 when committed <= 0), distinct
    years and sector groups, and the top-3 sectors' share of committed.

    The rows are aggregated by (raw sector, year); totals come from one final
    aggregate of that, the top three labels from a bounded top-k over the
    label sums.
    """
    pre = d.groupBy("sector", "year").agg(
        F.count(F.lit(1)).alias("_rows"),
        zsum("committed_usd").alias("_c"),
        zsum("disbursed_usd").alias("_d"),
        F.count_if(F.col("finance_type") == "DF").alias("_df"),
        F.count_if(F.col("finance_type") == "FDI").alias("_fdi"),
    )
    lab = pre.withColumn("_label", group_key_expr(title_case_words("sector")))
    head = lab.groupBy("_label").agg(F.sum("_c").alias("_label_value")).orderBy(
        F.col("_label_value").desc(), F.col("_label")).limit(3)
    first = F.sort_array(F.collect_list(F.struct((-F.col("_label_value")).alias("_minus"), "_label", "_label_value")))
    agg = lab.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("projects"),
        F.coalesce(F.sum("_c"), F.lit(0.0)).alias("committed_usd"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("disbursed_usd"),
        F.coalesce(F.sum("_df"), F.lit(0)).alias("df_projects"),
        F.coalesce(F.sum("_fdi"), F.lit(0)).alias("fdi_projects"),
        F.count_distinct("year").alias("_years_nonnull"),
        F.max(F.col("year").isNull().cast("int")).alias("_has_null_year"),
        F.count_distinct("_label").alias("sectors"),
    ).withColumn("_top", head.agg(first).scalar())
    c = F.col("committed_usd")
    top3_value = F.aggregate(F.col("_top"), F.lit(0.0), lambda acc, x: acc + x["_label_value"])
    return agg.select(
        F.col("projects").cast("bigint").alias("projects"),
        "committed_usd",
        "disbursed_usd",
        F.col("df_projects").cast("bigint").alias("df_projects"),
        F.col("fdi_projects").cast("bigint").alias("fdi_projects"),
        F.round(F.when(c > 0, F.col("disbursed_usd") / c).otherwise(F.lit(0.0)), RATIO_DIGITS).alias(
            "realization_rate"
        ),
        (F.col("_years_nonnull") + F.coalesce(F.col("_has_null_year"), F.lit(0))).cast("bigint").alias("years"),
        F.col("sectors").cast("bigint").alias("sectors"),
        F.array_join(F.transform(F.col("_top"), lambda x: x["_label"]), ", ").alias("top3_sectors"),
        F.round(top3_value / F.when(c != 0, c).otherwise(F.lit(1.0)), RATIO_DIGITS).alias("top3_share"),
    )


def peak_year(d: DataFrame) -> DataFrame:
    """The first year (ascending) whose committed zsum is the strict
    maximum above 0; (0, 0.0) when no year has a positive sum."""
    yearly = d.groupBy(group_key("year").alias("year_key"), F.col("year")).agg(
        zsum("committed_usd").alias("value")
    )
    # largest value first, then the earliest year, an unknown year last
    best = yearly.where(F.col("value") > 0).agg(
        F.min_by(F.struct("year", "value"),
                 F.struct(-F.col("value"), F.col("year").isNull(), F.col("year"))).alias("_best")
    )
    return best.select(
        F.coalesce(F.col("_best.year").cast("int"), F.lit(0)).alias("peak_year"),
        F.coalesce(F.col("_best.value"), F.lit(0.0)).alias("peak_committed_usd"),
    )


def completion_and_mean_deal(df_rows: DataFrame, fdi_rows: DataFrame) -> DataFrame:
    """E37 + E43: completed DF projects and their share; FDI mean deal as
    zsum / rows (null values count as 0 and as rows)."""
    done = df_rows.agg(
        F.count(F.lit(1)).alias("df_projects"),
        F.count_if(F.col("status") == "Completion").alias("completed"),
    )
    deals = fdi_rows.agg(F.struct(F.count(F.lit(1)).alias("fdi_deals"),
                                  zsum("committed_usd").alias("fdi_committed_usd"))).scalar()
    done = done.withColumn("fdi_deals", deals["fdi_deals"]).withColumn("fdi_committed_usd", deals["fdi_committed_usd"])
    return done.select(
        "df_projects",
        "completed",
        F.round(F.when(F.col("df_projects") > 0, F.col("completed") / F.col("df_projects")), RATIO_DIGITS).alias(
            "completed_share"
        ),
        "fdi_deals",
        "fdi_committed_usd",
        F.round(
            F.when(F.col("fdi_deals") > 0, F.col("fdi_committed_usd") / F.col("fdi_deals")).otherwise(F.lit(0.0)),
            RATIO_DIGITS,
        ).alias("mean_deal_usd"),
    )


def _status_col_name(status: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in status.lower()).replace("__", "_")


def status_by_year(d: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """E38 + R3: rows per year in each fixed status (exact match), 0-filled.
    The pivot gets its values explicitly, so no extra distinct job runs."""
    values = statuses or BROWSER_STATUSES
    pivoted = (
        d.where(F.col("year").isNotNull())
        .groupBy(F.col("year").cast("int").alias("year"))
        .pivot("status", values)
        .agg(F.count(F.lit(1)))
    )
    return pivoted.select(
        "year", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("bigint").alias(_status_col_name(s)) for s in values]
    )


def sector_by_year(d: DataFrame, top: int = 6) -> DataFrame:
    """E39 + R3: committed per year for each of the top sectors (by zsum),
    0-filled over every (year, top sector).  Matching is on the sector value
    itself, so the 'Unknown' bucket only sums rows literally named so."""
    head = top_sectors(d, top).select(F.col("rank").cast("int").alias("sector_rank"), "sector")
    # the (at most ``top``) leading sectors as one array, expanded per year
    leaders = head.agg(F.collect_list(F.struct("sector_rank", "sector"))).scalar()
    years = d.where(F.col("year").isNotNull()).select(F.col("year").cast("int").alias("year")).distinct()
    grid = years.select("year", F.explode(leaders).alias("_s")).select("year", "_s.sector_rank", "_s.sector")
    # rows are matched on the sector label itself ('Unknown' only matches a
    # sector literally named so); labels come from the (year, raw sector)
    # pre-aggregate
    pre = (d.where(F.col("year").isNotNull())
           .groupBy(F.col("year").cast("int").alias("year"), "sector")
           .agg(zsum("committed_usd").alias("_value"))
           .withColumn("sector", title_case_words("sector")))
    sums = (
        pre.join(F.broadcast(head.select("sector")), "sector", "left_semi")
        .groupBy("year", "sector")
        .agg(F.sum("_value").alias("committed_usd"))
    )
    return grid.join(sums, ["year", "sector"], "left").select(
        "year", "sector_rank", "sector", F.coalesce(F.col("committed_usd"), F.lit(0.0)).alias("committed_usd")
    )


def deals_and_value_by_year(d: DataFrame) -> DataFrame:
    """Deals and committed zsum per year group."""
    return d.groupBy(group_key("year").alias("year")).agg(
        F.count(F.lit(1)).alias("deals"), zsum("committed_usd").alias("committed_usd")
    )


def largest_deals(d: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` deals by committed (null as 0) and their share of the
    committed zsum (denominator 1 when the total is 0)."""
    from pyspark.sql.window import Window

    value = F.coalesce(F.col("committed_usd"), F.lit(0.0))
    head = (
        d.select("project_id", "project_name", "year", "sector", F.col("committed_usd"), value.alias("_v"))
        .orderBy(F.col("_v").desc(), F.col("project_id"))
        .limit(top)
    )
    head = head.withColumn("deal_rank", F.row_number().over(Window.orderBy(F.col("_v").desc(), F.col("project_id"))))
    total = d.agg(zsum("committed_usd")).scalar()
    head_sum = F.sum("_v").over(Window.partitionBy())  # over the ``top`` rows
    share = F.round(
        F.coalesce(head_sum, F.lit(0.0)) / F.when(total != 0, total).otherwise(F.lit(1.0)), RATIO_DIGITS
    )
    return head.select(
        F.col("deal_rank").cast("int").alias("deal_rank"),
        "project_id", "project_name", "year", title_case_words("sector").alias("sector"), "committed_usd",
        share.alias("top_share"),
    )
