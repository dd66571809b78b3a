"""Skew-safe ordered numbering and exact medians.

A window ``PARTITION BY g ORDER BY o`` sends a whole group to one task; with
one group holding a third of all rows that task holds a third of the data.
Here rows are dealt to slices of the order (g, o): a sample with the smallest
key hashes gives the slice bounds, which enter the plan as literals, so a
row's slice depends on the row alone and a recomputed task deals the same.
Each slice computes running sums over its own rows, and a small per-(slice,
group) table supplies the offsets from earlier slices.  No step holds more
than one slice of a group, and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_PER_SLICE = 64


def slice_bounds(df: DataFrame, keys: list[str], slices: int) -> list[tuple]:
    """``slices - 1`` keys or fewer that part the rows evenly, ascending: at
    most ``SAMPLE_PER_SLICE * slices`` keys, those with the smallest hashes,
    reach the driver."""
    chosen = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE_PER_SLICE * slices)
    sample = [tuple(r) for r in chosen.orderBy(*keys).collect()]
    step = -(-len(sample) // slices)
    return list(dict.fromkeys(sample[i] for i in range(step, len(sample), step))) if step else []


def slice_of(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """Number of bounds that are not above the row's key, by bisection."""
    types = [df.schema[k].dataType for k in keys]
    key = F.struct(*[F.col(k) for k in keys])

    def literal(bound: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(bound, types, keys, strict=True)])

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= literal(bounds[mid]), within(mid + 1, high)).otherwise(within(low, mid))

    return within(0, len(bounds))


def cumulative_within(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    weight_col: str | None = None,
    out_col: str = "cumulative",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = running sum of ``weight_col`` (1 per row when None)
    over rows of the same group in ascending ``order_cols`` order (nulls
    first), current row included.

    With unit weights and a total order this is ``row_number()``.
    """
    slices = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    weight = F.col(weight_col) if weight_col else F.lit(1)
    sliced = df.withColumns({"_w": weight.cast("bigint"), "_slice": slice_of(df, keys, slice_bounds(df, keys, slices))})
    inside = Window.partitionBy("_slice", *group_cols).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_local", F.sum("_w").over(inside))
    pieces = sliced.groupBy("_slice", *group_cols).agg(F.sum("_w").alias("_piece"))
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_slice").alias("_oslice"),
        *[F.col(g).alias(f"_o_{g}") for g in group_cols],
        F.coalesce(F.sum("_piece").over(before), F.lit(0)).alias("_offset"),
    )
    cond = local["_slice"] == offsets["_oslice"]
    for g in group_cols:
        cond = cond & local[g].eqNullSafe(offsets[f"_o_{g}"])
    joined = local.join(offsets, cond)
    return joined.withColumn(out_col, F.col("_local") + F.col("_offset")).drop(
        "_w", "_slice", "_local", "_oslice", "_offset", *[f"_o_{g}" for g in group_cols]
    )


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      out_col: str = "row_number") -> DataFrame:
    """Skew-safe ``row_number() OVER (PARTITION BY group ORDER BY order)``;
    ``order_cols`` must make the order total within a group."""
    return cumulative_within(df, group_cols, order_cols, None, out_col)


def exact_median(df: DataFrame, value_col: str, group_cols: list[str], out_col: str = "median") -> DataFrame:
    """Exact (interpolated) median of ``value_col`` per group, null values
    ignored; one row per group that has a value.

    Values are first reduced to (group, value, count) with a partially
    aggregated group-by, so a hot value collapses to one row; cumulative
    counts then locate the middle rank(s) without a per-group buffer.
    """
    v = F.col(value_col).cast("double")
    counted = (
        df.where(v.isNotNull())
        .groupBy(*group_cols, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    cum = cumulative_within(counted, group_cols, ["_v"], "_cnt", "_cum")
    totals = counted.groupBy(*group_cols).agg(F.sum("_cnt").alias("_n"))
    if group_cols:
        tot = totals.select(*[F.col(g).alias(f"_t_{g}") for g in group_cols], "_n")
        cond = None
        for g in group_cols:
            eq = cum[g].eqNullSafe(tot[f"_t_{g}"])
            cond = eq if cond is None else cond & eq
        located = cum.join(tot, cond).drop(*[f"_t_{g}" for g in group_cols])
    else:
        located = cum.withColumn("_n", totals.select("_n").scalar())
    k_lo = F.floor((F.col("_n") + 1) / 2)
    k_hi = F.ceil((F.col("_n") + 1) / 2)
    start = F.col("_cum") - F.col("_cnt")
    covers_lo = (start < k_lo) & (k_lo <= F.col("_cum"))
    covers_hi = (start < k_hi) & (k_hi <= F.col("_cum"))
    return located.where(covers_lo | covers_hi).groupBy(*group_cols).agg(
        ((F.min(F.when(covers_lo, F.col("_v"))) + F.min(F.when(covers_hi, F.col("_v")))) / 2).alias(out_col)
    )
