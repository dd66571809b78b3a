"""Exact quantiles without a sort (E22): a sketch brackets the rank, counts
locate it, a few values decide.

1. A mergeable quantile sketch (one aggregate) gives two values around the
   wanted rank and the number of values.
2. One count per bin, the bracket in ``BINS`` equal bins and what lies outside
   as one bin each, says in which bins the rank's neighbours lie.
3. The values of those bins, counted by value, are ranked.

Each step is one pass over one column; at most ``BINS`` + 2 counts and the
distinct values of two bins meet in one task.  A sketch that missed the rank
would only make step 3 read one of the outer bins: the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 10_000
BINS = 1 << 14


def exact_quantile(df: DataFrame, value_col: str, p: float = 0.5, out_col: str = "quantile", accuracy: int = ACCURACY,
                   bins: int = BINS) -> DataFrame:
    """One row: the ``p`` quantile of ``value_col``, linear between the two
    nearest ranks; nulls are passed over, null when there is no value."""
    v = df.select(F.col(value_col).cast("double").alias("v")).where("v IS NOT NULL")
    around = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    sketch = v.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", around, accuracy).alias("q"))
    s = sketch.select(F.struct("n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))).scalar()
    lo, hi = s["lo"], s["hi"]
    inside = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    binned = v.select("v", F.when(F.col("v") < lo, -1).when(F.col("v") > hi, bins).when(lo < hi, inside)
                      .otherwise(0).cast("int").alias("bin"))
    # a bin per row at most: BINS + 2 rows in one task
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto))
    place = (s["n"] - 1) * F.lit(p)  # from 0
    first, second = F.floor(place) + 1, F.ceil(place) + 1

    def holds(rank, start, end):
        return (F.col(start) < rank) & (rank <= F.col(end))

    counts = counts.withColumn("before", F.col("upto") - F.col("c"))
    hit = counts.where(holds(first, "before", "upto") | holds(second, "before", "upto")).select("bin", "before")
    values = binned.join(F.broadcast(hit), "bin").groupBy("bin", "before", "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = values.withColumn("end", F.col("before") + F.sum("c").over(
        Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = ranked.withColumn("start", F.col("end") - F.col("c"))
    below, above = (F.min(F.when(holds(r, "start", "end"), F.col("v"))) for r in (first, second))
    part = (place - F.floor(place)).cast("double")
    return ranked.agg(below.alias("a"), above.alias("b")).select(
        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).alias(out_col))
