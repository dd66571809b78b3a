"""Keep-first dedup and gap filling from an enrichment source (D2, D3, W1,
H1, H2, E51).

Keep-first is an arg-min aggregate: each task keeps the first row of every
key before the shuffle, so a key holding a third of all rows sends one row per
task.

Enrichment joins find heavy keys with a frequent-items sketch and join those
by broadcast, the rest by shuffle; null keys, which never match, are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.functions.text import name_key
from finlens.schema import ENRICH_FILL_FIELDS


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys`` value: the first by ``order`` (unique within a
    key).  Null key values form one group, as in a file-order dedup.

    An arg-min aggregate: every task reduces its rows to the first of each
    key, one shuffle of those, no sort of rows in the plan.  The empty list
    has an object buffer, which makes the planner take the object hash
    aggregate (a sort aggregate otherwise); a task with very many keys goes
    on with sorted runs on its own.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order))
    kept = df.groupBy(*keys).agg(first.alias("_first"), F.collect_list(F.lit(None).cast("int")).alias("_none"))
    return kept.where(F.size("_none") == 0).select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """H1: concatenate conformed sources (registry order is kept in the
    ``source_rank`` lineage column, which later orderings use)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# keys a sketch follows, and the most that are joined by broadcast
TRACKED_KEYS, HEAVY_KEYS = 8192, 256


def heavy_keys(df: DataFrame, key: str, parts: int, present: Column | None = None) -> DataFrame:
    """(key) of the keys that hold more than one ``parts``-th of the rows that
    have one, by a mergeable frequent-items sketch: at most ``HEAVY_KEYS``
    rows, whatever the input.  ``present`` says of a computed key whether a row
    has one, without working it out."""
    counted = df.where(F.col(key).isNotNull() if present is None else present).agg(
        F.expr(f"approx_top_k(`{key}`, {HEAVY_KEYS}, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("n"))
    items = counted.select("n", F.inline("top"))
    return items.where(F.col("count") * parts > F.col("n")).select(F.col("item").alias(key))


def _fill(left: DataFrame, right: DataFrame, on: str, fields: list[str], flag: str, heavy: DataFrame) -> DataFrame:
    """Left join on ``on`` and fill each null field from the right side;
    ``flag`` marks rows where at least one field was filled; ``heavy`` holds
    the ``heavy_keys`` of the left side.

    Heavy keys and their right rows are a broadcast of at most ``HEAVY_KEYS``
    rows.  Rows of a heavy key then need the shuffle no more, and rows whose
    key is null can never match: both get a per-row salt as join key, so that
    they spread over all shuffle partitions instead of hashing to one.
    """
    r = right.select(F.col(on).alias("_rk"), *[F.col(f).alias(f"_e_{f}") for f in fields])
    heavy = heavy.select(F.col(on).alias("_hk"))
    few = r.join(F.broadcast(heavy), F.col("_rk") == F.col("_hk"), "left_semi")
    few = heavy.join(F.broadcast(few), F.col("_rk") == F.col("_hk"), "left").select(
        "_hk", *[F.col(f"_e_{f}").alias(f"_h_{f}") for f in fields])
    marked = left.join(F.broadcast(few), left[on] == few["_hk"], "left")
    salt = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in left.columns]).cast("string"))
    alone = F.col("_hk").isNotNull() | F.col(on).isNull()
    joined = marked.withColumn("_jk", F.when(alone, salt).otherwise(F.col(on)))
    joined = joined.drop("_hk").join(r, F.col("_jk") == F.col("_rk"), "left")
    filled_any: Column = F.lit(False)
    cols = []
    for c in left.columns:
        if c in fields:
            found = F.coalesce(F.col(f"_h_{c}"), F.col(f"_e_{c}"))
            cols.append(F.coalesce(F.col(c), found).alias(c))
            filled_any = filled_any | (F.col(c).isNull() & found.isNotNull())
        elif c == flag:
            continue
        else:
            cols.append(F.col(c))
    prev = F.col(flag) if flag in left.columns else F.lit(False)
    return joined.select(*cols, (prev | filled_any).alias(flag))


def enrich(primary: DataFrame, enrichment: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Fill null fields of ``primary`` from ``enrichment`` in two passes.

    Pass 1 matches on project_id (enrichment deduped keep-first by source rank and
    row order).  Pass 2 matches on ``name_key(project_name) | year`` using the
    year *after* pass 1, against every enrichment row (keep-first per key).
    The enrichment never sets finance_type.  Adds a boolean ``enriched``
    column (true when either pass filled something; counted once).
    """
    fill = fields or ENRICH_FILL_FIELDS
    ord_cols = ["source_rank", "row_ord"]
    e = enrichment.select("project_id", "project_name", *fill, *ord_cols)
    by_id = keep_first(e.where(F.col("project_id").isNotNull()), ["project_id"], ord_cols)
    key = F.concat(name_key(F.col("project_name")), F.lit("|"), F.col("year").cast("string"))
    # null where one of its parts is: a test of the key itself would work it out
    # once more for every row
    has_key = F.col("project_name").isNotNull() & F.col("year").isNotNull()
    # which keys are heavy only steers the joins: both sketches read the rows as
    # they come, though pass 1 may still fill a year
    parts = int(primary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy1 = heavy_keys(primary.select(F.col("project_id").alias("_key1")), "_key1", parts)
    heavy2 = heavy_keys(primary.withColumn("_key2", key), "_key2", parts, has_key)
    step1 = _fill(primary.withColumn("_key1", F.col("project_id")), by_id.withColumnRenamed("project_id", "_key1"),
                  "_key1", fill, "enriched", heavy1).drop("_key1")
    by_key = keep_first(e.where(has_key).withColumn("_key2", key).drop("project_id", "project_name"),
                        ["_key2"], ord_cols)
    step2 = _fill(step1.withColumn("_key2", key), by_key, "_key2", fill, "enriched", heavy2).drop("_key2")
    return step2


def finalize_and_dedup(enriched: DataFrame) -> DataFrame:
    """C11 + H2/W1: drop rows without finance_type, then keep the first row
    per (project_id, finance_type) by (source_rank, row_ord)."""
    valid = enriched.where(F.col("finance_type").isNotNull())
    return keep_first(valid, ["project_id", "finance_type"], ["source_rank", "row_ord"])
