"""Intermediate tables in the cluster's shared folder, and tidy inputs.

``save`` cuts lineage by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir``: a lost executor costs one re-read, not a recompute,
and iterative jobs keep flat plans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.session import ensure_checkpoint_dir


#: rows of texts that reach a Python worker at a time
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is executed inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def save(df: DataFrame, name: str, rows_per_batch: int = 10_000, codec: str = "snappy", narrow: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; ``zstd``
    for large tables that are read once or twice.  Where the session merges no
    small partitions, a ``narrow`` table (short rows, no texts or sets) is
    dealt out evenly to fewer tasks first: a file costs more than its rows."""
    spark = df.sparkSession
    if narrow and not merges_partitions(spark):
        df = df.repartition(fewer_partitions(spark))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows_per_batch):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer_partitions(spark: SparkSession) -> int:
    """An eighth of the shuffle partitions, a dozen at least, if there are as many."""
    return min(partitions(spark), max(12, partitions(spark) // 8))


def merges_partitions(spark: SparkSession) -> bool:
    """Whether adaptive execution merges small shuffle partitions."""
    return all(spark.conf.get(f"spark.sql.adaptive.{name}", "true").lower() == "true"
               for name in ("enabled", "coalescePartitions.enabled"))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select ``out=input_column`` pairs; missing input columns become null
    strings.  Everything else (extra columns, name clashes) stays behind."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{src}`") if src in have else F.lit(None).cast("string")).alias(out)
        for out, src in wanted.items()
    ])


def crc_bucket(doc_id, modulus: int):
    """crc32 of the decimal text of ``doc_id`` modulo ``modulus`` (null id: the
    crc of the empty string, 0)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, for a column that goes again."""
    have = {c.lower() for c in df.columns}
    while stem in have:
        stem += "_"
    return stem
