"""A table that grows by numbered batches, each written exactly once.

Under ``path``::

    batch=7/bucket=3/...           rows of batch 7 whose key falls in bucket 3
    _keys/batch=7/bucket=3/...     their keys only: the index later batches read
    _commits/batch=7/...           written last; a batch without it does not count

A batch keeps the rows whose key no earlier committed batch has.  It reads the
key index of the buckets its own keys fall in and of no other, so the cost
follows the batch and its buckets, not the table.  Writing replaces the whole
directory of the batch, so a batch that was half written, or is delivered
again, ends as if written once; a committed batch is left alone.  One writer
at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batch directories under ``path``; none if there is no such
    path yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the batches that count."""
    return _read(spark, f"{path}/_commits", T.StructType([])).select("batch").distinct()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table: rows of committed batches, with ``batch`` and ``bucket``."""
    return _read(spark, path, schema).join(committed(spark, path), "batch", "left_semi")


def write_batch(rows: DataFrame, batch_id: int, path: str, keys: list[str], buckets: int = BUCKETS, commit: bool = True) -> None:
    """Add the rows of one batch (one per key) whose keys are new.  The keys
    are never null.  ``commit=False`` stops before the commit, as a lost
    writer would."""
    spark = rows.sparkSession
    if not committed(spark, path).where(F.col("batch") == batch_id).isEmpty():
        return
    schema = T.StructType([f for f in rows.schema.fields if f.name in keys])
    own = rows.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    index = _read(spark, f"{path}/_keys", schema).where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
    index = index.join(committed(spark, path), "batch", "left_semi")
    fresh = own.join(index.select("bucket", *keys), ["bucket", *keys], "left_anti")
    target = f"{path}/batch={batch_id}"
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = spark.read.schema(fresh.schema).parquet(target)
    written.select(*keys, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_keys/batch={batch_id}")
    if commit:
        spark.range(1).select(F.lit(0).alias("bucket"), F.lit(batch_id).alias("id")).write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{path}/_commits/batch={batch_id}")
