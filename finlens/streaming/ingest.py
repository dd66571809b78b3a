"""Incremental conform: raw CSV files arriving in a directory are conformed
as they land and appended to the canonical Parquet table.

The reference runs its conform as a batch command; this is the same conform
plan driven by a file stream, for sources that keep receiving exports.
Each micro-batch runs the batch operators (``conform_source`` then keep-first)
and is written to a batch table: keys of earlier batches are looked up in the
buckets the batch touches, so the stream itself keeps no unbounded state, and
a restarted query resumes from its checkpoint and may deliver a batch again
(the checkpoint location must be on shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from finlens.operators.conform import SourceSpec, conform_source
from finlens.operators.enrich import keep_first
from finlens.schema import CANONICAL_FIELDS, CANONICAL_SCHEMA
from finlens.sources.batch_table import read_batches, write_batch


def raw_text_schema(header: list[str]) -> T.StructType:
    """All-text schema for a raw layout (streams need the schema up front)."""
    return T.StructType([T.StructField(h, T.StringType(), True) for h in header])


KEYS = ["project_id", "finance_type"]


def append_batch(batch: DataFrame, batch_id: int, spec: SourceSpec, table_path: str) -> None:
    """foreachBatch body: conform, keep-first within the batch (file order),
    and add the keys that no earlier batch has.  A batch delivered again, or
    half written before, ends as if written once."""
    # a micro-batch is a static DataFrame: each file is read by one task in
    # order, so the per-task increasing id follows the file
    ordered = batch.withColumn("row_ord", F.monotonically_increasing_id())
    conformed = conform_source(ordered, spec).where(F.col("finance_type").isNotNull())
    first = keep_first(conformed, KEYS, ["source_rank", "row_ord"])
    write_batch(first.select(*CANONICAL_FIELDS), batch_id, table_path, KEYS)


def read_incremental(spark: SparkSession, table_path: str) -> DataFrame:
    """The table as the committed batches leave it."""
    return read_batches(spark, table_path, CANONICAL_SCHEMA).select(*CANONICAL_FIELDS)


def start_incremental_conform(
    spark: SparkSession,
    raw_dir: str,
    header: list[str],
    spec: SourceSpec,
    table_path: str,
    checkpoint_path: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream.  ``available_now`` processes everything present and
    stops (scheduled ingestion); otherwise it keeps polling."""
    stream = (
        spark.readStream.schema(raw_text_schema(header))
        .option("header", "true")
        .option("multiLine", "true")
        .option("maxFilesPerTrigger", 16)
        .csv(raw_dir)
    )
    writer = (
        stream.writeStream.foreachBatch(lambda df, bid: append_batch(df, bid, spec, table_path))
        .option("checkpointLocation", checkpoint_path)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
