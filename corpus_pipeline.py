"""A training corpus from ``documents``: five stages of the llm operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and its result is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.

Defined results of a run: a document without text, words or a letter goes in
the first stage.  Rows that repeat id and text, and copies under any ids,
leave one row: the smallest id, null before all others.  Rows with one id and
different texts are documents of their own.  A document whose every word is a
repeat goes in the third stage.  Null ``lang``, ``source`` or ``n_chars`` play
no part but that a null source is a source of its own in the mix.  Columns
beyond those of ``documents``, whatever their names, are carried to the mix,
which returns its own columns.  Empty tables give an empty result, and an
empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.llm import decontaminate, language_id, mixing, near_dedup, substring_dedup
from finlens.llm.store import TEXT_ROWS, crc_bucket, save, spare_name
from finlens.sources.tables import read_table

WORD = r"[^\x20\x09-\x0D]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; others go (no text, no
    letter, or nearly equal sizes under two languages)."""
    content = language_id.learn(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    found = spare_name(docs, "_found")
    rows = docs.withColumn(found, language_id.predict(content, F.col("text")))
    return rows.where(F.col(found)["score"] >= language_id.MIN_MARGIN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group similar by 0.8 in 5-word shingles."""
    return near_dedup.one_per_group(docs, n=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier;
    ``n_chars`` follows, and documents with no word left go."""
    kept = substring_dedup.dedup_text(docs)
    return kept.where(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast("bigint"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_hits(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document by source weights 1, 2, 3."""
    return mixing.taken(mixing.plan_mix(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("source_mix", mix),
]

# SQL cannot express the compression classifier or the pseudorandom mix; the
# tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}", TEXT_ROWS)
    return STAGES[-1][1](spark, docs, sf_dir)
