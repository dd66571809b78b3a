"""File sources and sinks.

Paths may be any Hadoop-compatible URI; nothing here touches the local
filesystem directly, so the same code runs against shared cluster storage.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlens.operators import quality as Q
from finlens.operators.conform import SourceSpec, coerce_schema
from finlens.operators.etl import EtlResult, run_etl
from finlens.schema import CANONICAL_FIELDS, CANONICAL_SCHEMA
from finlens.sources.layouts import layouts, read_layout, union_by_name
from finlens.sources.registry import ALL_SOURCES

RAW_EXTENSIONS = "*.{csv,xlsx,xls}"


def discover_raw_files(spark: SparkSession, raw_dir: str, pattern: str = RAW_EXTENSIONS) -> DataFrame:
    """A1: recursive listing of raw files by extension, sorted by path.
    Only file metadata is read (the content column is pruned)."""
    listing = _listing(spark, raw_dir, pattern).select("path", "length", "modificationTime")
    return listing.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).orderBy("path")


def _listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def read_csv_layouts(spark: SparkSession, path: str, multi_line: bool = False) -> list[DataFrame]:
    """A2: raw CSV (a file, a folder of files, or a glob of either), one
    DataFrame per header that occurs: all-text columns, header row 0, no type
    inference, ``row_ord`` as the place in the files.  Large files are split,
    unless cells may hold line breaks (``multi_line``)."""
    return [read_layout(spark, layout, multi_line) for layout in layouts(spark, path, multi_line)]


def read_csv_source(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A2 + B1: the files of a source as one DataFrame, every file under its
    own header, columns united by name.  With one header for all files the
    names are as they stand (conform cleans them)."""
    frames = read_csv_layouts(spark, path, multi_line)
    if not frames:
        return spark.createDataFrame([], "row_ord struct<file:string,block:bigint,position:bigint>")
    return frames[0] if len(frames) == 1 else union_by_name(frames)


def read_projects_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A3: the canonical table from Parquet with the explicit schema (no
    inference; partition column ``finance_type`` restored)."""
    return spark.read.schema(CANONICAL_SCHEMA).parquet(path).select(*CANONICAL_FIELDS)


def read_projects_table(spark: SparkSession, name: str = "projects") -> DataFrame:
    """A4 + A6: the canonical table from the catalog, coerced to the schema."""
    return coerce_schema(spark.table(name))


def write_projects(projects: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Write the canonical table as Parquet partitioned by finance type
    (readers filtering a type prune to one directory); optional CSV export."""
    projects.select(*CANONICAL_FIELDS).write.mode("overwrite").partitionBy("finance_type").parquet(path)
    if csv_path:
        projects.select(*CANONICAL_FIELDS).write.mode("overwrite").option("header", "true").csv(csv_path)


WARNING_STRUCT = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("warning_type", T.StringType()),
    T.StructField("message", T.StringType()),
])
LOAD_STRUCT = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("parser_used", T.StringType()),
    T.StructField("rows_in_source", T.LongType()),
    T.StructField("rows_loaded", T.LongType()),
    T.StructField("rows_excluded", T.LongType()),
    T.StructField("rows_used_for_enrichment", T.LongType()),
    T.StructField("province_missing_pct", T.DoubleType()),
    T.StructField("coordinate_missing_pct", T.DoubleType()),
    T.StructField("note", T.StringType()),
])
REPORT_SCHEMA = T.StructType([
    T.StructField("generated_at_utc", T.StringType()),
    T.StructField("raw_file_count", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("warning_count", T.LongType()),
    T.StructField("warnings", T.ArrayType(WARNING_STRUCT)),
    T.StructField("source_loads", T.ArrayType(LOAD_STRUCT)),
    T.StructField("missing_pct", T.MapType(T.StringType(), T.DoubleType())),
])


def quality_report(projects: DataFrame, warnings: DataFrame, loads: DataFrame, raw_file_count: int) -> DataFrame:
    """The nested one-row quality document: counts, warning and load rows,
    and missing % per canonical column.  The arrays hold one entry per
    (source, rule) and per source — bounded by the registry, not the data."""
    w = warnings.agg(F.collect_list(F.struct(*[F.col(f.name) for f in WARNING_STRUCT.fields]))).scalar()
    ld = loads.agg(F.collect_list(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOAD_STRUCT.fields]))).scalar()
    mp = Q.missing_pct(projects).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "missing_pct")))).scalar()
    rows = projects.agg(F.count(F.lit(1)).alias("row_count"))
    return rows.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at_utc"),
        F.lit(raw_file_count).cast("bigint").alias("raw_file_count"),
        "row_count",
        F.size(w).cast("bigint").alias("warning_count"),
        w.alias("warnings"),
        ld.alias("source_loads"),
        mp.alias("missing_pct"),
    )


def write_quality_report(report: DataFrame, path: str) -> None:
    """The report document as JSON (one record)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def _stub(spark: SparkSession, path: str, warning: str, message: str, projects: DataFrame | None) -> DataFrame:
    """The document shown for a report that cannot be read: one warning, and
    missing % from ``projects`` (100 for an empty or unknown table)."""
    if projects is None:
        projects = spark.createDataFrame([], CANONICAL_SCHEMA)
    warnings = spark.createDataFrame([(path, warning, message)], WARNING_STRUCT)
    return quality_report(projects, warnings, spark.createDataFrame([], LOAD_STRUCT), 0).withColumn(
        "generated_at_utc", F.lit(None).cast("string"))


def read_quality_report(spark: SparkSession, path: str, projects: DataFrame | None = None) -> DataFrame:
    """Read the report back, always as one row.

    The document may be indented.  Unparsable: a stub with one
    'invalid_quality_json' warning, no rows counted, 100 % missing per column.
    Absent: one 'quality_file_missing' warning, rows and missing % recomputed
    from ``projects``.
    """
    corrupt = T.StructField("_corrupt_record", T.StringType())
    try:
        raw = (
            spark.read.schema(T.StructType([*REPORT_SCHEMA.fields, corrupt]))
            .option("multiLine", "true")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _stub(spark, path, "quality_file_missing", "There is no quality report yet.", projects)
    names = [f.name for f in REPORT_SCHEMA.fields]
    document = raw.agg(F.first(F.struct(*names, "_corrupt_record")).alias("d")).select("d.*")
    good = F.col("_corrupt_record").isNull() & F.col("row_count").isNotNull()
    bad = _stub(spark, path, "invalid_quality_json", "The quality report is not valid JSON.", None)
    # exactly one of the two one-row documents remains
    broken = document.agg(F.count_if(good)).scalar() == 0
    return document.where(good).select(*names).unionByName(bad.select(*names).where(broken))


# where the registered sources lie under the raw folder: files, or folders of
# files, of that name
ROUTES = {spec.name: f"{spec.name}*" for spec in ALL_SOURCES}


def run_from_folder(spark: SparkSession, raw_dir: str, out_dir: str, routes: dict[str, str] | None = None,
                    specs: list[SourceSpec] | None = None, multi_line: bool = False) -> EtlResult:
    """The whole conform run from files (A1, A2, A7, A8, A10): discover, route
    by name, read, conform, enrich, dedup, and write under ``out_dir`` the
    canonical table (``projects``), the quality report (``quality_report``)
    and the lineage (``source_loads``, ``mapping_audit``).

    ``routes`` maps a source to a glob of files or folders in ``raw_dir``; a
    source that matches none counts as missing.  Only headers and file counts
    reach the driver.  The raw files are read once: both stages of the run are
    written under ``out_dir/stages``, and all outputs come from there.
    """
    routes = routes or ROUTES
    specs = specs or ALL_SOURCES
    base, out = raw_dir.rstrip("/"), out_dir.rstrip("/")
    files = discover_raw_files(spark, base)
    entry = F.element_at(F.split(F.substring_index("path", base + "/", -1), "/"), 1)

    def fits(glob: str):
        return entry.rlike("^" + "[^/]*".join(map(re.escape, glob.split("*"))) + "$")

    wanted = [s for s in specs if s.name in routes]
    found = files.agg(F.count(F.lit(1)).alias("_files"),
                      *[F.count_if(fits(routes[s.name])).alias(s.name) for s in wanted]).first()
    raw = {s.name: read_csv_layouts(spark, f"{base}/{routes[s.name]}", multi_line) for s in wanted if found[s.name]}

    def store(df: DataFrame, name: str) -> DataFrame:
        writer = df.write.mode("overwrite")
        if name == "conformed":
            # one folder per source: primaries and enrichment are read apart
            writer = writer.partitionBy("source_name").option("partitionOverwriteMode", "static")
        writer.parquet(f"{out}/stages/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/stages/{name}").select(*df.columns)

    result = run_etl(spark, raw, specs, parser="csv", store=store)
    write_projects(result.projects, f"{out}/projects")
    projects = read_projects_parquet(spark, f"{out}/projects")
    result.loads.write.mode("overwrite").parquet(f"{out}/source_loads")
    result.mapping_audit.write.mode("overwrite").parquet(f"{out}/mapping_audit")
    loads = spark.read.parquet(f"{out}/source_loads")
    write_quality_report(quality_report(projects, result.warnings, loads, found["_files"]), f"{out}/quality_report")
    return replace(result, projects=projects, loads=loads)
