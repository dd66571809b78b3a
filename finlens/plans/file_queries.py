"""Driver queries over files: layouts, catalog and report round trips, and the
table that grows by batches (A2, A4, A6-A9, B1-B3, H2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.operators.conform import coerce_schema, conform_source
from finlens.operators.enrich import keep_first
from finlens.operators.etl import run_etl
from finlens.plans.etl_queries import (
    CANON,
    CONFORM_SQL,
    ENRICH_SQL,
    WARNINGS_BODY,
    _calendar,
    _txt,
    _wrap,
    file_number,
    fresh,
    missing_parts,
    scratch_folder,
    stored_run,
    title,
    write_lines,
)
from finlens.plans.registry import register
from finlens.schema import CANONICAL_FIELDS
from finlens.sources import files as FS
from finlens.sources.batch_table import write_batch
from finlens.sources.fixtures import projects, with_projects
from finlens.sources.raw_fixtures import COUNTRY_HEADER, raw_source, raw_source_sql
from finlens.sources.registry import COUNTRY_SOURCE, FIXTURE_OF
from finlens.streaming.ingest import KEYS, read_incremental

# --- files of one source under four headers ----------------------------------

_CELLS = [h for h in COUNTRY_HEADER if h != "row_ord"]
_AT = {h: f"c{i}" for i, h in enumerate(_CELLS)}
ROWS_PER_FILE = 2000
# (header, cell) of each layout: as it is; reversed; two columns less; one more
# in front and one under another name
FILE_LAYOUTS = [
    [(h, _AT[h]) for h in _CELLS],
    [(h, _AT[h]) for h in reversed(_CELLS)],
    [(h, _AT[h]) for h in _CELLS if h not in ("Province", "Amount_musd")],
    [("Comment", "'note ' || CAST(row_ord AS STRING)"), ("Investor", "c0"), *[(h, _AT[h]) for h in _CELLS[1:]]],
]


def _snake(header: str) -> str:
    return header.lower().replace(" ", "_")


def layout_folder(spark: SparkSession, sf_dir: str) -> str:
    """The country source as files under the four headers."""
    base = scratch_folder(spark, "layouts")
    rows = raw_source(spark, sf_dir, FIXTURE_OF[COUNTRY_SOURCE.name])
    rows = rows.toDF(*[_AT.get(h, h) for h in COUNTRY_HEADER])
    part = file_number(rows, ROWS_PER_FILE)
    as_is = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    for k, layout in enumerate(FILE_LAYOUTS):
        cells = [F.expr(sql).alias(f"x{i}") for i, (_, sql) in enumerate(layout)]
        lines = rows.where(f"pmod(row_ord, 4) = {k}").select(
            F.concat(F.lit(f"{k}-"), part).alias("part"), F.col("row_ord").alias("at"),
            F.to_csv(F.struct(*cells), as_is).alias("value"))
        titles = lines.select("part").distinct().withColumn("value", F.lit(title([h for h, _ in layout])))
        write_lines(lines, titles, f"{base}/layout {k}")
    return base


def _layout_sql() -> str:
    parts = []
    for k, layout in enumerate(FILE_LAYOUTS):
        # an empty cell of a CSV file is no value
        cells = ", ".join(f"nullif({sql}, '') AS {_snake(h)}" for h, sql in layout)
        parts.append(f"SELECT {cells} FROM raw_ct WHERE ((row_ord % 4) + 4) % 4 = {k}")
    return with_projects(f"WITH raw_ct AS ({raw_source_sql('raw_country_source')})\n" + "\nUNION ALL BY NAME\n".join(parts))


@register("csv_layout_union", ["A2", "B1", "B3"], _layout_sql())
def csv_layout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one source that differ in the order of their columns, lack
    some or have more, each read under its own header and united by name."""
    rows = FS.read_csv_source(spark, layout_folder(spark, sf_dir)).drop("row_ord")
    return rows.toDF(*[_snake(c) for c in rows.columns])


_LAYOUT_CONFORM_SQL = CONFORM_SQL.replace(
    f"raw_ct AS ({raw_source_sql('raw_country_source')})",
    "raw_ct AS (SELECT c0, c1, c2, CASE WHEN ((row_ord % 4) + 4) % 4 <> 2 THEN c3 END AS c3, c4, "
    "CASE WHEN ((row_ord % 4) + 4) % 4 <> 2 THEN c5 END AS c5, c6, c7, c8, row_ord "
    f"FROM ({raw_source_sql('raw_country_source')}))")


@register("csv_layout_conform", ["A2", "B2", "B3", "A10"], _wrap(_LAYOUT_CONFORM_SQL, f"SELECT {CANON} FROM ct1"))
def csv_layout_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files conformed, every layout by its own columns."""
    frames = FS.read_csv_layouts(spark, layout_folder(spark, sf_dir))
    return run_etl(spark, {COUNTRY_SOURCE.name: frames}, [COUNTRY_SOURCE]).conformed.select(*CANONICAL_FIELDS)


# --- catalog table, strict coercion, quality report ------------------------------

@register("catalog_projects", ["A4", "A6"], with_projects(f"SELECT {CANON} FROM projects"))
def catalog_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table by its name in the catalog."""
    projects(spark, sf_dir).createOrReplaceTempView("finlens_projects")
    return FS.read_projects_table(spark, "finlens_projects")


def _strict(x: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({x}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


@register("strict_coercion", ["A6", "B8"], _wrap(CONFORM_SQL, f"""
SELECT {_txt('c0')} AS project_id, {_txt('c1')} AS project_name, 'DF' AS finance_type, {_txt('c4')} AS sector,
       {_txt('c5')} AS province, CAST(NULL AS VARCHAR) AS district, CAST(NULL AS DOUBLE) AS latitude,
       CAST(NULL AS DOUBLE) AS longitude, {_txt('c6')} AS status, {_calendar('c7')} AS approval_date,
       {_calendar('c9')} AS construction_start_date, CAST(NULL AS DATE) AS financial_close_date,
       {_calendar('c10')} AS operation_date, {_strict('c12')} AS committed_usd, {_strict('c14')} AS disbursed_usd,
       CASE WHEN ({_strict('c15')}) = floor({_strict('c15')}) THEN CAST({_strict('c15')} AS INTEGER) END AS year
FROM raw_df"""))
def strict_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An all-text table coerced to the canonical schema: values are taken as
    they stand or become null, never cleaned."""
    raw = raw_source(spark, sf_dir, "raw_df_source")
    cells = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    names = {"project_id": "c0", "project_name": "c1", "sector": "c4", "province": "c5", "status": "c6", "approval_date": "c7",
             "construction_start_date": "c9", "operation_date": "c10", "committed_usd": "c12", "disbursed_usd": "c14", "year": "c15"}
    return coerce_schema(cells.select(F.lit("DF").alias("finance_type"), *[F.col(c).alias(n) for n, c in names.items()]))


@register("report_document", ["A8", "A9", "E26"], _wrap(ENRICH_SQL + f""",
w AS ({WARNINGS_BODY}),
m AS ({missing_parts()})""", """
SELECT column_name, missing_pct, (SELECT count(*) FROM final) AS row_count, (SELECT count(*) FROM w) AS warning_count,
       CAST(5 AS BIGINT) AS raw_file_count, CAST(5 AS INTEGER) AS sources
FROM m"""))
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report of the run, written as JSON and read back."""
    run = stored_run(spark, sf_dir)
    path = scratch_folder(spark, "report")
    FS.write_quality_report(FS.quality_report(run.projects, run.warnings, run.loads, 5), path)
    report = FS.read_quality_report(spark, path)
    return report.select(F.explode("missing_pct").alias("column_name", "missing_pct"), "row_count", "warning_count",
                         "raw_file_count", F.size("source_loads").alias("sources"))


_FULL = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in CANONICAL_FIELDS)


@register("report_fallbacks", ["A9"], with_projects(f"""
SELECT 'absent' AS report, count(*) AS row_count, CAST(1 AS BIGINT) AS warning_count,
       'quality_file_missing' AS warning_type, CAST({_FULL} AS INTEGER) AS empty_columns FROM projects
UNION ALL
SELECT 'broken', CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'invalid_quality_json', {len(CANONICAL_FIELDS)}"""))
def report_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in for a report that is not there or cannot be parsed."""
    table, path = projects(spark, sf_dir), scratch_folder(spark, "broken-report")
    spark.createDataFrame([("{not json",)], "value string").write.text(path)
    found = {"absent": FS.read_quality_report(spark, f"{path}-absent", table),
             "broken": FS.read_quality_report(spark, path, table)}
    rows = [df.select(F.lit(kind).alias("report"), "row_count", "warning_count",
                      F.col("warnings")[0]["warning_type"].alias("warning_type"),
                      F.size(F.filter(F.map_values("missing_pct"), lambda v: v == 100.0)).alias("empty_columns"))
            for kind, df in found.items()]
    return rows[0].unionByName(rows[1])


# --- a table that grows by batches ------------------------------------------------

BATCHES = 4


@register("incremental_table", ["A7", "H2", "W1"], _wrap(CONFORM_SQL, f"""
SELECT {CANON} FROM ct1
QUALIFY row_number() OVER (PARTITION BY project_id, finance_type ORDER BY row_ord) = 1"""))
def incremental_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country source arriving in batches, some delivered twice and one
    half written first: the table is that of one run over all rows."""
    rows = fresh(raw_source(spark, sf_dir, FIXTURE_OF[COUNTRY_SOURCE.name]))
    ends = rows.agg(F.min("row_ord").alias("a"), F.max("row_ord").alias("b")).first()
    low, high = ends["a"] or 0, ends["b"] or 0
    path = scratch_folder(spark, "batches")

    def deliver(k: int, commit: bool = True) -> None:
        at = F.floor((F.col("row_ord") - low) * BATCHES / F.lit(high - low + 1))
        conformed = conform_source(rows.where(at == k), COUNTRY_SOURCE).where("finance_type IS NOT NULL")
        first = keep_first(conformed, KEYS, ["source_rank", "row_ord"])
        write_batch(first.select(*CANONICAL_FIELDS), k, path, KEYS, commit=commit)

    for k in range(BATCHES):
        if k == 2:
            deliver(k, commit=False)
        deliver(k)
        deliver(max(k - 1, 0))
    return read_incremental(spark, path)
