"""Invariants that must hold on any data, checked on the
smallest driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlens.operators import metrics as M
from finlens.operators import quality as Q
from finlens.operators import reports as R
from finlens.operators.conform import coerce_schema
from finlens.plans.etl_queries import etl, source_missingness, stored_run
from finlens.sources import files as FS
from finlens.sources.fixtures import projects


def test_shares_sum_to_one(spark, small_dir):
    total = M.sector_concentration(projects(spark, small_dir)).agg(F.sum("share")).first()[0]
    assert abs(total - 1.0) < 1e-5


def test_funnel_counts_not_above_rows(spark, small_dir):
    p = projects(spark, small_dir)
    n = p.count()
    assert all(r["projects"] <= n for r in M.lifecycle_funnel(p).collect())


def test_top_n_plus_other_equals_total(spark, small_dir):
    p = projects(spark, small_dir)
    conc = M.sector_concentration(p)
    for top in (1, 2, 3):
        rows = R.sector_share_with_other(conc, top).collect()
        assert abs(sum(r["committed_usd"] for r in rows) - conc.agg(F.sum("value")).first()[0]) < 1e-6


def test_union_minus_duplicates_equals_kept(spark, small_dir):
    r = etl(spark, small_dir)
    union_rows = r.enriched.count()
    dup = r.enriched.groupBy("project_id", "finance_type").count().where("count > 1") \
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    assert union_rows - dup == r.projects.count()


def test_coverage_plus_missing_is_100(spark, small_dir):
    for row in Q.field_coverage(projects(spark, small_dir)).collect():
        assert abs(row["non_null_pct"] + row["missing_pct"] - 100.0) < 0.1 + 1e-9
        assert row["non_null_count"] + row["missing_count"] >= 0


def test_exposure_bands_split_provinces(spark, small_dir):
    rows = M.exposure_vs_friction(projects(spark, small_dir)).collect()
    high = [r for r in rows if r["exposure_band"] == "High Exposure"]
    assert 0 < len(high) <= len(rows) and min(r["total_exposure"] for r in high) >= max(
        (r["total_exposure"] for r in rows if r["exposure_band"] == "Low Exposure"), default=float("-inf"))


def test_catalog_table_read_coerces(spark):
    df = spark.createDataFrame([("1", "DF", " 12 ", "2020-01-02", "2019")],
                               "project_id string, finance_type string, committed_usd string, "
                               "approval_date string, year string")
    df.createOrReplaceTempView("projects_raw_view")
    out = FS.read_projects_table(spark, "projects_raw_view").first()
    assert out["committed_usd"] == 12.0 and str(out["approval_date"]) == "2020-01-02" and out["year"] == 2019
    assert out["district"] is None and coerce_schema(df).columns[0] == "project_id"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facet_filters_and_type_lock_reach_the_scan(spark, small_dir):
    from finlens.operators import facets as FC

    p = projects(spark, small_dir)
    strict = FC.apply_facets_strict(p, {"status": ["Completion", "Delayed"]}).select("project_id")
    plan = _plan(strict)
    assert "PushedFilters: [In(status, [Completion,Delayed])]" in plan
    assert "ReadSchema: struct<project_id:string,status:string>" in plan
    locked = R.lock_finance_type(p, "fdi").select("committed_usd")
    assert "PartitionFilters: [" in _plan(locked) and "finance_type" in _plan(locked).split("PartitionFilters: [")[1].split("]")[0]


def test_dashboard_filter_with_options_reaches_the_scan(spark, small_dir):
    """C4 given the option lists: plain predicates, pushed and pruning."""
    from finlens.operators import facets as FC

    p = projects(spark, small_dir)
    options = FC.option_lists(p, ["finance_type", "status", "year"])
    assert options["finance_type"] == ["DF", "FDI"]
    selection = {"finance_type": ["fdi"], "status": ["Completion", "Delayed"], "year": [1996, 1997]}
    plan = _plan(FC.apply_facets(p, selection, options).select("project_id"))
    pushed = plan.split("PushedFilters: [")[1].split("]\n")[0]
    assert "In(status, [Completion,Delayed])" in pushed and "In(year, [1996,1997])" in pushed
    assert "finance_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Subquery" not in plan
    same = FC.apply_facets(p, selection)
    assert FC.apply_facets(p, selection, options).count() == same.count() > 0
    every = {"status": options["status"]}
    assert FC.apply_facets(p, every, options).count() == p.count() == FC.apply_facets(p, every).count()


def test_default_year_bounds_need_no_scan(spark, small_dir):
    from finlens.operators import browser as B

    plan = _plan(B.browser_filter(projects(spark, small_dir)).select("project_id"))
    assert "IsNotNull(year)" in plan and "Not(EqualTo(year,0))" in plan and "Subquery" not in plan
    assert plan.count("FileScan") == 1


def test_keep_first_drops_losers_before_the_shuffle(spark):
    """A key holding most rows sends one row per task."""
    from finlens.operators.enrich import keep_first

    hot = spark.range(0, 5000, 1, 4).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("ord"), F.lit("x").alias("v"))
    first = keep_first(hot, ["k"], ["ord"])
    plan = _plan(first)
    # an aggregate on both sides of the one shuffle, and no sort of rows
    assert plan.count("ObjectHashAggregate") == 2 and plan.count("Exchange") == 1 and "partial_min_by" in plan
    assert plan.index("partial_min_by") > plan.index("Exchange") and "Sort" not in plan and "Window" not in plan
    rows = {r["k"]: r["ord"] for r in first.collect()}
    assert rows[-1] == 1 and len(rows) == 501


def test_one_scan_of_facts_for_bucketed_shares(spark, small_dir):
    p = projects(spark, small_dir)
    assert _plan(R.sector_share_with_other(M.sector_concentration(p))).count("FileScan") <= 2


def test_missingness_reads_raw_rows_only(spark, small_dir):
    """One scan per conformed source, none of a stage stored by a run."""
    df = source_missingness(spark, small_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" parquet" in line for line in plan.splitlines()) == 4
    assert df.inputFiles() and not any("/run-" in f for f in df.inputFiles())
    r = stored_run(spark, small_dir)
    want = Q.source_missingness(r.conformed.unionByName(r.enrichment))
    assert sorted(df.collect()) == sorted(want.collect())
