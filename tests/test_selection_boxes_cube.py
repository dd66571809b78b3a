"""Exact quantiles, box regions, slices, heavy keys, arg-min dedup and the
facet cube against brute force."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from finlens.operators import boxes as X
from finlens.operators import cube as C
from finlens.operators import facets as FC
from finlens.operators import geo as G
from finlens.operators import reports as R
from finlens.operators.enrich import enrich, heavy_keys, keep_first
from finlens.operators.ranking import row_number_within, slice_bounds, slice_of
from finlens.operators.selection import exact_quantile
from finlens.schema import CANONICAL_SCHEMA
from finlens.sources.fixtures import projects


def _quantile(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
    return low if int(place) == place else low * (1 - place % 1) + high * (place % 1)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("shape", ["ties", "wide", "hot", "odd"])
def test_quantiles_are_exact(spark, p, shape):
    rnd = random.Random(len(shape))
    values = {"ties": [float(rnd.randint(0, 9)) for _ in range(2000)],
              "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-8, 15) for _ in range(3001)],
              "hot": [7.0] * 1000 + [rnd.random() for _ in range(2000)],
              "odd": [3.0, 1.0, 2.0]}[shape]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    for accuracy, bins in ((10_000, 1 << 14), (20, 3)):  # also with a sketch and bins far too coarse
        got = exact_quantile(df, "v", p, "q", accuracy, bins).first()["q"]
        assert got == pytest.approx(_quantile(values, p), rel=1e-12, abs=1e-12)
    assert exact_quantile(df.where("v is null"), "v", p).first()[0] is None


def test_median_plan_has_no_global_sort(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = exact_quantile(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort" not in plan


DEFAULT_BOXES = [("Sumatra", -7, 7, None, 108), ("Java", -9, -5, 105, 115), ("Kalimantan", -5, 5, 108, 118),
                 ("Sulawesi", -6, 3, 118, 128), ("Nusa Tenggara", -10, -7, 115, 125), ("Maluku", None, None, 125, 136),
                 ("Papua", None, None, 136, None)]


def _boxes(rows):
    return [(r[0], *[None if x is None else float(x) for x in r[1:]]) for r in rows]


def _region(boxes, lat, lon):
    lon = 0.0 if lon is None else lon
    for name, a, b, c, d in boxes:
        if (a is None or lat > a) and (b is None or lat < b) and (c is None or lon >= c) and (d is None or lon < d):
            return name
    return "Other"


def _points(seed, n):
    rnd = random.Random(seed)
    pts = [(rnd.choice([None, round(rnd.uniform(-95, 95), 2), -7.0, 5.0]), rnd.choice([None, round(rnd.uniform(-200, 200), 2), 108.0]))
           for _ in range(n)]
    return [(a, b, rnd.choice([None, 1.0, 2.5])) for a, b in pts + [(-6.2, 106.85)] * n]


def test_box_table_equals_the_fixed_boxes_and_brute_force(spark):
    points = _points(1, 800)
    df = spark.createDataFrame(points, "latitude double, longitude double, committed_usd double").repartition(3)
    fixed = {r["region"]: (r["deals"], r["committed_usd"]) for r in G.box_regions(df).collect()}
    table = X.box_table(spark, _boxes(DEFAULT_BOXES))
    assert {r["region"]: (r["deals"], r["committed_usd"]) for r in X.region_totals(df, table).collect()} == fixed
    rnd = random.Random(2)
    many = []
    for i in range(2000):
        a, b, w = rnd.uniform(-100, 100), rnd.uniform(-190, 190), 10 ** rnd.uniform(-2, 2)
        many.append((f"r{i % 50}", rnd.choice([None, a]), a + w, b, rnd.choice([b + w, b + w, None])))
    got = {r["region"]: r["deals"] for r in X.region_totals(df, X.box_table(spark, many)).collect()}
    want = Counter(_region(many, a, b) for a, b, _ in points if a is not None and -90 <= a <= 90)
    assert got == dict(want)
    plan = X.region_totals(df, X.box_table(spark, many))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_box_table(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "latitude double, longitude double, committed_usd double")
    assert [tuple(r) for r in X.region_totals(df, X.box_table(spark, [])).collect()] == [("Other", 1, 3.0)]


def test_slices_are_a_function_of_the_row(spark):
    """Bounds are literals: a recomputed or differently dealt input gets the
    same slices, in the order of the keys, of about even size."""
    data = [("hot" if i % 3 else f"g{i % 17}", f"{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o string")
    bounds = slice_bounds(df, ["g", "o"], 8)
    assert bounds == slice_bounds(df.repartition(13), ["g", "o"], 8) and len(bounds) == 7
    got = df.select("g", "o", slice_of(df, ["g", "o"], bounds).alias("s")).collect()
    ordered = [r["s"] for r in sorted(got, key=lambda r: (r["g"], r["o"]))]
    assert ordered == sorted(ordered) and max(Counter(ordered).values()) < 2 * 3000 / 8
    plan = row_number_within(df, ["g"], ["o"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "LogicalRDD" not in plan.replace("LogicalRDD [g", "")


def test_keep_first_is_an_aggregate_without_a_sort(spark, small_dir):
    df = projects(spark, small_dir).withColumn("row_ord", F.monotonically_increasing_id())
    plan = keep_first(df, ["project_id", "finance_type"], ["row_ord"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan and "Window" not in plan


def _canonical(spark, rows):
    return spark.createDataFrame(rows, CANONICAL_SCHEMA).withColumns(
        {"source_name": F.lit("s"), "source_rank": F.lit(0), "row_ord": F.monotonically_increasing_id()})


def test_heavy_name_key_is_joined_by_broadcast(spark):
    """A name and year on a third of all rows: the join's output is spread, no
    partition over three times the median, and every row is filled."""
    names = [f.name for f in CANONICAL_SCHEMA.fields]

    def row(i, **kw):
        return tuple(kw.get(n) if n != "project_id" else f"id{i}" for n in names)

    hot = [row(i, project_name="Hot Project", year=2001) for i in range(3000)]
    rest = [row(10_000 + i, project_name=f"P{i}", year=2000 + i % 9) for i in range(5000)]
    none = [row(20_000 + i) for i in range(1000)]
    extra = [row(f"x{i}", project_name="hot  project!" if i == 0 else f"P{i}", year=2001 if i == 0 else 2000 + i % 9,
                 sector=f"s{i}") for i in range(2000)]
    primary, enrichment = _canonical(spark, hot + rest + none).repartition(6), _canonical(spark, extra)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enrich(primary, enrichment).withColumn("part", F.spark_partition_id())
        rows = out.select("project_name", "sector", "enriched", "part").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 9000 and sum(r["enriched"] for r in rows) == 3000 + 1999
    assert all(r["sector"] == "s0" for r in rows if r["project_name"] == "Hot Project")
    sizes = sorted(Counter(r["part"] for r in rows).values())
    assert len(sizes) == 8 and sizes[-1] <= 3 * statistics.median(sizes)


def test_heavy_keys_are_few_and_right(spark):
    df = spark.createDataFrame([("a" if i % 3 == 0 else None if i % 7 == 0 else f"k{i}",) for i in range(3000)], "k string")
    assert [r["k"] for r in heavy_keys(df, "k", 8).collect()] == ["a"]
    assert heavy_keys(df.where("k is null"), "k", 8).collect() == []


def test_cube_kpis_equal_those_of_the_facts(spark, small_dir):
    p = projects(spark, small_dir)
    cells = C.build_cells(p)
    selections = [{}, {"status": ["Completion", "Delayed"], "year": [1996, 1997]}, {"finance_type": ["fdi"]}, {"sector": ["nope"]}]
    for s in selections:
        want, got = R.portfolio_kpis(FC.apply_facets(p, s)).first(), C.cell_kpis(FC.apply_facets(cells, s)).first()
        for c in want.asDict():
            assert got[c] == (pytest.approx(want[c], rel=1e-9) if want[c] is not None else None), c
        a, b = (FC.facet_narrowing(x, s, w).collect() for x, w in ((p, None), (cells, "projects")))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert sorted(map(tuple, FC.facet_values(p).collect())) == sorted(map(tuple, FC.facet_values(cells).collect()))


def test_cube_is_rebuilt_by_partition(spark, small_dir, tmp_path):
    p = projects(spark, small_dir)
    path = str(tmp_path / "cube")
    C.write_cube(C.build_cells(p), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "cube").glob("year=*") for f in f.glob("part-*")}
    late = p.where("year = 1997").withColumn("committed_usd", F.col("committed_usd") * 2)
    changed = p.where("year <> 1996 OR year IS NULL").where("year <> 1997 OR year IS NULL").unionByName(late)
    C.refresh_cube(changed, path, [1996, 1997])
    got = sorted(map(str, C.read_cube(spark, path).drop("days").collect()))
    want = sorted(map(str, C.build_cells(changed).drop("days").collect()))
    assert got == want
    kept = {f.name for f in (tmp_path / "cube").glob("year=*") if f.name not in ("year=1996", "year=1997") for f in f.glob("part-*")}
    assert kept and kept <= set(before)


def test_too_many_options_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(FC, "MAX_OPTIONS", 5)
    df = spark.createDataFrame([(str(i), f"s{i}") for i in range(20)], "project_id string, sector string")
    with pytest.raises(ValueError):
        FC.option_lists(df, ["sector"])
