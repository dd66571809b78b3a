"""Skew-safe numbering and exact medians against brute force, with one hot
key holding a third of the rows."""

from __future__ import annotations

import random
import statistics

from finlens.operators.enrich import keep_first
from finlens.operators.ranking import cumulative_within, exact_median, row_number_within


def _skewed(n=3000, seed=7):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 40)}"
        data.append((g, i, float(rnd.randint(0, 500))))
    return data


def test_row_number_within_matches_brute_force(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "g string, id long, v double")
    got = {(r["g"], r["id"]): r["rn"] for r in row_number_within(df, ["g"], ["id"], "rn").collect()}
    expected = {}
    for g in {d[0] for d in data}:
        ids = sorted(d[1] for d in data if d[0] == g)
        for k, i in enumerate(ids, 1):
            expected[(g, i)] = k
    assert got == expected


def test_cumulative_weights(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5), ("a", 3, 1)], "g string, o int, w int")
    got = {(r["g"], r["o"]): r["c"] for r in cumulative_within(df, ["g"], ["o"], "w", "c", 3).collect()}
    assert got == {("a", 1): 2, ("a", 2): 5, ("a", 3): 6, ("b", 1): 5}


def test_exact_median_grouped_and_global(spark):
    data = _skewed()
    df = spark.createDataFrame(data, "g string, id long, v double")
    got = {r["g"]: r["m"] for r in exact_median(df, "v", ["g"], "m").collect()}
    for g in {d[0] for d in data}:
        assert got[g] == statistics.median([d[2] for d in data if d[0] == g])
    glob = exact_median(df, "v", [], "m").first()["m"]
    assert glob == statistics.median([d[2] for d in data])


def test_keep_first_with_hot_key(spark):
    data = [("k", i, f"v{i}") for i in range(100, 0, -1)] + [("j", 5, "x"), (None, 3, "n1"), (None, 1, "n2")]
    df = spark.createDataFrame(data, "key string, ord long, val string")
    got = {r["key"]: r["val"] for r in keep_first(df, ["key"], ["ord"]).collect()}
    assert got == {"k": "v1", "j": "x", None: "n2"}
