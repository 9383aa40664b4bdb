"""Percentiles, deviations and running sums: both plans, skew, ties, NULLs."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.plans import quantiles, running
from pixelyard.plans.running import with_running_sum
from pixelyard.plans.scale import join_on, lookup, pinned


def _skewed(spark, n=6000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"
        value = float(rng.choice([1, 2, 3])) if rng.random() < 0.3 else rng.lognormvariate(3, 2)
        rows.append((key, value, rng.choice([None, 1.5, float(i)])))
    rows += [("one", 7.0, None), (None, 4.0, 2.0), (None, 8.0, None)]
    return rows, spark.createDataFrame(rows, "k string, v double, w double")


def test_percentiles_match_numpy(spark):
    rows, df = _skewed(spark)
    points = (0, 5, 50, 95, 99, 100)
    specs = [(f"v{p}", "v", p) for p in points] + [("w50", "w", 50)]
    out = {r["k"]: r for r in quantiles.aggregate(df, ["k"], specs, [F.count(F.lit(1)).alias("n")]).collect()}
    for key in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == key]
        w = [r[2] for r in rows if r[0] == key and r[2] is not None]
        assert out[key]["n"] == len(v)
        for p in points:
            assert out[key][f"v{p}"] == pytest.approx(np.percentile(v, p), rel=1e-12)
        assert out[key]["w50"] == (pytest.approx(np.percentile(w, 50)) if w else None)


def test_global_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double")
    row = quantiles.aggregate(df, [], [("p95", "v", 95), ("p50", "v", 50)], [F.max("v").alias("top")]).first()
    assert (row["p95"], row["p50"], row["top"]) == (48.0, 30.0, 50.0)


def test_median_abs_deviation(spark):
    rows, df = _skewed(spark, 2000)
    out = {r["k"]: r["mad"] for r in quantiles.median_abs_deviation(df, ["k"], "v").collect()}
    for key in {r[0] for r in rows}:
        v = np.array([r[1] for r in rows if r[0] == key])
        assert out[key] == pytest.approx(np.median(np.abs(v - np.median(v))))


def test_mad_resists_an_outlier(spark):
    df = spark.createDataFrame([("a", x) for x in (10.0, 11.0, 12.0, 13.0, 14.0, 10000.0)], "k string, v double")
    assert quantiles.median_abs_deviation(df, ["k"], "v").first()["mad"] < 5


def test_percentile_bounds_are_checked(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        quantiles.aggregate(df, [], [("p", "v", 101)])


def test_a_hot_group_is_never_dealt_as_a_whole(spark):
    """A third of all rows in one group: its rows are dealt by value or bucket, and only counts of its
    buckets, which are far fewer, by the group."""
    df = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "CAST(hash(id) AS DOUBLE) AS v")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = quantiles.aggregate(df, ["k"], [("p50", "v", 50)])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)  # lazy
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "hashpartitioning(__group" in plan
    hot = [r for r in out.where("k = 0").collect()]
    assert hot[0]["p50"] == np.percentile([r["v"] for r in df.where("k = 0").collect()], 50)


@pytest.mark.parametrize("options", [{"width": 50}, {"width": 1000, "rows": 20}])
def test_running_sum_with_slots(spark, options):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}" if rng.random() < 0.9 else None, rng.randrange(-1000, 5000) if i % 3 else 77, i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, a bigint")
    sums = with_running_sum(df, ["k"], "t", ["id"], F.col("a"), out="running", total="total", **options).collect()
    out, whole = {r["id"]: r["running"] for r in sums}, {r["k"]: r["total"] for r in sums}
    totals: dict = {}
    for k, t, i, a in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        totals[k] = totals.get(k, 0) + a
        assert out[i] == totals[k]
    assert whole == totals and len(sums) == len(rows)


def test_one_busy_second_and_one_global_group_are_spread(spark):
    """One group: half of its rows are in one second, or on one instant. No sort gets more than a bounded share."""
    for busy, width in ((F.lit(5_000_000) + F.col("id") * 25, 1_000_000), (F.lit(5_000_000), 1)):
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, busy).otherwise(F.col("id") * 1_000).alias("t"), "id")
        slots = running.slot_totals(df, [], "t", ["id"], F.lit(1), width)
        part = running._part("t", running._numeric_tie(df, ["id"]), 500)
        most = running.keyed(df, [], "t", width).join(slots, "__slot").groupBy("__slot", part.alias("p")).count().agg(F.max("count")).first()[0]
        block = F.floor(F.col("__slot.__n") / running.SPAN)
        assert most <= 1_000 and slots.groupBy(block).count().agg(F.max("count")).first()[0] <= running.SPAN
        got = {r["id"]: r["running"] for r in with_running_sum(df, [], "t", ["id"], F.lit(1), width, rows=500).collect()}
        assert got == {r["id"]: n + 1 for n, r in enumerate(sorted(df.collect(), key=lambda r: (r["t"], r["id"])))}


def test_join_on_matches_nulls_and_full(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "n"), (3, "z")], "k int, b string")
    assert {(r["a"], r["b"]) for r in join_on(a, b, ["k"]).collect()} == {("y", "n")}
    full = {(r["k"], r["a"], r["b"]) for r in join_on(a, b, ["k"], "full").collect()}
    assert full == {(1, "x", None), (None, "y", "n"), (3, None, "z")}


def test_pinned_is_not_copied_below_filters(spark):
    df = pinned(spark.range(10), y=F.col("id") * 2).where("y > 4")
    assert df.count() == 7
    assert statistics.mean(r["y"] for r in df.collect()) == 12


def test_lookup_default(spark):
    row = spark.range(1).select(lookup({"a": 1}, F.lit("b"), 9).alias("x"), lookup({"a": 1}, F.lit("b")).alias("y")).first()
    assert (row["x"], row["y"]) == (9, None)
