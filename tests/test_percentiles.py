from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from appwatch.functions import histograms as H
from appwatch.functions.percentiles import group_percentiles, value_band

LEVELS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def exact(df, keys, **kw):
    return group_percentiles(df, keys, "v", LEVELS, {"rows": F.lit(1)}, exact=True, **kw)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.5, float("nan")]))), min_size=1, max_size=60))
def test_equals_linear_interpolation(spark, rows):
    got = {r.k: r for r in exact(spark.createDataFrame(rows, "k string, v double"), ["k"]).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None and v == v]
        assert got[key].rows == sum(1 for k, _ in rows if k == key)
        for name, p in LEVELS.items():
            if values:
                assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)
            else:
                assert got[key][name] is None


def test_hot_group_and_repeated_values(spark):
    df = spark.range(200_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) k", "cast((id * 7919) % 10007 as double) / 8 v")
    got = {r.k: r for r in exact(df, ["k"]).collect()}
    want = df.groupBy("k").agg(F.expr("percentile(v, array(0.5, 0.95, 0.99))").alias("p")).collect()
    for r in want:
        assert [got[r.k].p50, got[r.k].p95, got[r.k].p99] == pytest.approx(r.p)


def test_global_and_weighted(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, n int")
    plain = [1.0] * 3 + [2.0] + [10.0] * 4
    row = exact(df, [], weight="n").first()
    assert row.p50 == pytest.approx(np.quantile(plain, 0.5)) and row.p95 == pytest.approx(np.quantile(plain, 0.95))


def test_bands_never_decrease(spark):
    vs = sorted([-1e9, -5.0, -0.1, 0.0, 1e-9, 0.1, 1.0, 1.0001, 2.0, 1e3, 1e3 + 1e-9, 1e9])
    bands = [r[0] for r in spark.createDataFrame([(v,) for v in vs], "v double").select("v", value_band(F.col("v")).alias("b")).orderBy("v").select("b").collect()]
    assert bands == sorted(bands)


def test_approximate_is_close(spark):
    df = spark.range(100_000).selectExpr("'a' k", "cast(id as double) v")
    row = group_percentiles(df, ["k"], "v", {"p95": 0.95}, {"n": F.lit(1)}).first()
    assert row.n == 100_000 and abs(row.p95 - 95_000) <= 100_000 / 10_000 + 1


def test_no_task_orders_a_whole_group(spark):
    """The ordering window of values is per group and band, not per group."""
    df = spark.range(10).selectExpr("'a' k", "cast(id as double) v")
    plan = exact(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_v" in line]
    assert windows and all("_band" in w for w in windows)


VALUES = [0.0, -0.0, 0.0004, 0.001, 0.255, 0.256, 0.257, 0.5, 1.0, 1.2345, 199.99, 1e3, 123456.789, 1e9, 8.9e15, 1e300, float("inf"), -0.5, -1234.5, None, float("nan")]


def test_histogram_buckets_are_ordered_and_near(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double").withColumn("b", H.bucket(F.col("v")))
    rows = df.withColumn("m", H.middle(F.col("b"))).collect()
    for r in rows:
        if r.v is None or np.isnan(r.v):
            assert r.b is None
        elif abs(r.v) < H.MOST:
            assert abs(r.m - r.v) <= H.ERROR * abs(r.v) + 0.001
    known = sorted((r.v, r.b) for r in rows if r.b is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and max(abs(b) for _, b in known) < 7300


def test_histograms_do_not_depend_on_partitioning(spark):
    df = spark.range(50_000).selectExpr("id % 7 as k", "cast((id * 7919) % 10007 as double) / 8 as v")
    got = []
    for parts in (1, 5, 40):
        counted = df.repartition(parts).groupBy("k", H.bucket(F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        out = counted.groupBy("k").agg(H.percentiles(F.col("b"), F.col("n"), [0.5, 0.95, 0.99]).alias("p"), H.as_text(H.collected("b", "n")).alias("h"))
        got.append(sorted((r.k, tuple(r.p), r.h) for r in out.collect()))
    assert got[0] == got[1] == got[2]
    exact = {r.k: r.p for r in df.groupBy("k").agg(F.expr("percentile(v, array(0.5, 0.95, 0.99))").alias("p")).collect()}
    for k, p, _ in got[0]:
        assert all(abs(a - b) <= H.ERROR * b + 0.001 for a, b in zip(p, exact[k]))


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double").withColumn("_b", H.bucket(F.col("v"))).withColumn("_n", F.lit(1).cast("long"))
    held = df.groupBy("k").agg(H.collected("_b", "_n").alias("h"))
    assert {r.k: len(r.h) for r in held.collect()} == {"a": 0, "b": 1}
    rows = H.entries(held, "h", ["k"])
    assert rows.count() == 2 and rows.where("_first").count() == 2
    p = {r.k: r.p for r in rows.groupBy("k").agg(H.percentiles(F.col("_bucket"), F.col("_n"), [0.5])[0].alias("p")).collect()}
    assert p["a"] is None and p["b"] == 1.0 - 0.0 or abs(p["b"] - 1.0) <= 0.004
