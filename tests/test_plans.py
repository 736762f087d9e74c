"""Plan shape of every registered telemetry query: nothing that stops working when the data grows."""

from __future__ import annotations

import re

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)

from appwatch.plans.registry import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(name, spark, small):
    plan = physical(QUERIES[name](spark, small))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|ArrowEval", plan)
    for line in plan.splitlines():
        if re.search(r"Window \[", line):
            spec = re.search(r"windowspecdefinition\((.*?)(ASC|DESC|specifiedwindowframe)", line)
            assert spec and "#" in spec.group(1), line


def test_type_filters_reach_the_scan(spark, small):
    plan = QUERIES["api_latency"](spark, small)._jdf.queryExecution().sparkPlan()
    scan = plan.collectLeaves().apply(0)
    assert "click" in scan.dataFilters().toString()


def test_top_rows_are_taken_without_a_full_sort(spark, small):
    for name in ("error_feed", "alerts_feed"):
        assert "TakeOrderedAndProject" in physical(QUERIES[name](spark, small))


def test_exact_percentiles_read_their_counts_once(spark, small):
    df = QUERIES["api_latency"](spark, small)
    df.collect()
    assert "ReusedExchange" in physical(df)


def test_grouped_aggregates_combine_before_the_shuffle(spark, small):
    for name in ("rollup_throughput", "rollup_errors_raw", "sessions", "overview_raw"):
        assert "partial_" in physical(QUERIES[name](spark, small))


def test_time_ranges_skip_months(spark, small, tmp_path):
    """Reads with a time range over stored tables choose their months before they read."""
    from datetime import datetime

    from appwatch import schema as S
    from appwatch.functions.filters import Filters
    from appwatch.operators import dashboard, sessions
    from appwatch.sources import tables
    from appwatch.sources import views as V

    root, day = str(tmp_path), Filters(start=datetime(2024, 1, 2), to=datetime(2024, 1, 3))
    stored = []
    for spec in S.TABLES:
        tables.append(V.table_view(spark, small, spec), root, spec.name, "load-0")
        stored.append(tables.read_stored(spark, root, spec, dedup=False))
    events, calls, errors = stored
    for df in (
        sessions.build_sessions(events, calls, errors, filters=day),
        sessions.error_last_screen(errors, events, filters=day),
        dashboard.compare_releases(events, calls, "v1.0.0", "v1.1.0", filters=day),
        dashboard.latency_overall(calls, ["app"], filters=day),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan parquet .*", plan)
        assert scans and all(re.search(r"PartitionFilters: \[[^\]]*event_month", s) for s in scans), scans


def test_bucketed_tables_need_no_shuffle(spark, small, tmp_path):
    """Neither picking the latest copies nor joining two tables by event moves rows; a new session can register the files."""
    from appwatch import schema as S
    from appwatch.operators.dedup import deduplicate
    from appwatch.sources import bucketed
    from appwatch.sources import views as V

    spec, path = S.MOBILE_ERRORS, str(tmp_path / "errors")
    bucketed.write(V.table_view(spark, small, spec), spec, "errors_in_buckets", path, buckets=4)
    latest = bucketed.latest(spark, spec, "errors_in_buckets")
    assert "Exchange" not in physical(latest) and "Window" in physical(latest)
    want = deduplicate(V.table_view(spark, small, spec).select(*spec.columns), spec)
    assert latest.exceptAll(want).count() == want.exceptAll(latest).count() == 0
    spark.sql("DROP TABLE errors_in_buckets")
    bucketed.register(spark, spec, "errors_again", path, buckets=4)
    again = bucketed.latest(spark, spec, "errors_again")
    assert "Exchange" not in physical(again) and again.count() == want.count()
    bucketed.write(V.table_view(spark, small, spec).where("screen_name is null"), spec, "errors_off_screen", str(tmp_path / "off"), buckets=4)
    joined = again.select("event_id", "event_time").hint("merge").join(spark.table("errors_off_screen").select("event_id", "screen_name"), "event_id")
    assert "Exchange" not in physical(joined)
    for name in ("errors_again", "errors_off_screen"):
        spark.sql(f"DROP TABLE {name}")
