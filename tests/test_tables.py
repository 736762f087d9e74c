from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions.filters import Filters, time_range
from appwatch.functions.percentiles import group_percentiles
from appwatch.functions import histograms
from appwatch.operators import dashboard, sessions
from appwatch.operators.dedup import deduplicate, narrow
from appwatch.operators.rollups import merge_rollup, roll_up, rollup_percentiles
from appwatch.sources import metadata, tables
from appwatch.sources import views as V

START = datetime(2024, 1, 1)
ALL = Filters(start=START, to=datetime(2024, 1, 3))


def error_rows(spark, rows):
    """Error table rows from (event_id, event_time, received_at, release)."""
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, received_at timestamp, release string")
    made = {"app": "'a'", "env": "'prod'", "error_class": "'E'", "session_id": "'s'"}
    return df.selectExpr(
        *[f"cast({made.get(f.name, f.name if f.name in df.columns else 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in S.MOBILE_ERRORS.schema]
    )


def test_dedup_keeps_the_latest_and_is_idempotent(spark):
    t = START
    rows = error_rows(
        spark, [("e1", t, t, "old"), ("e1", t, t + timedelta(seconds=9), "new"), ("e1", t + timedelta(seconds=1), t, "other"), ("e2", t, t, "x")]
    )
    once = deduplicate(rows, S.MOBILE_ERRORS)
    assert sorted((r.event_id, r.release) for r in once.collect()) == [("e1", "new"), ("e1", "other"), ("e2", "x")]
    assert deduplicate(once, S.MOBILE_ERRORS).count() == 3


def test_dedup_ties_do_not_depend_on_row_order(spark):
    t = START
    rows = error_rows(spark, [("e1", t, t, r) for r in ("b", "c", "a")])
    for order in ("release", "-release"):
        df = rows.orderBy(F.col(order.strip("-")).desc() if order[0] == "-" else F.col(order))
        assert [r.release for r in deduplicate(df.repartition(3), S.MOBILE_ERRORS).collect()] == ["c"]


def test_key_only_dedup_uses_a_hash_aggregate(spark, small):
    df = narrow(V.mobile_errors(spark, small), S.MOBILE_ERRORS, ["event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Window" not in plan
    assert df.count() == deduplicate(V.mobile_errors(spark, small), S.MOBILE_ERRORS).count()


def test_many_copies_shrink_before_the_shuffle(spark, small):
    plan = deduplicate(V.mobile_errors(spark, small), S.MOBILE_ERRORS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_append_replaces_the_same_batch(spark, root, small):
    rows = V.mobile_errors(spark, small)
    tables.append(rows, root, "mobile_errors", "b-1")
    tables.append(rows, root, "mobile_errors", "b-1")
    tables.append(rows.limit(3), root, "mobile_errors", "b-2")
    raw = tables.read_stored(spark, root, S.MOBILE_ERRORS, dedup=False)
    assert raw.count() == rows.count() + 3
    assert tables.read_stored(spark, root, S.MOBILE_ERRORS).count() == deduplicate(rows, S.MOBILE_ERRORS).count()


def three_months(spark):
    days = [datetime(2024, m, d, 12) for m, d in ((1, 5), (1, 20), (2, 3), (2, 4), (3, 1))]
    return error_rows(spark, [(f"e{i}", d, d + timedelta(seconds=c), "r") for i, d in enumerate(days) for c in (1, 2)])


def test_compaction_keeps_rows_and_skips_dedup(spark, root):
    tables.append(three_months(spark), root, "mobile_errors", "b-1")
    tables.append(three_months(spark), root, "mobile_errors", "b-2")
    before = tables.read_stored(spark, root, S.MOBILE_ERRORS).orderBy("event_id").collect()
    tables.rewrite_month(spark, root, S.MOBILE_ERRORS, 202402)
    assert len(tables.batches(spark, root, "mobile_errors", 202402)) == 1
    after = tables.read_stored(spark, root, S.MOBILE_ERRORS)
    assert after.orderBy("event_id").collect() == before
    clean = after.filter("event_month = 202402")._jdf.queryExecution().optimizedPlan().toString()
    assert after.filter("event_month = 202402").count() == 2 and "Window" not in clean
    tables.append(three_months(spark), root, "mobile_errors", "b-3")
    assert tables.read_stored(spark, root, S.MOBILE_ERRORS).orderBy("event_id").collect() == before


def test_settling_takes_up_only_the_days_that_new_batches_touch(spark, root):
    spec, days = S.MOBILE_ERRORS, lambda: {b.split("-")[1]: b for b in tables.batches(spark, root, "mobile_errors", 202401)}
    first = error_rows(spark, [(f"e{d}", datetime(2024, 1, d, 12), datetime(2024, 1, d, 13), "r") for d in (5, 6, 7) for _ in (1, 2)])
    tables.append(first, root, spec.name, "b-1")
    assert tables.settle(spark, root, spec, 202401) == ["20240105", "20240106", "20240107"]
    before = days()
    assert sorted(before) == ["20240105", "20240106", "20240107"] and tables._is_clean(spark, root, spec.name, 202401)
    assert tables.settle(spark, root, spec, 202401) == [] and days() == before
    late = error_rows(spark, [("e6", datetime(2024, 1, 6, 12), datetime(2024, 1, 9), "later"), ("new", datetime(2024, 1, 6, 1), datetime(2024, 1, 9), "r")])
    tables.append(late, root, spec.name, "b-2")
    want = tables.read_stored(spark, root, spec).orderBy("event_id").collect()
    assert [r.release for r in want if r.event_id == "e6"] == ["later"]
    assert tables.settle(spark, root, spec, 202401) == ["20240106"]
    after = days()
    assert {d for d in after if after[d] != before[d]} == {"20240106"}  # the other days' pieces are the same files
    assert tables.read_stored(spark, root, spec).orderBy("event_id").collect() == want
    clean = tables.read_stored(spark, root, spec).filter("event_month = 202401")
    assert "Window" not in clean._jdf.queryExecution().optimizedPlan().toString()


def test_settling_mends_what_a_crash_left(spark, root):
    """New pieces were written and the old ones not deleted: reads are right, and the next run ends with one piece per day."""
    spec = S.MOBILE_ERRORS
    rows = error_rows(spark, [("a", datetime(2024, 1, 5, 12), datetime(2024, 1, 5, 13), "r"), ("b", datetime(2024, 1, 6, 12), datetime(2024, 1, 6, 13), "r")])
    tables._write_days(rows, root, spec)
    tables._write_days(rows, root, spec)
    assert not tables._is_clean(spark, root, spec.name, 202401) and tables.read_stored(spark, root, spec).count() == 2
    tables.settle(spark, root, spec, 202401)
    assert len(tables.batches(spark, root, spec.name, 202401)) == 2 and tables.read_stored(spark, root, spec, dedup=False).count() == 2


def test_retention_of_days_reads_only_the_cutoff_day(spark, root):
    spec = S.MOBILE_ERRORS
    rows = error_rows(spark, [(f"e{d}{h}", datetime(2024, 1, d, h), datetime(2024, 1, d, 23), "r") for d in (4, 5, 6) for h in (6, 18)])
    tables.append(rows, root, spec.name, "b-1")
    tables.settle(spark, root, spec, 202401)
    last = [b for b in tables.batches(spark, root, spec.name, 202401) if "20240106" in b]
    tables.retain(spark, root, spec, datetime(2024, 1, 5, 12) + timedelta(days=90))
    assert sorted(r.event_id for r in tables.read_stored(spark, root, spec).collect()) == ["e518", "e618", "e66"]
    assert [b for b in tables.batches(spark, root, spec.name, 202401) if "20240106" in b] == last


def test_sessions_expire(spark, root, small):
    parts = sessions.session_partials(V.mobile_events(spark, small), V.mobile_api_calls(spark, small), V.mobile_errors(spark, small))
    tables.append(parts, root, "session_partials", "b-1", "started_at")
    old = parts.withColumn("started_at", F.expr("started_at - interval 70 days")).withColumn("session_id", F.concat(F.lit("old-"), "session_id"))
    tables.append(old, root, "session_partials", "b-0", "started_at")
    as_of = datetime(2024, 1, 2) + timedelta(days=90)
    kept = tables.read_sessions(spark, root, as_of).count()
    assert kept == parts.where("date_trunc('second', started_at) > timestamp'2024-01-02'").count() > 0
    tables.retain_sessions(spark, root, as_of)
    assert tables.months(spark, root, "session_partials") == [202401]
    assert tables.read_sessions(spark, root, as_of).count() == kept


def test_retention_drops_months_and_trims_the_boundary(spark, root):
    tables.append(three_months(spark), root, "mobile_errors", "b-1")
    as_of = datetime(2024, 2, 3, 12) + timedelta(days=90)
    tables.retain(spark, root, S.MOBILE_ERRORS, as_of)
    assert tables.months(spark, root, "mobile_errors") == [202402, 202403]
    assert sorted(r.event_id for r in tables.read_stored(spark, root, S.MOBILE_ERRORS).collect()) == ["e3", "e4"]
    kept = tables.retain_rows(three_months(spark), as_of)
    assert sorted({r.event_id for r in kept.collect()}) == ["e3", "e4"]


def test_time_filters_prune_partitions_and_reach_the_scan(spark, root):
    rows = tables.layout(three_months(spark), S.MOBILE_ERRORS)
    tables.append(rows, root, "mobile_errors", "b-1")
    filters = Filters(app="a", start=datetime(2024, 2, 1), to=datetime(2024, 2, 29))
    raw = tables.read_stored(spark, root, S.MOBILE_ERRORS, dedup=False)
    shown = ["event_id", "error_class", "error_message", "release", "platform", "screen_name", "event_time"]
    latest = tables.read_stored(spark, root, S.MOBILE_ERRORS, ["app", "env", *shown])
    for df in (dashboard.error_feed(raw, filters), dashboard.error_feed(latest, filters, dedup=False)):
        plan = df._jdf.queryExecution()
        scan, text = plan.sparkPlan().collectLeaves().apply(0), plan.executedPlan().toString()
        assert "event_month" in scan.partitionFilters().toString()
        assert "event_time" in scan.dataFilters().toString() and "app" in scan.dataFilters().toString()
        assert "TakeOrderedAndProject" in text
        assert "stacktrace" not in scan.schema().simpleString() and "session_id" not in scan.schema().simpleString()
        assert [r.event_id for r in df.collect()] == ["e3", "e2"]


def test_verify_names_what_is_missing(spark, root, small):
    tables.append(V.mobile_errors(spark, small), root, "mobile_errors", "b-1")
    found = {r.table_name: (r.present, r.rows) for r in tables.verify_tables(spark, root).collect()}
    assert found["mobile_errors"] == (True, V.mobile_errors(spark, small).count())
    assert found["mobile_events"] == (False, 0) and len(found) == 6
    with pytest.raises(ValueError, match="api_latency_1m"):
        tables.require_tables(spark, root)


def test_metadata_round_trip(spark, root, small):
    metadata.append_metadata(V.apps(spark, small), "apps", root)
    metadata.append_metadata(V.alert_firings(spark, small), "alert_firings", root)
    assert metadata.read_metadata(spark, "apps", root).count() == V.apps(spark, small).count()
    back = metadata.read_metadata(spark, "alert_firings", root)
    assert dict(back.dtypes)["value_observed"] == "decimal(14,4)" and os.path.isdir(f"{root}/alert_firings")


# --- rollups -------------------------------------------------------------------------------------


def test_merging_partials_equals_rolling_up_at_once(spark, small):
    rows = deduplicate(V.mobile_api_calls(spark, small), S.MOBILE_API_CALLS)
    whole = roll_up(rows, "api_latency_1m", dedup=False, histogram=False)
    parts = roll_up(rows.withColumn("b", F.pmod(F.hash("event_id"), F.lit(5))), "api_latency_1m", dedup=False, by=["b"], histogram=False)
    merged = merge_rollup(parts, "api_latency_1m").select(*whole.columns)
    total = F.round(F.sum("duration_sum"), 6)
    assert merged.agg(total).first() == whole.agg(total).first()
    keys = [c for c in whole.columns if c != "duration_sum"]
    assert merged.select(*keys).exceptAll(whole.select(*keys)).count() == 0


def test_histograms_merge_to_the_same_percentiles_within_their_error(spark, small):
    rows = deduplicate(V.mobile_api_calls(spark, small), S.MOBILE_API_CALLS)
    levels = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = []
    for slices in (1, 3, 16):
        parts = roll_up(rows.repartition(slices).withColumn("b", F.pmod(F.hash("event_id"), F.lit(slices))), "api_latency_1m", dedup=False, by=["b"])
        once = rollup_percentiles(parts, "api_latency_1m", levels, by=["app"])
        twice = rollup_percentiles(merge_rollup(parts, "api_latency_1m"), "api_latency_1m", levels, by=["app"])
        for df in (once, twice):
            found.append(sorted(tuple(r) for r in df.select("app", "request_count", "error_count", *levels).collect()))
    assert all(f == found[0] for f in found)
    exact = group_percentiles(rows, ["app"], "duration_ms", levels, exact=True)
    near = {r[0]: r[3:] for r in found[0]}
    for r in exact.collect():
        for n, got in zip(levels, near[r.app]):
            assert abs(got - r[n]) <= histograms.ERROR * abs(r[n]) + 0.001


def test_latency_from_rollup_is_near(spark, small):
    calls = V.mobile_api_calls(spark, small)
    quick = dashboard.latency_from_rollup(roll_up(calls, "api_latency_1m"), ALL)
    rows = deduplicate(calls, S.MOBILE_API_CALLS).withColumn("bucket", F.date_trunc("hour", "event_time"))
    key = ["path", "method", "release", "bucket"]
    full = rows.groupBy(*key).agg(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), F.count(F.lit(1)).alias("n"))
    both = quick.join(full, key).collect()
    assert len(both) == full.count() > 100
    for r in both:
        spare = histograms.ERROR * r.hi + 0.001  # the histogram's stated error
        assert r.request_count == r.n and r.lo - spare <= r.p50_ms <= r.p95_ms <= r.p99_ms <= r.hi + spare


# --- dashboard ----------------------------------------------------------------------------------


def test_default_range_is_the_last_day(spark):
    start, to = Filters().bounds()
    assert to - start == timedelta(hours=24)
    assert Filters.last_hours(6, datetime(2024, 1, 2)).start == datetime(2024, 1, 1, 18)
    rows = spark.createDataFrame([(START,), (START + timedelta(hours=1),), (START + timedelta(hours=2),)], "event_time timestamp")
    assert time_range(rows, Filters(start=START, to=START + timedelta(hours=1))).count() == 2


def test_blank_filters_add_no_predicate(spark, small):
    calls = V.mobile_api_calls(spark, small)
    plan = dashboard.overview_api(calls, Filters(app=" ", env=None, start=START, to=ALL.to))._jdf.queryExecution().optimizedPlan().toString()
    assert "LIKE" not in plan and "StartsWith" not in plan


def test_empty_inputs(spark, small):
    nothing = Filters(app="nobody", start=START, to=ALL.to)
    events, calls, errors = V.mobile_events(spark, small), V.mobile_api_calls(spark, small), V.mobile_errors(spark, small)
    assert tuple(dashboard.overview(events, calls, errors, nothing).first()) == (0, 0, 0, 0, 0, 0.0)
    cards = dashboard.overview_cards(dashboard.overview(events, calls, errors, nothing)).first()
    assert cards.api_error_pct is None and cards.avg_app_start is None and cards.total_events == "0"
    assert dashboard.api_latency(calls, nothing, exact=True).count() == 0
    assert dashboard.error_feed(errors, nothing).count() == 0


def test_feed_limits(spark, small):
    errors = V.mobile_errors(spark, small)
    assert dashboard.error_feed(errors, ALL).count() == 50
    assert dashboard.error_feed(errors, ALL, limit=60).count() == min(60, dashboard.error_feed(errors, ALL, limit=10**6).count())
    assert dashboard.api_limit(9999) == 500 and dashboard.api_limit(7) == 7 and dashboard.api_limit(-1) == 0


def test_approximate_reads_are_close(spark, small):
    events, calls = V.mobile_events(spark, small), V.mobile_api_calls(spark, small)
    exact, near = (dashboard.overview_events(events, ALL, approx=a).first() for a in (False, True))
    assert abs(exact.unique_sessions - near.unique_sessions) <= 0.1 * exact.unique_sessions
    total = dashboard.endpoint_summary(dashboard.api_latency(calls, ALL)).agg(F.sum("requests")).first()[0]
    assert total == dashboard.overview_api(calls, ALL).first().total_api_calls


def test_candidate_release_is_slower(spark, small):
    row = dashboard.compare_releases(V.mobile_events(spark, small), V.mobile_api_calls(spark, small), "v1.0.0", "v1.1.0").first()
    assert row.slower and row.candidate_mean_ms > row.base_mean_ms


# --- sessions ------------------------------------------------------------------------------------


def test_last_screen_against_brute_force(spark):
    views, errors = [], []
    for i in range(400):
        t = START + timedelta(minutes=(i * 37) % 600, seconds=i % 3)
        views.append((f"v{i}", "hot" if i % 3 else f"s{i % 7}", t, f"Screen{i % 11}"))
    for i in range(300):
        t = START + timedelta(minutes=(i * 53) % 600, seconds=i % 3)
        errors.append((f"x{i}", "hot" if i % 3 else f"s{i % 9}", t, "Own" if i % 5 == 0 else (" " if i % 7 == 0 else None)))
    ddl = "event_id string, session_id string, event_time timestamp, screen_name string"
    v = spark.createDataFrame(views, ddl).withColumn("event_type", F.lit("screen_view"))
    got = {r.event_id: r.screen_name for r in sessions.error_last_screen(spark.createDataFrame(errors, ddl), v, dedup=False).collect()}
    assert len(got) == len(errors)
    for eid, sid, t, own in errors:
        seen = [(vt, vid, name) for vid, vs, vt, name in views if vs == sid and vt <= t]
        assert got[eid] == (own if own and own.strip() else (max(seen)[2] if seen else None))


def test_session_partials_merge(spark, small):
    e, c, x = V.mobile_events(spark, small), V.mobile_api_calls(spark, small), V.mobile_errors(spark, small)
    split = F.pmod(F.hash("event_id"), F.lit(4))
    parts = sessions.session_partials(*[d.withColumn("b", split) for d in (e, c, x)], dedup=False, by=["b"])
    whole = sessions.build_sessions(e, c, x, dedup=False)
    assert sessions.merge_sessions(parts).exceptAll(whole).count() == 0
    assert whole.agg(F.sum("event_count")).first()[0] == e.count() + c.count() + x.count()
