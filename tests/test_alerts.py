from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from appwatch.operators import alerts, metadata
from appwatch.operators.rollups import roll_up
from appwatch.sources import views as V

NOW = datetime(2024, 1, 3)
RULE = "id long, app_id long, app_name string, name string, metric_type string, threshold double, window_minutes int, env string, release string"
CALL = "app string, env string, release string, event_time timestamp, status_code int, duration_ms double"
ROLL = "app string, env string, release string, minute timestamp, error_count long"
FIRING = "id long, rule_id long, fired_at timestamp, status string"


def rule(i, metric, threshold, window=5, app="demo-app", env=None, release=None):
    return (i, 1, app, f"rule {i}", metric, float(threshold), window, env, release)


def run(spark, rules, errors=(), calls=(), as_of=NOW, **kw):
    out = alerts.evaluate_rules(
        spark.createDataFrame(rules, RULE), spark.createDataFrame(list(errors), ROLL), spark.createDataFrame(list(calls), CALL),
        as_of, exact=kw.pop("exact", True), **kw,
    )
    return {r.rule_id: r for r in out.collect()}


def err(minutes_ago, n, app="demo-app", env="prod", release="v1"):
    return (app, env, release, NOW - timedelta(minutes=minutes_ago), n)


def call(seconds_ago, status=200, ms=100.0, app="demo-app", env="prod", release="v1"):
    return (app, env, release, NOW - timedelta(seconds=seconds_ago), status, ms)


def test_fifty_errors_in_five_minutes_are_ten_per_minute(spark):
    got = run(spark, [rule(1, "error_rate", 10)], [err(1, 20), err(4, 30), err(6, 99)])
    assert got[1].value == 10.0 and got[1].breached


def test_silent_rules_stay(spark):
    got = run(spark, [rule(1, "error_rate", 1), rule(2, "failed_requests", 0), rule(3, "p95_latency_ms", 0)])
    assert (got[1].value, got[1].breached) == (0.0, False)
    assert (got[2].value, got[2].breached) == (0.0, True)
    assert (got[3].value, got[3].breached) == (None, False)


def test_equal_fires_below_does_not(spark):
    calls = [call(i, 500) for i in range(50)]
    got = run(spark, [rule(1, "failed_requests", 50), rule(2, "failed_requests", 50.5)], calls=calls)
    assert got[1].breached and not got[2].breached


def test_unknown_metric_is_an_error_row_and_harms_nobody(spark):
    got = run(spark, [rule(1, "unknown_type", 0), rule(2, "failed_requests", 50)], calls=[call(i, 503) for i in range(75)])
    assert got[1].error == "Unknown metric type: unknown_type" and not got[1].breached and got[1].value is None
    assert got[2].value == 75 and got[2].breached


def test_env_and_app_filters(spark):
    errors = [err(1, 10), err(1, 5, env="staging"), err(1, 1, app="other-app")]
    got = run(spark, [rule(1, "error_rate", 0, 1), rule(2, "error_rate", 0, 1, env="prod"), rule(3, "error_rate", 0, 1, env=" "),
                      rule(4, "error_rate", 0, 1, app=" ")], errors)
    assert [got[i].value for i in (1, 2, 3, 4)] == [15, 10, 15, 16]


def test_release_applies_only_on_request(spark):
    errors = [err(1, 10), err(1, 5, release="v2")]
    rules = [rule(1, "error_rate", 0, 1, release="v2")]
    assert run(spark, rules, errors)[1].value == 15
    assert run(spark, rules, errors, apply_release=True)[1].value == 5


def test_window_edges(spark):
    """The lower bound is inclusive, later telemetry counts, and a rollup minute counts by its start."""
    calls = [call(300, 500), call(300.001, 500), call(-3600, 500)]
    assert run(spark, [rule(1, "failed_requests", 0)], calls=calls)[1].value == 2
    late = NOW + timedelta(seconds=30)
    assert run(spark, [rule(1, "error_rate", 0, 5)], [err(5, 10), err(4, 10)], as_of=late)[1].value == 2.0
    assert run(spark, [rule(1, "error_rate", 0, 5)], [err(5, 10), err(4, 10)])[1].value == 4.0


def test_approximate_p95_is_close(spark):
    calls = [call(i % 200, 200, float(i)) for i in range(2000)]
    got = run(spark, [rule(1, "p95_latency_ms", 0), rule(2, "p95_latency_ms", 0, env="prod")], calls=calls, exact=False)
    assert got[1].value == pytest.approx(1899, abs=60) and got[2].value == got[1].value
    again = run(spark, [rule(1, "p95_latency_ms", 0)], calls=calls[::-1], exact=False)
    assert again[1].value == got[1].value and got[1].value == pytest.approx(np.quantile(np.arange(2000.0), 0.95), rel=0.004)


def test_suppression_looks_back_two_windows_inclusive(spark):
    evaluated = alerts.evaluate_rules(
        spark.createDataFrame([rule(i, "failed_requests", 1) for i in (1, 2, 3, 4)], RULE), spark.createDataFrame([], ROLL),
        spark.createDataFrame([call(1, 500)], CALL), NOW,
    )
    firings = spark.createDataFrame(
        [
            (1, 1, NOW - timedelta(minutes=10), "firing"),
            (2, 2, NOW - timedelta(minutes=10, seconds=1), "firing"),
            (9, 3, NOW - timedelta(minutes=1), "resolved"),
        ],
        FIRING,
    )
    rows = alerts.new_firings(evaluated, firings, NOW).collect()
    assert sorted(r.rule_id for r in rows) == [2, 3, 4] and len({r.id for r in rows}) == 3 and min(r.id for r in rows) > 9
    assert {(r.status, str(r.value_observed)) for r in rows} == {("firing", "1.0000")}


@pytest.fixture(scope="module")
def sf001():
    return "/root/testdata/sf0.01"


def test_values_of_the_fixture(spark, sf001):
    """Literal values for the last hour of the derived telemetry."""
    from appwatch.plans.queries import _calls

    rules = [
        rule(1, "error_rate", 0.1, 60), rule(2, "p95_latency_ms", 2000, 60), rule(3, "failed_requests", 50, 60),
        rule(4, "failed_requests", 3, 60, app="other-app"), rule(5, "error_rate", 0.1, 60, env="prod"),
        rule(9, "p95_latency_ms", 0, 60, app="quiet-app"), rule(10, "error_rate", 0, 60, app="quiet-app"),
    ]
    errors = roll_up(V.mobile_errors(spark, sf001), "error_rate_1m")
    out = alerts.evaluate_rules(spark.createDataFrame(rules, RULE), errors, _calls(spark, sf001), NOW, exact=True)
    got = {r.rule_id: r for r in out.collect()}
    assert got[1].value == pytest.approx(0.383333, abs=1e-6) and got[1].breached
    assert got[2].value == pytest.approx(6537.04, abs=1e-6) and got[2].breached
    assert got[3].value == 9 and not got[3].breached
    assert got[4].value == 3 and got[4].breached
    assert got[5].value == pytest.approx(0.3)
    assert got[9].value is None and not got[9].breached
    assert got[10].value == 0 and got[10].breached


def brute_backtest(breaches: dict[int, float], window: int, step: int) -> list[int]:
    fired, last = [], None
    for tick in sorted(breaches):
        if last is None or (tick - last) * step > 2 * window:
            fired.append(tick)
            last = tick
    return fired


def test_backtest_replays_the_loop(spark):
    start = NOW - timedelta(hours=3)
    times = [3, 4, 31, 33, 34, 36, 70, 71, 72, 73, 74, 75, 76, 77, 120, 170]
    calls = [("demo-app", "prod", "v1", start + timedelta(minutes=m, seconds=20), 500, 10.0) for m in times]
    rules = [rule(1, "failed_requests", 2, 5), rule(2, "failed_requests", 1, 10), rule(3, "failed_requests", 0, 30), rule(4, "p95_latency_ms", 10, 5)]
    out = alerts.backtest(
        spark.createDataFrame(rules, RULE), spark.createDataFrame([], ROLL), spark.createDataFrame(calls, CALL), start, NOW, 1, exact=True
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.rule_id, []).append(int((r.fired_at - start).total_seconds() // 60))
    for rule_id, threshold, window in ((1, 2, 5), (2, 1, 10), (3, 0, 30)):
        counts = {t: sum(1 for m in times if t - window <= m < t) for t in range(181)}
        want = brute_backtest({t: c for t, c in counts.items() if c >= threshold}, window, 1)
        assert sorted(got.get(rule_id, [])) == want
    p95 = {t: 10.0 for t in range(181) if any(t - 5 <= m < t for m in times)}
    assert sorted(got[4]) == brute_backtest(p95, 5, 1)


def test_replay_follows_a_class_of_rules_once(spark, monkeypatch):
    """Rules with thresholds of their own fire as one by one, and what is written does not grow with their number."""
    start = NOW - timedelta(hours=3)
    times = [3, 4, 31, 33, 34, 36, 70, 71, 72, 73, 74, 75, 76, 77, 120, 170]
    calls = spark.createDataFrame([("demo-app", "prod", "v1", start + timedelta(minutes=m, seconds=20), 500, 10.0) for m in times], CALL)
    kept, write = [], alerts.written
    monkeypatch.setattr(alerts, "written", lambda df, label: (kept.append((label, write(df, label))), kept[-1][1])[1])
    rules = [rule(i, "failed_requests", i / 50, 5 if i % 2 else 10) for i in range(400)]
    out = alerts.backtest(spark.createDataFrame(rules, RULE), spark.createDataFrame([], ROLL), calls, start, NOW, 1, exact=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.rule_id, []).append((int((r.fired_at - start).total_seconds() // 60), r.value))
    for i in range(400):
        window = 5 if i % 2 else 10
        counts = {t: sum(1 for m in times if t - window <= m < t) for t in range(181)}
        want = brute_backtest({t: c for t, c in counts.items() if c >= i / 50}, window, 1)
        assert sorted(got.get(i, [])) == [(t, counts[t]) for t in want]
    levels = sum(len({sum(1 for m in times if t - w <= m < t) for t in range(181)}) for w in (5, 10))
    assert [df.count() for label, df in kept if label == "breaches"][0] <= levels * 181 < 400 * 181 / 10


def test_feed_has_as_many_rows_as_asked_for(spark, small):
    rules, apps, firings = V.alert_rules(spark, small), V.apps(spark, small), V.alert_firings(spark, small)
    feed = alerts.firings_feed(firings, rules, apps, datetime(2024, 1, 1), NOW, limit=700).collect()
    assert len(feed) == 700 and feed == sorted(feed, key=lambda r: (r.fired_at, r.id), reverse=True)
    assert len(alerts.firings_feed(firings, rules, apps, datetime(2024, 1, 1), NOW, app="demo-app").collect()) == 50
    assert alerts.firings_feed(firings, rules, apps, datetime(2024, 1, 1), NOW, app="nobody").count() == 0


def test_ids_are_unique_new_and_repeatable(spark):
    apps = spark.createDataFrame([(7, "a"), (9, "b")], "id long, name string")
    names = spark.range(1000).select(F.concat(F.lit("n"), F.col("id") % 300).alias("name")).union(apps.select("name"))
    first = {r.name: r.id for r in metadata.register_apps(names, apps).collect()}
    assert len(set(first.values())) == 300 and min(first.values()) > 9 and "a" not in first
    assert {r.name: r.id for r in metadata.register_apps(names.repartition(5), apps).collect()} == first
    everyone = {r.name: r.id for r in metadata.app_ids(names, apps).collect()}
    assert everyone == {**first, "a": 7, "b": 9}


def test_default_rules_only_for_apps_without_any(spark):
    apps = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rules = spark.createDataFrame([(9, 1)], "id long, app_id long")
    rows = metadata.default_rules(apps, rules).collect()
    assert len({r.id for r in rows}) == 3 and min(r.id for r in rows) > 9 and all(r.created_at for r in rows)
    assert sorted((r.app_id, r.metric_type, float(r.threshold), r.window_minutes, r.env) for r in rows) == [
        (2, "error_rate", 10.0, 5, "prod"), (2, "failed_requests", 50.0, 5, None), (2, "p95_latency_ms", 2000.0, 5, None),
    ]


def test_a_tick_from_rollups_equals_one_from_calls(spark, small):
    """At whole minutes and inside one; calls in a window's first, cut minute count one by one."""
    from appwatch.plans.queries import _calls

    rules = [rule(i, m, 0, w, app=a, env=e) for i, (m, w, a, e) in enumerate(
        (m, w, a, e) for m in ("error_rate", "p95_latency_ms", "failed_requests") for w in (1, 5, 6, 60, 600)
        for a, e in (("demo-app", None), ("other-app", "prod"), (" ", None)))]
    rules.append(rule(99, "unknown_type", 0))
    rules = spark.createDataFrame(rules, RULE)
    calls = _calls(spark, small).cache()
    errors, minutes = roll_up(V.mobile_errors(spark, small), "error_rate_1m").cache(), roll_up(calls, "api_latency_1m", dedup=False).cache()
    for as_of in (NOW, NOW - timedelta(hours=7, seconds=17, milliseconds=250), NOW - timedelta(days=1, milliseconds=1)):
        want = alerts.evaluate_rules(rules, errors, calls, as_of)
        got = alerts.evaluate_from_rollups(rules, errors, minutes, calls, as_of)
        key = lambda r: r.rule_id
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_a_tick_reads_calls_only_of_cut_minutes(spark, small, tmp_path):
    from appwatch import schema as S
    from appwatch.sources import tables

    tables.append(V.mobile_api_calls(spark, small), str(tmp_path), "mobile_api_calls", "b-0")
    calls = tables.read_stored(spark, str(tmp_path), S.MOBILE_API_CALLS, dedup=False)
    minutes, errors = roll_up(V.mobile_api_calls(spark, small), "api_latency_1m"), roll_up(V.mobile_errors(spark, small), "error_rate_1m")
    rules = spark.createDataFrame([rule(1, "p95_latency_ms", 0, 5), rule(2, "failed_requests", 0, 60)], RULE)
    plan = lambda as_of: alerts.evaluate_from_rollups(rules, errors, minutes, calls, as_of)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan(NOW)  # a whole minute: no calls at all
    cut = plan(NOW - timedelta(seconds=30))
    assert "2024-01-02 22:59:30" in cut and "2024-01-02 23:54:59.999999" in cut and "PushedFilters: [Or(" in cut
