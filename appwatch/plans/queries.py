"""Every operator as a query over the driver's tables, next to the SQL that computes the same rows.

Percentile and distinct-count queries use the exact modes, so that results can be compared.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions import histograms, scalars
from appwatch.functions.filters import Filters
from appwatch.operators import alerts, dashboard, ingest, metadata, sessions
from appwatch.operators.dedup import deduplicate, narrow
from appwatch.operators.mapping import skip_unknown, to_table
from appwatch.operators.rollups import SESSION_ERROR, SESSIONS_1M, merge_rollup, roll_up, rollup_percentiles, rollup_spec, unique_sessions
from appwatch.plans.registry import query
from appwatch.plans.sql import select
from appwatch.session import scratch_path
from appwatch.sources import bucketed as bucketed_tables
from appwatch.sources import tables
from appwatch.sources import views as V
from appwatch.sources.metadata import append_metadata, read_metadata

START = datetime(2024, 1, 1)
AS_OF = datetime(2024, 1, 3)
EVERYTHING = Filters(start=START, to=AS_OF)
CHECKOUT = Filters(start=START, to=AS_OF, path="/check%", method="POST")
DEMO_PROD = Filters.last_hours(24, AS_OF, app="demo%", env="prod", release="v1.0._")

_RANGE = "event_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-03'"
_NUMBER = "cast(substring(event_id, 3) as bigint)"


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and doubles to six digits, as compared."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            scalars.plain(F.col(c)).alias(c)
            if kinds[c] == "timestamp"
            else F.round(c, 6).alias(c)
            if kinds[c] == "double"
            else F.col(c)
            for c in df.columns
        ]
    )


def _r(*exprs: str) -> str:
    """``round(e, 6) AS name`` for each ``name=e``."""
    return ", ".join(f"round({e.split('=', 1)[1]}, 6) AS {e.split('=', 1)[0]}" for e in exprs)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated calls in the columns that rules and rollups look at."""
    columns = ["app", "env", "release", "path", "method", "event_time", "event_id", "status_code", "duration_ms"]
    return narrow(V.mobile_api_calls(spark, sf), S.MOBILE_API_CALLS, columns)


# --- dashboard reads ---------------------------------------------------------------------------

_OVERVIEW = """
SELECT (SELECT count(*) FROM {e} WHERE {f}) AS total_events,
  (SELECT count(DISTINCT session_id) FROM {e} WHERE {f}) AS unique_sessions,
  (SELECT count(*) FROM {x} WHERE {f}) AS total_errors,
  (SELECT count(*) FROM {c} WHERE {f}) AS total_api_calls,
  (SELECT count(*) FROM {c} WHERE {f} AND status_code >= 400) AS api_errors,
  round(coalesce((SELECT avg(duration_ms) FROM {e} WHERE {f} AND event_type = 'app_start'), 0), 6) AS avg_app_start_ms
"""
_DEMO_PROD = (
    "app LIKE 'demo%' AND env = 'prod' AND release LIKE 'v1.0._' "
    "AND event_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03'"
)


def _overview(spark: SparkSession, sf: str, filters: Filters, dedup: bool = True) -> DataFrame:
    return dashboard.overview(
        V.mobile_events(spark, sf), V.mobile_api_calls(spark, sf), V.mobile_errors(spark, sf), filters, dedup
    )


@query("overview", select(_OVERVIEW.format(e="de", c="dc", x="dx", f=_RANGE)))
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_overview(spark, sf, EVERYTHING))


@query("overview_raw", select(_OVERVIEW.format(e="me", c="mc", x="mx", f=_RANGE)))
def overview_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_overview(spark, sf, EVERYTHING, dedup=False))


@query("overview_filtered", select(_OVERVIEW.format(e="de", c="dc", x="dx", f=_DEMO_PROD)))
def overview_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_overview(spark, sf, DEMO_PROD))


@query(
    "overview_events",
    select(
        "SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions, "
        "round(avg(CASE WHEN event_type = 'app_start' THEN duration_ms END), 6) AS avg_app_start_ms FROM de WHERE " + _RANGE
    ),
)
def overview_events(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(dashboard.overview_events(V.mobile_events(spark, sf), EVERYTHING))


@query("overview_errors", select("SELECT count(*) AS total_errors FROM dx WHERE " + _RANGE))
def overview_errors(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.overview_errors(V.mobile_errors(spark, sf), EVERYTHING)


@query(
    "overview_api",
    select("SELECT count(*) AS total_api_calls, count(*) FILTER (status_code >= 400) AS api_errors FROM dc WHERE " + _RANGE),
)
def overview_api(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.overview_api(V.mobile_api_calls(spark, sf), EVERYTHING)


def _compact(c: str) -> str:
    return f"CASE WHEN {c} >= 1000000 THEN printf('%.1fM', {c} / 1000000.0) WHEN {c} >= 1000 THEN printf('%.1fK', {c} / 1000.0) ELSE printf('%.0f', {c} * 1.0) END"


@query(
    "overview_cards",
    select(
        "SELECT "
        + ", ".join(f"{_compact(c)} AS {c}" for c in ("total_events", "unique_sessions", "total_errors", "total_api_calls", "api_errors"))
        + ", CASE WHEN total_api_calls > 0 THEN round(api_errors * 100.0 / total_api_calls, 1) END AS api_error_pct, "
        + f"CASE WHEN avg_app_start_ms > 0 THEN {_compact('avg_app_start_ms')} || ' ms' END AS avg_app_start FROM o",
        "o AS (" + _OVERVIEW.format(e="de", c="dc", x="dx", f=_RANGE) + ")",
    ),
)
def overview_cards(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.overview_cards(_overview(spark, sf, EVERYTHING))


_ERROR_FEED = (
    "SELECT event_id, error_class, error_message, release, platform, screen_name, event_time FROM dx WHERE "
    + _RANGE + " ORDER BY event_time DESC, event_id DESC LIMIT "
)


@query("error_feed", select(_ERROR_FEED + "500"))
def error_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(dashboard.error_feed(V.mobile_errors(spark, sf), EVERYTHING, limit=500))


@query("error_feed_long", select(_ERROR_FEED + "3000"))
def error_feed_long(spark: SparkSession, sf: str) -> DataFrame:
    """More rows than the web API grants: the operator returns what is asked for."""
    return _plain(dashboard.error_feed(V.mobile_errors(spark, sf), EVERYTHING, limit=3000))


def _latency_sql(where: str = "", source: str = "dc", q: str = "quantile_cont") -> str:
    return (
        "SELECT path, method, release, date_trunc('hour', event_time) AS bucket, count(*) AS request_count, "
        "count(*) FILTER (status_code >= 400) AS error_count, "
        + _r(*[f"{n}={q}(duration_ms, {p})" for n, p in dashboard.LEVELS.items()])
        + f" FROM {source} WHERE {_RANGE} {where} GROUP BY ALL"
    )


@query("api_latency", select(_latency_sql()))
def api_latency(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(dashboard.api_latency(V.mobile_api_calls(spark, sf), EVERYTHING, exact=True))


@query("latency_checkout", select(_latency_sql("AND path LIKE '/check%' AND method = 'POST'")))
def latency_checkout(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(dashboard.api_latency(V.mobile_api_calls(spark, sf), CHECKOUT, exact=True))


def bucketed(source: str = "dc") -> str:
    """CTEs ending in ``hc``: calls with the histogram bucket of their duration, and in its place the value that stands for the bucket."""
    return f"""
hq AS (SELECT *, CAST(floor(least(abs(duration_ms), 9e15) * 1000) AS BIGINT) AS units FROM {source}),
hs AS (SELECT *, greatest(length(bin(units)) - 8, 0) AS spare, CASE WHEN duration_ms < 0 THEN -1 ELSE 1 END AS sign FROM hq),
hc AS (SELECT * REPLACE (sign * (((units >> spare) << spare) + ((1::BIGINT << spare) - 1) / 2.0) / 1000 AS duration_ms),
  sign * (spare * 128 + (units >> spare)) AS hbucket, duration_ms AS exact_ms FROM hs)"""


@query("latency_from_rollup", select(_latency_sql(source="hc"), bucketed()))
def latency_from_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly figures from the minute rollup, percentiles from its histograms."""
    minutes = roll_up(V.mobile_api_calls(spark, sf), "api_latency_1m")
    return _plain(dashboard.latency_from_rollup(minutes, EVERYTHING))


@query(
    "endpoint_summary",
    select(
        "SELECT method, path, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, "
        "round(count(*) FILTER (status_code >= 400) * 100.0 / count(*), 1) AS error_pct FROM dc WHERE " + _RANGE + " GROUP BY ALL"
    ),
)
def endpoint_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.endpoint_summary(dashboard.api_latency(V.mobile_api_calls(spark, sf), EVERYTHING))


@query(
    "latency_series",
    select(
        "SELECT method, path, release, bucket, "
        + ", ".join(f"CAST(floor({n} + 0.5) AS BIGINT) AS {n}" for n in dashboard.LEVELS)
        + ", error_count AS errors, request_count AS requests FROM (" + _latency_sql() + ")"
    ),
)
def latency_series(spark: SparkSession, sf: str) -> DataFrame:
    exact = dashboard.api_latency(V.mobile_api_calls(spark, sf), EVERYTHING, exact=True)
    rounded = exact.select(*[F.round(c, 6).alias(c) if c in dashboard.LEVELS else c for c in exact.columns])
    return _plain(dashboard.latency_series(rounded))


@query(
    "latency_overall",
    select(
        "SELECT app, method, path, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, "
        "count(*) FILTER (status_code = 0) AS network_failures, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM dc GROUP BY ALL"
    ),
)
def latency_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(dashboard.latency_overall(V.mobile_api_calls(spark, sf), ["app", "method", "path"], exact=True))


@query("counts_by_type", select("SELECT event_type, count(*) AS n FROM t GROUP BY 1"))
def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    calls = V.mobile_api_calls(spark, sf).withColumn("event_type", F.lit("api_timing"))
    errors = V.mobile_errors(spark, sf).withColumn("event_type", F.lit("error"))
    return dashboard.counts_by_type(V.mobile_events(spark, sf), calls, errors)


@query(
    "window_presets",
    select(
        "SELECT h.hours, count(t.event_time) AS n FROM (VALUES (1), (6), (24), (168)) h(hours) LEFT JOIN t "
        "ON t.event_time BETWEEN TIMESTAMP '2024-01-03' - to_hours(h.hours) AND TIMESTAMP '2024-01-03' GROUP BY 1"
    ),
)
def window_presets(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.window_presets(V.telemetry(spark, sf), AS_OF)


def _release(label: str, release: str) -> str:
    c, e = f"FROM dc WHERE release = '{release}'", f"FROM de WHERE release = '{release}' AND event_type = 'app_start'"
    return ", ".join(
        f"round((SELECT {x}), 6) AS {label}_{n}"
        for n, x in (
            ("mean_ms", f"avg(duration_ms) {c}"),
            ("p95_ms", f"quantile_cont(duration_ms, 0.95) {c}"),
            ("error_share", f"avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) {c}"),
            ("start_ms", f"avg(duration_ms) {e}"),
        )
    )


@query(
    "compare_releases",
    select(
        "SELECT 'v1.0.0' AS base, 'v1.1.0' AS candidate, " + _release("base", "v1.0.0") + ", " + _release("candidate", "v1.1.0")
        + ", (SELECT avg(duration_ms) FROM dc WHERE release = 'v1.1.0') > (SELECT avg(duration_ms) FROM dc WHERE release = 'v1.0.0') AS slower"
    ),
)
def compare_releases(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(
        dashboard.compare_releases(V.mobile_events(spark, sf), V.mobile_api_calls(spark, sf), "v1.0.0", "v1.1.0", exact=True)
    )


@query("chronological", select("SELECT event_time, event_id, event_type, session_id, received_at FROM t ORDER BY event_time, event_id, received_at"))
def chronological(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.telemetry(spark, sf).select("event_time", "event_id", "event_type", "session_id", "received_at")
    return _plain(rows.orderBy("event_time", "event_id", "received_at"))


# --- deduplication and rollups -------------------------------------------------------------------


def _table_sql(spec: S.TableSpec, source: str) -> str:
    made = {
        "trace_id": "CAST(NULL AS VARCHAR) AS trace_id", "stacktrace": "CAST(NULL AS VARCHAR) AS stacktrace",
        "request_size": "CAST(NULL AS BIGINT) AS request_size", "response_size": "CAST(NULL AS BIGINT) AS response_size",
        "schema_version": "1 AS schema_version", "event_data": "coalesce(event_data, '{}') AS event_data",
        "duration_ms": "round(duration_ms, 6) AS duration_ms",
    }
    return "SELECT " + ", ".join(made.get(c, c) for c in spec.columns) + f" FROM {source}"


@query("dedup_events", select(_table_sql(S.MOBILE_EVENTS, "de")))
def dedup_events(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(deduplicate(V.mobile_events(spark, sf), S.MOBILE_EVENTS).select(*S.MOBILE_EVENTS.columns))


@query("dedup_api_calls", select(_table_sql(S.MOBILE_API_CALLS, "dc")))
def dedup_api_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(deduplicate(V.mobile_api_calls(spark, sf), S.MOBILE_API_CALLS).select(*S.MOBILE_API_CALLS.columns))


@query("dedup_errors", select(_table_sql(S.MOBILE_ERRORS, "dx")))
def dedup_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(deduplicate(V.mobile_errors(spark, sf), S.MOBILE_ERRORS).select(*S.MOBILE_ERRORS.columns))


_MINUTE = "date_trunc('minute', event_time) AS minute"
_THROUGHPUT = f"SELECT app, env, release, platform, event_type, {_MINUTE}, count(*) AS event_count FROM {{}} GROUP BY ALL"
_LATENCY_1M = (
    f"SELECT app, env, release, path, method, {_MINUTE}, count(*) AS request_count, "
    "count(*) FILTER (status_code >= 400) AS error_count, round(sum(duration_ms), 6) AS duration_sum, "
    "round(max(duration_ms), 6) AS duration_max FROM {} GROUP BY ALL"
)
_ERRORS_1M = f"SELECT app, env, release, platform, error_type, error_class, {_MINUTE}, count(*) AS error_count FROM {{}} GROUP BY ALL"


@query("rollup_throughput", select(_THROUGHPUT.format("de")))
def rollup_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(roll_up(V.mobile_events(spark, sf), "events_throughput_1m"))


_HISTOGRAM_1M = (
    "SELECT app, env, release, path, method, " + _MINUTE + ", count(*) AS request_count, "
    "count(*) FILTER (status_code >= 400) AS error_count, round(sum(exact_ms), 6) AS duration_sum, round(max(exact_ms), 6) AS duration_max, "
    + _r(*[f"{n}=quantile_cont(duration_ms, {p})" for n, p in dashboard.LEVELS.items()])
    + ", array_to_string([CAST(e.key AS VARCHAR) || ':' || CAST(e.value AS VARCHAR) FOR e IN map_entries(histogram(hbucket))], ',') AS durations "
    "FROM hc GROUP BY ALL"
)


def _with_percentiles(rollup: DataFrame) -> DataFrame:
    """The rollup's rows with their histograms as text and the percentiles these give."""
    rows = rollup.withColumn("durations", histograms.as_text(F.col("duration_histogram")))
    return rollup_percentiles(rows, "api_latency_1m", dashboard.LEVELS, [*rollup_spec("api_latency_1m").key, "durations"])


@query("rollup_api_latency", select(_HISTOGRAM_1M, bucketed()))
def rollup_api_latency(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_with_percentiles(roll_up(V.mobile_api_calls(spark, sf), "api_latency_1m")))


@query("rollup_errors", select(_ERRORS_1M.format("dx")))
def rollup_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(roll_up(V.mobile_errors(spark, sf), "error_rate_1m"))


@query("rollup_errors_raw", select(_ERRORS_1M.format("mx")))
def rollup_errors_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery counted, as when rolling up at insert time."""
    return _plain(roll_up(V.mobile_errors(spark, sf), "error_rate_1m", dedup=False))


@query("rollup_merge", select(_HISTOGRAM_1M, bucketed()))
def rollup_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Partial rollups of eight slices, merged: the same as rolling up at once, histograms included."""
    rows = _calls(spark, sf)
    rows = rows.withColumn("slice", F.pmod(F.crc32("event_id"), F.lit(8)))
    partials = roll_up(rows, "api_latency_1m", dedup=False, by=["slice"])
    return _plain(_with_percentiles(merge_rollup(partials, "api_latency_1m")))


# --- sessions --------------------------------------------------------------------------------------

_SESSIONS = (
    "SELECT session_id, any_value(user_id) AS user_id, any_value(app) AS app, any_value(env) AS env, "
    "any_value(app_version) AS app_version, any_value(release) AS release, any_value(platform) AS platform, "
    "any_value(device_model) AS device_model, any_value(os_version) AS os_version, min(event_time) AS started_at, "
    "max(event_time) AS ended_at, count(*) AS event_count, count(*) FILTER (event_type = 'error') AS error_count FROM {} GROUP BY session_id"
)


@query("sessions", select(_SESSIONS.format("(SELECT * FROM de UNION ALL SELECT * FROM dc UNION ALL SELECT * FROM dx)")))
def build_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sessions.build_sessions(V.mobile_events(spark, sf), V.mobile_api_calls(spark, sf), V.mobile_errors(spark, sf)))


@query(
    "error_last_screen",
    select(
        "SELECT event_id, session_id, event_time, CASE WHEN own IS NOT NULL THEN own ELSE seen END AS screen_name FROM "
        "(SELECT *, last_value(screen IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_time, kind, event_id "
        "ROWS UNBOUNDED PRECEDING) AS seen FROM ("
        "SELECT 1 AS kind, event_id, session_id, event_time, screen_name AS own, NULL AS screen FROM dx UNION ALL "
        "SELECT 0, event_id, session_id, event_time, NULL, screen_name FROM de WHERE event_type = 'screen_view')) WHERE kind = 1"
    ),
)
def error_last_screen(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sessions.error_last_screen(V.mobile_errors(spark, sf), V.mobile_events(spark, sf)))


# --- the same in a time range: months outside it are not read -------------------------------------------

SECOND_DAY = Filters(start=datetime(2024, 1, 2), to=AS_OF)
_SECOND_DAY = "event_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03'"
_DAY_CTES = ", ".join(f"{n} AS (SELECT * FROM {t} WHERE {_SECOND_DAY})" for n, t in (("re", "de"), ("rc", "dc"), ("rx", "dx")))


@query(
    "sessions_range",
    select(
        "SELECT session_id, " + ", ".join(f"last({d} ORDER BY event_time, event_id) AS {d}" for d in sessions.SESSION_DIMS)
        + ", min(event_time) AS started_at, max(event_time) AS ended_at, count(*) AS event_count, count(*) FILTER (event_type = 'error') AS error_count "
        "FROM (SELECT * FROM re UNION ALL SELECT * FROM rc UNION ALL SELECT * FROM rx) GROUP BY session_id",
        _DAY_CTES,
    ),
)
def sessions_range(spark: SparkSession, sf: str) -> DataFrame:
    tables_ = V.mobile_events(spark, sf), V.mobile_api_calls(spark, sf), V.mobile_errors(spark, sf)
    return _plain(sessions.build_sessions(*tables_, filters=SECOND_DAY))


@query(
    "error_last_screen_range",
    select(
        "SELECT event_id, session_id, event_time, CASE WHEN own IS NOT NULL THEN own ELSE seen END AS screen_name FROM "
        "(SELECT *, last_value(screen IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_time, kind, event_id "
        "ROWS UNBOUNDED PRECEDING) AS seen FROM ("
        "SELECT 1 AS kind, event_id, session_id, event_time, screen_name AS own, NULL AS screen FROM rx UNION ALL "
        "SELECT 0, event_id, session_id, event_time, NULL, screen_name FROM de WHERE event_type = 'screen_view' "
        "AND event_time BETWEEN TIMESTAMP '2024-01-01 18:00:00' AND TIMESTAMP '2024-01-03')) WHERE kind = 1",
        _DAY_CTES,
    ),
)
def error_last_screen_range(spark: SparkSession, sf: str) -> DataFrame:
    errors, events = V.mobile_errors(spark, sf), V.mobile_events(spark, sf)
    return _plain(sessions.error_last_screen(errors, events, filters=SECOND_DAY, look_back=timedelta(hours=6)))


@query(
    "compare_releases_range",
    select(
        "SELECT 'v1.0.0' AS base, 'v1.1.0' AS candidate, " + (_release("base", "v1.0.0") + ", " + _release("candidate", "v1.1.0")).replace("FROM dc", "FROM rc").replace("FROM de", "FROM re")
        + ", (SELECT avg(duration_ms) FROM rc WHERE release = 'v1.1.0') > (SELECT avg(duration_ms) FROM rc WHERE release = 'v1.0.0') AS slower",
        _DAY_CTES,
    ),
)
def compare_releases_range(spark: SparkSession, sf: str) -> DataFrame:
    events, calls = V.mobile_events(spark, sf), V.mobile_api_calls(spark, sf)
    return _plain(dashboard.compare_releases(events, calls, "v1.0.0", "v1.1.0", exact=True, filters=SECOND_DAY))


@query(
    "latency_overall_range",
    select(
        "SELECT app, method, path, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, "
        "count(*) FILTER (status_code = 0) AS network_failures, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM rc WHERE method = 'POST' GROUP BY ALL",
        _DAY_CTES,
    ),
)
def latency_overall_range(spark: SparkSession, sf: str) -> DataFrame:
    posts = replace(SECOND_DAY, method="POST")
    return _plain(dashboard.latency_overall(V.mobile_api_calls(spark, sf), ["app", "method", "path"], exact=True, filters=posts))


# --- alerts ----------------------------------------------------------------------------------------


@query("rules_enabled", select("SELECT * FROM er"))
def rules_enabled(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.enabled_rules(V.alert_rules(spark, sf), V.apps(spark, sf))


@query(
    "rules_for_app",
    select(
        "SELECT r.id, app_id, r.name, metric_type, threshold, window_minutes, env, release, enabled, r.created_at "
        "FROM rules r JOIN apps a ON a.id = r.app_id WHERE a.name = 'demo-app'"
    ),
)
def rules_for_app(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(alerts.rules_for_app(V.alert_rules(spark, sf), V.apps(spark, sf), "demo-app"))


@query(
    "alerts_feed",
    select(
        "SELECT f.id, f.rule_id, r.name AS rule_name, metric_type, threshold, value_observed, status, fired_at, resolved_at "
        "FROM firings f JOIN rules r ON r.id = f.rule_id JOIN apps a ON a.id = f.app_id "
        "WHERE fired_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-03' ORDER BY fired_at DESC, f.id DESC LIMIT 500"
    ),
)
def alerts_feed(spark: SparkSession, sf: str) -> DataFrame:
    rules, apps = V.alert_rules(spark, sf), V.apps(spark, sf)
    return _plain(alerts.firings_feed(V.alert_firings(spark, sf), rules, apps, START, AS_OF, limit=500))


def _evaluated_sql(release: bool = False, calls: str = "dc") -> str:
    rel = "AND (coalesce(r.release, '') = '' OR d.release = r.release)" if release else ""
    dims = "(trim(r.app_name) = '' OR d.app = r.app_name) AND (coalesce(trim(r.env), '') = '' OR d.env = r.env) " + rel
    since = "TIMESTAMP '2024-01-03' - to_minutes(r.window_minutes)"
    return f"""
ev1 AS (SELECT r.id, coalesce(sum(d.c), 0) / r.window_minutes AS value FROM er r LEFT JOIN rollx d
  ON d.minute >= {since} AND {dims} WHERE metric_type = 'error_rate' GROUP BY r.id, r.window_minutes),
ev2 AS (SELECT r.id, quantile_cont(d.duration_ms, 0.95) AS value FROM er r LEFT JOIN {calls} d
  ON d.event_time >= {since} AND {dims} WHERE metric_type = 'p95_latency_ms' GROUP BY r.id),
ev3 AS (SELECT r.id, count(d.event_id) AS value FROM er r LEFT JOIN dc d
  ON d.status_code >= 400 AND d.event_time >= {since} AND {dims} WHERE metric_type = 'failed_requests' GROUP BY r.id),
ev AS (SELECT r.id AS rule_id, app_id, name, metric_type, threshold, window_minutes,
    CAST(v.value AS DOUBLE) AS value,
    CASE WHEN metric_type = 'unknown_type' THEN 'Unknown metric type: unknown_type' END AS error,
    coalesce(CAST(v.value AS DOUBLE) >= threshold, FALSE) AS breached
  FROM er r LEFT JOIN (SELECT * FROM ev1 UNION ALL SELECT * FROM ev2 UNION ALL SELECT * FROM ev3) v ON v.id = r.id)"""


def _evaluate(
    spark: SparkSession, sf: str, apply_release: bool = False, metrics: tuple[str, ...] = S.ALERT_METRICS, exact: bool = True
) -> DataFrame:
    rules = alerts.enabled_rules(V.alert_rules(spark, sf), V.apps(spark, sf))
    calls = _calls(spark, sf)
    errors = roll_up(V.mobile_errors(spark, sf), "error_rate_1m")
    return alerts.evaluate_rules(rules, errors, calls, AS_OF, exact=exact, apply_release=apply_release, metrics=metrics)


_EV = "SELECT rule_id, app_id, name, metric_type, threshold, window_minutes, round(value, 6) AS value, error, breached FROM ev"


@query("alerts_evaluate", select(_EV, _evaluated_sql()))
def alerts_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_evaluate(spark, sf))


@query("alerts_evaluate_release", select(_EV, _evaluated_sql(release=True)))
def alerts_evaluate_release(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that name a release see that release only."""
    return _plain(_evaluate(spark, sf, apply_release=True))


@query("alerts_evaluate_histogram", select(_EV, bucketed() + "," + _evaluated_sql(calls="hc")))
def alerts_evaluate_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """As a tick evaluates them: percentiles from histograms, the same at every run."""
    return _plain(_evaluate(spark, sf, exact=False))


MID_MINUTE = datetime(2024, 1, 2, 23, 59, 30, 500_000)


@query("alerts_evaluate_rollups", select(_EV, (bucketed() + "," + _evaluated_sql(calls="hc")).replace("TIMESTAMP '2024-01-03'", f"TIMESTAMP '{MID_MINUTE}'")))
def alerts_evaluate_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """A tick in the middle of a minute, from stored minutes and the calls of the minutes that windows cut."""
    rules = alerts.enabled_rules(V.alert_rules(spark, sf), V.apps(spark, sf))
    errors = roll_up(V.mobile_errors(spark, sf), "error_rate_1m")
    minutes = roll_up(V.mobile_api_calls(spark, sf), "api_latency_1m")
    return _plain(alerts.evaluate_from_rollups(rules, errors, minutes, _calls(spark, sf), MID_MINUTE))


def _metric(name: str):
    sql = select("SELECT rule_id, threshold, window_minutes, round(value, 6) AS value, breached FROM ev "
                 f"WHERE metric_type = '{name}'", _evaluated_sql())  # fmt: skip

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _evaluate(spark, sf, metrics=(name,))
        return _plain(rows.select("rule_id", "threshold", "window_minutes", "value", "breached"))

    return run, sql


for _name, _kind in (("metric_error_rate", "error_rate"), ("metric_p95", "p95_latency_ms"), ("metric_failed", "failed_requests")):
    _run, _sql = _metric(_kind)
    query(_name, _sql)(_run)


@query("alerts_bad_rule", select("SELECT rule_id, metric_type, error, breached FROM ev WHERE error IS NOT NULL", _evaluated_sql()))
def alerts_bad_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluate(spark, sf).filter("error is not null").select("rule_id", "metric_type", "error", "breached")


@query(
    "alerts_fire",
    select(
        "SELECT (SELECT max(id) FROM firings) + (row_number() OVER (PARTITION BY substr(md5(CAST(rule_id AS VARCHAR)), 1, 3) "
        "ORDER BY CAST(rule_id AS VARCHAR)) - 1) * 4096 + CAST('0x' || substr(md5(CAST(rule_id AS VARCHAR)), 1, 3) AS BIGINT) + 1 AS id, "
        "rule_id, app_id, TIMESTAMP '2024-01-03' AS fired_at, CAST(NULL AS TIMESTAMP) AS resolved_at, "
        "round(value, 4) AS value_observed, 'firing' AS status FROM ev WHERE breached AND NOT EXISTS (SELECT 1 FROM firings f "
        "WHERE f.rule_id = ev.rule_id AND f.status = 'firing' AND f.fired_at >= TIMESTAMP '2024-01-03' - to_minutes(2 * window_minutes))",
        _evaluated_sql(),
    ),
)
def alerts_fire(spark: SparkSession, sf: str) -> DataFrame:
    fired = alerts.new_firings(_evaluate(spark, sf), V.alert_firings(spark, sf), AS_OF)
    return _plain(fired.withColumn("value_observed", F.col("value_observed").cast("double")))


_BACKTEST = """
ticks AS (SELECT i, TIMESTAMP '2024-01-01' + to_minutes(CAST(i * 30 AS INTEGER)) AS tick FROM range(97) r(i)),
spec AS (SELECT DISTINCT metric_type, app_name, coalesce(trim(env), '') AS env, window_minutes FROM er WHERE metric_type <> 'unknown_type'),
st AS (SELECT *, tick - to_minutes(window_minutes) AS since FROM spec, ticks),
bv AS (
  SELECT metric_type, app_name, st.env, window_minutes, i, tick, coalesce(sum(d.c), 0) / window_minutes AS value FROM st LEFT JOIN rollx d
    ON d.minute >= since AND d.minute < tick AND d.app = app_name AND (st.env = '' OR d.env = st.env) WHERE metric_type = 'error_rate' GROUP BY metric_type, app_name, st.env, window_minutes, i, tick
  UNION ALL
  SELECT metric_type, app_name, st.env, window_minutes, i, tick, count(d.event_id) FROM st LEFT JOIN dc d ON d.status_code >= 400
    AND d.event_time >= since AND d.event_time < tick AND d.app = app_name AND (st.env = '' OR d.env = st.env) WHERE metric_type = 'failed_requests' GROUP BY metric_type, app_name, st.env, window_minutes, i, tick
  UNION ALL
  SELECT metric_type, app_name, st.env, window_minutes, i, tick, quantile_cont(d.duration_ms, 0.95) FROM st JOIN dc d
    ON d.event_time >= since AND d.event_time < tick AND d.app = app_name AND (st.env = '' OR d.env = st.env) WHERE metric_type = 'p95_latency_ms' GROUP BY metric_type, app_name, st.env, window_minutes, i, tick),
br AS (
  SELECT r.id AS rule_id, r.app_id, r.window_minutes, tick, value FROM er r JOIN bv b ON b.metric_type = r.metric_type
    AND b.app_name = r.app_name AND b.env = coalesce(trim(r.env), '') AND b.window_minutes = r.window_minutes WHERE value >= threshold),
fired AS (
  SELECT rule_id, window_minutes, min(tick) AS fired_at FROM br GROUP BY rule_id, window_minutes
  UNION ALL
  SELECT f.rule_id, f.window_minutes, min(b.tick) FROM fired f JOIN br b ON b.rule_id = f.rule_id
    AND b.tick > f.fired_at + to_minutes(2 * f.window_minutes) GROUP BY f.rule_id, f.window_minutes, f.fired_at)"""


@query(
    "alerts_backtest",
    select(
        "SELECT b.rule_id, b.app_id, f.fired_at, round(b.value, 6) AS value FROM fired f JOIN br b ON b.rule_id = f.rule_id AND b.tick = f.fired_at",
        _BACKTEST,
        recursive=True,
    ),
)
def alerts_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """All rules evaluated every 30 minutes over the whole time span."""
    rules = alerts.enabled_rules(V.alert_rules(spark, sf), V.apps(spark, sf))
    calls = _calls(spark, sf)
    errors = roll_up(V.mobile_errors(spark, sf), "error_rate_1m")
    return _plain(alerts.backtest(rules, errors, calls, START, AS_OF, 30, exact=True))


# --- metadata --------------------------------------------------------------------------------------


@query(
    "register_apps",
    select(
        "SELECT (SELECT max(id) FROM apps) + (row_number() OVER (PARTITION BY substr(md5(name), 1, 3) ORDER BY name) - 1) * 4096 "
        "+ CAST('0x' || substr(md5(name), 1, 3) AS BIGINT) + 1 AS id, name, TIMESTAMP '2024-01-03' AS created_at FROM (SELECT DISTINCT 'app-' || CAST(user_id AS VARCHAR) AS name FROM events) WHERE name NOT IN (SELECT name FROM apps)"
    ),
)
def register_apps(spark: SparkSession, sf: str) -> DataFrame:
    names = V.read_table(spark, sf, "events").select(F.concat(F.lit("app-"), "user_id").alias("name"))
    return _plain(metadata.register_apps(names, V.apps(spark, sf), AS_OF))


@query(
    "app_ids",
    select(
        "SELECT id, name, created_at FROM apps WHERE name IN (SELECT name FROM wanted) UNION ALL "
        "SELECT (SELECT max(id) FROM apps) + (row_number() OVER (PARTITION BY substr(md5(name), 1, 3) ORDER BY name) - 1) * 4096 "
        "+ CAST('0x' || substr(md5(name), 1, 3) AS BIGINT) + 1, name, TIMESTAMP '2024-01-03' FROM wanted WHERE name NOT IN (SELECT name FROM apps)",
        "wanted AS (SELECT DISTINCT 'app-' || CAST(user_id AS VARCHAR) AS name FROM events)",
    ),
)
def app_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Each name's app, made if it is not there: known names keep their id and creation time."""
    names = V.read_table(spark, sf, "events").select(F.concat(F.lit("app-"), "user_id").alias("name"))
    return _plain(metadata.app_ids(names, V.apps(spark, sf), AS_OF))


_STORED_METADATA = {
    "apps": ("apps", "id, name, created_at"),
    "api_keys": ("api_keys", "id, app_id, key_prefix, active"),
    "alert_rules": ("rules", "id, app_id, name, metric_type, threshold, window_minutes, env, release, enabled, created_at"),
    "alert_firings": ("firings", "id, rule_id, app_id, fired_at, resolved_at, value_observed, status"),
}


@query("metadata_round_trip", select(" UNION ALL BY NAME ".join(f"SELECT '{n}' AS table_name, {c} FROM {t}" for n, (t, c) in _STORED_METADATA.items())))
def metadata_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The four metadata tables appended to storage and read back."""
    root = scratch_path(spark, "metadata")
    out = None
    for name, (_, columns) in _STORED_METADATA.items():
        append_metadata(getattr(V, name)(spark, sf), name, root)
        rows = read_metadata(spark, name, root).select(*columns.split(", ")).withColumn("table_name", F.lit(name))
        for c in ("threshold", "value_observed"):
            rows = rows.withColumn(c, F.col(c).cast("double")) if c in rows.columns else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return _plain(out)


@query(
    "default_rules",
    select(
        "SELECT (SELECT max(id) FROM rules) + (row_number() OVER (PARTITION BY substr(md5(a.id || '|' || d.name), 1, 3) ORDER BY a.id || '|' || d.name) - 1) * 4096 "
        "+ CAST('0x' || substr(md5(a.id || '|' || d.name), 1, 3) AS BIGINT) + 1 AS id, "
        "a.id AS app_id, d.name, metric_type, threshold, window_minutes, env, CAST(NULL AS VARCHAR) AS release, TRUE AS enabled, "
        "TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM apps a, "
        "(VALUES ('High Error Rate', 'error_rate', 10.0::DOUBLE, 5, 'prod'), ('Slow p95 API Latency', 'p95_latency_ms', 2000.0::DOUBLE, 5, NULL), "
        "('High Failed Requests', 'failed_requests', 50.0::DOUBLE, 5, NULL)) d(name, metric_type, threshold, window_minutes, env) "
        "WHERE a.id NOT IN (SELECT app_id FROM rules)"
    ),
)
def default_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = metadata.default_rules(V.apps(spark, sf), V.alert_rules(spark, sf), datetime(2024, 1, 1))
    return _plain(rules.withColumn("threshold", F.col("threshold").cast("double")))


@query(
    "attribute_app",
    select(
        "SELECT d.batch_id, o.app_id FROM docs d LEFT JOIN (SELECT key_prefix, min(app_id) AS app_id FROM api_keys WHERE active "
        "GROUP BY 1 HAVING count(DISTINCT app_id) = 1) o ON length(d.api_key) >= 8 AND substr(d.api_key, 1, 8) = o.key_prefix"
    ),
)
def attribute_app(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its app; those refused for their key with NULL."""
    docs = V.documents(spark, sf).select("batch_id", "api_key")
    known, refused = ingest.attribute_app(docs, V.api_keys(spark, sf))
    return known.select("batch_id", "app_id").unionByName(refused.select("batch_id", F.lit(None).cast("bigint").alias("app_id")))


@query(
    "attribute_app_digest",
    select(
        "SELECT d.batch_id, o.app_id FROM docs d LEFT JOIN (SELECT key_prefix, min(app_id) AS app_id FROM api_keys WHERE active AND id % 7 <> 0 GROUP BY 1) o "
        "ON length(d.api_key) >= 8 AND substr(d.api_key, 1, 8) = o.key_prefix"
    ),
)
def attribute_app_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Keys told by the digest of the whole key: prefixes may be shared, and one key in seven has another secret."""
    docs = V.documents(spark, sf).select("batch_id", "api_key")
    secret = F.when(F.col("id") % 7 == 0, F.lit("-other")).otherwise(F.lit("-secret"))
    keys = V.api_keys(spark, sf).withColumn("key_sha256", F.sha2(F.concat("key_prefix", secret).cast("binary"), 256))
    known, refused = ingest.attribute_app(docs, keys)
    return known.select("batch_id", "app_id").unionByName(refused.select("batch_id", F.lit(None).cast("bigint").alias("app_id")))


# --- ingest ------------------------------------------------------------------------------------------


@query("ingest_explode", select("SELECT batch_id, pos, event_id, event_type FROM w"))
def ingest_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.explode_documents(V.documents(spark, sf))
    return rows.select("batch_id", "pos", F.json_tuple("raw", "event_id", "event_type").alias("event_id", "event_type"))


@query("decode_status", select("SELECT status, count(*) AS n FROM judged GROUP BY 1"))
def decode_status(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classify_events(V.documents(spark, sf, defects=True)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("validate_events", select("SELECT batch_id, pos, status = 'ok' AS valid FROM judged WHERE status <> 'unreadable' AND pos IS NOT NULL"))
def validate_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.classify_events(V.documents(spark, sf, defects=True)).filter("status <> 'unreadable' and pos is not null")
    return rows.select("batch_id", "pos", (F.col("status") == "ok").alias("valid"))


@query("validation_errors", select("SELECT batch_id, pos, reason AS errors FROM judged WHERE status = 'invalid'"))
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.classify_events(V.documents(spark, sf, defects=True)).filter("status = 'invalid'")
    return rows.select("batch_id", "pos", F.array_join("errors", "; ").alias("errors"))


@query("rejected_batches", select("SELECT batch_id, status, reason FROM docs WHERE status <> 'ok'"))
def rejected_batches(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = ingest.accept(V.documents(spark, sf, defects=True), reject="batch")
    return rejected.select("batch_id", "status", F.array_join("errors", "; ").alias("reason"))


@query("dead_letters", select("SELECT batch_id, pos, topic, status, reason FROM judged WHERE status <> 'ok'"))
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = ingest.accept(V.documents(spark, sf, defects=True), reject="event")
    return ingest.dead_letters(rejected).drop("payload")


@query(
    "accepted_per_batch",
    select("SELECT w.batch_id, count(*) AS accepted FROM w JOIN docs d ON d.batch_id = w.batch_id WHERE d.status = 'ok' GROUP BY 1"),
)
def accepted_per_batch(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = ingest.accept(V.documents(spark, sf, defects=True), reject="batch")
    return accepted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted"))


@query(
    "enveloped",
    select(
        "SELECT w.batch_id, topic, session_id AS key, 1 AS schema_version, batch_received_at AS received_at, batch_ip AS source_ip, event_id "
        "FROM w JOIN docs d ON d.batch_id = w.batch_id WHERE d.status = 'ok'"
    ),
)
def enveloped(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = ingest.accept(V.documents(spark, sf, defects=True), reject="batch")
    rows = ingest.envelope(accepted)
    return _plain(rows.select("batch_id", "topic", "key", "schema_version", "received_at", "source_ip", F.col("event.event_id").alias("event_id")))


@query("route_counts", select("SELECT topic, count(*) AS n FROM wok GROUP BY 1"))
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = ingest.accept(V.documents(spark, sf, defects=True), reject="event")
    return ingest.envelope(accepted).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("topic_records", select("SELECT topic, session_id AS key, event_id, event_type, batch_ip AS source_ip FROM wok"))
def topic_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records written and decoded again."""
    accepted, _ = ingest.accept(V.documents(spark, sf, defects=True), reject="event")
    back = ingest.decode_records(ingest.topic_records(ingest.envelope(accepted))).filter("readable")
    return back.select("topic", "key", F.col("event.event_id").alias("event_id"), F.col("event.event_type").alias("event_type"), "source_ip")


def _mapped(spark: SparkSession, sf: str, spec: S.TableSpec) -> DataFrame:
    accepted, _ = ingest.accept(V.documents(spark, sf), reject="batch")
    return _plain(to_table(ingest.envelope(accepted), spec))


def _mapped_sql(spec: S.TableSpec, kinds: str) -> str:
    body = _table_sql(spec, f"w WHERE event_type IN ({kinds})")
    body = body.replace("coalesce(event_data, '{}')", "coalesce(replace(event_data, ' ', ''), '{}')")
    body = body.replace("received_at", "batch_received_at AS received_at").replace("source_ip", "batch_ip AS source_ip")
    if spec is S.MOBILE_API_CALLS:
        body = body.replace("error_message", "CASE WHEN status_code >= 400 THEN 'HTTP ' || CAST(status_code AS VARCHAR) END AS error_message")
    return select(body)


@query("map_events", _mapped_sql(S.MOBILE_EVENTS, "'app_start', 'screen_view', 'custom_event'"))
def map_events(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, S.MOBILE_EVENTS)


@query("map_api_calls", _mapped_sql(S.MOBILE_API_CALLS, "'api_timing'"))
def map_api_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, S.MOBILE_API_CALLS)


@query("map_errors", _mapped_sql(S.MOBILE_ERRORS, "'error'"))
def map_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, S.MOBILE_ERRORS)


@query(
    "skipped_types",
    select("SELECT event_type, count(*) AS n FROM w WHERE NOT broken AND NOT hollow AND wire_type <> 'mystery' GROUP BY 1"),
)
def skipped_types(spark: SparkSession, sf: str) -> DataFrame:
    """What is left per type once unknown event types are skipped."""
    rows = ingest.classify_events(V.documents(spark, sf, defects=True)).filter("pos is not null")
    return skip_unknown(rows, column="wire.event_type").groupBy(F.col("wire.event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_sdk", select("SELECT event_id, event_type, event_name, error_type, replace(event_data, ' ', '') AS event_data FROM w"))
def coerce_sdk(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the client library's field names, accepted after coercion."""
    accepted, _ = ingest.accept(V.documents(spark, sf, client_form=True), reject="batch", coerce=True)
    return accepted.select(*[F.col(f"event.{c}").alias(c) for c in ("event_id", "event_type", "event_name", "error_type", "event_data")])


@query(
    "endpoint_normalise",
    select("SELECT event_id, received_at, path, CASE WHEN n % 5 = 0 THEN 'GET' ELSE method END AS method FROM mc"),
)
def endpoint_normalise(spark: SparkSession, sf: str) -> DataFrame:
    calls = V.mobile_api_calls(spark, sf).selectExpr(
        "event_id",
        "received_at",
        f"case {_NUMBER} % 3 when 0 then concat('https://api.example.com:8443', path, '?from=app') when 1 then concat(path, '?page=2') else path end as url",
        f"case when {_NUMBER} % 5 <> 0 then lower(method) end as method",
    )
    return _plain(ingest.normalise_endpoint(calls).select("event_id", "received_at", "path", "method"))


@query(
    "error_normalise",
    select(
        "SELECT event_id, received_at, CASE WHEN n % 4 = 0 THEN 'Error' ELSE error_class END AS error_class, "
        "coalesce(screen_name, 'on ' || session_id) AS screen_name FROM mx"
    ),
)
def error_normalise(spark: SparkSession, sf: str) -> DataFrame:
    errors = V.mobile_errors(spark, sf).selectExpr(
        "event_id", "received_at", f"case when {_NUMBER} % 4 = 0 then ' ' else error_class end as error_class",
        "screen_name", "concat('on ', session_id) as current_screen",
    )
    return _plain(ingest.normalise_error(errors, "current_screen").drop("current_screen"))


@query("utc_times", select("SELECT event_id, received_at, CASE WHEN n % 7 <> 0 THEN event_time END AS event_time FROM t"))
def utc_times(spark: SparkSession, sf: str) -> DataFrame:
    """The same instants written with three offsets and two precisions; one in seven is no time at all."""
    shape = "yyyy-MM-dd''T''HH:mm:ss.SSS".replace("''", "'")
    rows = V.telemetry(spark, sf).selectExpr(
        "event_id",
        "received_at",
        f"case when {_NUMBER} % 7 = 0 then 'last tuesday' "
        f'when {_NUMBER} % 3 = 0 then concat(date_format(event_time + interval 2 hours, "{shape}"), \'+02:00\') '
        f'when {_NUMBER} % 3 = 1 then concat(date_format(event_time - interval 210 minutes, "{shape}"), \'999-03:30\') '
        f'else concat(date_format(event_time, "{shape}"), \'Z\') end as text',
    )
    return _plain(rows.select("event_id", "received_at", scalars.utc_millis(F.col("text")).alias("event_time")))


# --- storage -----------------------------------------------------------------------------------------


@query(
    "retention",
    select(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS kept, min(event_time) AS oldest FROM {s} WHERE date_trunc('second', event_time) > TIMESTAMP '2024-01-02'"
            for n, s in (("mobile_events", "me"), ("mobile_api_calls", "mc"), ("mobile_errors", "mx"))
        )
    ),
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """What 90 days of retention keep on 1 April 2024."""
    out = None
    for spec in S.TABLES:
        kept = tables.retain_rows(V.table_view(spark, sf, spec), datetime(2024, 4, 1))
        row = kept.agg(F.count(F.lit(1)).alias("kept"), F.min("event_time").alias("oldest"))
        row = row.select(F.lit(spec.name).alias("table_name"), "kept", "oldest")
        out = row if out is None else out.unionByName(row)
    return _plain(out)


_KEPT = ("event_id", "session_id", "user_id", "app", "env", "release", "platform", "event_time", "received_at", "source_ip")


@query(
    "stored_upkeep",
    select(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, {', '.join(_KEPT)} FROM {s} WHERE date_trunc('second', event_time) > TIMESTAMP '2024-01-02'"
            for n, s in (("mobile_events", "de"), ("mobile_api_calls", "dc"), ("mobile_errors", "dx"))
        )
    ),
)
def stored_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Tables after upkeep: settled by day, given redeliveries, settled again, and cut by retention on 1 April 2024."""
    root = scratch_path(spark, "upkeep")
    out = None
    for spec in S.TABLES:
        rows = V.table_view(spark, sf, spec)
        for delivery in (0, 1):
            tables.append(rows.where(F.col("source_ip").startswith(f"10.0.{delivery}.")), root, spec.name, f"load-{delivery}")
            tables.settle(spark, root, spec, 202401)
        tables.retain(spark, root, spec, datetime(2024, 4, 1))
        kept = tables.read_stored(spark, root, spec, list(_KEPT)).drop("event_month").withColumn("table_name", F.lit(spec.name))
        out = kept if out is None else out.unionByName(kept)
    return _plain(out)


@query(
    "sessions_from_rollup",
    select("SELECT app, release, date_trunc('hour', event_time) AS bucket, count(DISTINCT session_id) AS unique_sessions, TRUE AS near FROM de GROUP BY ALL"),
)
def sessions_from_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sessions per hour from per-minute sketches of ten slices, next to the exact counts: within the stated error."""
    events = V.mobile_events(spark, sf)
    rows = narrow(events, S.MOBILE_EVENTS, ["app", "env", "release", "platform", "event_time", "event_id", "session_id"])
    rows = rows.withColumn("bucket", F.date_trunc("hour", "event_time"))
    by = ["app", "release", "bucket"]
    partials = roll_up(rows.withColumn("slice", F.pmod(F.crc32("event_id"), F.lit(10))), SESSIONS_1M, dedup=False, by=["slice"])
    merged = merge_rollup(partials.withColumn("bucket", F.date_trunc("hour", "minute")), SESSIONS_1M, by)
    near = merged.select(*by, unique_sessions(F.col("session_sketch")).alias("estimate"))
    exact = rows.groupBy(*by).agg(F.count_distinct("session_id").alias("unique_sessions"))
    inside = F.abs(F.col("estimate") - F.col("unique_sessions")) <= F.ceil(SESSION_ERROR * F.col("unique_sessions"))
    return _plain(exact.join(near, by).select(*by, "unique_sessions", inside.alias("near")))


@query(
    "dedup_bucketed",
    select(" UNION ALL ".join(f"SELECT '{n}' AS table_name, {', '.join(_KEPT)} FROM {s}" for n, s in (("mobile_events", "de"), ("mobile_api_calls", "dc"), ("mobile_errors", "dx")))),
)
def dedup_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The tables written in buckets by event; the latest copies are picked inside the buckets."""
    root = scratch_path(spark, "bucketed")
    out = None
    for spec in S.TABLES:
        table = f"{spec.name}_{uuid.uuid4().hex}"
        bucketed_tables.write(V.table_view(spark, sf, spec), spec, table, f"{root}/{spec.name}", buckets=8)
        rows = bucketed_tables.latest(spark, spec, table).select(F.lit(spec.name).alias("table_name"), *_KEPT)
        out = rows if out is None else out.unionByName(rows)
    return _plain(out)
