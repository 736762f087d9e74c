"""SQL building blocks for the counterparts: the derived telemetry and metadata as CTEs (DuckDB)."""

from __future__ import annotations

_CTES = """
src AS (
  SELECT event_id AS n, user_id AS u, event_type AS src, value, props,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    1704067200000 + (((epoch_us(ts) // 1000) - 1704067200000) // 15) AS t_ms
  FROM events),
deliv AS (SELECT *, 0 AS copy FROM src UNION ALL SELECT *, 1 AS copy FROM src WHERE n % 20 = 0),
t AS (
  SELECT n, u, k, copy, t_ms, value, props,
    'e-' || CAST(n AS VARCHAR) AS event_id,
    CASE src WHEN 'signup' THEN 'app_start' WHEN 'view' THEN 'screen_view' WHEN 'click' THEN 'api_timing'
      WHEN 'error' THEN 'error' ELSE 'custom_event' END AS event_type,
    's-' || CAST(u AS VARCHAR) || '-' || CAST(t_ms // 21600000 AS VARCHAR) AS session_id,
    CASE WHEN u % 11 = 0 THEN NULL ELSE 'u-' || CAST(u AS VARCHAR) END AS user_id,
    CASE WHEN u % 3 = 0 THEN 'other-app' ELSE 'demo-app' END AS app,
    CASE WHEN u % 4 = 0 THEN 'staging' ELSE 'prod' END AS env,
    '1.0.0' AS app_version,
    CASE WHEN u % 10 < 7 THEN 'v1.0.0' ELSE 'v1.1.0' END AS release,
    CASE WHEN u % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
    CASE WHEN u % 2 = 0 THEN 'iPhone14' ELSE 'Pixel7' END AS device_model,
    CASE WHEN u % 2 = 0 THEN '17.0' ELSE '13' END AS os_version,
    CASE WHEN src = 'signup' THEN n % 5 < 3 END AS cold_start,
    CASE WHEN src = 'signup' THEN value * 10
      WHEN src = 'click' THEN value * (CASE WHEN u % 10 < 7 THEN 10 ELSE 40 END) END AS duration_ms,
    CASE WHEN src = 'view' OR (src = 'error' AND k % 5 <> 4) THEN
      CASE k % 5 WHEN 0 THEN 'HomeScreen' WHEN 1 THEN 'ProfileScreen' WHEN 2 THEN 'FeedScreen'
        WHEN 3 THEN 'SettingsScreen' ELSE 'CheckoutScreen' END END AS screen_name,
    CASE WHEN src = 'click' THEN CASE WHEN k % 4 IN (0, 3) THEN 'POST' ELSE 'GET' END END AS method,
    CASE WHEN src = 'click' THEN CASE k % 4 WHEN 0 THEN '/checkout' WHEN 1 THEN '/api/feed'
      WHEN 2 THEN '/api/user' ELSE '/api/cart' END END AS path,
    CASE WHEN src = 'click' THEN CASE k % 10 WHEN 0 THEN 500 WHEN 1 THEN 503 WHEN 2 THEN 404
      WHEN 3 THEN 0 ELSE 200 END END AS status_code,
    CASE WHEN src = 'error' THEN CASE WHEN k % 3 = 0 THEN 'unhandled' ELSE 'handled' END END AS error_type,
    CASE WHEN src = 'error' THEN CASE k % 4 WHEN 0 THEN 'java.lang.NullPointerException'
      WHEN 1 THEN 'java.lang.IllegalStateException' WHEN 2 THEN 'NetworkError' ELSE 'ParseError' END END AS error_class,
    CASE WHEN src = 'error' THEN 'message ' || CAST(k AS VARCHAR) END AS error_message,
    CASE WHEN src = 'purchase' THEN 'custom_' || CAST(k % 4 AS VARCHAR) END AS event_name,
    CASE WHEN src = 'purchase' THEN props END AS event_data,
    epoch_ms(t_ms) AS event_time,
    epoch_ms(t_ms + (k % 7) * 1000 + copy * 60000) AS received_at,
    '10.0.' || CAST(copy AS VARCHAR) || '.' || CAST(u % 250 AS VARCHAR) AS source_ip
  FROM deliv),
me AS (SELECT * FROM t WHERE event_type IN ('app_start', 'screen_view', 'custom_event')),
mc AS (SELECT * REPLACE (CASE WHEN status_code >= 400 THEN 'HTTP ' || CAST(status_code AS VARCHAR) END AS error_message)
  FROM t WHERE event_type = 'api_timing'),
mx AS (SELECT * FROM t WHERE event_type = 'error'),
de AS (SELECT * FROM me QUALIFY row_number() OVER (PARTITION BY app, env, event_type, event_time, event_id ORDER BY received_at DESC) = 1),
dc AS (SELECT * FROM mc QUALIFY row_number() OVER (PARTITION BY app, env, path, method, event_time, event_id ORDER BY received_at DESC) = 1),
dx AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY app, env, error_class, event_time, event_id ORDER BY received_at DESC) = 1),
w0 AS (
  SELECT *, n // 20 AS g, (n // 20) * 2 + copy AS batch_id,
    CAST(row_number() OVER (PARTITION BY n // 20, copy ORDER BY n) - 1 AS INTEGER) AS pos,
    max(t_ms + (k % 7) * 1000 + copy * 60000) OVER (PARTITION BY n // 20, copy) AS batch_ms
  FROM t),
w AS (
  SELECT *, epoch_ms(batch_ms) AS batch_received_at,
    '10.0.' || CAST(copy AS VARCHAR) || '.' || CAST(g % 250 AS VARCHAR) AS batch_ip,
    CASE WHEN g % 31 = 3 THEN 'abc' ELSE 'k' || lpad(CAST((g * 7) % 200 AS VARCHAR), 7, '0') || '-secret' END AS api_key,
    g % 37 = 5 AS broken, g % 37 <> 5 AND g % 41 = 9 AS hollow,
    n % 409 = 11 OR (n % 421 <> 17 AND n % 431 = 19) OR (n % 439 = 29 AND event_type = 'api_timing') AS unreadable,
    CASE WHEN n % 409 = 11 THEN 'mystery' ELSE event_type END AS wire_type,
    concat_ws('; ',
      CASE WHEN n % 401 = 7 THEN 'events[' || CAST(pos AS VARCHAR) || '].eventId: must not be blank' END,
      CASE WHEN n % 419 = 13 THEN 'events[' || CAST(pos AS VARCHAR) || '].platform: must not be blank' END,
      CASE WHEN n % 421 = 17 THEN 'events[' || CAST(pos AS VARCHAR) || '].timestamp: must not be null' END,
      CASE WHEN n % 433 = 23 AND event_type = 'screen_view' THEN 'events[' || CAST(pos AS VARCHAR) || '].screenName: must not be blank'
        WHEN n % 433 = 23 AND event_type = 'api_timing' THEN 'events[' || CAST(pos AS VARCHAR) || '].method: must not be blank'
        WHEN n % 433 = 23 AND event_type = 'error' THEN 'events[' || CAST(pos AS VARCHAR) || '].errorType: must not be blank'
        WHEN n % 433 = 23 AND event_type = 'custom_event' THEN 'events[' || CAST(pos AS VARCHAR) || '].eventName: must not be blank' END) AS errs,
    CASE WHEN event_type = 'api_timing' THEN 'mobile.api.raw' WHEN event_type = 'error' THEN 'mobile.errors.raw' ELSE 'mobile.events.raw' END AS topic
  FROM w0),
wok AS (SELECT * FROM w WHERE NOT broken AND NOT hollow AND NOT unreadable AND errs = ''),
judged AS (
  SELECT batch_id, pos,
    CASE WHEN wire_type = 'api_timing' THEN 'mobile.api.dlq' WHEN wire_type = 'error' THEN 'mobile.errors.dlq' ELSE 'mobile.events.dlq' END AS topic,
    CASE WHEN unreadable THEN 'unreadable' WHEN errs <> '' THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN unreadable THEN 'Invalid request body' ELSE errs END AS reason
  FROM w WHERE NOT broken AND NOT hollow
  UNION ALL
  SELECT batch_id, CAST(NULL AS INTEGER), 'mobile.events.dlq', 'unreadable', 'Invalid request body' FROM w WHERE broken GROUP BY batch_id
  UNION ALL
  SELECT batch_id, CAST(NULL AS INTEGER), 'mobile.events.dlq', 'invalid', 'events: events must not be empty' FROM w WHERE hollow GROUP BY batch_id),
docs AS (
  SELECT batch_id, any_value(api_key) AS api_key,
    CASE WHEN bool_or(broken OR (unreadable AND NOT hollow)) THEN 'unreadable' WHEN bool_or(hollow OR errs <> '') THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN bool_or(broken OR (unreadable AND NOT hollow)) THEN 'Invalid request body' WHEN bool_or(hollow) THEN 'events: events must not be empty'
      ELSE coalesce(string_agg(nullif(errs, ''), '; ' ORDER BY pos), '') END AS reason
  FROM w GROUP BY batch_id),
apps AS (
  SELECT s_suppkey + 1 AS id,
    CASE s_suppkey WHEN 0 THEN 'demo-app' WHEN 1 THEN 'other-app' ELSE 'app-' || CAST(s_suppkey AS VARCHAR) END AS name,
    epoch_ms(1704067200000 + s_suppkey * 60000) AS created_at
  FROM supplier),
api_keys AS (
  SELECT c_custkey AS id, c_custkey % 10 + 1 AS app_id,
    'k' || lpad(CAST(CASE WHEN c_custkey % 17 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR), 7, '0') AS key_prefix,
    c_custkey % 5 <> 0 AS active
  FROM customer),
rules AS (
  SELECT p_partkey + 1 AS id,
    CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE p_size % 10 + 1 END AS app_id,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
    CASE WHEN p_partkey % 7 IN (0, 1) THEN 'error_rate' WHEN p_partkey % 7 IN (2, 3) THEN 'p95_latency_ms'
      WHEN p_partkey % 7 IN (4, 5) THEN 'failed_requests' WHEN p_partkey % 3 = 0 THEN 'unknown_type' ELSE 'error_rate' END AS metric_type,
    CAST(CASE WHEN p_partkey % 7 IN (2, 3) THEN (p_partkey * 37 % 1000) * 8 WHEN p_partkey % 7 IN (4, 5) THEN p_partkey % 40
      ELSE (p_partkey * 37 % 1000) / 1000.0 END AS DOUBLE) AS threshold,
    CAST(CASE p_size % 5 WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 30 WHEN 3 THEN 60 ELSE 120 END AS INTEGER) AS window_minutes,
    CASE p_partkey % 5 WHEN 2 THEN 'prod' WHEN 3 THEN 'staging' WHEN 4 THEN '' END AS env,
    CASE WHEN p_partkey % 9 = 4 THEN 'v1.1.0' END AS release,
    p_partkey % 11 <> 0 AS enabled,
    epoch_ms(1704067200000 + p_partkey * 60000) AS created_at
  FROM part),
firings AS (
  SELECT o_orderkey + 1 AS id, o_custkey % 200 + 1 AS rule_id, o_custkey % 10 + 1 AS app_id,
    epoch_ms((1704067200 + o_orderkey * 577 % 172800) * 1000) AS fired_at,
    CASE WHEN o_orderstatus = 'F' THEN epoch_ms((1704067200 + o_orderkey * 577 % 172800 + 600) * 1000) END AS resolved_at,
    round(o_totalprice / 100, 4) AS value_observed,
    CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'firing' END AS status
  FROM orders),
er AS (
  SELECT r.id, r.app_id, a.name AS app_name, r.name, metric_type, threshold, window_minutes, env, release
  FROM rules r JOIN apps a ON a.id = r.app_id WHERE enabled),
rollx AS (SELECT app, env, release, date_trunc('minute', event_time) AS minute, count(*) AS c FROM dx GROUP BY ALL)
"""


def select(body: str, more: str = "", recursive: bool = False) -> str:
    """``body`` over the CTEs; ``more`` adds further CTEs."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    extra = ("," + more) if more else ""
    return head + _CTES.strip() + extra + "\n" + body
