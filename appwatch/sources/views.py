"""A telemetry data set derived from the driver's tables, used by the registered queries and tests.

The generic ``events`` table becomes app telemetry (two apps, two environments, two releases, 48
hours), one row in twenty is delivered twice, and suppliers, parts, orders and customers stand in
for the apps, alert rules, past firings and API keys, so that all inputs grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appwatch.schema import MOBILE_API_CALLS, MOBILE_ERRORS, MOBILE_EVENTS, TableSpec
from appwatch.session import prepare

# How the generic event types are read as telemetry.
SOURCE_TYPES = {
    "app_start": "signup",
    "screen_view": "view",
    "api_timing": "click",
    "error": "error",
    "custom_event": "purchase",
}
START_MS = 1704067200000

_TYPE = "case event_type when 'signup' then 'app_start' when 'view' then 'screen_view' when 'click' then 'api_timing' when 'error' then 'error' else 'custom_event' end"
_SCREEN = "case k % 5 when 0 then 'HomeScreen' when 1 then 'ProfileScreen' when 2 then 'FeedScreen' when 3 then 'SettingsScreen' else 'CheckoutScreen' end"
_PATH = "case k % 4 when 0 then '/checkout' when 1 then '/api/feed' when 2 then '/api/user' else '/api/cart' end"
_STATUS = "case k % 10 when 0 then 500 when 1 then 503 when 2 then 404 when 3 then 0 else 200 end"
_CLASS = "case k % 4 when 0 then 'java.lang.NullPointerException' when 1 then 'java.lang.IllegalStateException' when 2 then 'NetworkError' else 'ParseError' end"

_COLUMNS = {
    "event_id": "concat('e-', n)",
    "session_id": "concat('s-', u, '-', t_ms div 21600000)",
    "user_id": "case when u % 11 <> 0 then concat('u-', u) end",
    "app": "case when u % 3 = 0 then 'other-app' else 'demo-app' end",
    "env": "case when u % 4 = 0 then 'staging' else 'prod' end",
    "app_version": "'1.0.0'",
    "release": "case when u % 10 < 7 then 'v1.0.0' else 'v1.1.0' end",
    "platform": "case when u % 2 = 0 then 'ios' else 'android' end",
    "device_model": "case when u % 2 = 0 then 'iPhone14' else 'Pixel7' end",
    "os_version": "case when u % 2 = 0 then '17.0' else '13' end",
    "cold_start": "case when src = 'app_start' then n % 5 < 3 end",
    "duration_ms": "case src when 'app_start' then value * 10 when 'api_timing' then value * case when u % 10 < 7 then 10 else 40 end end",
    "screen_name": f"case when src = 'screen_view' or (src = 'error' and k % 5 <> 4) then {_SCREEN} end",
    "method": "case when src = 'api_timing' then case when k % 4 in (0, 3) then 'POST' else 'GET' end end",
    "path": f"case when src = 'api_timing' then {_PATH} end",
    "status_code": f"case when src = 'api_timing' then {_STATUS} end",
    "error_type": "case when src = 'error' then case when k % 3 = 0 then 'unhandled' else 'handled' end end",
    "error_class": f"case when src = 'error' then {_CLASS} end",
    "error_message": "case when src = 'error' then concat('message ', k) end",
    "event_name": "case when src = 'custom_event' then concat('custom_', k % 4) end",
    "event_data": "case when src = 'custom_event' then props end",
    "event_time": "timestamp_millis(t_ms)",
    "received_at": "timestamp_millis(t_ms + (k % 7) * 1000 + copy * 60000)",
    "source_ip": "concat('10.0.', copy, '.', u % 250)",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _deliveries(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None) -> DataFrame:
    """Source events as telemetry deliveries: type, cut time, and a second copy of every 20th."""
    events = read_table(spark, sf_dir, "events")
    if types:
        events = events.filter(F.col("event_type").isin([SOURCE_TYPES[t] for t in types]))
    return events.selectExpr(
        "event_id as n", "user_id as u", "value", "props",
        f"{_TYPE} as src",
        "cast(get_json_object(props, '$.k') as int) as k",
        f"{START_MS} + (unix_millis(cast(ts as timestamp)) - {START_MS}) div 15 as t_ms",
        "explode(case when event_id % 20 = 0 then array(0, 1) else array(0) end) as copy",
    )


def telemetry(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """All deliveries in one wide row form."""
    return _deliveries(spark, sf_dir, types).selectExpr(
        "src as event_type", *[f"{e} as {c}" for c, e in _COLUMNS.items()]
    )


def table_view(spark: SparkSession, sf_dir: str, spec: TableSpec) -> DataFrame:
    """One of the three stored tables as a view over the driver's events."""
    rows = _deliveries(spark, sf_dir, spec.event_types)
    exprs = dict(_COLUMNS, event_type="src")
    exprs["schema_version"] = "1"
    exprs["event_data"] = "coalesce(" + _COLUMNS["event_data"] + ", '{}')"
    if spec is MOBILE_API_CALLS:
        exprs["error_message"] = f"case when {_STATUS} >= 400 then concat('HTTP ', {_STATUS}) end"
    return rows.selectExpr(
        *[f"cast({exprs.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in spec.schema]
    )


def mobile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_view(spark, sf_dir, MOBILE_EVENTS)


def mobile_api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_view(spark, sf_dir, MOBILE_API_CALLS)


def mobile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_view(spark, sf_dir, MOBILE_ERRORS)


# --- batch documents -----------------------------------------------------------------------

# What is wrong with some of the events and documents; n is the event number, g the batch number.
DEFECTS = {
    "no_id": "n % 401 = 7",
    "bad_type": "n % 409 = 11",
    "blank_platform": "n % 419 = 13",
    "no_time": "n % 421 = 17",
    "bad_time": "n % 431 = 19",
    "no_variant": "n % 433 = 23",
    "bad_number": "n % 439 = 29",
}
BROKEN_BODY = "g % 37 = 5"
EMPTY_BODY = "g % 41 = 9"


def _event_json(defects: bool, client_form: bool) -> str:
    def unless(flag: str, expr: str, other: str = "null") -> str:
        return f"case when {DEFECTS[flag]} then {other} else {expr} end" if defects else expr

    c = _COLUMNS
    time_text = "concat(date_format(timestamp_millis(t_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), 'Z')"
    fields = {
        "event_id": unless("no_id", c["event_id"]),
        "event_type": unless("bad_type", "src", "'mystery'"),
        "session_id": c["session_id"],
        "user_id": c["user_id"],
        "app_name": c["app"],
        "environment": c["env"],
        "app_version": c["app_version"],
        "release": c["release"],
        "platform": unless("blank_platform", c["platform"], "'  '"),
        "device_model": c["device_model"],
        "os_version": c["os_version"],
        "timestamp": unless("no_time", unless("bad_time", time_text, "'yesterday'")),
        "cold_start": c["cold_start"],
        "duration_ms": c["duration_ms"],
        "screen_name": unless("no_variant", c["screen_name"]),
        "method": unless("no_variant", c["method"]),
        "path": c["path"],
        "status_code": unless("bad_number", f"cast({c['status_code']} as string)", "case when src = 'api_timing' then 'many' end"),
        "error_class": c["error_class"],
        "error_message": f"case when src = 'api_timing' and {_STATUS} >= 400 then concat('HTTP ', {_STATUS}) else {c['error_message']} end",
    }
    # The payload of a custom event is an object inside the event, not text.
    data = "case when src = 'custom_event' then from_json(props, 'map<string,int>') end"
    if client_form:
        fields["fatal"] = "case when src = 'error' then k % 3 = 0 end"
        fields["name"] = c["event_name"]
        fields["properties"] = data
    else:
        fields["error_type"] = unless("no_variant", c["error_type"])
        fields["event_name"] = unless("no_variant", c["event_name"])
        fields["event_data"] = data
    return "to_json(struct(" + ", ".join(f"{e} as {f}" for f, e in fields.items()) + "))"


def documents(spark: SparkSession, sf_dir: str, defects: bool = False, client_form: bool = False) -> DataFrame:
    """The telemetry as posted batch documents: twenty consecutive event numbers each, redelivered
    copies in documents of their own. ``client_form`` uses the client library's field names."""
    rows = _deliveries(spark, sf_dir, None).selectExpr(
        "n div 20 as g", "copy", "n", "k", "t_ms", f"{_event_json(defects, client_form)} as event"
    )
    # Event numbers are unique, so a document gathers at most twenty events.
    batches = rows.groupBy("g", "copy").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(n, event))), x -> x.event), ',')").alias("events"),
        F.expr("max(t_ms + (k % 7) * 1000 + copy * 60000)").alias("received_ms"),
    )
    body = "concat('{\"events\":[', events, ']}')"
    if defects:
        body = (
            f"case when {BROKEN_BODY} then substring({body}, 1, length({body}) div 2) "
            f"when {EMPTY_BODY} then '{{\"events\": []}}' else {body} end"
        )
    return batches.selectExpr(
        "g * 2 + copy as batch_id",
        "case when g % 31 = 3 then 'abc' else concat('k', lpad((g * 7) % 200, 7, '0'), '-secret') end as api_key",
        "concat('10.0.', copy, '.', g % 250) as source_ip",
        "timestamp_millis(received_ms) as received_at",
        f"{body} as body",
    )


# --- metadata ------------------------------------------------------------------------------


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 1 as id",
        "case s_suppkey when 0 then 'demo-app' when 1 then 'other-app' else concat('app-', s_suppkey) end as name",
        f"timestamp_seconds({START_MS // 1000} + s_suppkey * 60) as created_at",
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per customer; every 17th shares its prefix with the next one."""
    number = "case when c_custkey % 17 = 0 then c_custkey + 1 else c_custkey end"
    return read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "c_custkey % 10 + 1 as app_id",
        f"concat('k', lpad({number}, 7, '0')) as key_prefix",
        "c_name as label",
        "c_custkey % 5 <> 0 as active",
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey + 1 as id",
        "case p_partkey % 4 when 0 then 1 when 1 then 1 when 2 then 2 else p_size % 10 + 1 end as app_id",
        "concat(p_name, ' ', p_partkey) as name",
        "case when p_partkey % 7 in (0, 1) then 'error_rate' when p_partkey % 7 in (2, 3) then 'p95_latency_ms' "
        "when p_partkey % 7 in (4, 5) then 'failed_requests' when p_partkey % 3 = 0 then 'unknown_type' else 'error_rate' end as metric_type",
        "cast(case when p_partkey % 7 in (2, 3) then (p_partkey * 37 % 1000) * 8 when p_partkey % 7 in (4, 5) then p_partkey % 40 "
        "else (p_partkey * 37 % 1000) / 1000D end as decimal(14,4)) as threshold",
        "cast(case p_size % 5 when 0 then 5 when 1 then 15 when 2 then 30 when 3 then 60 else 120 end as int) as window_minutes",
        "case p_partkey % 5 when 2 then 'prod' when 3 then 'staging' when 4 then '' end as env",
        "case when p_partkey % 9 = 4 then 'v1.1.0' end as release",
        "p_partkey % 11 <> 0 as enabled",
        f"timestamp_seconds({START_MS // 1000} + p_partkey * 60) as created_at",
    )


def alert_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = f"{START_MS // 1000} + o_orderkey * 577 % 172800"
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey + 1 as id",
        "o_custkey % 200 + 1 as rule_id",
        "o_custkey % 10 + 1 as app_id",
        f"timestamp_seconds({fired}) as fired_at",
        f"case when o_orderstatus = 'F' then timestamp_seconds({fired} + 600) end as resolved_at",
        "cast(o_totalprice / 100 as decimal(14,4)) as value_observed",
        "case when o_orderstatus = 'F' then 'resolved' else 'firing' end as status",
    )
