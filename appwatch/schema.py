"""Wire fields, table columns, keys and partitions, stated once as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Event types, topics, tables.
EVENT_TYPES = ("app_start", "screen_view", "api_timing", "error", "custom_event")
TOPIC_EVENTS = "mobile.events.raw"
TOPIC_API = "mobile.api.raw"
TOPIC_ERRORS = "mobile.errors.raw"
TOPICS = (TOPIC_EVENTS, TOPIC_API, TOPIC_ERRORS)
SCHEMA_VERSION = 1
RETENTION_DAYS = 90
FEED_DEFAULT_ROWS = 50
FEED_MAX_ROWS = 500
LOOK_BACK_HOURS = 24
WINDOW_PRESET_HOURS = (1, 6, 24, 168)

# Wire names of every variant together. Each value is first read as text, because the wire
# accepts "200" and 200 alike; typing happens in operators.ingest.
WIRE_FIELDS = (
    "event_id", "event_type", "session_id", "user_id", "app_name", "environment", "app_version",
    "release", "platform", "device_model", "os_version", "timestamp", "trace_id",
    "cold_start", "duration_ms", "screen_name", "method", "path", "status_code",
    "request_size", "response_size", "error_message", "error_type", "error_class", "stacktrace",
    "event_name", "event_data",
)
# What the mobile client library sends where the server expects event_name, event_data, error_type.
CLIENT_FIELDS = ("name", "properties", "fatal")
WIRE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in WIRE_FIELDS + CLIENT_FIELDS])

# Required text fields: (wire field, name used in error messages).
REQUIRED_COMMON = (
    ("event_id", "eventId"), ("event_type", "eventType"), ("session_id", "sessionId"),
    ("app_name", "appName"), ("app_version", "appVersion"), ("platform", "platform"),
)
REQUIRED_BY_TYPE = {
    "screen_view": (("screen_name", "screenName"),),
    "api_timing": (("method", "method"), ("path", "path")),
    "error": (("error_type", "errorType"), ("error_class", "errorClass"), ("error_message", "errorMessage")),
    "custom_event": (("event_name", "eventName"),),
}

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)

_COMMON = (
    "event_id string, session_id string, user_id string, app string, env string, app_version string, "
    "release string, platform string, device_model string, os_version string, "
)
_TAIL = "event_time timestamp, received_at timestamp, trace_id string, source_ip string, schema_version int"


@dataclass(frozen=True)
class TableSpec:
    """One stored table: columns, replace key (also its sort order), and the event types it holds."""

    name: str
    ddl: str
    sort_key: tuple[str, ...]
    event_types: tuple[str, ...]
    topic: str
    version: str = "received_at"

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return [field.split()[0] for field in self.ddl.split(", ")]


MOBILE_EVENTS = TableSpec(
    "mobile_events",
    "event_type string, " + _COMMON + "screen_name string, event_name string, event_data string, "
    "cold_start boolean, duration_ms double, " + _TAIL,
    ("app", "env", "event_type", "event_time", "event_id"),
    ("app_start", "screen_view", "custom_event"),
    TOPIC_EVENTS,
)
MOBILE_API_CALLS = TableSpec(
    "mobile_api_calls",
    _COMMON + "method string, path string, status_code int, duration_ms double, request_size bigint, "
    "response_size bigint, error_message string, " + _TAIL,
    ("app", "env", "path", "method", "event_time", "event_id"),
    ("api_timing",),
    TOPIC_API,
)
MOBILE_ERRORS = TableSpec(
    "mobile_errors",
    _COMMON + "error_type string, error_class string, error_message string, stacktrace string, "
    "screen_name string, " + _TAIL,
    ("app", "env", "error_class", "event_time", "event_id"),
    ("error",),
    TOPIC_ERRORS,
)
TABLES = (MOBILE_EVENTS, MOBILE_API_CALLS, MOBILE_ERRORS)
TABLES_BY_NAME = {t.name: t for t in TABLES}

ALERT_METRICS = ("error_rate", "p95_latency_ms", "failed_requests")
# Rules given to an app that has none: name, metric, threshold, window minutes, environment.
DEFAULT_RULES = (
    ("High Error Rate", "error_rate", 10.0, 5, "prod"),
    ("Slow p95 API Latency", "p95_latency_ms", 2000.0, 5, None),
    ("High Failed Requests", "failed_requests", 50.0, 5, None),
)
