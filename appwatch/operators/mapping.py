"""Envelopes to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from appwatch import schema as S


def _common(e: Column) -> dict[str, Column]:
    def text(name: str) -> Column:
        return F.coalesce(e[name], F.lit(""))

    return {
        "event_id": e["event_id"],
        "event_type": e["event_type"],
        "session_id": e["session_id"],
        "user_id": e["user_id"],
        "app": e["app_name"],
        "env": text("environment"),
        "app_version": e["app_version"],
        "release": text("release"),
        "platform": e["platform"],
        "device_model": text("device_model"),
        "os_version": text("os_version"),
        "event_time": e["timestamp"],
        "received_at": F.col("received_at"),
        "trace_id": e["trace_id"],
        "source_ip": F.col("source_ip"),
        "schema_version": F.col("schema_version"),
    }


def _specific(e: Column, spec: S.TableSpec) -> dict[str, Column]:
    if spec is S.MOBILE_EVENTS:
        custom = e["event_type"] == "custom_event"
        start = e["event_type"] == "app_start"
        return {
            "screen_name": F.when(e["event_type"] == "screen_view", e["screen_name"]),
            "event_name": F.when(custom, e["event_name"]),
            "event_data": F.coalesce(F.when(custom, e["event_data"]), F.lit("{}")),
            "cold_start": F.when(start, e["cold_start"]),
            "duration_ms": F.when(start, e["duration_ms"]),
        }
    if spec is S.MOBILE_API_CALLS:
        zeroed = {"status_code": F.lit(0), "duration_ms": F.lit(0.0)}
        plain = ("method", "path", "request_size", "response_size", "error_message")
        return {**{c: F.coalesce(e[c], z) for c, z in zeroed.items()}, **{c: e[c] for c in plain}}
    return {c: e[c] for c in ("error_type", "error_class", "error_message", "stacktrace", "screen_name")}


def to_table(envelopes: DataFrame, spec: S.TableSpec) -> DataFrame:
    """The envelopes that belong in ``spec``, in its columns. Unknown event types belong nowhere."""
    e = F.col("event")
    values = {**_common(e), **_specific(e, spec)}
    rows = envelopes.filter(e["event_type"].isin(*spec.event_types))
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in spec.schema])


def skip_unknown(envelopes: DataFrame, observation: Observation | None = None, column: str = "event.event_type") -> DataFrame:
    """Known event types only; the number skipped is observed while the rows pass by."""
    known = F.coalesce(F.col(column).isin(*S.EVENT_TYPES), F.lit(False))
    if observation is not None:
        envelopes = envelopes.observe(observation, F.count_if(~known).alias("skipped"))
    return envelopes.filter(known)
