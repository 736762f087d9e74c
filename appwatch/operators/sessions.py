"""Sessions from telemetry, and the screen a session was on when an error happened."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions.filters import Filters
from appwatch.functions.scalars import is_blank
from appwatch.operators.dashboard import select_range
from appwatch.operators.dedup import narrow

SESSION_DIMS = ("user_id", "app", "env", "app_version", "release", "platform", "device_model", "os_version")


def _rows(df: DataFrame, spec: S.TableSpec, columns: list[str], dedup: bool, filters: Filters | None) -> DataFrame:
    return narrow(df, spec, columns, dedup) if filters is None else select_range(df, spec, filters, tuple(columns), dedup)


def session_partials(
    events: DataFrame, calls: DataFrame, errors: DataFrame, dedup: bool = True, by: list[str] | None = None, filters: Filters | None = None
) -> DataFrame:
    """Start, end, counts and latest dimensions per session, in a form that merges."""
    extra = by or []
    columns = ["session_id", "event_time", "event_id", *SESSION_DIMS, *extra]
    rows = None
    for df, spec in ((events, S.MOBILE_EVENTS), (calls, S.MOBILE_API_CALLS), (errors, S.MOBILE_ERRORS)):
        part = _rows(df, spec, columns, dedup, filters).withColumn("_error", F.lit(spec is S.MOBILE_ERRORS))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("session_id", *extra).agg(
        F.min("event_time").alias("started_at"),
        F.max("event_time").alias("ended_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if("_error").alias("error_count"),
        F.max(F.struct("event_time", "event_id", *SESSION_DIMS)).alias("latest"),
    )


def merge_sessions(partials: DataFrame) -> DataFrame:
    """Session rows from partials of any number of batches."""
    merged = partials.groupBy("session_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("event_count").alias("event_count"),
        F.sum("error_count").alias("error_count"),
        F.max("latest").alias("latest"),
    )
    return _present(merged)


def build_sessions(
    events: DataFrame, calls: DataFrame, errors: DataFrame, dedup: bool = True, filters: Filters | None = None
) -> DataFrame:
    """One row per session over all three tables. Every row counts as an event, error rows also as errors.

    With ``filters`` a session is what it did in their time range; months outside it are not read.
    """
    return _present(session_partials(events, calls, errors, dedup, filters=filters))


def _present(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", *[F.col(f"latest.{d}").alias(d) for d in SESSION_DIMS],
        "started_at", "ended_at", "event_count", "error_count",
    )


def error_last_screen(
    errors: DataFrame, events: DataFrame, dedup: bool = True, filters: Filters | None = None, look_back: timedelta = timedelta(hours=24)
) -> DataFrame:
    """Errors without a screen get the last screen their session viewed, at or before the error.

    Views and look-ups shrink to one point per session and instant, and points are ordered inside
    session hours; what each hour starts with comes from the hours before it. A session with very
    many rows is thus never ordered as one group.

    With ``filters`` only errors of their time range, and screens viewed in it or up to ``look_back`` before.
    """
    columns = ["event_id", "session_id", "event_time", "screen_name"]
    earlier_too = filters and replace(filters, start=filters.bounds()[0] - look_back, to=filters.bounds()[1])
    e = _rows(errors, S.MOBILE_ERRORS, columns, dedup, filters)
    v = _rows(events.filter("event_type = 'screen_view'"), S.MOBILE_EVENTS, columns, dedup, earlier_too)
    missing = e.filter(is_blank(F.col("screen_name")))

    viewed = F.struct("event_id", "screen_name")
    points = (
        v.select("session_id", "event_time", viewed.alias("view"))
        .unionByName(missing.select("session_id", "event_time"), allowMissingColumns=True)
        .groupBy("session_id", "event_time")
        .agg(F.max("view").alias("view"))
        .select("session_id", "event_time", F.col("view.screen_name").alias("screen"))
        .withColumn("hour", F.date_trunc("hour", "event_time"))
    )
    so_far = Window.partitionBy("session_id", "hour").orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    inside = points.withColumn("seen", F.last("screen", ignorenulls=True).over(so_far))
    earlier = Window.partitionBy("session_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        points.groupBy("session_id", "hour")
        .agg(F.max(F.when(F.col("screen").isNotNull(), F.struct("event_time", "screen"))).alias("last"))
        .select("session_id", "hour", F.last("last.screen", ignorenulls=True).over(earlier).alias("carried"))
    )
    found = inside.join(hours, ["session_id", "hour"]).select(
        "session_id", "event_time", F.coalesce("seen", "carried").alias("found")
    )
    e, found = e.alias("e"), found.alias("f")
    same = (
        (F.col("e.session_id") == F.col("f.session_id"))
        & (F.col("e.event_time") == F.col("f.event_time"))
        & is_blank(F.col("e.screen_name"))
    )
    return e.join(found, same, "left").select(
        "e.event_id",
        "e.session_id",
        "e.event_time",
        F.when(is_blank(F.col("e.screen_name")), F.col("f.found")).otherwise(F.col("e.screen_name")).alias("screen_name"),
    )
