"""The dashboard reads: overview, error feed, endpoint latency, and the tables derived from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions.filters import Filters, like_filters, time_range
from appwatch.functions.percentiles import group_percentiles
from appwatch.functions.scalars import as_instant, compact_number
from appwatch.operators.dedup import narrow
from appwatch.operators.rollups import rollup_percentiles

DIMENSIONS = ("app", "env", "release")
LEVELS = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def select_range(
    df: DataFrame,
    spec: S.TableSpec,
    filters: Filters,
    columns: tuple[str, ...] = (),
    dedup: bool = True,
    dims: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Rows of a table that pass the filters, in ``columns`` only.

    Filters on key columns run before deduplication, where they prune the scan; copies of an event
    agree on them. A filter on any other column runs after it, on the row that won.
    """
    early = tuple(d for d in dims if d in spec.sort_key)
    late = tuple(d for d in dims if d not in early)
    df = like_filters(time_range(df, filters), filters, early)
    if not dedup:
        return like_filters(df, filters, late).select(*columns)
    active = [d for d in late if getattr(filters, d)]
    return like_filters(narrow(df, spec, [*columns, *active]), filters, late).select(*columns)


# --- overview ------------------------------------------------------------------------------


def _sessions(approx: bool) -> Column:
    return (F.approx_count_distinct if approx else F.count_distinct)("session_id").alias("unique_sessions")


def overview_events(events: DataFrame, filters: Filters, dedup: bool = True, approx: bool = False) -> DataFrame:
    rows = select_range(events, S.MOBILE_EVENTS, filters, ("session_id", "event_type", "duration_ms"), dedup)
    start_ms = F.when(F.col("event_type") == "app_start", F.col("duration_ms"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_events"), _sessions(approx), F.avg(start_ms).alias("avg_app_start_ms")
    )


def overview_errors(errors: DataFrame, filters: Filters, dedup: bool = True) -> DataFrame:
    rows = select_range(errors, S.MOBILE_ERRORS, filters, ("event_id",), dedup)
    return rows.agg(F.count(F.lit(1)).alias("total_errors"))


def overview_api(calls: DataFrame, filters: Filters, dedup: bool = True) -> DataFrame:
    rows = select_range(calls, S.MOBILE_API_CALLS, filters, ("status_code",), dedup)
    return rows.agg(
        F.count(F.lit(1)).alias("total_api_calls"), F.count_if(F.col("status_code") >= 400).alias("api_errors")
    )


def overview(
    events: DataFrame, calls: DataFrame, errors: DataFrame, filters: Filters, dedup: bool = True, approx: bool = False
) -> DataFrame:
    """All overview figures in one row. The three tables are stacked with a marker and aggregated once.

    Sessions and totals cover the events table only. Without app starts the average is 0.
    """
    e = select_range(events, S.MOBILE_EVENTS, filters, ("session_id", "event_type", "duration_ms"), dedup)
    a = select_range(calls, S.MOBILE_API_CALLS, filters, ("status_code",), dedup)
    x = select_range(errors, S.MOBILE_ERRORS, filters, ("event_id",), dedup)
    stacked = (
        e.select(
            F.lit("e").alias("t"),
            "session_id",
            F.when(F.col("event_type") == "app_start", F.col("duration_ms")).alias("start_ms"),
            F.lit(None).cast("int").alias("status_code"),
        )
        .unionByName(a.select(F.lit("a").alias("t"), "status_code"), allowMissingColumns=True)
        .unionByName(x.select(F.lit("x").alias("t")), allowMissingColumns=True)
    )
    return stacked.agg(
        F.count_if(F.col("t") == "e").alias("total_events"),
        _sessions(approx),
        F.count_if(F.col("t") == "x").alias("total_errors"),
        F.count_if(F.col("t") == "a").alias("total_api_calls"),
        F.count_if(F.col("status_code") >= 400).alias("api_errors"),
        F.coalesce(F.avg("start_ms"), F.lit(0.0)).alias("avg_app_start_ms"),
    )


def error_percent(errors: Column, total: Column) -> Column:
    """Share in percent with one decimal; NULL when there is nothing to divide by."""
    return F.when(total > 0, F.round(errors / total * 100, 1))


def overview_cards(row: DataFrame) -> DataFrame:
    """The overview row as shown: compact numbers, error share, start time in ms."""
    start = F.when(F.col("avg_app_start_ms") > 0, F.concat(compact_number(F.col("avg_app_start_ms")), F.lit(" ms")))
    return row.select(
        *[compact_number(F.col(c)).alias(c) for c in ("total_events", "unique_sessions", "total_errors", "total_api_calls", "api_errors")],
        error_percent(F.col("api_errors"), F.col("total_api_calls")).alias("api_error_pct"),
        start.alias("avg_app_start"),
    )


# --- errors --------------------------------------------------------------------------------


def api_limit(limit: int) -> int:
    """The number of rows that the web API grants; callers that serve it apply this themselves."""
    return max(0, min(limit, S.FEED_MAX_ROWS))


def error_feed(errors: DataFrame, filters: Filters, limit: int = S.FEED_DEFAULT_ROWS, dedup: bool = True) -> DataFrame:
    """Newest errors first, as many as asked for."""
    columns = ("event_id", "error_class", "error_message", "release", "platform", "screen_name", "event_time")
    rows = select_range(errors, S.MOBILE_ERRORS, filters, columns, dedup)
    return rows.orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(max(0, limit))


# --- latency -------------------------------------------------------------------------------


def api_latency(calls: DataFrame, filters: Filters, dedup: bool = True, exact: bool = False) -> DataFrame:
    """Hourly requests, errors and latency percentiles per path, method and release."""
    rows = select_range(
        calls, S.MOBILE_API_CALLS, filters, ("path", "method", "release", "event_time", "status_code", "duration_ms"),
        dedup, (*DIMENSIONS, "path", "method"),
    )
    rows = rows.withColumn("bucket", F.date_trunc("hour", "event_time"))
    counts = {
        "request_count": F.lit(1),
        "error_count": F.when(F.col("status_code") >= 400, 1).otherwise(0),
    }
    out = group_percentiles(rows, ["path", "method", "release", "bucket"], "duration_ms", LEVELS, counts, exact=exact)
    return out.orderBy("bucket", "path", "method", "release")


def latency_from_rollup(rollup: DataFrame, filters: Filters) -> DataFrame:
    """Hourly latency from the per-minute rollup and its histograms: never touches raw calls."""
    rows = like_filters(time_range(rollup, filters, "minute"), filters, (*DIMENSIONS, "path", "method"))
    rows = rows.withColumn("bucket", F.date_trunc("hour", "minute"))
    by = ["path", "method", "release", "bucket"]
    hourly = rollup_percentiles(rows, "api_latency_1m", LEVELS, by)
    return hourly.select(*by, "request_count", "error_count", *LEVELS).orderBy("bucket", "path", "method", "release")


def endpoint_summary(latency: DataFrame) -> DataFrame:
    """Totals per endpoint over all latency buckets."""
    return (
        latency.groupBy("method", "path")
        .agg(F.sum("request_count").alias("requests"), F.sum("error_count").alias("errors"))
        .withColumn("error_pct", error_percent(F.col("errors"), F.col("requests")))
    )


def latency_series(latency: DataFrame) -> DataFrame:
    """Chart rows per endpoint in time order, percentiles rounded to whole milliseconds."""
    return latency.select(
        "method",
        "path",
        "release",
        "bucket",
        *[F.floor(F.col(n) + 0.5).cast("long").alias(n) for n in LEVELS],
        F.col("error_count").alias("errors"),
        F.col("request_count").alias("requests"),
    ).orderBy("method", "path", "bucket", "release")


def latency_overall(
    calls: DataFrame, keys: list[str], dedup: bool = True, exact: bool = False, filters: Filters | None = None
) -> DataFrame:
    """Requests, errors, network failures and p95 latency per ``keys``, of all time or of the filters' range."""
    columns = (*keys, "status_code", "duration_ms")
    rows = narrow(calls, S.MOBILE_API_CALLS, columns, dedup)
    if filters is not None:
        rows = select_range(calls, S.MOBILE_API_CALLS, filters, columns, dedup, (*DIMENSIONS, "path", "method"))
    counts = {
        "requests": F.lit(1),
        "errors": F.when(F.col("status_code") >= 400, 1).otherwise(0),
        "network_failures": F.when(F.col("status_code") == 0, 1).otherwise(0),
    }
    return group_percentiles(rows, keys, "duration_ms", {"p95_ms": 0.95}, counts, exact=exact)


# --- volumes and comparison ------------------------------------------------------------------


def counts_by_type(*tables: DataFrame) -> DataFrame:
    """Stored rows per event type. Each table is counted first and only the counts are combined."""
    parts = [t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))


def window_presets(rows: DataFrame, as_of: datetime, hours: tuple[int, ...] = S.WINDOW_PRESET_HOURS) -> DataFrame:
    """Rows inside each quick window that ends at ``as_of``; one pass over the widest one."""
    widest = time_range(rows, Filters(start=as_of - timedelta(hours=max(hours)), to=as_of))
    to = as_instant(as_of)
    inside = [
        F.count_if(F.col("event_time") >= to - F.expr(f"interval {h} hours")).alias(f"h{h}") for h in hours
    ]
    pairs = ", ".join(f"{h}, h{h}" for h in hours)
    return widest.agg(*inside).selectExpr(f"stack({len(hours)}, {pairs}) as (hours, n)")


def compare_releases(
    events: DataFrame, calls: DataFrame, base: str, candidate: str, dedup: bool = True, exact: bool = False, filters: Filters | None = None
) -> DataFrame:
    """One row setting a candidate release against a base release, over all time or the filters' range."""
    both = F.col("release").isin(base, candidate)
    of_calls, of_events = ("release", "status_code", "duration_ms"), ("release", "event_type", "duration_ms")
    if filters is None:
        c, e = narrow(calls, S.MOBILE_API_CALLS, of_calls, dedup), narrow(events, S.MOBILE_EVENTS, of_events, dedup)
    else:
        c = select_range(calls, S.MOBILE_API_CALLS, filters, of_calls, dedup)
        e = select_range(events, S.MOBILE_EVENTS, filters, of_events, dedup)
    c, e = c.filter(both), e.filter(both)
    start = e.filter("event_type = 'app_start'").groupBy("release").agg(F.avg("duration_ms").alias("start_ms"))
    sums = {
        "calls": F.lit(1),
        "timed": F.when(F.col("duration_ms").isNotNull(), 1).otherwise(0),
        "total_ms": F.col("duration_ms"),
        "failed": F.when(F.col("status_code") >= 400, 1).otherwise(0),
    }
    latency = group_percentiles(c, ["release"], "duration_ms", {"p95_ms": 0.95}, sums, exact=exact).select(
        "release",
        "p95_ms",
        F.try_divide("total_ms", "timed").alias("mean_ms"),
        (F.col("failed") / F.col("calls")).alias("error_share"),
    )
    per = latency.unionByName(start, allowMissingColumns=True)
    picks = []
    for label, release in (("base", base), ("candidate", candidate)):
        for m in ("mean_ms", "p95_ms", "error_share", "start_ms"):
            picks.append(F.max(F.when(F.col("release") == release, F.col(m))).alias(f"{label}_{m}"))
    return per.agg(*picks).select(
        F.lit(base).alias("base"),
        F.lit(candidate).alias("candidate"),
        "*",
        (F.col("candidate_mean_ms") > F.col("base_mean_ms")).alias("slower"),
    )
