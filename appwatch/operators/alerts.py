"""Threshold alerts: evaluate every rule in one job, suppress repeats, replay history."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions import histograms as H
from appwatch.functions.percentiles import group_percentiles
from appwatch.functions.scalars import as_instant, blank_to_null, minutes_back, since_month
from appwatch.operators.metadata import assign_ids
from appwatch.session import written

P95 = 0.95
# The metric whose value is a percentile, and the message for one that is not known.
P95_METRIC = "p95_latency_ms"
UNKNOWN_METRIC = "Unknown metric type: "


# --- reads of rules and firings --------------------------------------------------------------


def enabled_rules(rules: DataFrame, apps: DataFrame) -> DataFrame:
    """Enabled rules with the name of their app, by rule id."""
    a = apps.select(F.col("id").alias("app_id"), F.col("name").alias("app_name"))
    columns = ("id", "app_id", "app_name", "name", "metric_type", "threshold", "window_minutes", "env", "release")
    joined = rules.filter("enabled").join(a, "app_id")
    return joined.select(*columns).withColumn("threshold", F.col("threshold").cast("double")).orderBy("id")


def rules_for_app(rules: DataFrame, apps: DataFrame, app: str | None = None) -> DataFrame:
    a = apps.select(F.col("id").alias("app_id"), F.col("name").alias("_app"))
    if app is not None and app.strip():
        a = a.filter(F.col("_app") == app)
    columns = ("id", "app_id", "name", "metric_type", "threshold", "window_minutes", "env", "release", "enabled", "created_at")
    joined = rules.join(a, "app_id").select(*columns)
    return joined.withColumn("threshold", F.col("threshold").cast("double")).orderBy("created_at", "id")


def firings_feed(
    firings: DataFrame, rules: DataFrame, apps: DataFrame, start: datetime, to: datetime,
    app: str | None = None, limit: int = S.FEED_DEFAULT_ROWS,
) -> DataFrame:
    """Firings in a closed time range with their rule, newest first, as many as asked for."""
    f = firings.filter(F.col("fired_at").between(as_instant(start), as_instant(to)))
    r = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "metric_type", "threshold")
    a = apps.select(F.col("id").alias("app_id"), F.col("name").alias("_app"))
    if app is not None and app.strip():
        a = a.filter(F.col("_app") == app)
    return (
        f.join(r, "rule_id")
        .join(a, "app_id")
        .select(
            "id", "rule_id", "rule_name", "metric_type", F.col("threshold").cast("double").alias("threshold"),
            F.col("value_observed").cast("double").alias("value_observed"), "status", "fired_at", "resolved_at",
        )
        .orderBy(F.col("fired_at").desc(), F.col("id").desc())
        .limit(max(0, limit))
    )


# --- rule keys -----------------------------------------------------------------------------
# A rule names an app and maybe an environment and release; NULL stands for any. Telemetry is
# summed per combination first and each sum is then offered under "its value" and under "any", so
# that rules find their rows by plain equality and no rule is compared with every row.


def _dims(apply_release: bool) -> list[str]:
    return ["app", "env", "release"] if apply_release else ["app", "env"]


def _keyed(rules: DataFrame, dims: list[str]) -> DataFrame:
    source = {"app": "app_name", "env": "env", "release": "release"}
    return rules.select(
        F.col("id").alias("rule_id"), "app_id", "name", "metric_type", F.col("threshold").cast("double").alias("threshold"),
        "window_minutes", *[blank_to_null(F.col(source[d])).alias(f"k_{d}") for d in dims],
    )


def _offer(df: DataFrame, dims: list[str]) -> DataFrame:
    for d in dims:
        df = df.withColumn(f"k_{d}", F.explode(F.array(F.col(d), F.lit(None).cast("string")))).drop(d)
    return df


def _meet(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Join on equal (or both NULL) columns, keeping the left side's."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return left.join(other, reduce(and_, same if also is None else [*same, also]), how).drop(*[f"_{c}" for c in columns])


def _specs(keyed: DataFrame, metrics: list[str], k: list[str]) -> DataFrame:
    """What has to be measured: rules that watch the same thing share one measurement."""
    return keyed.filter(F.col("metric_type").isin(*metrics)).select("metric_type", *k, "window_minutes").distinct()


def _slots(errors: DataFrame, failed: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Additive metrics per combination and slot (a minute number), offered under rule keys."""
    sources = {
        "error_rate": errors.select(*dims, "slot", F.col("error_count").alias("amount")),
        "failed_requests": failed.select(*dims, "slot", F.lit(1).cast("long").alias("amount")),
    }
    both = reduce(DataFrame.unionByName, [sources[m].withColumn("metric_type", F.lit(m)) for m in metrics])
    summed = both.groupBy("metric_type", *dims, "slot").agg(F.sum("amount").alias("amount"))
    k = [f"k_{d}" for d in dims]
    return _offer(summed, dims).groupBy("metric_type", *k, "slot").agg(F.sum("amount").alias("amount"))


def _latency_slots(calls: DataFrame, dims: list[str], exact: bool) -> DataFrame:
    """Durations per combination and slot: repeat counts of values when exact, of histogram buckets otherwise.

    Buckets are summed once more after the offer, so "any app" holds few rows however many apps there are.
    """
    if exact:
        return _offer(calls.groupBy(*dims, "slot", "duration_ms").agg(F.count(F.lit(1)).alias("n")), dims)
    bucketed = calls.select(*dims, "slot", H.bucket(F.col("duration_ms")).alias("_bucket")).where("_bucket is not null")
    counted = bucketed.groupBy(*dims, "slot", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    return _offer(counted, dims).groupBy(*[f"k_{d}" for d in dims], "slot", "_bucket").agg(F.sum("n").alias("n"))


def _p95(rows: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    if exact:
        return group_percentiles(rows, keys, "duration_ms", {"value": P95}, weight="n", exact=True)
    return rows.groupBy(*keys).agg(H.percentiles(F.col("_bucket"), F.col("n"), [P95])[0].alias("value"))


def _rate(amount: Column) -> Column:
    per_minute = (F.col("metric_type") == "error_rate") & (F.col("window_minutes") > 0)
    return F.when(per_minute, amount / F.col("window_minutes")).otherwise(amount.cast("double"))


# --- one tick ------------------------------------------------------------------------------


def evaluate_rules(
    rules: DataFrame, error_rollup: DataFrame, calls: DataFrame, as_of: datetime,
    exact: bool = False, apply_release: bool = False, metrics: tuple[str, ...] = S.ALERT_METRICS,
) -> DataFrame:
    """Observed value of every enabled rule at ``as_of``.

    The window has a lower bound only, so telemetry dated later counts. Errors come from the
    per-minute rollup, by minute start. Silent rules stay: 0 for counts, NULL for a percentile,
    and NULL never breaches. A rule with an unknown metric gets ``error`` and harms no other.
    ``metrics`` narrows the work to rules of these known metrics. Percentiles are ``exact`` or come from
    histograms, within 0.4 %; both are the same whenever they are computed from the same rows.
    """
    dims = _dims(apply_release)
    k = [f"k_{d}" for d in dims]
    keyed = _watched(rules, dims, metrics)
    now, since = as_instant(as_of), _earliest(keyed, as_of)
    recent = since_month(calls, since).filter(F.col("event_time") >= since)
    recent = recent.withColumn("slot", minutes_back(now, F.col("event_time")))
    counted = [m for m in metrics if m != P95_METRIC]
    amounts = _slots(_error_slots(error_rollup, since, now), recent.filter("status_code >= 400"), dims, counted) if counted else None
    latency = _latency_slots(recent, dims, exact) if P95_METRIC in metrics else None
    return _judged(keyed, _values(keyed, k, amounts, latency, metrics, exact))


def evaluate_from_rollups(
    rules: DataFrame, error_rollup: DataFrame, latency_rollup: DataFrame, calls: DataFrame, as_of: datetime, apply_release: bool = False
) -> DataFrame:
    """The same values from per-minute rollups; of the raw calls only minutes that a window's edge cuts are read.

    A minute counts whole for windows that reach its start. The window that ends inside it gets the
    calls of that minute one by one: at most one minute per distinct window length, and none if ``as_of`` is a whole minute.
    """
    dims = _dims(apply_release)
    k = [f"k_{d}" for d in dims]
    keyed = _watched(rules, dims, S.ALERT_METRICS)
    now, since = as_instant(as_of), _earliest(keyed, as_of)
    minutes = since_month(latency_rollup, since).filter(F.col("minute") >= since)
    minutes = minutes.withColumn("slot", minutes_back(now, F.col("minute")))
    failed = minutes.select(*dims, "slot", F.col("error_count").alias("amount"))
    latency = H.entries(minutes, "duration_histogram", [*dims, "slot"]).where("_bucket is not null")
    latency = latency.select(*dims, "slot", "_bucket", F.col("_n").alias("n"))
    whole = F.lit(None).cast("long").alias("only")
    failed, latency = failed.select("*", whole), latency.select("*", whole)
    if as_of.second or as_of.microsecond:
        edges = sorted(r[0] for r in keyed.select("window_minutes").distinct().collect())  # lengths that rules have
        starts = [(as_of - timedelta(minutes=w)) for w in edges if w is not None]
        inside = [F.col("event_time").between(as_instant(t), as_instant(t.replace(second=59, microsecond=999_999))) for t in starts]
        cut = since_month(calls, since).filter(reduce(or_, inside, F.lit(False)))
        # Counts for the one window that ends in its minute; longer ones have the minute whole.
        cut = cut.select(*dims, minutes_back(now, F.col("event_time")).alias("slot"), "status_code", H.bucket(F.col("duration_ms")).alias("_bucket"))
        only, one = F.col("slot").alias("only"), F.lit(1).cast("long")
        failed = failed.unionByName(cut.filter("status_code >= 400").select(*dims, "slot", one.alias("amount"), only))
        latency = latency.unionByName(cut.where("_bucket is not null").select(*dims, "slot", "_bucket", one.alias("n"), only))
    errors = _error_slots(error_rollup, since, now).select(*dims, "slot", F.col("error_count").alias("amount"), whole)
    both = errors.withColumn("metric_type", F.lit("error_rate")).unionByName(failed.withColumn("metric_type", F.lit("failed_requests")))
    amounts = _offered(both.groupBy("metric_type", *dims, "slot", "only").agg(F.sum("amount").alias("amount")), dims, ["metric_type", "slot", "only"], "amount")
    buckets = latency.groupBy(*dims, "slot", "only", "_bucket").agg(F.sum("n").alias("n"))
    buckets = _offered(buckets, dims, ["slot", "only", "_bucket"], "n")
    return _judged(keyed, _values(keyed, k, amounts, buckets, S.ALERT_METRICS, exact=False))


def _watched(rules: DataFrame, dims: list[str], metrics: tuple[str, ...]) -> DataFrame:
    if set(metrics) != set(S.ALERT_METRICS):
        rules = rules.filter(F.col("metric_type").isin(*metrics))
    return _keyed(rules, dims)


def _earliest(keyed: DataFrame, as_of: datetime) -> Column:
    """The start of the widest window."""
    widest = keyed.select(F.coalesce(F.max("window_minutes"), F.lit(0))).scalar()
    return F.timestamp_add("MINUTE", -widest, as_instant(as_of))


def _error_slots(error_rollup: DataFrame, since: Column, now: Column) -> DataFrame:
    errors = since_month(error_rollup, since).filter(F.col("minute") >= since)
    return errors.withColumn("slot", minutes_back(now, F.col("minute")))


def _offered(summed: DataFrame, dims: list[str], by: list[str], amount: str) -> DataFrame:
    return _offer(summed, dims).groupBy(*[f"k_{d}" for d in dims], *by).agg(F.sum(amount).alias(amount))


def _values(
    keyed: DataFrame, k: list[str], amounts: DataFrame | None, latency: DataFrame | None, metrics: tuple[str, ...], exact: bool
) -> DataFrame:
    """The value of everything that rules watch. Rows with ``only`` count for windows of that length alone."""

    def reach(df: DataFrame) -> Column:
        inside = F.col("slot") <= F.col("window_minutes")
        return inside & (F.col("only").isNull() | (F.col("only") == F.col("window_minutes"))) if "only" in df.columns else inside

    values = []
    if amounts is not None:
        counted = [m for m in metrics if m != P95_METRIC]
        found = _meet(_specs(keyed, counted, k), amounts, ["metric_type", *k], also=reach(amounts))
        sums = found.groupBy("metric_type", *k, "window_minutes").agg(F.sum("amount").alias("amount"))
        values.append(sums.select("metric_type", *k, "window_minutes", _rate(F.col("amount")).alias("value")))
    if latency is not None:
        met = _meet(_specs(keyed, [P95_METRIC], k), latency, k, also=reach(latency))
        values.append(_p95(met, [*k, "window_minutes"], exact).withColumn("metric_type", F.lit(P95_METRIC)))
    return reduce(DataFrame.unionByName, values)


def _judged(keyed: DataFrame, values: DataFrame) -> DataFrame:
    """Every rule with its value, its error if its metric is unknown, and whether it is breached."""
    k = [c for c in keyed.columns if c.startswith("k_")]
    joined = _meet(keyed, values, ["metric_type", *k, "window_minutes"], "left")
    metric = F.col("metric_type")
    value = (
        F.when(~metric.isin(*S.ALERT_METRICS), F.lit(None))
        .when(metric == P95_METRIC, F.col("value"))
        .otherwise(F.coalesce("value", F.lit(0.0)))
    )
    return joined.select(
        "rule_id", "app_id", "name", "metric_type", "threshold", "window_minutes",
        value.cast("double").alias("value"),
        F.when(~metric.isin(*S.ALERT_METRICS), F.concat(F.lit(UNKNOWN_METRIC), metric)).alias("error"),
    ).withColumn("breached", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def new_firings(evaluated: DataFrame, firings: DataFrame, as_of: datetime) -> DataFrame:
    """Breaches without an active firing in the last two windows, as rows to append."""
    now = as_instant(as_of)
    last = firings.filter("status = 'firing'").groupBy("rule_id").agg(F.max("fired_at").alias("last_fired"))
    last = last.withColumnRenamed("rule_id", "_rule")
    since = F.timestamp_add("MINUTE", -2 * F.col("window_minutes"), now)
    suppressed = (F.col("rule_id") == F.col("_rule")) & (F.col("last_fired") >= since)
    fresh = evaluated.filter("breached").join(last, suppressed, "left_anti").select(
        F.col("rule_id").cast("string").alias("_key"),
        "rule_id",
        "app_id",
        now.alias("fired_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.col("value").cast("decimal(14,4)").alias("value_observed"),
        F.lit("firing").alias("status"),
    )
    return assign_ids(fresh, "_key", firings).drop("_key")


# --- replay --------------------------------------------------------------------------------


def backtest(
    rules: DataFrame, error_rollup: DataFrame, calls: DataFrame, start: datetime, to: datetime, step_minutes: int,
    exact: bool = False, apply_release: bool = False,
) -> DataFrame:
    """The firings that evaluating every ``step_minutes`` from ``start`` to ``to`` would have made.

    A tick at T sees telemetry in [T - window, T). Counts are summed per minute from ``start``; a window's value is the
    difference of two running sums, so a minute's count moves once however many windows hold it. Latency buckets
    are merged over the minutes that the same ticks see, and only then handed to these ticks.

    A firing keeps its rule quiet for two windows. Each breach points at the first one after its quiet time; which breaches fire
    is found by doubling these pointers, in as many rounds as the number of ticks has binary digits. Rules that watch the same
    thing and breach at the same ticks are followed once, however many they are: a watch has no more levels than ticks.
    """
    dims = _dims(apply_release)
    k = [f"k_{d}" for d in dims]
    keyed = _keyed(rules, dims)
    t0, t1 = as_instant(start), as_instant(to)
    last_tick = int((to - start).total_seconds() // 60) // step_minutes
    widest = keyed.select(F.coalesce(F.max("window_minutes"), F.lit(0))).scalar()
    since = F.timestamp_add("MINUTE", -widest, t0)

    def slotted(df: DataFrame, column: str) -> DataFrame:
        inside = (F.col(column) >= since) & (F.col(column) < t1)
        minute = F.floor((F.unix_micros(F.col(column)) - F.unix_micros(t0)) / F.lit(60_000_000.0)).cast("long")
        return since_month(df, since, t1).filter(inside).withColumn("slot", minute)

    recent = slotted(calls, "event_time")
    counted = ["error_rate", "failed_requests"]
    amounts = _slots(slotted(error_rollup, "minute"), recent.filter("status_code >= 400"), dims, counted)
    additive = _window_sums(_specs(keyed, counted, k), amounts, k, step_minutes, last_tick)
    latency = _meet(_specs(keyed, [P95_METRIC], k), _latency_slots(recent, dims, exact), k)
    p95 = _p95(_at_ticks(latency, k, step_minutes, last_tick), [*k, "window_minutes", "tick"], exact).withColumn("metric_type", F.lit(P95_METRIC))
    watch = ["metric_type", *k, "window_minutes"]
    values = written(additive.unionByName(p95), "values")
    levelled = _levelled(keyed, values, watch)
    classes = levelled.select(*watch, "level").distinct().withColumn("watched", F.to_json(F.struct(*watch, "level")))
    breaches = _meet(classes, values, watch).filter(F.col("value") >= F.col("level"))
    breaches = breaches.withColumn("quiet", F.floor(F.lit(2) * F.col("window_minutes") / step_minutes))
    fired = _firing_ticks(written(breaches, "breaches"), last_tick).select(*watch, "level", "tick", "value")
    return _meet(levelled, fired, [*watch, "level"]).select(
        "rule_id", "app_id", F.timestamp_add("MINUTE", (F.col("tick") * step_minutes).cast("int"), t0).alias("fired_at"), "value"
    )


def _levelled(keyed: DataFrame, values: DataFrame, watch: list[str]) -> DataFrame:
    """Rules with the smallest value of what they watch that breaches them; rules that nothing breaches are left out.

    A tick breaches a rule if its value is at least that one, so thresholds between two values come to the same. A
    watch has one list of values, one per tick at most.
    """
    lists = written(values.groupBy(*watch).agg(F.collect_set("value").alias("levels")), "levels")
    met = _meet(keyed.select("rule_id", "app_id", *watch, "threshold"), lists, watch)
    level = F.array_min(F.filter("levels", lambda v: v >= F.col("threshold")))
    return met.withColumn("level", level).where("level is not null").drop("levels", "threshold")


def _window_sums(specs: DataFrame, amounts: DataFrame, k: list[str], step: int, last_tick: int) -> DataFrame:
    """The value of each additive spec at each tick, from running sums at both ends of its window.

    Sums run over the minutes and ticks of one key, whose number does not depend on the telemetry.
    """
    key = ["metric_type", *k]
    ticks = specs.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(last_tick)))).withColumn("tick", F.col("tick").cast("long"))
    ends = F.array(
        F.struct((F.col("tick") * step).alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("tick") * step - F.col("window_minutes")).alias("at"), F.lit(-1).alias("sign")),
    )
    edges = ticks.select(*key, "window_minutes", "tick", F.explode(ends).alias("e")).select(*key, "window_minutes", "tick", "e.at", "e.sign")
    # A minute counts for every end after it.
    points = amounts.select(*key, (F.col("slot") + 1).alias("at"), "amount").unionByName(edges, allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy("at", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    summed = points.withColumn("running", F.coalesce(F.sum("amount").over(upto), F.lit(0))).where("sign is not null")
    sums = summed.groupBy(*key, "window_minutes", "tick").agg(F.sum(F.col("sign") * F.col("running")).alias("amount"))
    return sums.select(*key, "window_minutes", "tick", _rate(F.col("amount")).alias("value"))


def _at_ticks(latency: DataFrame, k: list[str], step: int, last_tick: int) -> DataFrame:
    """Rows for each tick that sees their minute; minutes that the same ticks see are merged before."""
    first = F.greatest(F.floor(F.col("slot") / step) + 1, F.lit(0))
    last = F.least(F.floor((F.col("slot") + F.col("window_minutes")) / step), F.lit(last_tick))
    what = "_bucket" if "_bucket" in latency.columns else "duration_ms"
    cells = latency.select(*k, "window_minutes", what, "n", first.alias("first"), last.alias("last")).where("first <= last")
    cells = cells.groupBy(*k, "window_minutes", "first", "last", what).agg(F.sum("n").alias("n"))
    return cells.withColumn("tick", F.explode(F.sequence("first", "last"))).drop("first", "last")


def _firing_ticks(breaches: DataFrame, last_tick: int) -> DataFrame:
    """The breaches that fire: the first one of each ``watched``, then each first one more than ``quiet`` ticks after a firing."""
    kind = F.lit(0).alias("probe")
    found = breaches.select("watched", F.col("tick").alias("at"), kind, F.col("tick").alias("hit"), F.lit(None).cast("long").alias("tick"))
    probes = breaches.select("watched", (F.col("tick") + F.col("quiet")).alias("at"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("hit"), "tick")
    # From the latest back: the breach seen last is the next one after the probe.
    later = Window.partitionBy("watched").orderBy(F.col("at").desc(), F.col("probe").desc()).rowsBetween(Window.unboundedPreceding, 0)
    jump = found.unionByName(probes).withColumn("next", F.min("hit").over(later)).where("probe = 1 and next is not null")
    jumps = [written(jump.select("watched", "tick", "next"), "jumps")]
    while 2 ** len(jumps) <= last_tick + 1:
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        twice = a.join(b, (F.col("a.watched") == F.col("b.watched")) & (F.col("a.next") == F.col("b.tick")))
        twice = written(twice.select("a.watched", "a.tick", "b.next"), "jumps")
        if twice.isEmpty():
            break
        jumps.append(twice)
    fired = breaches.groupBy("watched").agg(F.min("tick").alias("tick"))
    for jump in reversed(jumps):
        fired = fired.unionByName(fired.join(jump, ["watched", "tick"]).select("watched", F.col("next").alias("tick")))
        fired = written(fired, "fired")
    return breaches.join(fired, ["watched", "tick"])
