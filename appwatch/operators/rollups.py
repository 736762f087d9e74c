"""Per-minute rollups as data: dimensions and mergeable measures, used by batch and stream alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appwatch.functions import histograms as H
from appwatch.operators.dedup import narrow
from appwatch.schema import MOBILE_API_CALLS, MOBILE_ERRORS, MOBILE_EVENTS, TableSpec


SESSIONS_1M = "sessions_1m"
SKETCH_BITS = 12
#: Three standard errors of a sketch's estimate, 1.04 / sqrt(2 ** SKETCH_BITS) each.
SESSION_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


@dataclass(frozen=True)
class Rollup:
    name: str
    source: TableSpec
    dims: tuple[str, ...]
    # measure -> (how it is taken from rows, how partial values of it merge)
    measures: dict[str, tuple[Column, str]]
    inputs: tuple[str, ...] = ()
    # (column, values counted in it): a histogram, which merges by adding counts per bucket
    histogram: tuple[str, str] | None = None

    @property
    def key(self) -> list[str]:
        return [*self.dims, "minute"]


def _rollups() -> dict[str, Rollup]:
    one = F.count(F.lit(1))
    return {
        r.name: r
        for r in (
            Rollup(
                "events_throughput_1m", MOBILE_EVENTS, ("app", "env", "release", "platform", "event_type"),
                {"event_count": (one, "sum")},
            ),
            Rollup(
                "api_latency_1m", MOBILE_API_CALLS, ("app", "env", "release", "path", "method"),
                {
                    "request_count": (one, "sum"),
                    "error_count": (F.count_if(F.col("status_code") >= 400), "sum"),
                    "duration_sum": (F.sum("duration_ms"), "sum"),
                    # A maximum merges by maximum, never by adding.
                    "duration_max": (F.max("duration_ms"), "max"),
                },
                ("status_code", "duration_ms"),
                ("duration_histogram", "duration_ms"),
            ),
            Rollup(
                "error_rate_1m", MOBILE_ERRORS, ("app", "env", "release", "platform", "error_type", "error_class"),
                {"error_count": (one, "sum")},
            ),
            Rollup(
                SESSIONS_1M, MOBILE_EVENTS, ("app", "env", "release", "platform"),
                {
                    "event_count": (one, "sum"),
                    # Distinct counts do not add up, their sketches do; one holds 4 KB at most.
                    "session_sketch": (F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)), "hll_union_agg"),
                },
                ("session_id",),
            ),
        )
    }


def rollup_spec(name: str) -> Rollup:
    return _rollups()[name]


def rollup_names() -> tuple[str, ...]:
    """The rollups kept by streams. ``sessions_1m`` is rolled up on request: its sketches are large for quiet minutes."""
    return ("events_throughput_1m", "api_latency_1m", "error_rate_1m")


def roll_up(rows: DataFrame, name: str, dedup: bool = True, by: list[str] | None = None, histogram: bool = True) -> DataFrame:
    """Per-minute partial aggregate of a table. ``by`` adds grouping columns, such as a batch number.

    With ``dedup`` a redelivered event counts once; without it every delivery counts, as when
    rolling up at insert time. ``histogram=False`` leaves the histogram column out.
    """
    spec, extra = rollup_spec(name), by or []
    rows = narrow(rows, spec.source, [*spec.dims, "event_time", *spec.inputs, *extra], dedup)
    rows = rows.withColumn("minute", F.date_trunc("minute", "event_time"))
    measures = [agg.alias(m) for m, (agg, _) in spec.measures.items()]
    key = [*spec.key, *extra]
    if spec.histogram is None or not histogram:
        return rows.groupBy(*key).agg(*measures)
    column, value = spec.histogram
    counted = rows.withColumn("_bucket", H.bucket(F.col(value))).groupBy(*key, "_bucket").agg(*measures, F.count(F.lit(1)).alias("_n"))
    return _collect(counted, spec, key, column)


def _merges(spec: Rollup, columns: list[str], where: Column | None = None) -> list[Column]:
    pick = (lambda m: F.col(m)) if where is None else (lambda m: F.when(where, F.col(m)))
    return [F.call_function(merge, pick(m)).alias(m) for m, (_, merge) in spec.measures.items() if m in columns]


def _collect(counted: DataFrame, spec: Rollup, key: list[str], column: str) -> DataFrame:
    """Rows per bucket to one row per key, the buckets in a histogram."""
    return counted.groupBy(*key).agg(*_merges(spec, counted.columns), H.collected("_bucket", "_n").alias(column))


def merge_rollup(partials: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Partial rows of a rollup merged on its key (or on coarser ``by`` columns)."""
    spec = rollup_spec(name)
    key, column = by or spec.key, (spec.histogram or ("",))[0]
    if column not in partials.columns:
        return partials.groupBy(*key).agg(*_merges(spec, partials.columns))
    rows = H.entries(partials, column, [*key, *[m for m in spec.measures if m in partials.columns]])
    counted = rows.groupBy(*key, "_bucket").agg(*_merges(spec, rows.columns, F.col("_first")), F.sum("_n").alias("_n"))
    return _collect(counted, spec, key, column)


def unique_sessions(sketch: Column) -> Column:
    """Distinct sessions in a merged ``session_sketch`` of ``sessions_1m``, within ``SESSION_ERROR`` with 99.7 %."""
    return F.hll_sketch_estimate(sketch)


def rollup_percentiles(partials: DataFrame, name: str, levels: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Partial rows merged on ``by``, with the percentiles in ``levels`` (name to fraction) in place of the histogram."""
    spec = rollup_spec(name)
    key, (column, _) = by or spec.key, spec.histogram
    rows = H.entries(partials, column, [*key, *[m for m in spec.measures if m in partials.columns]])
    merged = rows.groupBy(*key).agg(
        *_merges(spec, rows.columns, F.col("_first")), H.percentiles(F.col("_bucket"), F.col("_n"), list(levels.values())).alias("_p")
    )
    return merged.select(*[c for c in merged.columns if c != "_p"], *[F.col("_p")[i].alias(n) for i, n in enumerate(levels)])
