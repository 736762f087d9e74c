"""Histograms of durations that merge by adding, with a stated error and nothing random in them.

A value is cut to whole microseconds and falls into one of 128 equal parts of its doubling; below 256
microseconds each has a bucket of its own. So the middle of a bucket is within 0.4 % of each of its values, or within
a microsecond. Buckets and their counts are whole numbers: any order and any number of partial
histograms give the same sum, and the same percentiles.

A histogram is a MAP from bucket to count. There are fewer than 15,000 buckets, 7,300 of them for positive numbers, so a histogram has a
bounded size whatever is counted in it. NULL and NaN are in no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 128  # of a doubling
UNITS = 1000  # per millisecond
MOST = 9e15  # larger values, and infinities, count as this many milliseconds
ERROR = 1 / (2 * PARTS)
TYPE = "map<int,bigint>"


def bucket(v: Column) -> Column:
    """The bucket of a number; never decreases as it grows."""
    units = F.floor(F.least(F.abs(v), F.lit(MOST)) * UNITS).cast("long")
    spare = F.greatest(F.length(F.bin(units)) - 8, F.lit(0))
    number = (spare * PARTS + F.call_function("shiftright", units, spare)).cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v), F.when(v < 0, -number).otherwise(number))


def middle(b: Column) -> Column:
    """The value that stands for all of a bucket."""
    spare = F.greatest(F.floor(F.abs(b) / PARTS) - 1, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", F.abs(b).cast("long") - spare * PARTS, spare)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), spare)
    return F.signum(b.cast("double")) * (low + (size - 1) / F.lit(2.0)) / UNITS


def percentiles(b: Column, n: Column, fractions: list[float]) -> Column:
    """An aggregate: percentiles of bucketed values, ``n`` of them per row, interpolated between neighbouring ranks.

    Its state is the counts of one group's buckets. A group without values gets NULL.
    """
    return F.percentile(middle(b), F.array(*[F.lit(p) for p in fractions]), n)


def collected(b: str, n: str) -> Column:
    """An aggregate: the histogram of rows that each have another bucket ``b`` and its count ``n``."""
    entry = F.when(F.col(b).isNotNull(), F.struct(F.col(b), F.col(n)))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def entries(df: DataFrame, histogram: str, columns: list[str]) -> DataFrame:
    """One row per bucket: ``columns``, ``_first`` (true once per row of ``df``), ``_bucket`` and ``_n``.

    Rows with an empty histogram give one row without a bucket.
    """
    rows = df.select(*columns, F.posexplode_outer(histogram).alias("_pos", "_bucket", "_n"))
    return rows.select(*columns, (F.coalesce("_pos", F.lit(0)) == 0).alias("_first"), "_bucket", "_n")


def as_text(histogram: Column) -> Column:
    """``bucket:count`` in order of buckets, comma-joined."""
    sorted_entries = F.array_sort(F.map_entries(histogram))
    return F.array_join(F.transform(sorted_entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
