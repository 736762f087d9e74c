"""Grouped percentiles: approximate in one pass, or exact without gathering a group in one task.

The exact form counts equal values first, cuts each group into narrow value bands, finds the bands
that hold the wanted ranks from the per-band counts alone, and orders only the values of those
bands. A group holding a third of all rows is therefore spread over its bands, and what any one
task orders is the distinct values of one band.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS_PER_DOUBLING = 1024
APPROX_ACCURACY = 10_000


def value_band(v: Column) -> Column:
    """A band number that never decreases as ``v`` grows; about 0.07 % wide for ``|v|`` above 1."""
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * BANDS_PER_DOUBLING)


def group_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    levels: dict[str, float],
    counts: dict[str, Column] | None = None,
    weight: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Per group: the percentiles in ``levels`` (name to fraction) and sums of the numbers in ``counts``.

    NULL and NaN values do not enter a percentile but their rows do enter ``counts``; a group
    without values gets NULL. ``weight`` is a repeat count per row and needs ``exact``.
    Exact results interpolate linearly between neighbouring ranks.
    """
    counts = counts or {}
    v = F.col(value).cast("double")
    rows = df.select(
        *keys,
        F.when(~F.isnan(v), v).alias("_v"),
        (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"),
        *[c.alias(n) for n, c in counts.items()],
    )
    if exact:
        return _exact(rows, keys, levels, list(counts))
    if weight:
        raise ValueError("weights need exact=True")
    return rows.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in counts],
        F.percentile_approx("_v", list(levels.values()), APPROX_ACCURACY).alias("_p"),
    ).select(*keys, *counts, *[F.col("_p")[i].alias(n) for i, n in enumerate(levels)])


def _exact(rows: DataFrame, keys: list[str], levels: dict[str, float], counts: list[str]) -> DataFrame:
    # A constant key stands in for a global percentile.
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))

    values = (
        rows.withColumn("_band", value_band(F.col("_v")))
        .groupBy(*by, "_band", "_v")
        .agg(F.sum("_w").alias("_n"), *[F.sum(c).alias(c) for c in counts])
    )
    bands = values.groupBy(*by, "_band").agg(
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).alias("_n"),
        *[F.sum(c).alias(c) for c in counts],
    )
    group = Window.partitionBy(*by)
    running = group.orderBy("_band")
    bands = bands.select(
        *by,
        "_band",
        "_n",
        F.row_number().over(running).alias("_first"),
        F.coalesce(F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
        *[F.sum(c).over(group).alias(c) for c in counts],
    )

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    def holds(r: Column) -> Column:
        return (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))

    # The first band of a group stays in any case, so that groups without values keep their counts.
    wanted = [holds(f(rank(p))) for p in levels.values() for f in (F.floor, F.ceil)]
    bands = bands.filter(reduce(or_, wanted, F.col("_first") == 1)).drop("_n")

    b, c = bands.alias("b"), values.select(*by, "_band", "_v", "_n").alias("c")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_band"]]
    ordered = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.join(b, same).select(
        *[F.col(f"c.{k}").alias(k) for k in [*by, "_band"]],
        "_v",
        F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0).alias("_n"),
        "_before",
        "_total",
        *[F.col(f"b.{n}").alias(n) for n in counts],
    )
    ranked = ranked.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(ordered), F.lit(0)))

    picks = []
    for n, p in levels.items():
        picks.append(F.max(F.when(holds(F.floor(rank(p))), F.col("_v"))).alias(f"_lo_{n}"))
        picks.append(F.max(F.when(holds(F.ceil(rank(p))), F.col("_v"))).alias(f"_hi_{n}"))
    out = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *[F.max(n).alias(n) for n in counts], *picks)
    return out.select(
        *keys,
        *counts,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank(p) - F.floor(rank(p)))).alias(n)
            for n, p in levels.items()
        ],
    )
