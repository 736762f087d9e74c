"""Keyed replacement: of several rows with the same key, the latest received stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appwatch.schema import TableSpec


def deduplicate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Latest row per replace key.

    Select the columns you need first: columns outside the key take part in breaking ties, so
    that a re-run picks the same row, and are read for it. When only key columns are there, any
    copy will do and a hash aggregate replaces the sort. Otherwise each task keeps at most one
    row per key before the shuffle, so a key with very many copies does not pile up anywhere.
    """
    key = [c for c in reversed(spec.sort_key)]  # event_id first: the sort compares it cheaply
    if "event_month" in df.columns:
        key.append("event_month")  # follows from event_time; lets month filters pass to the scan
    rest = [c for c in df.columns if c not in key]
    if not [c for c in rest if c != spec.version]:
        return df.select(*key).distinct() if not rest else df.groupBy(*key).agg(F.max(spec.version).alias(spec.version))
    order = [F.col(spec.version).desc()] + [F.col(c).desc() for c in rest if c != spec.version]
    newest = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(newest)).filter("_copy = 1").drop("_copy")


def narrow(df: DataFrame, spec: TableSpec, columns: tuple[str, ...] | list[str], dedup: bool = True) -> DataFrame:
    """The wanted columns of a table, deduplicated on its full key unless told otherwise."""
    wanted = list(dict.fromkeys(columns))
    if not dedup:
        return df.select(*wanted)
    key = [*spec.sort_key, *[c for c in df.columns if c == "event_month"]]
    needed = list(dict.fromkeys([*key, *wanted]))
    if [c for c in needed if c not in key] and spec.version not in needed:
        needed.append(spec.version)
    return deduplicate(df.select(*needed), spec).select(*wanted)
