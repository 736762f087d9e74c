"""Stored telemetry tables: month partitions, idempotent appends, retention and compaction.

A table is Parquet below ``root/name/event_month=M/batch_id=B``. A batch that is written again
replaces itself. Compaction (:func:`settle`) keeps one deduplicated, sorted ``compact-`` piece per day and later takes up
only the days that new batches touch; a month of such pieces needs no deduplication when read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appwatch import schema as S
from appwatch.functions.scalars import as_instant, event_month
from appwatch.operators.dedup import deduplicate, narrow
from appwatch.operators.rollups import rollup_names, rollup_spec
from appwatch.operators.sessions import merge_sessions

COMPACTED = "compact-"


def _partitioned(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("event_month", T.IntegerType()), T.StructField("batch_id", T.StringType())])


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in whatever storage it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _subfolders(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition value to path of the partition folders directly below ``path``."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return {}
    dirs = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    return {d.getName().split("=", 1)[1]: d.toString() for d in dirs if "=" in d.getName()}


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def months(spark: SparkSession, root: str, name: str) -> list[int]:
    return sorted(int(m) for m in _subfolders(spark, f"{root}/{name}"))


def batches(spark: SparkSession, root: str, name: str, month: int) -> list[str]:
    return sorted(_subfolders(spark, f"{root}/{name}/event_month={month}"))


# --- writing ---------------------------------------------------------------------------------


def layout(rows: DataFrame, spec: S.TableSpec) -> DataFrame:
    """Rows ranged and sorted by month and sort key, for files that readers can skip.

    Ranges end in the event id, so an app or month with very many rows spreads over many files.
    """
    rows = rows.withColumn("event_month", event_month(F.col("event_time")))
    order = ["event_month", *spec.sort_key]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def append(rows: DataFrame, root: str, name: str, batch: str, time_column: str = "event_time") -> None:
    if "event_month" not in rows.columns:
        rows = rows.withColumn("event_month", event_month(F.col(time_column)))
    (
        rows.withColumn("batch_id", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_month", "batch_id")
        .parquet(f"{root}/{name}")
    )


def append_dead_letters(letters: DataFrame, root: str, batch: str) -> None:
    (
        letters.withColumnRenamed("batch_id", "document_id")
        .withColumn("batch_id", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(f"{root}/dead_letters")
    )


# --- reading ---------------------------------------------------------------------------------


def read_stored(
    spark: SparkSession, root: str, spec: S.TableSpec, columns: list[str] | None = None, dedup: bool = True
) -> DataFrame:
    """A stored table, whole or in the named columns, plus ``event_month``.

    With ``dedup`` the latest row per key is read and compacted months skip the work; name the
    columns then, since all that are read take part in it. Filters on key columns and on
    ``event_month`` still reach the scan. The dashboard operators deduplicate by themselves unless
    told otherwise, and do so after filtering.
    """
    rows = spark.read.schema(_partitioned(spec.schema)).parquet(f"{root}/{spec.name}")
    wanted = [*(columns or spec.columns), "event_month"]
    if not dedup:
        return rows.select(*wanted)
    clean = [m for m in months(spark, root, spec.name) if _is_clean(spark, root, spec.name, m)]
    rest = narrow(rows.filter(~F.col("event_month").isin(clean)), spec, wanted)
    return rest.unionByName(rows.filter(F.col("event_month").isin(clean)).select(*wanted)) if clean else rest


def _day_of(batch: str) -> str | None:
    """The day a compacted piece holds, empty for one of a whole month, None for other batches."""
    if not batch.startswith(COMPACTED):
        return None
    day = batch[len(COMPACTED) :].split("-", 1)[0]
    return day if len(day) == 8 and day.isdigit() else ""


def _is_clean(spark: SparkSession, root: str, name: str, month: int) -> bool:
    """Only compacted pieces, and no day twice."""
    days = [_day_of(b) for b in batches(spark, root, name, month)]
    return bool(days) and None not in days and len(set(days)) == len(days) and ("" not in days or len(days) == 1)


def read_rollup(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Partial rows of a rollup; merge them before use."""
    types = {f.name: f.dataType for spec in S.TABLES for f in spec.schema}
    spec = rollup_spec(name)
    fields = [T.StructField(d, types[d]) for d in spec.dims] + [T.StructField("minute", T.TimestampType())]
    kinds = {"duration_sum": T.DoubleType(), "duration_max": T.DoubleType(), "session_sketch": T.BinaryType()}
    fields += [T.StructField(m, kinds.get(m, T.LongType())) for m in spec.measures]
    if spec.histogram:
        fields.append(T.StructField(spec.histogram[0], T.MapType(T.IntegerType(), T.LongType())))
    return spark.read.schema(_partitioned(T.StructType(fields))).parquet(f"{root}/{name}")


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/dead_letters")


# --- upkeep ----------------------------------------------------------------------------------


def rewrite_month(spark: SparkSession, root: str, spec: S.TableSpec, month: int, newer_than: datetime | None = None) -> None:
    """Replace a month's batches by one deduplicated, sorted batch, optionally without old rows.

    The new batch is complete before the old ones go. If the job dies in between, rows are there
    twice, which reading with deduplication does not show, and running it again finishes the work.
    Batches that arrive meanwhile are left alone.
    """
    old = {b: p for b, p in _subfolders(spark, f"{root}/{spec.name}/event_month={month}").items()}
    rows = spark.read.schema(_partitioned(spec.schema)).parquet(f"{root}/{spec.name}")
    rows = rows.filter((F.col("event_month") == month) & F.col("batch_id").isin(list(old)))
    rows = deduplicate(rows.select(*spec.columns), spec)
    if newer_than is not None:
        rows = rows.filter(unexpired(newer_than))
    append(layout(rows, spec), root, spec.name, f"{COMPACTED}{uuid.uuid4().hex}")
    for path in old.values():
        _delete(spark, path)


def _paths(spark: SparkSession, root: str, spec: S.TableSpec, paths: list[str]) -> DataFrame:
    """The rows of some batches only; others are not looked at."""
    reader = spark.read.schema(_partitioned(spec.schema)).option("basePath", f"{root}/{spec.name}")
    return reader.parquet(*paths).select(*spec.columns)


def _write_days(rows: DataFrame, root: str, spec: S.TableSpec) -> None:
    """Rows, ranged and sorted, as one compacted piece per day."""
    piece = F.concat(F.lit(COMPACTED), F.date_format("event_time", "yyyyMMdd"), F.lit(f"-{uuid.uuid4().hex}"))
    (
        layout(rows, spec)
        .withColumn("batch_id", piece)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_month", "batch_id")
        .parquet(f"{root}/{spec.name}")
    )


def settle(spark: SparkSession, root: str, spec: S.TableSpec, month: int) -> list[str]:
    """Merge the batches of a month that came since into the pieces of the days they touch; returns these days.

    Pieces of other days are neither read nor written. The new pieces are complete before the old
    ones and the batches go; dying in between leaves rows twice, which reading with deduplication does not
    show and the next run mends. Batches that arrive meanwhile are left for the next run.
    """
    found = _subfolders(spark, f"{root}/{spec.name}/event_month={month}")
    loose = [p for b, p in found.items() if _day_of(b) is None]
    of_day: dict[str, list[str]] = {}
    for b, p in found.items():
        if _day_of(b):
            of_day.setdefault(_day_of(b), []).append(p)
    whole = [p for b, p in found.items() if _day_of(b) == ""]
    doubled = [p for paths in of_day.values() if len(paths) > 1 for p in paths]
    fresh = [*loose, *whole, *doubled]
    if not fresh:
        return []
    day = F.date_format("event_time", "yyyyMMdd")
    touched = sorted(r[0] for r in _paths(spark, root, spec, fresh).select(day).distinct().collect())  # a month's days
    old = list(dict.fromkeys([*fresh, *[p for d in touched for p in of_day.get(d, [])]]))
    _write_days(deduplicate(_paths(spark, root, spec, old), spec), root, spec)
    for path in old:
        _delete(spark, path)
    return touched


def unexpired(cutoff: datetime, column: str = "event_time"):
    """Rows to keep: the time, cut to whole seconds, lies after the cutoff."""
    at = as_instant(cutoff)
    return (F.col(column) > at) & (F.date_trunc("second", column) > at)


def retain_rows(rows: DataFrame, as_of: datetime, days: int = S.RETENTION_DAYS, column: str = "event_time") -> DataFrame:
    return rows.filter(unexpired(as_of - timedelta(days=days), column))


def retain(spark: SparkSession, root: str, spec: S.TableSpec, as_of: datetime, days: int = S.RETENTION_DAYS) -> None:
    """Drop expired months and, once the cutoff's month is settled, expired days without reading them; of
    the rows only those of the cutoff's own day are rewritten."""
    cutoff = as_of - timedelta(days=days)
    boundary, last = cutoff.year * 100 + cutoff.month, f"{cutoff:%Y%m%d}"
    for month in months(spark, root, spec.name):
        folder = f"{root}/{spec.name}/event_month={month}"
        if month < boundary:
            _delete(spark, folder)
        elif month == boundary:
            settle(spark, root, spec, month)
            for batch, path in _subfolders(spark, folder).items():
                if (_day_of(batch) or last) < last:
                    _delete(spark, path)
                elif _day_of(batch) == last:
                    _write_days(_paths(spark, root, spec, [path]).filter(unexpired(cutoff)), root, spec)
                    _delete(spark, path)


def read_sessions(spark: SparkSession, root: str, as_of: datetime | None = None, days: int = S.RETENTION_DAYS) -> DataFrame:
    """Session rows merged from their partials, without those that started before the retention cutoff."""
    rows = merge_sessions(spark.read.parquet(f"{root}/session_partials"))
    return rows if as_of is None else retain_rows(rows, as_of, days, "started_at")


def retain_sessions(spark: SparkSession, root: str, as_of: datetime, days: int = S.RETENTION_DAYS) -> None:
    """Drop the months of session partials that no session reaches that is still read.

    One month more than the cutoff's stays, so that sessions across its start keep their first part.
    """
    cutoff = (as_of - timedelta(days=days)).replace(day=1) - timedelta(days=1)
    for month in months(spark, root, "session_partials"):
        if month < cutoff.year * 100 + cutoff.month:
            _delete(spark, f"{root}/session_partials/event_month={month}")


def verify_tables(spark: SparkSession, root: str) -> DataFrame:
    """Presence, row count and column count of every expected table and rollup."""
    out = None
    for name in (*[t.name for t in S.TABLES], *rollup_names()):
        try:
            stored = spark.read.parquet(f"{root}/{name}")
            row = stored.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table_name"), F.lit(True).alias("present"), "rows", F.lit(len(stored.columns)).alias("columns")
            )
        except AnalysisException:
            row = spark.range(1).select(
                F.lit(name).alias("table_name"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("rows"), F.lit(0).alias("columns")
            )
        out = row if out is None else out.unionByName(row)
    return out


def require_tables(spark: SparkSession, root: str) -> None:
    absent = [n for n in (*[t.name for t in S.TABLES], *rollup_names()) if not _subfolders(spark, f"{root}/{n}")]
    if absent:
        raise ValueError("missing tables: " + ", ".join(absent))
