"""Counting each event once: an index of the events counted so far, kept next to the tables.

``root/counted/<table>/event_day=D/batch_id=B`` holds a digest of the replace key of every event that a
micro-batch counted. The next micro-batch keeps one row per key and is anti-joined with the days it has
events of; what is left is new, and its digests are written under its own name. A micro-batch that runs
again does not look at what it wrote itself, so it finds the same events new and replaces its own files.
One stream writes the index of a table.

Without a limit events of any lateness count and the index is pruned with the tables (:func:`prune`). With
``lateness`` events older than that, by the server's clock of earlier micro-batches, are set aside in ``root/late/<table>``,
and their days can be pruned. ``root/deliveries/<table>`` has the balance of every micro-batch: received = new + duplicate + late.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appwatch.functions.scalars import as_instant, event_month
from appwatch.operators.dedup import deduplicate
from appwatch.schema import TableSpec
from appwatch.sources import tables

INDEX = "key binary, event_day int, batch_id string"
HORIZON = "received_at timestamp, batch_id string"
BALANCE = "event_type string, received bigint, new bigint, late bigint, duplicate bigint, batch_id string"


def event_key(spec: TableSpec) -> Column:
    """128 bits that stand for the replace key of a row."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in spec.sort_key]
    return F.unhex(F.md5(F.concat_ws("\u001f", *parts).cast("binary")))


def event_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def _read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows below ``path``, or none where nothing was written yet."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fs, p = tables._folder(spark, path)
    if fs.exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _write(rows: DataFrame, path: str, batch: str, *by: str) -> None:
    writer = rows.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by, "batch_id").parquet(path)


def _horizon(spark: SparkSession, path: str, batch: str) -> datetime | None:
    """The latest time of receipt before this micro-batch; the one before it has left it."""
    stream, number = batch.rsplit("-", 1)
    before = _read(spark, path, HORIZON).where(F.col("batch_id") == f"{stream}-{int(number) - 1}")
    return before.agg(F.max("received_at")).first()[0]


def admit(rows: DataFrame, spec: TableSpec, root: str, batch: str, lateness: str | None = None) -> DataFrame:
    """The rows of a micro-batch that no earlier one counted, one per key, persisted; the caller unpersists them.

    ``batch`` is the name of the micro-batch, ending in its number. ``lateness`` is an interval such as ``12 hours``.
    """
    spark = rows.sparkSession
    index, horizons = f"{root}/counted/{spec.name}", f"{root}/horizon/{spec.name}"
    timely, late = rows, rows.where("false")
    if lateness is not None:
        upto = _horizon(spark, horizons, batch)
        if upto is not None:
            too_late = F.col("event_time") < as_instant(upto) - F.expr(f"interval {lateness}")
            timely, late = rows.where(~too_late), rows.where(too_late)
    day = event_day(F.col("event_time"))
    days = timely.agg(F.min(day), F.max(day)).first()
    once = deduplicate(timely, spec).withColumn("key", event_key(spec)).withColumn("event_day", day)
    # Plain bounds, so that the days' partitions are chosen before anything is read.
    known = _read(spark, index, INDEX).where(F.col("event_day").between(F.lit(days[0]), F.lit(days[1])) & (F.col("batch_id") != batch))
    new = once.join(known.select("key", "event_day"), ["key", "event_day"], "left_anti").persist()
    _write(new.select("key", "event_day"), index, batch, "event_day")
    if lateness is not None:
        seen = rows.agg(F.max("received_at").alias("received_at"))
        held = seen if upto is None else seen.select(F.greatest("received_at", as_instant(upto)).alias("received_at"))
        _write(held, horizons, batch)
        _write(late.withColumn("event_month", event_month(F.col("event_time"))), f"{root}/late/{spec.name}", batch, "event_month")
    kind = F.col("event_type") if "event_type" in rows.columns else F.lit(spec.event_types[0])
    seen_as = [df.select(kind.alias("event_type"), F.lit(name).alias("as")) for df, name in ((rows, "received"), (new, "new"), (late, "late"))]
    counts = [F.count_if(F.col("as") == name).alias(name) for name in ("received", "new", "late")]
    balance = reduce(DataFrame.unionByName, seen_as).groupBy("event_type").agg(*counts)
    balance = balance.withColumn("duplicate", F.col("received") - F.col("new") - F.col("late"))
    _write(balance, f"{root}/deliveries/{spec.name}", batch)
    return new


def read_deliveries(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """Per micro-batch and event type: received, new, duplicate and late."""
    return _read(spark, f"{root}/deliveries/{spec.name}", BALANCE)


def read_late(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """The rows set aside for their lateness, whole."""
    return _read(spark, f"{root}/late/{spec.name}", tables._partitioned(spec.schema)).select(*spec.columns)


def prune(spark: SparkSession, root: str, spec: TableSpec, before: datetime) -> None:
    """Forget the events of days before ``before``, without reading them. Do so when their rows go from the
    tables, or when ``lateness`` keeps such events out."""
    day = before.year * 10000 + before.month * 100 + before.day
    for value, path in tables._subfolders(spark, f"{root}/counted/{spec.name}").items():
        if value.isdigit() and int(value) < day:
            tables._delete(spark, path)
