"""Stored tables in buckets by event, so that keyed replacement and joins by event need no shuffle.

A bucketed table is registered in the session's catalog, which knows its buckets, with its files below a
path of one's own. All copies of an event lie in one bucket, sorted: the window that picks the latest
copy runs bucket by bucket, where it would otherwise move every row. A session that finds only the
files registers them with :func:`register`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from appwatch import schema as S
from appwatch.functions.scalars import event_month
from appwatch.operators.dedup import deduplicate

KEY = "event_id"
BUCKETS = 64


def write(rows: DataFrame, spec: S.TableSpec, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Replace ``table`` by ``rows``, by month and bucket. Choose buckets that fit a task's memory at the table's final size.

    Rows are brought to their buckets first, so each task writes few files.
    """
    rows = rows.select(*spec.columns).withColumn("event_month", event_month(rows["event_time"]))
    (
        rows.repartition(buckets, KEY)
        .write.mode("overwrite")
        .format("parquet")
        .partitionBy("event_month")
        .bucketBy(buckets, KEY)
        .sortBy(KEY, "event_time")
        .option("path", path)
        .saveAsTable(table)
    )


def register(spark: SparkSession, spec: S.TableSpec, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Make files that :func:`write` left known to a new session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, event_month INT) USING parquet PARTITIONED BY (event_month) "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}, event_time) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {table}")


def latest(spark: SparkSession, spec: S.TableSpec, table: str) -> DataFrame:
    """The latest copy of every event, without a shuffle."""
    return deduplicate(spark.table(table).select(*spec.columns), spec)
