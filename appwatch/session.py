"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    name: str = "appwatch", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None
) -> SparkSession:
    """A session with the settings this package relies on; cluster sizing stays with spark-submit.

    ``driver_memory`` matters in local mode, where the driver does all the work.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = prepare(builder.getOrCreate())
    # The virtual machine does not compile methods above 8000 bytes of code, so wider projections, such
    # as event decoding, run several times faster as separate expressions than fused into one method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


# Fixed setting: minutes, hours and months must mean the same everywhere.
SETTINGS = {"spark.sql.session.timeZone": "UTC"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings this package relies on to a session made elsewhere."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="appwatch-")
    return _local_dir


_local_dir: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; no two calls share one."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
