"""Registering apps and their default rules."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appwatch.functions.scalars import as_instant
from appwatch.schema import DEFAULT_RULES

ID_BUCKETS = 4096


def assign_ids(rows: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """Give new rows, unique by the text column ``key``, ids above the largest existing one.

    Rows are numbered inside 4096 hash buckets of ``key`` and the buckets interleave, so no task
    sees all rows. Ids are unique and the same when run again, but not without gaps.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key)), 1, 3), 16, 10).cast("long")
    base = existing.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)).cast("long")
    numbered = rows.withColumn("_bucket", bucket).withColumn("_within", within)
    new_id = base + (F.col("_within") - 1) * ID_BUCKETS + F.col("_bucket") + 1
    return numbered.select(new_id.alias("id"), *rows.columns)


def register_apps(names: DataFrame, apps: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """New app rows, whole, for the distinct names that are not registered yet; created now unless told otherwise."""
    fresh = names.select("name").distinct().join(apps.select("name"), "name", "left_anti")
    fresh = fresh.withColumn("created_at", as_instant(created_at or datetime.now(timezone.utc).replace(tzinfo=None)))
    return assign_ids(fresh, "name", apps)


def app_ids(names: DataFrame, apps: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """The row of every distinct name: the one that is there, or else the new one. A name's creation time never changes."""
    fresh = register_apps(names, apps, created_at)
    created = F.col("created_at") if "created_at" in apps.columns else F.lit(None).cast("timestamp")
    known = names.select("name").distinct().join(apps.select("id", "name", created.alias("created_at")), "name")
    return known.select(*fresh.columns).unionByName(fresh)


def default_rules(apps: DataFrame, rules: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """The three default rules for each app that has no rule at all, as whole rows with ids of their own."""
    bare = apps.select(F.col("id").alias("app_id")).join(rules.select("app_id").distinct(), "app_id", "left_anti")
    defaults = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(metric).alias("metric_type"),
                F.lit(threshold).cast("decimal(14,4)").alias("threshold"),
                F.lit(window).alias("window_minutes"),
                F.lit(env).cast("string").alias("env"),
                F.lit(None).cast("string").alias("release"),
            )
            for name, metric, threshold, window, env in DEFAULT_RULES
        ]
    )
    fresh = bare.select("app_id", F.inline(defaults)).withColumn("enabled", F.lit(True))
    fresh = fresh.withColumn("created_at", as_instant(created_at or datetime.now(timezone.utc).replace(tzinfo=None)))
    return assign_ids(fresh.withColumn("_key", F.concat_ws("|", "app_id", "name")), "_key", rules).drop("_key")
