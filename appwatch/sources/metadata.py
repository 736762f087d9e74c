"""Apps, API keys, alert rules and alert firings, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed columns of the metadata tables.
METADATA = {
    "apps": "id bigint, name string, created_at timestamp",
    "api_keys": "id bigint, app_id bigint, key_prefix string, key_hash string, label string, active boolean, created_at timestamp",
    "alert_rules": "id bigint, app_id bigint, name string, metric_type string, threshold decimal(14,4), window_minutes int, "
    "env string, release string, enabled boolean, created_at timestamp",
    "alert_firings": "id bigint, rule_id bigint, app_id bigint, fired_at timestamp, resolved_at timestamp, "
    "value_observed decimal(14,4), status string",
}


def metadata_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(METADATA[name])


def read_metadata(spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A metadata table from ``path/name`` or from a database given by JDBC options."""
    schema = metadata_schema(name)
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).option("dbtable", name).load()
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def append_metadata(rows: DataFrame, name: str, path: str) -> None:
    """Append rows to a metadata table, filling absent columns with NULL."""
    from pyspark.sql import functions as F

    fields = metadata_schema(name).fields
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    rows.select(*columns).write.mode("append").parquet(f"{path}/{name}")
