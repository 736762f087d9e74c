"""Landed batch documents and topic records, as files or streams; Kafka by options only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appwatch.operators.ingest import decode_records, explode_documents
from appwatch.schema import DOCUMENT_SCHEMA

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "value", "topic", "batch_id")])
KAFKA_FROM_START = {"startingOffsets": "earliest", "failOnDataLoss": "true"}


def write_documents(docs: DataFrame, path: str) -> None:
    """Land documents, one JSON line each, next to those already there."""
    docs.select(F.to_json(F.struct(*DOCUMENT_SCHEMA.fieldNames())).alias("value")).write.mode("append").text(path)


def parse_landed(lines: DataFrame) -> DataFrame:
    """Landed lines to documents. A line that is no document keeps its text as the body."""
    doc = F.from_json("value", DOCUMENT_SCHEMA)
    return lines.withColumn("_d", doc).select(
        *[F.col(f"_d.{c}").alias(c) for c in DOCUMENT_SCHEMA.fieldNames() if c != "body"],
        F.coalesce("_d.body", "value").alias("body"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_landed(spark.read.text(path))


def stream_documents(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files below ``path`` (which may be a glob) as a stream of documents."""
    return parse_landed(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per posted event: ``batch_id``, ``pos`` and the event's JSON text."""
    return explode_documents(read_documents(spark, path))


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Every record of a topic from the start, decoded."""
    rows = spark.read.schema(RECORD_SCHEMA).parquet(path).filter(F.col("topic") == topic)
    return decode_records(rows)


def stream_topic(spark: SparkSession, path: str, topic: str, max_files: int = 1000) -> DataFrame:
    """A topic as a stream from the start; the query's checkpoint holds the position.

    Only the topic's own folder is listed, so ``max_files`` counts files of this topic and none that are read for nothing.
    The pattern lets a stream start before its topic has a folder.
    """
    stream = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", max_files).option("basePath", path)
    return decode_records(stream.parquet(f"{path}/topic={topic}/*"))


def kafka_options(servers: str, topic: str, max_offsets: int = 1_000_000) -> dict[str, str]:
    """From the start, in micro-batches of at most ``max_offsets`` records, the first one included."""
    return {**KAFKA_FROM_START, "kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(max_offsets)}


def stream_kafka_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000) -> DataFrame:
    """The same from Kafka; needs the Kafka connector on the class path."""
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_offsets)).load()
    return decode_records(rows.selectExpr("cast(key as string) as key", "cast(value as string) as value", "topic"))


def write_topics(records: DataFrame, path: str, batch: str) -> None:
    """Topic records to files, one folder per topic and batch, so that a repeated batch replaces itself."""
    (
        records.withColumn("batch_id", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("topic", "batch_id")
        .parquet(path)
    )


def write_kafka_topics(records: DataFrame, servers: str) -> None:
    """Topic records to the Kafka topics they name; needs the Kafka connector on the class path."""
    records.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()
