"""Ingest as a stream: documents to topics, documents or topics to tables, rollups and dead letters.

Each micro-batch is written under its checkpoint's id and its own number, so a micro-batch that is
run again after a failure replaces what it wrote, and nothing else; the checkpoint moves on only once all its writes are done. Rollups
and session rows are partial results per micro-batch that merge when read: they accept events of
any lateness. A redelivered event counts once: ``streaming.seen`` keeps an index of what was counted, written by
one stream per table. ``ingest_documents`` is that stream; with the consumers of topics, which append to tables side by
side, ``count_table`` reads each table and counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from appwatch import schema as S
from appwatch.operators import ingest
from appwatch.operators.mapping import to_table
from appwatch.operators.rollups import roll_up, rollup_names, rollup_spec
from appwatch.operators.sessions import session_partials
from appwatch.sources import tables
from appwatch.sources.documents import write_topics
from appwatch.streaming import seen


# Rows that a micro-batch keeps are in as many parts as their size asks for, not one for each shuffle partition: each part
# would shuffle to every partition again, and leave a file per day in the index. A stream has a session of its own; others do not see this.
BATCH_SETTINGS = {"spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true"}


def _start(df: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str, once: bool) -> StreamingQuery:
    """Start a stream; ``write`` gets each micro-batch with a name that no other checkpoint gives.

    The name holds the id that Spark keeps in the checkpoint, so it is the same when a micro-batch is
    run again, and another one for another stream or a checkpoint that was lost and begun anew.
    """
    known: list[str] = []

    def named(batch: DataFrame, number: int) -> None:
        if not known:
            for name, value in BATCH_SETTINGS.items():
                batch.sparkSession.conf.set(name, value)
            known.append(batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"])
        write(batch, f"{known[0]}-{number}")

    writer = df.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()


def append_tables(envelopes: DataFrame, root: str, batch: str) -> dict[str, DataFrame]:
    """Split envelopes by type and append the tables, every delivery of an event; returns the rows by table."""
    stored = {spec.name: to_table(envelopes, spec) for spec in S.TABLES}
    for spec in S.TABLES:
        tables.append(stored[spec.name], root, spec.name, batch)
    return stored


def append_counts(rows: DataFrame, spec: S.TableSpec, root: str, batch: str, once: bool = True, lateness: str | None = None) -> None:
    """Per-minute and session partials of a table's rows in a micro-batch.

    With ``once`` only of events that no earlier micro-batch counted; ``lateness`` sets later ones aside.
    """
    new = seen.admit(rows, spec, root, batch, lateness) if once else rows
    try:
        for name in rollup_names():
            if rollup_spec(name).source is spec:
                tables.append(roll_up(new, name, dedup=False), root, name, batch, "minute")
        none = {s.name: _no_rows(new.sparkSession, s) for s in S.TABLES if s is not spec}
        partial = session_partials(*[none.get(s.name, new) for s in S.TABLES], dedup=False)
        tables.append(partial, root, "session_partials", f"{batch}-{spec.name}", "started_at")
    finally:
        new.unpersist()


def _needed(judged: DataFrame) -> DataFrame:
    """Judged rows without the posted text of what passed: only dead letters repeat it."""
    failed = F.col("status") != "ok"
    text = {c: F.when(failed, F.col(c)) for c in ("raw", "body") if c in judged.columns}
    return judged.withColumns(text)


def _no_rows(spark: SparkSession, spec: S.TableSpec) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema])


def ingest_documents(
    docs: DataFrame, root: str, checkpoint: str, label: str = "ingest", reject: str = "event", coerce: bool = False, once: bool = True,
    count: str = "once", lateness: str | None = None,
) -> StreamingQuery:
    """Documents to tables. What fails to decode or validate goes to dead letters, payload and reason kept.

    ``count`` is ``once`` (a redelivered event counts once in rollups and sessions), ``every`` (each
    delivery counts) or ``none``. ``once`` as a flag processes what is there and ends.
    """
    if count not in ("once", "every", "none"):
        raise ValueError("count is 'once', 'every' or 'none'")

    def write(batch: DataFrame, number: str) -> None:
        judged = _needed(ingest.judge(batch, reject, coerce)).persist()  # decoded once for all the writes
        try:
            stored = append_tables(ingest.envelope(ingest.accepted_events(judged)), root, f"{label}-{number}")
            if count != "none":
                for spec in S.TABLES:
                    append_counts(stored[spec.name], spec, root, f"{label}-{number}", count == "once", lateness)
            tables.append_dead_letters(ingest.dead_letters(ingest.rejected_rows(judged)), root, f"{label}-{number}")
        finally:
            judged.unpersist()

    return _start(docs, write, checkpoint, once)


def publish_documents(
    docs: DataFrame, path: str, checkpoint: str, label: str = "publish", reject: str = "event", coerce: bool = False, once: bool = True
) -> StreamingQuery:
    """Documents to keyed topic records."""

    def write(batch: DataFrame, number: str) -> None:
        accepted, _ = ingest.accept(batch, reject, coerce)
        write_topics(ingest.topic_records(ingest.envelope(accepted)), path, f"{label}-{number}")

    return _start(docs, write, checkpoint, once)


def consume_topic(records: DataFrame, spec: S.TableSpec, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """One topic to tables; unreadable values go to the topic's dead letters with their payload.

    Events go to the table of their own type, whatever the topic they came by. Each micro-batch reports how many
    records it read, how many it skipped as unreadable, and how many came by another type's topic.
    """
    label = spec.topic.replace(".", "-")
    known = F.coalesce(F.col("readable"), F.lit(False))
    stray = known & (ingest.route_topic(F.col("event.event_type")) != spec.topic)
    counts = (F.count(F.lit(1)).alias("read"), F.count_if(~known).alias("skipped"), F.count_if(stray).alias("strayed"))

    def write(batch: DataFrame, number: str) -> None:
        batch = batch.withColumn("value", F.when(~known, F.col("value"))).persist()  # of what is readable the text is not needed again
        try:
            append_tables(batch.filter("readable"), root, f"{label}-{number}")
            letters = batch.filter("not readable").select(
                F.lit(None).cast("long").alias("batch_id"),
                F.lit(None).cast("int").alias("pos"),
                F.lit(spec.topic.replace(".raw", ".dlq")).alias("topic"),
                F.lit("unreadable").alias("status"),
                F.lit(ingest.UNREADABLE).alias("reason"),
                F.col("value").alias("payload"),
            )
            tables.append_dead_letters(letters, root, f"{label}-{number}")
        finally:
            batch.unpersist()

    return _start(records.observe("consumed", *counts), write, checkpoint, once)


def consume_topics(open_topic: Callable[[str], DataFrame], root: str, checkpoint: str, once: bool = True) -> dict[str, StreamingQuery]:
    """A consumer for each topic, side by side, with checkpoints of their own; ``open_topic`` gives a topic's decoded records."""
    return {spec.topic: consume_topic(open_topic(spec.topic), spec, root, f"{checkpoint}/{spec.topic}", once) for spec in S.TABLES}


def count_table(
    spark: SparkSession, spec: S.TableSpec, root: str, checkpoint: str, once: bool = True, lateness: str | None = None, max_files: int = 1000
) -> StreamingQuery:
    """The rows that were appended to a table, whoever did so, to rollups and sessions, each event once.

    Files of compacted months hold nothing new and are left out. Files that a repeated micro-batch replaced may be gone or
    be read again; the index knows their events.
    """
    schema = tables._partitioned(spec.schema)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("ignoreMissingFiles", "true")
    rows = reader.parquet(f"{root}/{spec.name}").where(~F.col("batch_id").startswith(tables.COMPACTED)).select(*spec.columns)

    def write(batch: DataFrame, number: str) -> None:
        append_counts(batch, spec, root, f"count-{number}", True, lateness)

    return _start(rows, write, checkpoint, once)


def distinct_events(accepted: DataFrame, lateness: str, salts: int = 16) -> DataFrame:
    """Each event id once among events posted no later than ``lateness``; state is dropped past it.

    Time is when the server received an event: clients' clocks may be far ahead, and one of them would
    make all that follows look late.

    Copies of one id are first thinned out in ``salts`` groups by where they were posted, so that an
    id with very many copies does not go through a single task.
    """
    rows = accepted.select(
        F.col("event.event_id").alias("event_id"), F.col("event.event_type").alias("event_type"),
        F.col("event.session_id").alias("session_id"), F.col("event.timestamp").alias("event_time"),
        "received_at",
        F.pmod(F.xxhash64("batch_id", "pos", "received_at", "source_ip"), F.lit(salts)).alias("_salt"),
    ).withWatermark("received_at", lateness)
    once = rows.dropDuplicatesWithinWatermark(["event_id", "_salt"]).drop("_salt").dropDuplicatesWithinWatermark(["event_id"])
    return once.drop("received_at")


# Stream state in RocksDB, off the heap, checkpointing only its changes; expired state goes with the
# next batch of data instead of in a batch of its own. Rows of state are not counted, which takes a read for every write.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def write_distinct(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    conf = rows.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        conf.set(name, value)
    try:
        writer = rows.writeStream.format("parquet").outputMode("append")
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a stream keeps the settings it was started with; others in the session keep theirs
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def minute_windows(rows: DataFrame, name: str, lateness: str) -> DataFrame:
    """The rollup as one stateful event-time window aggregate, for sinks that take updates."""
    spec = rollup_spec(name)
    measures = [agg.alias(m) for m, (agg, _) in spec.measures.items()]
    windowed = rows.withWatermark("event_time", lateness).groupBy(*spec.dims, F.window("event_time", "1 minute").alias("_w"))
    return windowed.agg(*measures).withColumn("minute", F.col("_w.start")).drop("_w")
