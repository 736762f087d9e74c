"""Queries that run a stream over landed documents and read back what it wrote.

Documents derived from the driver's tables are landed as files in the shared folder; first the
original posts are ingested, then the redeliveries, by a second run on the same checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.operators import ingest
from appwatch.operators.rollups import merge_rollup, rollup_names, rollup_percentiles
from appwatch.operators.sessions import SESSION_DIMS, merge_sessions
from appwatch.plans.queries import _plain, _r, _table_sql, bucketed
from appwatch.plans.registry import query
from appwatch.plans.sql import select
from appwatch.session import scratch_path
from appwatch.sources import tables
from appwatch.sources import views as V
from appwatch.sources.documents import read_topic, stream_documents, stream_topic, write_documents, write_topics
from appwatch.streaming import pipelines, seen
from appwatch.streaming.progress import BatchLog

_runs: dict[tuple, str] = {}


def _key(spark: SparkSession, sf: str, kind: str) -> tuple:
    """What a run depends on, the events' content included: changed inputs are run anew."""
    events = V.read_table(spark, sf, "events")
    content = events.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*events.columns).cast("decimal(38,0)"))).first()
    return (spark.sparkContext.applicationId, sf, kind, *content)


def _run_once(spark: SparkSession, sf: str, kind: str, run) -> str:
    """The folder a stream wrote for these inputs; queries on the same session share one run."""
    key = _key(spark, sf, kind)
    if key not in _runs:
        root = scratch_path(spark, kind)
        landing = f"{root}/landing"
        docs = V.documents(spark, sf, defects=True)
        for delivery in (0, 1):
            write_documents(docs.filter(F.col("batch_id") % 2 == delivery), landing)
            run(stream_documents(spark, landing), root).awaitTermination()
        _runs[key] = root
    return _runs[key]


def ingested(spark: SparkSession, sf: str) -> str:
    return _run_once(spark, sf, "ingest", lambda docs, root: pipelines.ingest_documents(docs, root, f"{root}/checkpoint"))


def published(spark: SparkSession, sf: str) -> str:
    return _run_once(
        spark, sf, "publish", lambda docs, root: pipelines.publish_documents(docs, f"{root}/topics", f"{root}/checkpoint")
    )


# Accepted events, each once.
_ONCE = "ow AS (SELECT * FROM wok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_id) = 1)"
_CALLS = "oc AS (SELECT * FROM ow WHERE event_type = 'api_timing')"
_MINUTE = "date_trunc('minute', event_time) AS minute"
_WOK_TABLE = "CASE event_type WHEN 'api_timing' THEN 'mobile_api_calls' WHEN 'error' THEN 'mobile_errors' ELSE 'mobile_events' END"


@query("sink_row_counts", select(f"SELECT {_WOK_TABLE} AS table_name, app, count(*) AS n FROM wok GROUP BY ALL"))
def sink_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    root = ingested(spark, sf)
    out = None
    for spec in S.TABLES:
        rows = tables.read_stored(spark, root, spec, dedup=False).groupBy("app").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(F.lit(spec.name).alias("table_name"), "app", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_SHARED = ("event_id", "session_id", "user_id", "app", "env", "release", "platform", "event_time", "received_at", "source_ip")


@query(
    "stream_ingest",
    select(
        f"SELECT {_WOK_TABLE} AS table_name, event_id, session_id, user_id, app, env, release, platform, event_time, "
        "batch_received_at AS received_at, batch_ip AS source_ip FROM wok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_received_at DESC) = 1"
    ),
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All three tables after the stream, deduplicated: the same as a batch load."""
    root = ingested(spark, sf)
    out = None
    for spec in S.TABLES:
        rows = tables.read_stored(spark, root, spec).select(F.lit(spec.name).alias("table_name"), *_SHARED)
        out = rows if out is None else out.unionByName(rows)
    return _plain(out)


# --- topics to tables -----------------------------------------------------------------------------


_NUMBER = "cast(substring(event_id, 3) as bigint)"


def consumed(spark: SparkSession, sf: str) -> str:
    """The folder that three consumers and three counters wrote from one topic log.

    In the log one event in 23 is on the topic of another type, and after one in 29 comes a value that is no event.
    """
    key = _key(spark, sf, "consume")
    if key not in _runs:
        root = scratch_path(spark, "consume")
        log = f"{root}/topics"
        accepted, _ = ingest.accept(V.documents(spark, sf, defects=True), reject="event")
        enveloped = ingest.envelope(accepted).withColumn("event_id", F.col("event.event_id"))
        topics = F.array(*[F.lit(t) for t in S.TOPICS])
        moved = F.element_at(topics, F.array_position(topics, F.col("topic")).cast("int") % 3 + 1)
        enveloped = enveloped.withColumn("topic", F.when(F.expr(f"{_NUMBER} % 23 = 7"), moved).otherwise(F.col("topic")))
        junk = F.when(F.expr(f"{_NUMBER} % 29 = 3"), F.concat(F.lit("broken "), "event_id"))
        values = F.array_compact(F.array("value", junk))  # an event and its junk leave one pass over the documents
        for delivery in (0, 1):  # the batch number tells originals from redeliveries
            records = ingest.topic_records(enveloped.where(F.col("batch_id") % 2 == delivery), "event_id")
            write_topics(records.select("topic", "key", F.explode(values).alias("value")), log, f"delivery-{delivery}")
        with BatchLog(spark) as batches:
            queries = pipelines.consume_topics(lambda topic: stream_topic(spark, log, topic, max_files=4), root, f"{root}/consumers")
            for query_ in queries.values():
                query_.awaitTermination()
            batches.wait_for(q.id for q in queries.values())
            names = spark.createDataFrame([(str(q.id), topic) for topic, q in queries.items()], "query_id string, topic string")
            batches.table().join(names, "query_id").write.parquet(f"{root}/stream_batches")
        counters = [pipelines.count_table(spark, spec, root, f"{root}/counters/{spec.name}") for spec in S.TABLES]
        for query_ in counters:
            query_.awaitTermination()
        _runs[key] = root
    return _runs[key]


def _loaded_sql(spec: S.TableSpec, where: str) -> str:
    body = _table_sql(spec, f"lw WHERE {where}").replace("coalesce(event_data, '{}')", "coalesce(replace(event_data, ' ', ''), '{}')")
    body = body.replace("received_at", "batch_received_at AS received_at").replace("source_ip", "batch_ip AS source_ip")
    if spec is S.MOBILE_API_CALLS:
        body = body.replace("error_message", "CASE WHEN status_code >= 400 THEN 'HTTP ' || CAST(status_code AS VARCHAR) END AS error_message")
    return body.replace("SELECT ", f"SELECT '{spec.name}' AS table_name, ", 1)


_LAST = "lw AS (SELECT * FROM wok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_received_at DESC) = 1)"
_JUNKED = "n % 29 = 3"
_CAME_BY = (
    "lt AS (SELECT *, CASE WHEN n % 23 <> 7 THEN topic WHEN topic = 'mobile.events.raw' THEN 'mobile.api.raw' "
    "WHEN topic = 'mobile.api.raw' THEN 'mobile.errors.raw' ELSE 'mobile.events.raw' END AS came_by FROM wok)"
)


@query(
    "stream_topics_to_tables",
    select(
        _loaded_sql(S.MOBILE_EVENTS, "event_type IN ('app_start', 'screen_view', 'custom_event')") + " UNION ALL BY NAME "
        + _loaded_sql(S.MOBILE_API_CALLS, "event_type = 'api_timing'") + " UNION ALL BY NAME " + _loaded_sql(S.MOBILE_ERRORS, "event_type = 'error'"),
        _LAST,
    ),
)
def stream_topics_to_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that consumers of three topics wrote side by side, all columns: the same as a batch load."""
    root = consumed(spark, sf)
    out = None
    for spec in S.TABLES:
        rows = tables.read_stored(spark, root, spec).drop("event_month").withColumn("table_name", F.lit(spec.name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return _plain(out)


@query(
    "stream_topic_dead_letters",
    select(f"SELECT replace(came_by, '.raw', '.dlq') AS topic, 'unreadable' AS status, 'Invalid request body' AS reason, 'broken ' || event_id AS payload FROM lt WHERE {_JUNKED}", _CAME_BY),
)
def stream_topic_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_dead_letters(spark, consumed(spark, sf)).select("topic", "status", "reason", "payload")


@query(
    "stream_topic_counts",
    select(
        f"SELECT came_by AS topic, count(*) + count(*) FILTER ({_JUNKED}) AS read, count(*) FILTER ({_JUNKED}) AS skipped, "
        "count(*) FILTER (came_by <> topic) AS strayed FROM lt GROUP BY came_by",
        _CAME_BY,
    ),
)
def stream_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the consumers' micro-batches reported: records read, skipped as unreadable, and come by another type's topic."""
    rows = spark.read.parquet(f"{consumed(spark, sf)}/stream_batches").groupBy("topic")
    return rows.pivot("metric", ["read", "skipped", "strayed"]).agg(F.sum("value"))


@query(
    "stream_topic_rollups",
    select(
        f"SELECT app, env, release, platform, error_type, error_class, {_MINUTE}, count(*) AS error_count FROM ow WHERE event_type = 'error' GROUP BY ALL",
        _ONCE,
    ),
)
def stream_topic_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Error counts by the counter of the errors table, which other topics' consumers wrote to as well."""
    return _plain(merge_rollup(tables.read_rollup(spark, consumed(spark, sf), "error_rate_1m"), "error_rate_1m"))


@query("stream_dead_letters", select("SELECT batch_id AS document_id, pos, topic, status, reason FROM judged WHERE status <> 'ok'"))
def stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_dead_letters(spark, ingested(spark, sf)).select("document_id", "pos", "topic", "status", "reason")


@query(
    "stream_rollup",
    select(
        f"SELECT 'events_throughput_1m' AS rollup, app, env, release, platform, event_type, {_MINUTE}, count(*) AS event_count FROM ow "
        "WHERE event_type IN ('app_start', 'screen_view', 'custom_event') GROUP BY ALL UNION ALL BY NAME "
        f"SELECT 'api_latency_1m' AS rollup, app, env, release, path, method, {_MINUTE}, count(*) AS request_count, "
        "count(*) FILTER (status_code >= 400) AS error_count, round(sum(exact_ms), 6) AS duration_sum, round(max(exact_ms), 6) AS duration_max, "
        + _r("p50_ms=quantile_cont(duration_ms, 0.5)", "p95_ms=quantile_cont(duration_ms, 0.95)")
        + " FROM hc GROUP BY ALL UNION ALL BY NAME "
        f"SELECT 'error_rate_1m' AS rollup, app, env, release, platform, error_type, error_class, {_MINUTE}, count(*) AS error_count FROM ow "
        "WHERE event_type = 'error' GROUP BY ALL",
        f"{_ONCE}, {_CALLS}, {bucketed('oc')}",
    ),
)
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Partial rollups written per micro-batch, merged, with all their columns: a redelivered event counts once."""
    root = ingested(spark, sf)
    out = None
    for name in rollup_names():
        partials = tables.read_rollup(spark, root, name)
        if name == "api_latency_1m":
            merged = rollup_percentiles(partials, name, {"p50_ms": 0.5, "p95_ms": 0.95})
        else:
            merged = merge_rollup(partials, name)
        part = merged.withColumn("rollup", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return _plain(out)


@query(
    "stream_sessions",
    select(
        "SELECT session_id, " + ", ".join(f"last({d} ORDER BY event_time, event_id) AS {d}" for d in SESSION_DIMS)
        + ", min(event_time) AS started_at, max(event_time) AS ended_at, count(*) AS event_count, "
        "count(*) FILTER (event_type = 'error') AS error_count FROM ow GROUP BY session_id",
        _ONCE,
    ),
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session rows merged from what each micro-batch saw, with all their columns: a redelivered event counts once."""
    return _plain(merge_sessions(spark.read.parquet(f"{ingested(spark, sf)}/session_partials")))


_OF_TABLE = "CASE event_type WHEN 'api_timing' THEN 1 WHEN 'error' THEN 2 ELSE 0 END"


@query(
    "stream_late",
    select(
        "SELECT event_type, count(*) AS received, count(*) FILTER (copy = 0) AS new, count(*) FILTER (copy = 1 AND NOT late) AS duplicate, "
        "count(*) FILTER (copy = 1 AND late) AS late, count(*) FILTER (copy = 1 AND late) AS aside FROM "
        f"(SELECT *, event_time < max(CASE WHEN copy = 0 THEN batch_received_at END) OVER (PARTITION BY {_OF_TABLE}) - INTERVAL 12 HOUR AS late FROM wok) "
        "GROUP BY event_type"
    ),
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """The balance of a stream that sets events aside that come more than 12 hours late: received = new + duplicate + late.

    ``aside`` counts the rows that were kept apart. Redeliveries come in a micro-batch of their own.
    """
    run = lambda docs, root: pipelines.ingest_documents(docs, root, f"{root}/checkpoint", lateness="12 hours")
    root = _run_once(spark, sf, "late", run)
    out = None
    for spec in S.TABLES:
        kind = F.col("event_type") if "event_type" in spec.columns else F.lit(spec.event_types[0])
        balance = seen.read_deliveries(spark, root, spec).drop("batch_id").withColumn("aside", F.lit(0).cast("long"))
        aside = seen.read_late(spark, root, spec).select(kind.alias("event_type"), F.lit(1).cast("long").alias("aside"))
        part = balance.unionByName(aside, allowMissingColumns=True)
        out = part if out is None else out.unionByName(part)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "new", "duplicate", "late", "aside")]
    return out.groupBy("event_type").agg(*sums)


@query("verify_tables", select(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, TRUE AS present, count(*) AS n FROM wok WHERE {_WOK_TABLE} = '{n}'" for n in ("mobile_events", "mobile_api_calls", "mobile_errors"))
    + "".join(f" UNION ALL SELECT '{n}', TRUE, NULL" for n in rollup_names())
))
def verify_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rollup sizes depend on how the stream was cut into micro-batches, so only tables show theirs."""
    found = tables.verify_tables(spark, ingested(spark, sf))
    n = F.when(F.col("table_name").startswith("mobile_"), F.col("rows"))
    return found.select("table_name", "present", n.alias("n"))


@query("stream_replay_counts", select("SELECT topic, count(*) AS records, count(DISTINCT session_id) AS keys FROM wok GROUP BY 1"))
def stream_replay_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every topic replayed from its first record."""
    root = published(spark, sf)
    out = None
    for topic in S.TOPICS:
        rows = read_topic(spark, f"{root}/topics", topic).filter("readable").groupBy("topic")
        row = rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("key").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "stream_dedup",
    select("SELECT event_id, any_value(event_type) AS event_type, any_value(session_id) AS session_id, any_value(event_time) AS event_time FROM wok GROUP BY 1"),
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event id once, by a stateful stream that remembers ids for 72 hours of event time."""

    def run(docs: DataFrame, root: str):
        accepted, _ = ingest.accept(docs, reject="event")
        return pipelines.write_distinct(pipelines.distinct_events(accepted, "72 hours"), f"{root}/distinct", f"{root}/checkpoint")

    return _plain(spark.read.parquet(f"{_run_once(spark, sf, 'dedup', run)}/distinct"))


@query(
    "month_partitions",
    select(
        "SELECT 'mobile_events' AS table_name, CAST(strftime(event_time, '%Y%m') AS INTEGER) AS event_month, app, count(*) AS n, "
        "min(event_time) AS first, max(event_time) AS last FROM de GROUP BY ALL UNION ALL "
        "SELECT 'mobile_api_calls', CAST(strftime(event_time, '%Y%m') AS INTEGER), app, count(*), min(event_time), max(event_time) FROM dc GROUP BY ALL UNION ALL "
        "SELECT 'mobile_errors', CAST(strftime(event_time, '%Y%m') AS INTEGER), app, count(*), min(event_time), max(event_time) FROM dx GROUP BY ALL"
    ),
)
def month_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The tables written in their partitioned, sorted layout and read back per month."""
    root = scratch_path(spark, "layout")
    out = None
    for spec in S.TABLES:
        tables.append(tables.layout(V.table_view(spark, sf, spec), spec), root, spec.name, "load-0")
        rows = tables.read_stored(spark, root, spec).groupBy("event_month", "app")
        rows = rows.agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
        rows = rows.select(F.lit(spec.name).alias("table_name"), "event_month", "app", "n", "first", "last")
        out = rows if out is None else out.unionByName(rows)
    return _plain(out)
