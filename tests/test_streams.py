from __future__ import annotations

import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions.histograms import as_text
from appwatch.operators import ingest
from appwatch.operators.mapping import to_table
from appwatch.operators.rollups import merge_rollup, roll_up
from appwatch.operators.sessions import build_sessions, merge_sessions
from appwatch.sources import tables
from appwatch.sources import views as V
from appwatch.sources.documents import kafka_options, read_batches, read_topic, stream_documents, stream_topic
from appwatch.streaming import pipelines, seen
from appwatch.streaming.progress import BatchLog


@pytest.fixture(scope="module")
def landed(spark, small, tmp_path_factory):
    """Eight files of documents in time order, the third one delivered twice, a late event, two broken lines."""
    folder = tmp_path_factory.mktemp("landed")
    docs = V.documents(spark, small).orderBy("batch_id")
    lines = [r[0] for r in docs.select(F.to_json(F.struct(*S.DOCUMENT_SCHEMA.fieldNames()))).collect()]
    size = -(-len(lines) // 8)
    files = [lines[i * size : (i + 1) * size] for i in range(8)]
    again = [json.dumps({**json.loads(line), "received_at": "2024-01-05T00:00:00.000Z"}) for line in files[2]]
    late = {"event_id": "late-1", "event_type": "screen_view", "session_id": "s-late", "app_name": "demo-app", "app_version": "1", "platform": "ios",
            "timestamp": "2023-12-31T00:00:30Z", "screen_name": "HomeScreen"}
    late_doc = json.dumps({"batch_id": 10_000, "api_key": "k", "source_ip": "10.1.1.1", "received_at": "2024-01-05T00:00:00Z", "body": json.dumps({"events": [late]})})
    for i, content in enumerate([*files, again, [late_doc], ["not a document", '{"batch_id": 7, "body": "oops"}']]):
        path = folder / f"part-{i:02d}.txt"
        path.write_text("\n".join(content) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def batch_tables(spark, landed):
    from appwatch.sources.documents import read_documents

    accepted, rejected = ingest.accept(read_documents(spark, landed), reject="event")
    env = ingest.envelope(accepted)
    return {s.name: to_table(env, s) for s in S.TABLES}, rejected


@pytest.fixture(scope="module")
def streamed(spark, landed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("streamed"))
    query = pipelines.ingest_documents(stream_documents(spark, landed, max_files=3), root, f"{root}/checkpoint")
    query.awaitTermination()
    return root


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    a, b = a.select(*columns), b.select(*columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch(spark, landed, streamed):
    from appwatch.operators.dedup import deduplicate

    want, _ = batch_tables(spark, landed)
    for spec in S.TABLES:
        assert len(tables.batches(spark, streamed, spec.name, 202401)) > 1
        same(tables.read_stored(spark, streamed, spec).drop("event_month"), deduplicate(want[spec.name], spec))
        same(tables.read_stored(spark, streamed, spec, dedup=False).drop("event_month"), want[spec.name])


def test_streamed_rollups_equal_batch(spark, landed, streamed):
    want, _ = batch_tables(spark, landed)
    for name, source in (("events_throughput_1m", "mobile_events"), ("error_rate_1m", "mobile_errors")):
        same(merge_rollup(tables.read_rollup(spark, streamed, name), name), roll_up(want[source], name))
    late = tables.read_rollup(spark, streamed, "events_throughput_1m").filter("minute = '2023-12-31 00:00:00'")
    assert [r.event_count for r in late.collect()] == [1]
    got = merge_rollup(tables.read_rollup(spark, streamed, "api_latency_1m"), "api_latency_1m")
    direct = roll_up(want["mobile_api_calls"], "api_latency_1m")
    text = as_text(F.col("duration_histogram")).alias("durations")
    kept = [c for c in direct.columns if c not in ("duration_sum", "duration_histogram")]
    same(got.select(*kept, text), direct.select(*kept, text))


def test_streamed_sessions_equal_batch(spark, landed, streamed):
    want, _ = batch_tables(spark, landed)
    got = merge_sessions(spark.read.parquet(f"{streamed}/session_partials"))
    same(got, build_sessions(want["mobile_events"], want["mobile_api_calls"], want["mobile_errors"]))


def test_the_index_gets_a_file_per_day_not_per_shuffle_partition(streamed):
    """What a micro-batch keeps is cached in as many parts as its size asks for."""
    for spec in S.TABLES:
        parts = glob.glob(f"{streamed}/counted/{spec.name}/event_day=*/batch_id=*")
        assert parts and all(len(glob.glob(f"{p}/*.parquet")) == 1 for p in parts)


def test_the_text_of_accepted_events_is_not_cached(spark, landed):
    from appwatch.sources.documents import read_documents

    judged = ingest.judge(read_documents(spark, landed), "event")
    kept = pipelines._needed(judged)
    assert kept.filter("status = 'ok'").count() > 0 and kept.filter("status = 'ok' and (raw is not null or body is not null)").count() == 0
    same(ingest.dead_letters(ingest.rejected_rows(kept)), ingest.dead_letters(ingest.rejected_rows(judged)))
    same(ingest.envelope(ingest.accepted_events(kept)), ingest.envelope(ingest.accepted_events(judged)))


def test_broken_lines_become_dead_letters(spark, streamed):
    letters = tables.read_dead_letters(spark, streamed).collect()
    assert sorted((r.document_id, r.payload, r.status) for r in letters if r.document_id is not None) == [(7, "oops", "unreadable")]
    assert [r.payload for r in letters if r.document_id is None] == ["not a document"]


def test_a_repeated_micro_batch_replaces_itself(spark, landed, tmp_path):
    """A micro-batch whose commit is missing runs again from the same checkpoint: nothing doubles."""
    lake, checkpoint = str(tmp_path / "lake"), tmp_path / "checkpoint"
    start = lambda: pipelines.ingest_documents(stream_documents(spark, landed, max_files=3), lake, str(checkpoint)).awaitTermination()
    start()
    before = sorted(tables.read_stored(spark, lake, S.MOBILE_ERRORS, dedup=False).select("event_id").collect())
    batches = tables.batches(spark, lake, "mobile_errors", 202401)
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    start()
    assert tables.batches(spark, lake, "mobile_errors", 202401) == batches
    assert sorted(tables.read_stored(spark, lake, S.MOBILE_ERRORS, dedup=False).select("event_id").collect()) == before


def test_two_streams_share_a_lake(spark, landed, tmp_path):
    """Streams with checkpoints of their own do not overwrite each other."""
    lake = str(tmp_path / "lake")
    for name in ("one", "two"):
        pipelines.ingest_documents(stream_documents(spark, landed), lake, str(tmp_path / name)).awaitTermination()
    want, _ = batch_tables(spark, landed)
    assert tables.read_stored(spark, lake, S.MOBILE_ERRORS, dedup=False).count() == 2 * want["mobile_errors"].count()


def test_events_on_the_wrong_topic_reach_their_table(spark, landed, tmp_path):
    root, topics = str(tmp_path / "t"), str(tmp_path / "topics")
    pipelines.publish_documents(stream_documents(spark, landed), topics, f"{root}/c0").awaitTermination()
    want, _ = batch_tables(spark, landed)
    moved = spark.read.parquet(f"{topics}/topic={S.TOPIC_ERRORS}").select("key", "value")
    moved.selectExpr("*", f"'{S.TOPIC_API}' as topic", "'moved' as batch_id").write.partitionBy("topic", "batch_id").mode("append").parquet(topics)
    spec = S.MOBILE_API_CALLS
    pipelines.consume_topic(stream_topic(spark, topics, spec.topic), spec, root, f"{root}/c1").awaitTermination()
    same(tables.read_stored(spark, root, spec, dedup=False).drop("event_month"), want["mobile_api_calls"])
    same(tables.read_stored(spark, root, S.MOBILE_ERRORS, dedup=False).drop("event_month"), want["mobile_errors"])


def test_nothing_new_means_nothing_written(spark, landed, streamed):
    before = tables.batches(spark, streamed, "mobile_errors", 202401)
    pipelines.ingest_documents(stream_documents(spark, landed, max_files=3), streamed, f"{streamed}/checkpoint").awaitTermination()
    assert tables.batches(spark, streamed, "mobile_errors", 202401) == before


def test_topics_and_consumers(spark, landed, tmp_path):
    root, topics = str(tmp_path / "t"), str(tmp_path / "topics")
    pipelines.publish_documents(stream_documents(spark, landed), topics, f"{root}/c0").awaitTermination()
    want, _ = batch_tables(spark, landed)
    junk = spark.createDataFrame([("s", "junk", "mobile.errors.raw", "x")], "key string, value string, topic string, batch_id string")
    junk.write.partitionBy("topic", "batch_id").mode("append").parquet(topics)
    assert read_topic(spark, topics, S.TOPIC_API).count() == want["mobile_api_calls"].count()
    for spec in S.TABLES:
        pipelines.consume_topic(stream_topic(spark, topics, spec.topic), spec, root, f"{root}/c-{spec.name}").awaitTermination()
        same(tables.read_stored(spark, root, spec, dedup=False).drop("event_month"), want[spec.name])
    letters = tables.read_dead_letters(spark, root).collect()
    assert [(r.topic, r.payload) for r in letters] == [("mobile.errors.dlq", "junk")]
    for spec in S.TABLES:
        pipelines.count_table(spark, spec, root, f"{root}/n-{spec.name}").awaitTermination()
    tables.require_tables(spark, root)
    same(merge_rollup(tables.read_rollup(spark, root, "error_rate_1m"), "error_rate_1m"), roll_up(want["mobile_errors"], "error_rate_1m"))


def test_distinct_events(spark, landed, tmp_path):
    root = str(tmp_path)
    accepted, _ = ingest.accept(stream_documents(spark, landed, max_files=2), reject="event")
    pipelines.write_distinct(pipelines.distinct_events(accepted, "30 days"), f"{root}/d", f"{root}/c").awaitTermination()
    want, _ = batch_tables(spark, landed)
    ids = want["mobile_events"].select("event_id").union(want["mobile_api_calls"].select("event_id")).union(want["mobile_errors"].select("event_id"))
    same(spark.read.parquet(f"{root}/d").select("event_id"), ids.distinct())


def test_rows_of_state_are_not_counted(spark, landed, tmp_path):
    """Counting them takes a read of the state for every write."""
    accepted, _ = ingest.accept(stream_documents(spark, landed), reject="event")
    query = pipelines.write_distinct(pipelines.distinct_events(accepted, "30 days"), f"{tmp_path}/d", f"{tmp_path}/c")
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p.stateOperators]
    assert sum(s.numRowsUpdated for s in states) > 0 and {s.numRowsTotal for s in states} == {0}


def test_windowed_rollup_in_update_mode(spark, streamed, tmp_path):
    stored = f"{streamed}/mobile_errors"
    schema = spark.read.parquet(stored).schema
    rows = pipelines.minute_windows(spark.readStream.schema(schema).parquet(stored), "error_rate_1m", "7 days")
    query = rows.writeStream.outputMode("complete").format("memory").queryName("minute_errors").trigger(availableNow=True).start()
    query.awaitTermination()
    direct = roll_up(spark.read.parquet(stored), "error_rate_1m", dedup=False)
    same(spark.table("minute_errors"), direct)


def test_batches_read_one_row_per_event(spark, landed):
    rows = read_batches(spark, landed)
    assert {"batch_id", "pos", "raw"} <= set(rows.columns)
    want, _ = batch_tables(spark, landed)
    assert rows.count() == sum(t.count() for t in want.values())


def error_rows(spark, ids, day, received="2024-01-10 00:00:00"):
    rows = [{"event_id": i, "app": "a", "env": "prod", "error_class": "E", "event_time": f"2024-01-{day:02d} 00:00:0{k % 10}", "received_at": received} for k, i in enumerate(ids)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))
    spec = S.MOBILE_ERRORS
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema])


def test_events_are_admitted_once(spark, tmp_path):
    root, spec = str(tmp_path), S.MOBILE_ERRORS
    admitted = lambda rows, batch, **kw: sorted(r.event_id for r in seen.admit(rows, spec, root, batch, **kw).collect())
    first = error_rows(spark, ["a", "b", "c"], 5)
    assert admitted(first.union(first), "s-0") == ["a", "b", "c"]
    again = error_rows(spark, ["a", "b", "c"], 5, "2024-01-11 00:00:00").union(error_rows(spark, ["d", "a"], 6))
    assert admitted(again, "s-1") == ["a", "d"]  # the same id at another time is another event
    assert admitted(again, "s-1") == ["a", "d"]  # run again after a failure: the same events are new
    assert admitted(again, "s-2") == []
    assert admitted(first.where("false"), "s-3") == []
    balance = {r.batch_id: (r.received, r.new, r.duplicate, r.late) for r in seen.read_deliveries(spark, root, spec).collect()}
    assert balance == {"s-0": (6, 3, 3, 0), "s-1": (5, 2, 3, 0), "s-2": (5, 0, 5, 0)}


def test_late_events_are_set_aside_whole(spark, tmp_path):
    root, spec = str(tmp_path), S.MOBILE_ERRORS
    seen.admit(error_rows(spark, ["a"], 9, "2024-01-10 00:00:00"), spec, root, "s-0", "2 days")
    mixed = error_rows(spark, ["old"], 7).union(error_rows(spark, ["a"], 9)).union(error_rows(spark, ["new"], 8))
    new = seen.admit(mixed, spec, root, "s-1", "2 days")
    assert [r.event_id for r in new.collect()] == ["new"]
    late = seen.read_late(spark, root, spec)
    same(late, error_rows(spark, ["old"], 7))
    seen.admit(error_rows(spark, ["b"], 8, "2024-01-09 00:00:00"), spec, root, "s-2", "2 days")  # the clock does not go back
    assert seen._horizon(spark, f"{root}/horizon/{spec.name}", "s-3").day == 10


def test_only_the_days_of_the_batch_are_read_from_the_index(spark, tmp_path):
    root, spec = str(tmp_path), S.MOBILE_ERRORS
    for day in (3, 4, 5, 6):
        seen.admit(error_rows(spark, ["a", "b"], day), spec, root, f"s-{day}")
    new = seen.admit(error_rows(spark, ["a", "c"], 4), spec, root, "s-7")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_day" in plan[plan.index("PartitionFilters") :]
    assert [r.event_id for r in new.collect()] == ["c"]
    seen.prune(spark, root, spec, datetime(2024, 1, 5))
    assert sorted(tables._subfolders(spark, f"{root}/counted/{spec.name}")) == ["20240105", "20240106"]


def test_consumers_report_each_micro_batch(spark, landed, tmp_path):
    root, topics = str(tmp_path / "t"), str(tmp_path / "topics")
    pipelines.publish_documents(stream_documents(spark, landed, max_files=3), topics, f"{root}/c0").awaitTermination()
    junk = spark.createDataFrame([("s", "junk", "mobile.errors.raw", "x")], "key string, value string, topic string, batch_id string")
    junk.write.partitionBy("topic", "batch_id").mode("append").parquet(topics)
    want, _ = batch_tables(spark, landed)
    with BatchLog(spark) as log:
        queries = pipelines.consume_topics(lambda t: stream_topic(spark, topics, t, max_files=2), root, f"{root}/c")
        for q in queries.values():
            q.awaitTermination()
        log.wait_for(q.id for q in queries.values())
        rows = log.table().collect()
    assert len({(r.query_id, r.batch) for r in rows}) > 3  # bounded triggers: several micro-batches
    for spec in S.TABLES:
        total = {m: sum(r.value for r in rows if r.query_id == str(queries[spec.topic].id) and r.metric == m) for m in ("read", "skipped", "strayed")}
        bad = int(spec is S.MOBILE_ERRORS)
        assert total == {"read": want[spec.name].count() + bad, "skipped": bad, "strayed": 0}
    log.save(f"{root}/stream_batches")
    assert spark.read.parquet(f"{root}/stream_batches").count() == len(rows) and log.table().count() == 0


def test_a_trigger_counts_files_of_its_own_topic(spark, tmp_path):
    """Files of other topics take no place in a micro-batch, and a topic without a record yet is an empty stream."""
    topics = str(tmp_path / "topics")
    for i in range(6):
        record = spark.createDataFrame([("s", "junk", S.TOPIC_API if i % 3 else S.TOPIC_ERRORS, f"b-{i}")], "key string, value string, topic string, batch_id string")
        record.coalesce(1).write.partitionBy("topic", "batch_id").mode("append").parquet(topics)
    for topic, most, batches in ((S.TOPIC_API, 2, 2), (S.TOPIC_ERRORS, 2, 1), (S.TOPIC_EVENTS, 2, 0)):
        got = []
        stream = stream_topic(spark, topics, topic, max_files=most)
        take = lambda batch, _: got.append([(r.topic, r.value, r.batch_id) for r in batch.collect()])
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / topic)).trigger(availableNow=True).start().awaitTermination()
        assert len(got) == batches and all(r[0] == topic for rows in got for r in rows)
        assert len({r for rows in got for r in rows}) == {S.TOPIC_API: 4, S.TOPIC_ERRORS: 2}.get(topic, 0)


def test_kafka_reads_are_bounded():
    assert kafka_options("host:9092", S.TOPIC_API, 500)["maxOffsetsPerTrigger"] == "500"
