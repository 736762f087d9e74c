from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions import scalars
from appwatch.operators import ingest
from appwatch.operators.mapping import skip_unknown, to_table

COMMON = {
    "event_id": "evt-1", "session_id": "sess-1", "app_name": "demo", "app_version": "1.0.0",
    "platform": "ios", "timestamp": "2025-01-01T00:00:00Z",
}
VIEW = {**COMMON, "event_type": "screen_view", "screen_name": "HomeScreen"}


def docs(spark, *bodies):
    rows = [(i, "k0000001-x", "10.0.0.1", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "batch_id long, api_key string, source_ip string, body string")
    return df.withColumn("received_at", F.lit("2025-01-01 00:00:05").cast("timestamp"))


def verdicts(spark, *bodies, coerce=False):
    rows = ingest.classify_batches(docs(spark, *bodies), coerce).select("batch_id", "status", "errors").collect()
    return [(r.status, r.errors) for r in sorted(rows)]


def without(event, *names):
    return {k: v for k, v in event.items() if k not in names}


def test_literal_documents(spark):
    start = {**COMMON, "event_type": "app_start"}
    got = verdicts(
        spark,
        {"events": [without(start, "event_id")]},
        {"events": [{**start, "event_type": "unknown_type"}]},
        {"events": []},
        {"events": [VIEW]},
        "not json",
        {"events": None},
        {},
        '{"events": [',
    )
    assert got == [
        ("invalid", ["events[0].eventId: must not be blank"]),
        ("unreadable", [ingest.UNREADABLE]),
        ("invalid", [ingest.EMPTY_BATCH]),
        ("ok", []),
        ("unreadable", [ingest.UNREADABLE]),
        ("invalid", [ingest.EMPTY_BATCH]),
        ("invalid", [ingest.EMPTY_BATCH]),
        ("unreadable", [ingest.UNREADABLE]),
    ]


def test_required_fields_per_type(spark):
    cases = {
        "screen_view": ["screenName"],
        "api_timing": ["method", "path"],
        "error": ["errorType", "errorClass", "errorMessage"],
        "custom_event": ["eventName"],
        "app_start": [],
    }
    got = verdicts(spark, *[{"events": [{**COMMON, "event_type": t}]} for t in cases])
    assert [e for _, e in got] == [[f"events[0].{f}: must not be blank" for f in fields] for fields in cases.values()]


def test_missing_type_and_blank_fields(spark):
    got = verdicts(
        spark,
        {"events": [without(VIEW, "event_type") | {"screen_name": "x"}]},
        {"events": [{**VIEW, "app_name": "  ", "platform": ""}]},
        {"events": [without(VIEW, "timestamp")]},
        {"events": [{**VIEW, "timestamp": "2025-01-01 00:00:00"}]},
    )
    assert got[0][0] == "unreadable"
    assert got[1] == ("invalid", ["events[0].appName: must not be blank", "events[0].platform: must not be blank"])
    assert got[2] == ("invalid", ["events[0].timestamp: must not be null"])
    assert got[3][0] == "unreadable"


def test_one_bad_event_refuses_the_document_or_only_itself(spark):
    d = docs(spark, {"events": [VIEW, without(VIEW, "session_id"), VIEW]})
    good, bad = ingest.accept(d, reject="batch")
    assert (good.count(), bad.count()) == (0, 1)
    good, bad = ingest.accept(d, reject="event")
    assert [r.pos for r in good.orderBy("pos").collect()] == [0, 2]
    letter = ingest.dead_letters(bad).first()
    assert (letter.pos, letter.status, letter.reason) == (1, "invalid", "events[1].sessionId: must not be blank")
    assert json.loads(letter.payload)["event_id"] == "evt-1"


def test_nothing_posted_is_lost(spark):
    d = docs(spark, {"events": [VIEW, {**VIEW, "event_type": "x"}]}, "oops", {"events": []}, {"events": [None, VIEW]})
    good, bad = ingest.accept(d, reject="event")
    assert good.count() + bad.count() == 2 + 1 + 1 + 2


def test_numbers_may_be_quoted_and_bad_ones_are_unreadable(spark):
    call = {**COMMON, "event_type": "api_timing", "method": "GET", "path": "/x"}
    d = docs(
        spark,
        {"events": [{**call, "status_code": "503", "duration_ms": "12.5", "request_size": 9007199254740993}]},
        {"events": [{**call, "status_code": "many"}]},
        {"events": [call]},
    )
    good, bad = ingest.accept(d)
    rows = to_table(ingest.envelope(good), S.MOBILE_API_CALLS).orderBy("status_code").collect()
    assert [(r.status_code, r.duration_ms, r.request_size) for r in rows] == [(0, 0.0, None), (503, 12.5, 9007199254740993)]
    assert [r.status for r in bad.collect()] == ["unreadable"]


def test_poison_values_do_not_stop_the_job(spark):
    call = {**COMMON, "event_type": "api_timing", "method": "GET", "path": "/x", "status_code": 200, "duration_ms": 1}
    bad = [
        {**call, "status_code": 1e300}, {**call, "status_code": "NaN"}, {**call, "request_size": "1e300"}, {**call, "duration_ms": {}},
        {**call, "timestamp": "2025-02-30T00:00:00Z"}, {**call, "timestamp": 5}, {**VIEW, "event_data": [1]}, {**call, "event_type": ["x"]}, 7, "text", [], None,
    ]
    good, rejected = ingest.accept(docs(spark, {"events": [*bad, call]}), reject="event")
    assert [r.status for r in rejected.collect()] == ["unreadable"] * len(bad)
    assert to_table(ingest.envelope(good), S.MOBILE_API_CALLS).count() == 1


def test_client_form_needs_coercion(spark):
    error = {**COMMON, "event_type": "error", "error_class": "TypeError", "error_message": "x", "fatal": True}
    custom = {**COMMON, "event_type": "custom_event", "name": "buy", "properties": {"n": 1}}
    assert [s for s, _ in verdicts(spark, {"events": [error]}, {"events": [custom]})] == ["invalid", "invalid"]
    good, bad = ingest.accept(docs(spark, {"events": [error, custom, {**error, "fatal": False}]}), coerce=True)
    rows = good.orderBy("pos").select("event.error_type", "event.event_name", "event.event_data").collect()
    assert [tuple(r) for r in rows] == [("unhandled", None, None), (None, "buy", '{"n":1}'), ("handled", None, None)]
    assert bad.count() == 0


def test_envelope_routing_and_key(spark):
    events = [VIEW, {**COMMON, "event_type": "api_timing", "method": "GET", "path": "/"},
              {**COMMON, "event_type": "error", "error_type": "handled", "error_class": "E", "error_message": "m"}]
    good, _ = ingest.accept(docs(spark, {"events": events}))
    env = ingest.envelope(good)
    assert {(r.topic, r.key) for r in env.collect()} == {(t, "sess-1") for t in S.TOPICS}
    back = ingest.decode_records(ingest.topic_records(env))
    row = back.filter(F.col("topic") == S.TOPIC_EVENTS).first()
    assert row.readable and row.schema_version == 1 and row.source_ip == "10.0.0.1"
    assert row.event.screen_name == "HomeScreen"
    assert row.received_at == env.first().received_at


def test_unreadable_records_are_marked(spark):
    rows = spark.createDataFrame([("mobile.api.raw", "s", "junk"), ("mobile.api.raw", "s", "{}")], "topic string, key string, value string")
    assert [r.readable for r in ingest.decode_records(rows).collect()] == [False, False]


def test_unknown_types_are_skipped_and_observed(spark):
    from pyspark.sql import Observation

    seen = Observation("skipped")
    rows = ingest.classify_events(docs(spark, {"events": [VIEW, {**VIEW, "event_type": "zoom"}]}))
    assert skip_unknown(rows, seen, "wire.event_type").count() == 1
    assert seen.get["skipped"] == 1


def test_optional_fields_default_in_tables(spark):
    good, _ = ingest.accept(docs(spark, {"events": [VIEW]}))
    row = to_table(ingest.envelope(good), S.MOBILE_EVENTS).first()
    assert (row.env, row.release, row.device_model, row.os_version) == ("", "", "", "")
    assert (row.event_data, row.screen_name, row.user_id) == ("{}", "HomeScreen", None)


@pytest.mark.parametrize(
    "url, path",
    [
        ("https://api.example.com/users?page=1", "/users"), ("https://api.example.com", "/"), ("/cart?x=1", "/cart"),
        ("/checkout", "/checkout"), ("http://h:80/a/b#frag", "/a/b"), ("items?q", "items"),
    ],
)
def test_endpoint_path(spark, url, path):
    assert spark.range(1).select(scalars.endpoint_path(F.lit(url))).first()[0] == path


def test_methods_and_topics(spark):
    row = spark.range(1).select(
        scalars.http_method(F.lit("post")), scalars.http_method(F.lit(None).cast("string")),
        *[scalars.dead_letter_topic(F.lit(t)) for t in S.TOPICS],
    ).first()
    assert tuple(row) == ("POST", "GET", "mobile.events.dlq", "mobile.api.dlq", "mobile.errors.dlq")


def test_times_with_offsets(spark):
    texts = ["2025-01-01T00:00:00Z", "2025-01-01T02:00:00+02:00", "2024-12-31T20:30:00.1239-03:30", "2025-01-01", "2025-13-01T00:00:00Z", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(scalars.plain(scalars.utc_millis(F.col("t")))).collect()]
    assert [str(g) if g else None for g in got] == ["2025-01-01 00:00:00", "2025-01-01 00:00:00", "2025-01-01 00:00:00.123000", None, None, None]


def test_keys_attribute_documents(spark):
    keys = spark.createDataFrame(
        [(1, 7, "aaaaaaaa", True), (2, 8, "bbbbbbbb", False), (3, 1, "cccccccc", True), (4, 2, "cccccccc", True), (5, 7, "aaaaaaaa", True)],
        "id long, app_id long, key_prefix string, active boolean",
    )
    d = spark.createDataFrame([(1, "aaaaaaaaXYZ"), (2, "bbbbbbbb"), (3, "ccccccccc"), (4, "short"), (5, None)], "batch_id long, api_key string")
    known, refused = ingest.attribute_app(d, keys)
    assert [(r.batch_id, r.app_id) for r in known.collect()] == [(1, 7)]
    assert sorted(r.batch_id for r in refused.collect()) == [2, 3, 4, 5]


def test_whole_keys_attribute_documents(spark):
    """With digests a wrong secret is refused, and apps may share a prefix."""
    sha = lambda key: hashlib.sha256(key.encode()).hexdigest()
    keys = spark.createDataFrame(
        [(1, 7, "cccccccc", sha("cccccccc-one"), True), (2, 8, "cccccccc", sha("cccccccc-two"), True), (3, 9, "dddddddd", sha("dddddddd"), False)],
        "id long, app_id long, key_prefix string, key_sha256 string, active boolean",
    )
    d = spark.createDataFrame([(1, "cccccccc-one"), (2, "cccccccc-two"), (3, "cccccccc"), (4, "dddddddd"), (5, None)], "batch_id long, api_key string")
    known, refused = ingest.attribute_app(d, keys)
    assert sorted((r.batch_id, r.app_id) for r in known.collect()) == [(1, 7), (2, 8)]
    assert sorted(r.batch_id for r in refused.collect()) == [3, 4, 5]
    assert known.columns == refused.columns[: len(d.columns)] + ["app_id"]


def test_blank_is_any_white_space(spark):
    texts = ["", " ", "\t\n", "\u3000\u2028", "\x1f", "\u00a0", " x ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(scalars.is_blank(F.col("t"))).collect()] == [True, True, True, True, True, False, False, True]
    assert [r[0] for r in df.select(scalars.blank_to_null(F.col("t"))).collect()] == [None] * 5 + ["\u00a0", " x ", None]


def test_compact_numbers(spark):
    row = spark.range(1).select(*[scalars.compact_number(F.lit(n)) for n in (12345, 1_200_000, 999, 840.5)]).first()
    assert tuple(row) == ("12.3K", "1.2M", "999", "841")


@pytest.mark.parametrize("reject", ["event", "batch"])
def test_objects_and_lists_in_text_fields_are_refused(spark, reject):
    """A text that looks like JSON is a text; an object, a list or a nested value in its place is not."""
    good = {"event_id": "e", "event_type": "screen_view", "session_id": "s", "app_name": "a", "app_version": "1", "platform": "ios",
            "timestamp": "2024-01-01T00:00:00Z", "screen_name": "Home"}
    cases = [
        ({}, "ok"), ({"user_id": {"a": 1}}, "unreadable"), ({"user_id": ["x"]}, "unreadable"), ({"user_id": '{"a": 1}'}, "ok"),
        ({"user_id": "[x"}, "ok"), ({"screen_name": {}}, "unreadable"), ({"user_id": 17}, "ok"), ({"event_data": {"a": [1]}}, "ok"),
        ({"trace_id": "{", "platform": []}, "unreadable"), ({"extra": {"a": 1}, "user_id": "{}"}, "ok"),
    ]
    docs = [(i, "k", "ip", None, json.dumps({"events": [{**good, **change}]})) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(docs, S.DOCUMENT_SCHEMA)
    got = {r.batch_id: r.status for r in ingest.judge(df, reject).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
