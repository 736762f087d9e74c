"""Decode, validate, reject, envelope and route posted batch documents."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appwatch import schema as S
from appwatch.functions.scalars import (
    as_instant,
    blank_to_null,
    dead_letter_topic,
    endpoint_path,
    error_name,
    http_method,
    is_blank,
    utc_millis,
)

# The server's messages.
EMPTY_BATCH = "events: events must not be empty"
UNREADABLE = "Invalid request body"
NOT_BLANK, NOT_NULL = "must not be blank", "must not be null"


# --- one event -----------------------------------------------------------------------------


def coerce_client_fields(e: Column) -> Column:
    """Client-library names to wire names: name, properties and fatal, where the wire field is missing."""
    is_error = e["event_type"] == "error"
    handled = F.when(e["fatal"] == "true", "unhandled").when(e["fatal"] == "false", "handled")
    return F.struct(
        *[
            F.coalesce(e["event_name"], e["name"]).alias(f)
            if f == "event_name"
            else F.coalesce(e["event_data"], e["properties"]).alias(f)
            if f == "event_data"
            else F.when(is_error, F.coalesce(e["error_type"], handled)).otherwise(e["error_type"]).alias(f)
            if f == "error_type"
            else e[f].alias(f)
            for f in S.WIRE_SCHEMA.fieldNames()
        ]
    )


def _typed_fields(e: Column) -> dict[str, Column]:
    """The fields that are not text. Values arrive as text, so numbers may be quoted."""

    def whole(name: str) -> Column:
        return F.coalesce(e[name].try_cast("long"), e[name].try_cast("double").try_cast("long"))

    return {
        "timestamp": utc_millis(e["timestamp"]),
        "cold_start": F.when(e["cold_start"] == "true", True).when(e["cold_start"] == "false", False),
        "duration_ms": e["duration_ms"].try_cast("double"),
        "status_code": e["status_code"].try_cast("double").try_cast("int"),
        "request_size": whole("request_size"),
        "response_size": whole("response_size"),
    }


def typed_event(e: Column) -> Column:
    """Text fields of a readable event to a typed struct."""
    typed = _typed_fields(e)
    return F.when(e.isNotNull(), F.struct(*[typed.get(f, e[f]).alias(f) for f in S.WIRE_FIELDS]))


def _nested_text(e: Column, raw: Column) -> Column:
    """True where a text field holds an object or a list. Both arrive as their JSON text, so the event is
    parsed again, but only if some text field looks like one; a text that merely does is no object."""
    typed = _typed_fields(e)
    fields = [f for f in S.WIRE_FIELDS if f not in typed and f != "event_data"]
    looks = reduce(or_, [F.coalesce(e[f].startswith("{") | e[f].startswith("["), F.lit(False)) for f in fields])
    kinds = [F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{f}", "variant")) for f in fields]
    nested = reduce(or_, [F.coalesce(k.rlike("^(OBJECT|ARRAY)"), F.lit(False)) for k in kinds])
    return F.when(looks, nested).otherwise(F.lit(False))


def is_readable(e: Column, raw: Column) -> Column:
    """False where the server would refuse to parse the event: an unknown type, a value that does
    not fit its field, an object or a list in a text field, or event data that is no object."""
    fits = [~_nested_text(e, raw)]
    fits += [F.coalesce(e["event_type"].isin(*S.EVENT_TYPES), F.lit(False))]
    fits += [e[name].isNull() | typed.isNotNull() for name, typed in _typed_fields(e).items()]
    fits.append(e["event_data"].isNull() | F.ltrim(e["event_data"]).startswith("{"))
    return reduce(and_, fits)


def _constraints(e: Column) -> list[tuple[Column, str, str]]:
    """(violated, field, message) of every constraint, in declaration order."""
    checks = [(is_blank(e[f]), name, NOT_BLANK) for f, name in S.REQUIRED_COMMON]
    checks.append((e["timestamp"].isNull(), "timestamp", NOT_NULL))
    for kind, required in S.REQUIRED_BY_TYPE.items():
        checks += [((e["event_type"] == kind) & is_blank(e[f]), name, NOT_BLANK) for f, name in required]
    return checks


def is_valid(e: Column) -> Column:
    return ~reduce(or_, [violated for violated, _, _ in _constraints(e)])


def violations(e: Column, pos: Column) -> Column:
    """Failed constraints of a readable event as ``events[i].field: message``."""
    start = F.concat(F.lit("events["), pos.cast("string"))
    found = [F.when(bad, F.concat(start, F.lit(f"].{name}: {message}"))) for bad, name, message in _constraints(e)]
    return F.array_compact(F.array(*found))


def route_topic(event_type: Column) -> Column:
    return (
        F.when(event_type == "api_timing", S.TOPIC_API)
        .when(event_type == "error", S.TOPIC_ERRORS)
        .otherwise(S.TOPIC_EVENTS)
    )


# --- documents -----------------------------------------------------------------------------


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is costly to compute. Filters are not pushed below a generator, so later
    conditions on the column do not parse the text again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _wire_events(docs: DataFrame, coerce: bool) -> DataFrame:
    """Documents with ``broken`` (no readable JSON) and ``wire``: raw text and text fields per event."""
    docs = _once(docs, "_doc", F.from_json("body", "events array<string>, _corrupt_record string"))
    broken = F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull()
    wire = F.transform(
        F.col("_doc.events"), lambda r: F.struct(r.alias("raw"), F.from_json(r, S.WIRE_SCHEMA).alias("wire"))
    )
    if coerce:
        wire = F.transform(wire, lambda x: F.struct(x["raw"].alias("raw"), coerce_client_fields(x["wire"]).alias("wire")))
    docs = docs.withColumn("broken", broken)
    return _once(docs, "wire", F.when(~F.col("broken"), wire)).drop("_doc")


def _judged(docs: DataFrame, unreadable: Column, empty: Column, valid: Column, found: Column) -> DataFrame:
    """Add ``status`` and, for what did not pass, ``errors``; passing rows build no error list."""
    status = F.when(unreadable, "unreadable").when(empty | ~valid, "invalid").otherwise("ok")
    errors = (
        F.when(unreadable, F.array(F.lit(UNREADABLE)))
        .when(empty, F.array(F.lit(EMPTY_BATCH)))
        .when(valid, F.array().cast("array<string>"))
        .otherwise(found)
    )
    return docs.select("*", status.alias("status"), errors.alias("errors"))


def classify_events(docs: DataFrame, coerce: bool = False) -> DataFrame:
    """One row per posted event, judged on its own: ``pos``, ``raw`` text, ``wire`` fields, ``status``
    (ok, invalid, unreadable) and ``errors``.

    Broken and empty documents give one row with a NULL ``pos`` and their ``body``, so nothing
    posted is lost; other rows do not repeat the body.
    """
    keep = [c for c in docs.columns if c != "body"]
    rows = _wire_events(docs, coerce).select(*keep, "body", "broken", F.posexplode_outer("wire").alias("pos", "_e"))
    whole = F.col("pos").isNull()
    rows = rows.select(
        *keep, F.when(whole, F.col("body")).alias("body"), "broken", "pos", F.col("_e.raw").alias("raw"), F.col("_e.wire").alias("wire")
    )
    wire = F.col("wire")
    unreadable = F.col("broken") | (~whole & ~is_readable(wire, F.col("raw")))
    return _judged(rows, unreadable, whole, is_valid(wire), violations(wire, F.col("pos"))).drop("broken")


def explode_documents(docs: DataFrame) -> DataFrame:
    """One row per posted event: document columns, ``pos`` and the event's own JSON text in ``raw``."""
    doc = _once(docs, "_doc", F.from_json("body", "events array<string>"))
    keep = [c for c in docs.columns if c != "body"]
    return doc.select(*keep, F.posexplode("_doc.events").alias("pos", "raw"))


def classify_batches(docs: DataFrame, coerce: bool = False) -> DataFrame:
    """Documents with their ``wire`` events and the verdict on the whole document.

    The decision is taken on the array inside the row, before any explode, so it needs no shuffle.
    ``errors`` lists every violation of every event.
    """
    docs = _wire_events(docs, coerce)
    bad = F.exists("wire", lambda x: ~is_readable(x["wire"], x["raw"]))
    docs = _once(docs, "_unreadable", F.col("broken") | F.coalesce(bad, F.lit(False)))
    docs = _once(docs, "_valid", F.coalesce(F.forall("wire", lambda x: is_valid(x["wire"])), F.lit(True)))
    found = F.flatten(F.transform("wire", lambda x, i: violations(x["wire"], i)))
    empty = F.coalesce(F.size("wire"), F.lit(0)) <= 0
    return _judged(docs, F.col("_unreadable"), empty, F.col("_valid"), found).drop("broken", "_unreadable", "_valid")


def judge(docs: DataFrame, reject: str = "batch", coerce: bool = False) -> DataFrame:
    """Documents decoded and judged.

    ``reject="batch"``: one bad event refuses its whole document, as at the HTTP endpoint; one row
    per document. ``reject="event"``: for landed files; one row per event.
    """
    if reject not in ("batch", "event"):
        raise ValueError("reject is 'batch' or 'event'")
    return classify_batches(docs, coerce) if reject == "batch" else classify_events(docs, coerce)


def accepted_events(judged: DataFrame) -> DataFrame:
    """The events that passed, one typed ``event`` per row, from either form of ``judge``."""
    good = judged.filter("status = 'ok'").drop("body", "status", "errors")
    keep = [c for c in good.columns if c not in ("pos", "raw", "wire")]
    if "pos" not in judged.columns:
        good = good.select(*keep, F.posexplode("wire").alias("pos", "_e"))
        good = good.select(*keep, "pos", F.col("_e.raw").alias("raw"), F.col("_e.wire").alias("wire"))
    return good.select(*keep, "pos", "raw", typed_event(F.col("wire")).alias("event"))


def rejected_rows(judged: DataFrame) -> DataFrame:
    """The documents or events that did not pass, with ``status`` and ``errors``."""
    return judged.filter("status <> 'ok'").drop("wire")


def accept(docs: DataFrame, reject: str = "batch", coerce: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted events, rejected rows)``; see ``judge`` for the two ways to reject."""
    judged = judge(docs, reject, coerce)
    return accepted_events(judged), rejected_rows(judged)


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Rejected rows as dead-letter records: topic, reason, and the payload as posted."""
    payload = F.coalesce("raw", "body") if "raw" in rejected.columns else F.col("body")
    kind = F.get_json_object("raw", "$.event_type") if "raw" in rejected.columns else F.lit(None).cast("string")
    pos = F.col("pos") if "pos" in rejected.columns else F.lit(None).cast("int")
    return rejected.select(
        "batch_id",
        pos.alias("pos"),
        dead_letter_topic(route_topic(kind)).alias("topic"),
        "status",
        F.array_join("errors", "; ").alias("reason"),
        payload.alias("payload"),
    )


# --- envelopes -----------------------------------------------------------------------------


def envelope(accepted: DataFrame, received_at: datetime | str | Column | None = None) -> DataFrame:
    """Accepted events in their envelope, with the topic and the session as record key."""
    when = F.col("received_at") if "received_at" in accepted.columns else F.current_timestamp()
    if received_at is not None:
        when = as_instant(received_at)
    extra = ["batch_id"] if "batch_id" in accepted.columns else []
    app_id = F.col("app_id") if "app_id" in accepted.columns else F.lit(None).cast("long")
    return accepted.select(
        *extra,
        route_topic(F.col("event.event_type")).alias("topic"),
        F.col("event.session_id").alias("key"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.date_trunc("millisecond", when).alias("received_at"),
        "source_ip",
        app_id.alias("app_id"),
        "event",
    )


def topic_records(enveloped: DataFrame, *keep: str) -> DataFrame:
    """Envelopes as topic records: topic, key, JSON value, and the columns in ``keep``."""
    value = F.to_json(
        F.struct("schema_version", "received_at", "source_ip", "app_id", "event"),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"},
    )
    return enveloped.select("topic", "key", value.alias("value"), *keep)


def decode_records(records: DataFrame) -> DataFrame:
    """Topic records back to envelopes. ``readable`` is false for values that are no envelope."""
    v = F.from_json("value", "schema_version int, received_at string, source_ip string, app_id bigint, event string")
    extra = [c for c in records.columns if c not in ("value",)]
    rows = _once(_once(records, "_v", v), "_e", F.from_json("_v.event", S.WIRE_SCHEMA))
    return rows.withColumn("event", typed_event(F.col("_e"))).select(
        *extra,
        "value",
        F.col("_v.schema_version").alias("schema_version"),
        utc_millis(F.col("_v.received_at")).alias("received_at"),
        F.col("_v.source_ip").alias("source_ip"),
        F.col("_v.app_id").alias("app_id"),
        "event",
        F.coalesce(is_readable(F.col("_e"), F.col("_v.event")), F.lit(False)).alias("readable"),
    )


# --- API keys ------------------------------------------------------------------------------


def attribute_app(docs: DataFrame, api_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the ``app_id`` of their key, and those without one.

    Only active keys count. With a column ``key_sha256`` (hex digest of the whole key) in ``api_keys``
    the whole key must be right, and apps may share a prefix. Without it a key counts by its first
    eight characters, the secret part is not checked, and a shared prefix attributes to no app.
    """
    prefix = F.when(F.length("api_key") >= 8, F.substring("api_key", 1, 8))
    if "key_sha256" in api_keys.columns:
        owners = api_keys.filter("active").groupBy("key_prefix", "key_sha256").agg(F.min("app_id").alias("app_id"))
        keyed = docs.withColumn("key_prefix", prefix).withColumn("key_sha256", F.sha2(F.col("api_key").cast("binary"), 256))
        both = ["key_prefix", "key_sha256"]
        return keyed.join(owners, both).drop(*both), keyed.join(owners, both, "left_anti").drop(*both)
    owners = (
        api_keys.filter("active")
        .groupBy("key_prefix")
        .agg(F.min("app_id").alias("app_id"), F.max("app_id").alias("_other"))
        .filter("app_id = _other")
        .drop("_other")
    )
    keyed = docs.withColumn("key_prefix", prefix)
    return keyed.join(owners, "key_prefix").drop("key_prefix"), keyed.join(owners, "key_prefix", "left_anti").drop("key_prefix")


# --- client-side shaping at table level ------------------------------------------------------


def normalise_endpoint(df: DataFrame, url: str = "url", method: str = "method") -> DataFrame:
    return df.withColumn("path", endpoint_path(F.col(url))).withColumn("method", http_method(F.col(method)))


def normalise_error(df: DataFrame, screen: str | None = None) -> DataFrame:
    """Unnamed errors become ``Error``; a missing screen is taken from the caller's column."""
    df = df.withColumn("error_class", error_name(F.col("error_class")))
    if screen:
        df = df.withColumn("screen_name", F.coalesce(blank_to_null(F.col("screen_name")), F.col(screen)))
    return df
