from __future__ import annotations

import hashlib
import io

import pyarrow as pa
import pytest
import zstandard

from appwatch.llm import warc

BIG, SMALL = "<p>" + "x" * 1200, "<p>small"
ROWS = [
    (1, "http://a/ b\n", BIG), (2, None, BIG), (3, "http://c", BIG + "é"), (4, "http://d", SMALL), (5, "http://d", SMALL),
    (6, "http://e", None), (7, "http://e", ""), (8, "http://f", BIG), (8, "http://f", BIG), (None, "http://g%0A", BIG),
    (9, "http://h", "y" * 3_000_000), (10, "WARC/1.1\r\n\r\n", "\r\n\r\nWARC/1.1\r\n" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size", "'x' as bundle")


@pytest.fixture(scope="module")
def index(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    return warc.write_archives(warc.plan_revisits(pages), path, frame_bytes=3000, bundle_bytes=9000).cache()


def test_round_trip(pages, index):
    got = sorted((str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(index).collect())
    want = []
    for page_id, url, html in ROWS:
        raw = (html or "").encode()
        revisit = html == BIG and page_id != 8
        digest = hashlib.sha1(raw).hexdigest()
        kind = "revisit" if revisit else "response"
        want.append((str(page_id), url, len(raw), digest, kind, 8 if revisit else None, None if revisit else raw))
    key = lambda r: tuple(str(x)[:80] for x in r)
    assert sorted(got, key=key) == sorted([(*w[:6], bytearray(w[6]) if w[6] is not None else None) for w in want], key=key)


def test_one_record_costs_one_frame(index):
    for page_id in (3, 5, 10):
        (record,) = warc.fetch(index.where(f"page_id = {page_id}")).collect()
        assert bytes(record.payload).decode() == next(h for i, _, h in ROWS if i == page_id)


def test_bundles_are_plain_zstandard_with_a_seek_table(index):
    for row in index.select("bundle").distinct().collect():
        with open(row.bundle, "rb") as f:
            raw = f.read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        frames = warc.read_seek_table(pa.BufferReader(raw))
        assert sum(f[2] for f in frames) == len(whole)
        assert b"".join(warc.read_frame(pa.BufferReader(raw), f) for f in frames) == whole
        assert all(headers["WARC-Type"] in ("response", "revisit") for _, _, headers, _ in warc.parse(whole))


def test_empty_table(pages):
    assert warc.archive(pages.where("false")).count() == 0


def test_archives_are_read_back_by_many_tasks(spark, tmp_path):
    """A single bundle of many frames is read by as many tasks as it has runs of frames."""
    pages = spark.range(600).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 400) as html").coalesce(1)
    index = warc.write_archives(warc.plan_revisits(pages).coalesce(1), str(tmp_path), frame_bytes=1 << 13)
    frames = index.select("bundle", "frame").distinct().count()
    assert index.select("bundle").distinct().count() == 1 and frames > 16 * warc.RUN
    by_task = warc.read_archives(index).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(by_task) == 8 and sum(r["count"] for r in by_task) == 600
    assert max(r["count"] for r in by_task) < 300
