"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records, and a skippable
frame with the seek table, whose footer ends the file (the Zstandard seekable format). An index maps
each page to its bundle, frame, and the record's offset in the unpacked frame, so one record costs
one frame. A payload that many pages share is stored once: the other pages get revisit records.

Cases: a null payload is empty; a null address leaves out the target. Of equal payloads of at least
``dedup_bytes`` the page of largest id is the response; rows that repeat that id are responses too.
Pages without an id revisit it like the rest; if no page of a group has an id, all are responses.
An empty table gives an empty index and no bundle. Very long payloads have a frame of their own.
Executors may be lost at any time: each attempt of a task writes files of its own name, and only
those of the attempt that Spark accepts get into the index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.llm import common
from appwatch.session import scratch_path

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
# Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
NEWLINE = b"\r\n"
ID_PREFIX = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def plan_revisits(pages: DataFrame, dedup_bytes: int = 1000, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """page_id, url, payload, digest, size, response_id (set where the record is a revisit).

    Only digests that occur twice meet the pages again; the largest id is found before the shuffle.
    """
    payload = F.coalesce(common.field(pages, payload_col, "string"), F.lit("")).cast("binary")
    rows = pages.select(
        common.field(pages, id_col, "long").alias("page_id"),
        common.field(pages, url_col, "string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    shared = (
        rows.where(F.col("size") >= dedup_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("largest").isNotNull())
        .select("digest", "largest")
    )
    joined = rows.join(shared, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("largest"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(other, F.col("largest")).alias("response_id"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head with the payload's length but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if response_id is not None else head + payload
    name = f"{ID_PREFIX}{page_id}" if page_id is not None else f"{ID_PREFIX}none:{digest}"
    lines = [
        f"WARC-Type: {'revisit' if response_id is not None else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_escape(url)}")
    if response_id is not None:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{response_id}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return b"".join([VERSION, NEWLINE, "\r\n".join(lines).encode(), NEWLINE * 2, block, NEWLINE * 2])


def _escape(url: str) -> str:
    """White space, control signs and the percent sign as percent escapes, so that a header stays one line."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def _unescape(url: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an unpacked frame."""
    at = 0
    while at < len(data):
        end = data.index(NEWLINE * 2, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version.encode() != VERSION:
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != NEWLINE * 2:
            raise ValueError(f"record at {at} does not end where it should")
        yield at, stop + 4 - at, headers, data[start:stop]
        at = stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame of packed and unpacked frame sizes, with its footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """Position, packed and unpacked size of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 128 else 8
    file.seek(size - 9 - count * width)
    table = file.read(count * width)
    frames, at = [], 0
    for i in range(count):
        packed, unpacked = struct.unpack_from("<II", table, i * width)
        frames.append((at, packed, unpacked))
        at += packed
    return frames


def read_frame(file, frame: tuple[int, int, int]) -> bytes:
    at, packed, unpacked = frame
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(unpacked, 1))


class _Bundle:
    """A file that frames are appended to."""

    def __init__(self, path: str):
        self.path, self.frames = path, []
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_output_stream(inner, compression=None)

    def add(self, data: bytes, level: int) -> None:
        packed = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data)))

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


#: Frames that a task reads in a row.
RUN = 4


def write_archives(
    planned: DataFrame, path: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27, level: int = 3
) -> DataFrame:
    """Write the records of :func:`plan_revisits` below ``path``; the stored index is returned.

    A task holds one unpacked frame at a time. ``path`` must be reachable from all executors.
    """
    spark = planned.sparkSession
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(f"{inner}/bundles", recursive=True)

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{path}/bundles/{task.partitionId():06d}-{task.taskAttemptId()}"
        bundle, number, written = None, 0, 0
        pending: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, number, written, size
            if bundle is None:
                bundle = _Bundle(f"{stem}-{number:04d}.warc.zst")
            rows: dict[str, list] = {n: [] for n in ("page_id", "bundle", "frame", "offset", "length")}
            offset = 0
            for page_id, data in pending:
                for n, v in zip(rows, (page_id, bundle.path, len(bundle.frames), offset, len(data))):
                    rows[n].append(v)
                offset += len(data)
            bundle.add(b"".join([d for _, d in pending]), level)
            written += offset
            pending.clear()
            size = 0
            if written >= bundle_bytes:
                bundle.close()
                bundle, number, written = None, number + 1, 0
            return common.to_batch(rows, INDEX)

        for batch in common.slices(batches, 64):
            for page_id, url, payload, digest, _, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append((page_id, record(page_id, url, payload, digest, response_id)))
                size += len(pending[-1][1])
                if size >= frame_bytes:
                    yield flush()
        if pending:
            yield flush()
        if bundle:
            bundle.close()

    index = common.map_arrow(planned, run, INDEX)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """The columns of ``RECORDS``; a response's digest and length come from its payload, and must agree."""

    def number(name: str) -> int | None:
        text = headers[name][1:-1].removeprefix(ID_PREFIX)
        return None if text.startswith("none:") else int(text)

    head, _, payload = block.partition(NEWLINE * 2)
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what its headers say")
    url = headers.get("WARC-Target-URI")
    refers = number("WARC-Refers-To") if kind == "revisit" else None
    return (
        number("WARC-Record-ID"), None if url is None else _unescape(url), kind, length, digest, refers,
        payload if kind == "response" else None,
    )


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles in ``index``, frame by frame.

    A task's share is runs of frames, dealt out in turn: a bundle is read by as many tasks as it has runs.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    for frame in read_seek_table(file)[first : first + RUN]:
                        rows = [_row(headers, block) for _, _, headers, block in parse(read_frame(file, frame))]
                        yield common.to_batch(dict(zip(_NAMES, map(list, zip(*rows)))), RECORDS)

    runs = index.select("bundle", (F.floor(F.col("frame") / RUN) * RUN).alias("first")).distinct()
    # Without a key: the rows are few and small, and must not be put together again.
    return common.map_arrow(runs.repartition(parts), run, RECORDS)


def fetch(index: DataFrame) -> DataFrame:
    """Only the records that ``index`` names: their frames are unpacked, and cut at the offsets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, file, frames, at, data = None, None, [], None, b""
        for batch in batches:
            for path, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != last:
                    store, inner = fs.FileSystem.from_uri(path)
                    file, last, at = store.open_input_file(inner), path, None
                    frames = read_seek_table(file)
                if frame != at:
                    data, at = read_frame(file, frames[frame]), frame
                ((_, _, headers, block),) = parse(data[offset : offset + length])
                yield common.to_batch(dict(zip(_NAMES, ([v] for v in _row(headers, block)))), RECORDS)

    chosen = index.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return common.map_arrow(chosen, run, RECORDS)


_NAMES = [f.split()[0] for f in RECORDS.split(",")]


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all ``pages`` and read the archives back; ``path`` defaults to the shared folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_revisits(pages), path, **options))
