"""Removal of long byte strings that an earlier document has, by suffix arrays of what may repeat.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document of smaller id.
Documents are whole UTF-8 texts, matches stay within documents, and all is judged on the input.

The windows of ``length`` bytes of a document are told apart by their anchors: the place in the window
of the smallest hash of ``gram`` bytes (long enough to be rare by chance). Equal windows have equal anchors, so what repeats can be found
among the stretches around equal anchors alone:

1. Documents are copied to the shared folder in groups of bounded size. Per group and range of hashes,
   the anchors' hashes are sent on in packed form; hashes that occur in two documents come back to the
   groups that have them, as files that the group's reader opens.
2. Each group sends the distinct stretches around such anchors, with its smallest and largest id, as one compressed row for each range of hashes.
3. Stretches of one anchor hash meet, trimmed to what may be equal. Where they still differ, a suffix
   array (Lyndon grouping) of them brings equal windows together; each window learns the smallest id that has it. That goes back by group.
4. Each document marks the windows whose smallest id is below its own, and drops what they cover.

No text is shuffled whole, copies within a group meet as one, and a common stretch is sent once per
group. An anchor hash that occurs more than ``most`` times is split by window: each of its windows is a stretch of its own,
under a hash of its content, so that no single task needs to hold them all.

Cases: null texts are empty; texts shorter than ``length`` lose nothing. Rows without an id lose nothing
and count for nothing. Rows of equal id do not remove each other's bytes, as neither id is smaller. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appwatch.llm import common
from appwatch.llm.common import stored
from appwatch.llm.minhash import mix
from appwatch.llm.suffixes import suffix_array
from appwatch.session import scratch_path

HASH_BITS = 40
PLACE_BITS = 30  # a slice of documents has fewer bytes than that
SLICE_BITS = 16  # a document's number within its slice
SLICE_ROWS = 1 << SLICE_BITS


@dataclass(frozen=True)
class Params:
    length: int = 50
    gram: int = 24
    group_bytes: int = 1 << 25
    range_anchors: int = 1_500_000
    array_bytes: int = 1 << 18
    most: int = 20_000


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Hashes of strings of ``width`` bytes, each with the string behind it."""
    n = min(len(left), len(right) - width)
    return mix(left[:n] * np.uint64(0x9E3779B97F4A7C15) + (right[width : width + n] ^ np.uint64(width)))


def anchors(data: bytes, ends: np.ndarray, params: Params) -> tuple[np.ndarray, ...]:
    """Hash, first and last window start, document number and place of each anchor of joined documents.

    ``ends`` are the documents' ends in ``data``. Of equal hashes in a window the leftmost counts.
    """
    empty = np.zeros(0, np.int64)
    n = len(data) - params.length + 1
    if n <= 0:
        return (empty,) * 5
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    # Hashes of 1, 2, 4, ... bytes, and of the sum of those widths that make up the gram.
    width, powers, grams, covered = 1, x, None, 0
    while True:
        if params.gram & width:
            grams = powers if grams is None else _joined(grams, powers, covered)
            covered += width
        if covered == params.gram:
            break
        powers = _joined(powers, powers, width)
        width *= 2
    grams = grams[: len(data) - params.gram + 1]
    key = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    span, low, covered = params.length - params.gram + 1, key, 1
    while covered * 2 <= span:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    if covered < span:
        low = np.minimum(low[: len(key) - span + 1], low[span - covered :][: len(key) - span + 1])
    place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)[:n]
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(n + 1, np.int64)  # windows that lie within one document
    whole = ends - starts >= params.length
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - params.length + 1, -1)
    fits = np.cumsum(edge)[:n] > 0
    at = np.flatnonzero(fits)
    if not len(at):
        return (empty,) * 5
    own = place[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    hashes = (grams[own[first]] & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    return hashes, at[first], at[last], np.searchsorted(ends, at[first], side="right"), own[first]


def _places(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``hashes`` holds one of the ascending ``wanted``, which are not empty."""
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return np.flatnonzero(wanted[at] == hashes)


GROUPED = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("raw", T.BinaryType())])


def grouped(docs: DataFrame, params: Params, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """A stored copy of ids and bytes, with the number of the group each row is in.

    With ``carry`` the whole row but its text goes along, as a struct ``rest``.
    """
    chosen = docs.select(common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"))
    schema = GROUPED
    if carry:
        rest = [F.when(F.lit(c != text_col), F.col(f"`{c}`")).alias(c) for c in docs.columns]
        rest = F.struct(*rest, F.col(f"`{text_col}`").isNull().alias("text_is_null"))
        chosen = docs.select(
            common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"), rest.alias("rest")
        )
        schema = T.StructType([*GROUPED.fields, chosen.schema["rest"]])

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 24, 0
        for batch in common.slices(batches):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            columns = {"part": [part] * len(raws), "doc_id": batch.column(0).to_pylist(), "raw": raws}
            if carry:
                columns["rest"] = batch.column(2).to_pylist()
            yield common.to_batch(columns, schema)
            size += sum(map(len, raws))
            if size >= params.group_bytes:
                part, size = part + 1, 0

    return stored(common.map_arrow(chosen, run, schema), "grouped")


def _slices(batches) -> Iterator[tuple[int, list[list]]]:
    """Group number and columns of rows that follow each other in one group, some hundred kB and at most ``SLICE_ROWS`` at a time."""
    at, rows, size = None, [], 0
    for batch in common.slices(batches):
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (part != at or size >= 1 << 19 or len(rows) >= SLICE_ROWS):
                yield at, [list(c) for c in zip(*rows)]
                rows, size = [], 0
            at = part
            rows.append(row)
            size += len(row[1])
    if rows:
        yield at, [list(c) for c in zip(*rows)]


def _by_group(slices) -> Iterator[tuple[int, Iterator[list[list]]]]:
    """The slices of each group in turn, without keeping them."""
    held = next(slices, None)
    while held is not None:
        part = held[0]

        def rest() -> Iterator[list[list]]:
            nonlocal held
            while held is not None and held[0] == part:
                yield held[1]
                held = next(slices, None)

        yield part, rest()


def _known(ids: list, raws: list[bytes]) -> tuple[list[int], bytes, np.ndarray]:
    """Ids, joined bytes and ends of the rows that have an id."""
    pairs = [(i, r) for i, r in zip(ids, raws) if i is not None]
    return [i for i, _ in pairs], b"".join(r for _, r in pairs), np.cumsum([len(r) for _, r in pairs], dtype=np.int64)


def _side_table(path: str, part: int) -> pa.Table | None:
    """What has been written for a group, read from the shared folder."""
    store, inner = fs.FileSystem.from_uri(f"{path}/part={part}")
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    return ds.dataset(inner, filesystem=store, format="parquet").to_table()


def _store_by_group(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


def pack(ascending: np.ndarray) -> bytes:
    """Whole numbers as steps: 24 bits for most, the few large ones apart with their places."""
    steps = np.diff(ascending, prepend=0)
    large = np.flatnonzero(steps >= 1 << 24)
    low = (steps & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return len(large).to_bytes(4, "little") + large.astype("<u4").tobytes() + (steps[large] >> 24).astype("<u4").tobytes() + low.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    large, high = np.frombuffer(packed[4 : 4 + 8 * n], "<u4").reshape(2, n)
    low = np.frombuffer(packed[4 + 8 * n :], np.uint8).reshape(-1, 3).astype(np.int64)
    steps = low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16
    steps[large] |= high.astype(np.int64) << 24
    return np.cumsum(steps)


def squeezed(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Whole numbers in columns of equal length and a string, as one compressed string."""
    planes = [c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]  # bytes of one place together
    raw = b"".join([*planes, tail])
    return np.array([len(columns), len(columns[0]), len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    k, n, size = np.frombuffer(packed[:24], "<i8").tolist()
    raw = pa.decompress(packed[24:], size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, count=8 * k * n).reshape(k, 8, n)
    return [np.ascontiguousarray(x.T).view("<i8").reshape(n) for x in planes], raw[8 * k * n :]


SENT = "bucket int, part long, hashes binary, twice binary, counts binary"


def _send_hashes(copy: DataFrame, bits: int, params: Params) -> DataFrame:
    """Per group and range: ascending anchor hashes, marks for those in two documents of the group, and how often each occurs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, slices in _by_group(_slices(batches)):
            found = []
            for ids, raws in slices:
                _, data, ends = _known(ids, raws)
                hashes, _, _, docs, _ = anchors(data, ends, params)
                pairs, times = np.unique(hashes << SLICE_BITS | docs, return_counts=True)  # once per document
                found.append((pairs >> SLICE_BITS, times))
            hashes, occurs = (np.concatenate(x) for x in zip(*found))
            if not len(hashes):
                continue
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.diff(hashes, prepend=-1))
            every, times, occurs = hashes[first], np.diff(first, append=len(hashes)), np.add.reduceat(occurs[order], first)
            cuts = np.searchsorted(every, np.arange(1 << bits) << (HASH_BITS - bits))
            for bucket, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(every)])):
                if b > a:
                    rest = every[a:b] - (bucket << (HASH_BITS - bits))
                    packed = pack(rest)
                    twice, counts = np.packbits(times[a:b] > 1).tobytes(), squeezed(occurs[a:b])
                    yield common.to_batch({"bucket": [bucket], "part": [part], "hashes": [packed], "twice": [twice], "counts": [counts]}, SENT)

    return common.map_arrow(copy.select("part", "doc_id", "raw"), run, SENT)


SHARED = "part long, hashes binary, hot binary"


def _shared_hashes(sent: DataFrame, bits: int, params: Params) -> DataFrame:
    """Per group: the hashes it has that occur in two documents anywhere, and those of them that occur more than ``most`` times."""

    def close(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        arrays = [unpack(h) for _, h, _, _ in rows]
        marked = [a[np.unpackbits(np.frombuffer(t, np.uint8), count=len(a)).astype(bool)] for a, (_, _, t, _) in zip(arrays, rows)]
        every, times = np.unique(np.concatenate([*arrays, *marked]), return_counts=True)
        shared = every[times > 1]
        occurs = np.zeros(len(shared), np.int64)
        hits = []
        for own, (_, _, _, counts) in zip(arrays, rows):
            hit = np.isin(own, shared, assume_unique=True)
            hits.append(own[hit])
            occurs[np.searchsorted(shared, hits[-1])] += unsqueezed(counts)[0][0][hit]
        hot = shared[occurs > params.most]
        start = bucket << (HASH_BITS - bits)
        for (part, *_), hit in zip(rows, hits):
            if len(hit):
                own = hit[np.isin(hit, hot, assume_unique=True)]
                yield common.to_batch({"part": [part], "hashes": [(hit + start).tobytes()], "hot": [(own + start).tobytes()]}, SHARED)

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in common.slices(batches, 16):
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and rows:
                    yield from close(at, rows)
                    rows = []
                at = bucket
                rows.append(tuple(row))
        if rows:
            yield from close(at, rows)

    ordered = sent.repartition("bucket").sortWithinPartitions("bucket")
    return common.map_arrow(ordered.select("bucket", "part", "hashes", "twice", "counts"), run, SHARED)


def _wanted(shared_path: str, part: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The shared and the hot hashes of a group, ascending."""
    table = _side_table(shared_path, part)
    if table is None:
        return None
    return tuple(np.sort(np.concatenate([np.frombuffer(h, np.int64) for h in table.column(c).to_pylist()])) for c in ("hashes", "hot"))


def code_of(stretch: bytes) -> int:
    return xxhash.xxh3_64_intdigest(stretch) - (1 << 63)


def _occurrences(data: bytes, ends: np.ndarray, wanted: tuple[np.ndarray, np.ndarray], params: Params) -> tuple[np.ndarray, ...]:
    """Hash, start, end, document number and anchor's place in it of each stretch around a shared anchor.

    Around a hot anchor each window is a stretch, with a hash and a place that its content gives: equal windows stay together.
    """
    hashes, first, last, docs, place = anchors(data, ends, params)
    hit = _places(hashes, wanted[0])
    hashes, first, last, docs, place = (x[hit] for x in (hashes, first, last, docs, place))
    cold = (hashes, first, last + params.length, docs, place - first)
    if not len(wanted[1]):
        return cold
    at = _places(hashes, wanted[1])
    of = np.repeat(at, last[at] - first[at] + 1)
    starts = first[of] + np.arange(len(of)) - np.searchsorted(of, of)
    mask = (1 << HASH_BITS) - 1
    keys = np.array([code_of(data[x : x + params.length]) & mask for x in starts.tolist()], np.int64)
    windows = (keys, starts, starts + params.length, docs[of], np.zeros(len(of), np.int64))
    return tuple(np.concatenate([np.delete(x, at), y]) for x, y in zip(cold, windows))


def _numbers() -> defaultdict:
    """Numbers strings in the order in which they are first looked up."""
    found: defaultdict[bytes, int] = defaultdict()
    found.default_factory = found.__len__
    return found


STRETCHES = "bucket int, part long, packed binary"


def _stretches(copy: DataFrame, shared_path: str, bits: int, params: Params) -> DataFrame:
    """Distinct stretches around shared anchors in each group, with the group's smallest and largest id, by ranges of hashes.

    The bytes of a stretch give its anchor, and so its hash and place.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, slices in _by_group(_slices(batches)):
            wanted = _wanted(shared_path, part)
            if wanted is None:
                for _ in slices:
                    pass
                continue
            number, new, seen = _numbers(), [], []
            for ids, raws in slices:
                ids, data, ends = _known(ids, raws)
                hashes, first, stop, docs, place = _occurrences(data, ends, wanted, params)
                before = len(number)
                which = np.array([number[data[a:b]] for a, b in zip(first.tolist(), stop.tolist())], np.int64)
                each, at = np.unique(which, return_index=True)
                at = at[each >= before]
                new.append((hashes[at], place[at], stop[at] - first[at]))
                seen.append((which, np.array(ids, np.int64)[docs]))
            if not number:
                continue
            hashes, place, sizes = (np.concatenate(x) for x in zip(*new))
            which, owners = (np.concatenate(x) for x in zip(*seen))
            low, high = _extremes(which, owners, len(number))
            texts = list(number)
            order = np.argsort(hashes)
            cuts = np.searchsorted(hashes[order], np.arange((1 << bits) + 1) << (HASH_BITS - bits))
            for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    own = order[a:b]
                    tail = b"".join([texts[i] for i in own.tolist()])
                    packed = squeezed(np.diff(hashes[own], prepend=0), place[own], sizes[own], low[own], high[own] - low[own], tail=tail)
                    yield common.to_batch({"bucket": [bucket], "part": [part], "packed": [packed]}, STRETCHES)

    return common.map_arrow(copy.select("part", "doc_id", "raw"), run, STRETCHES)


def _extremes(which: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of each of ``n`` numbers, all of which occur."""
    limits = np.iinfo(np.int64)
    low, high = np.full(n, limits.max), np.full(n, limits.min)
    np.minimum.at(low, which, values)
    np.maximum.at(high, which, values)
    return low, high


def least_ids(stretches: list[bytes], lows: list[int], length: int) -> list[np.ndarray]:
    """For each window of each stretch, the smallest id that has it, by a suffix array of them all."""
    text = b"".join(stretches)
    sizes = np.array([len(s) for s in stretches])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(stretches)), sizes)
    fits = np.arange(len(text)) + length <= (starts + sizes)[owner]
    order = np.array(suffix_array(text), np.int64)
    order = order[fits[order]]  # suffixes that start a window, in order
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)[order]
    new = np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)])
    low = np.array(lows, np.int64)[owner[order]]
    least = np.minimum.reduceat(low, np.flatnonzero(new))[np.cumsum(new) - 1]
    by_place = np.zeros(len(text), np.int64)
    by_place[order] = least
    return [by_place[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trimmed(stretches: list[tuple[int, bytes]], length: int) -> list[tuple[int, int]]:
    """Where each of several (place of the anchor, stretch) may repeat in another one: start and end.

    Equal windows have their anchor at the same place, so what is equal grows from the anchor to both
    sides: no farther to a side than the nearest neighbour in the order of that side. Start is end if
    too little is left for a window.
    """
    left = [s[:at][::-1] for at, s in stretches]
    right = [s[at:] for at, s in stretches]
    reach = []
    for side in (left, right):
        order = sorted(range(len(side)), key=side.__getitem__)
        best = [0] * len(side)
        for x, y in zip(order, order[1:]):
            n = _common(side[x], side[y])
            best[x] = max(best[x], n)
            best[y] = n
        reach.append(best)
    spans = [(at - x, at + y) for (at, _), x, y in zip(stretches, *reach)]
    return [(a, b) if b - a >= length else (a, a) for a, b in spans]


Run = tuple[int, int, int, int]


def _runs(stretches: list[tuple[int, bytes]], lows: list[int], groups: list[list[int]], params: Params) -> Iterator[Run]:
    """Runs of windows of stretches (place, bytes): number of the stretch, first window, windows, smallest id that has them.

    ``groups`` are the stretches of one anchor hash each. They are trimmed to what may repeat, which makes most of
    them equal. Those that still differ go into a suffix array together with those of other anchors.
    """
    differ: dict[tuple[int, bytes], int] = {}
    waiting: list[tuple[int, int, tuple[int, bytes]]] = []

    def settle() -> Iterator[Run]:
        found = dict(zip(differ, least_ids([k[1] for k in differ], list(differ.values()), params.length))) if differ else {}
        for i, start, key in waiting:
            values = found[key]
            cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
            yield from ((i, start + x, y - x, int(values[x])) for x, y in zip(cuts, cuts[1:]))

    size = 0
    for no, group in enumerate(groups):
        spans = trimmed([stretches[i] for i in group], params.length)
        texts = {stretches[i][1][a:b] for i, (a, b) in zip(group, spans) if a < b}
        shared = min((lows[i] for i, (a, b) in zip(group, spans) if a < b), default=0)
        for i, (a, b) in zip(group, spans):
            stretch, low = stretches[i][1], lows[i]
            n = len(stretch) - params.length + 1
            if a == b:
                yield i, 0, n, low
                continue
            m = b - a - params.length + 1
            yield i, 0, a, low
            yield i, a + m, n - a - m, low
            if len(texts) == 1:
                yield i, a, m, shared
            else:
                key = (no, stretch[a:b])
                size += 0 if key in differ else b - a
                differ[key] = min(differ.get(key, low), low)
                waiting.append((i, a, key))
        if size >= params.array_bytes or len(waiting) >= 20_000:
            yield from settle()
            differ.clear()
            waiting.clear()
            size = 0
    yield from settle()


FOUND = "part long, packed binary"


def _resolve(stretches: DataFrame, params: Params) -> DataFrame:
    """Runs of windows with the smallest id that has them, for each group that has a larger id with them."""

    def close(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        number, columns, which = _numbers(), [], []
        for _, packed in rows:
            (steps, place, sizes, low, above), tail = unsqueezed(packed)
            ends = np.cumsum(sizes).tolist()
            which.append(np.array([number[tail[a:b]] for a, b in zip([0, *ends], ends)], np.int64))
            columns.append((np.cumsum(steps), place, sizes, low, low + above))
        parts = np.repeat(np.arange(len(rows)), [len(w) for w in which])
        which = np.concatenate(which)
        hashes, place, sizes, low, high = (np.concatenate(x) for x in zip(*columns))
        each, at = np.unique(which, return_index=True)  # all numbers, so each is its own place
        hashes, place, sizes = hashes[at], place[at], sizes[at]
        lows, _ = _extremes(which, low, len(each))
        # Stretches that are the only one of their hash have one id for all windows. The others go on by hash.
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.diff(hashes[order], prepend=-1))
        ends = np.append(first[1:], len(order))
        alone = order[first[ends - first == 1]]
        groups = [order[a:b].tolist() for a, b in zip(first.tolist(), ends.tolist()) if b - a > 1]
        texts = list(number)
        made = list(_runs(list(zip(place.tolist(), texts)), lows.tolist(), groups, params))
        runs = np.array(made, np.int64).reshape(-1, 4)
        runs = np.concatenate([np.stack([alone, np.zeros_like(alone), sizes[alone] - params.length + 1, lows[alone]], axis=1), runs])
        runs = runs[runs[:, 2] > 0]
        of, start, windows, least = runs[np.argsort(runs[:, 0], kind="stable")].T
        hit, run = _matches(which, of)
        keep = least[run] < high[hit]
        hit, run = hit[keep], run[keep]
        used = np.unique(of[run])
        codes = np.zeros(len(texts), np.int64)
        codes[used] = [code_of(texts[i]) for i in used.tolist()]
        cuts = np.searchsorted(parts[hit], np.arange(len(rows) + 1))
        for (part, _), a, b in zip(rows, cuts, cuts[1:]):
            if b > a:
                own = run[a:b]
                yield common.to_batch({"part": [part], "packed": [squeezed(codes[of[own]], start[own], windows[own], least[own])]}, FOUND)

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in common.slices(batches, 16):
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and rows:
                    yield from close(rows)
                    rows = []
                at = bucket
                rows.append(tuple(row))
        if rows:
            yield from close(rows)

    ordered = stretches.repartition("bucket").sortWithinPartitions("bucket")
    return common.map_arrow(ordered.select("bucket", "part", "packed"), run, FOUND)


def _matches(left: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places that have equal values, in the order of the left side."""
    start = np.searchsorted(ascending, left, "left")
    n = np.searchsorted(ascending, left, "right") - start
    at = np.repeat(np.arange(len(left)), n)
    return at, start[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


KINDS = {
    "doc_id": T.LongType(),
    "n_bytes": T.LongType(),
    "n_removed": T.LongType(),
    "n_spans": T.LongType(),
    "kept_sha256": T.StringType(),
    "starts": T.ArrayType(T.IntegerType()),
    "ends": T.ArrayType(T.IntegerType()),
    "kept": T.StringType(),
}


def _remove(copy: DataFrame, shared_path: str, found_path: str, params: Params, outputs: list[str]) -> DataFrame:
    """The result row of each document: which runs of bytes go, and what is left."""
    fields = [T.StructField(o, KINDS[o]) for o in outputs if o != "rest"]
    schema = T.StructType([*fields, *(copy.schema[o] for o in outputs if o == "rest")])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, slices in _by_group(_slices(batches)):
            table = _side_table(found_path, part)
            wanted = _wanted(shared_path, part) if table is not None else None
            if wanted is not None:
                columns = [unsqueezed(p)[0] for p in table.column("packed").to_pylist()]
                codes, start, windows, low = (np.concatenate(x) for x in zip(*columns))
                order = np.argsort(codes)
                codes, start, windows, low = codes[order], start[order], windows[order], low[order]
            for ids, raws, *rest in slices:
                known, data, ends = _known(ids, raws)
                gone = np.zeros(len(data) + 1, np.int32)
                if wanted is not None:
                    _, first, stop, docs, _ = _occurrences(data, ends, wanted, params)
                    own = np.array([code_of(data[a:b]) for a, b in zip(first.tolist(), stop.tolist())], np.int64)
                    hit, found = _matches(own, codes)
                    keep = low[found] < np.array(known, np.int64)[docs[hit]]
                    hit, found = hit[keep], found[keep]
                    begin = first[hit] + start[found]
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + windows[found] - 1 + params.length, -1)
                covered = np.cumsum(gone)[:-1] > 0
                columns = _rows(ids, raws, covered, [f.name for f in fields])
                if rest:
                    columns["rest"] = rest[0]
                yield common.to_batch(columns, schema)

    return common.map_arrow(copy, run, schema)


def _rows(ids: list, raws: list[bytes], covered: np.ndarray, outputs: list[str]) -> dict[str, list]:
    out: dict[str, list] = {o: [] for o in outputs}
    at = 0
    for doc_id, raw in zip(ids, raws):
        mask = np.zeros(len(raw), bool)
        if doc_id is not None:
            mask = covered[at : at + len(raw)]
            at += len(raw)
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        kept = raw if not len(edges) else np.frombuffer(raw, np.uint8)[~mask].tobytes()
        row = {
            "doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(edges) // 2,
            "kept_sha256": hashlib.sha256(kept).hexdigest(), "starts": edges[::2].tolist(), "ends": edges[1::2].tolist(),
            "kept": kept.decode("utf-8", "ignore"),
        }
        for o in outputs:
            out[o].append(row[o])
    return out


def _found(copy: DataFrame, params: Params) -> tuple[str, str]:
    """Where the shared hashes and the runs of repeated windows are written, by group."""
    total = copy.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    per_range = params.range_anchors * (params.length - params.gram + 2) / 2
    bits = min(24, max(0, int(np.ceil(np.log2(max(total / per_range, 1))))))
    shared = _store_by_group(_shared_hashes(_send_hashes(copy, bits, params), bits, params), "shared")
    return shared, _store_by_group(_resolve(_stretches(copy, shared, bits, params), params), "found")


def remove_repeats(
    docs: DataFrame,
    params: Params = Params(),
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs=("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"),
) -> DataFrame:
    """One row per document with the chosen columns of ``KINDS``; ``starts`` and ``ends`` are byte spans."""
    copy = grouped(docs, params, id_col, text_col)
    return _remove(copy, *_found(copy, params), params, list(outputs))


def cut_repeats(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; texts that lose all their bytes go.

    Where a cut splits a character, its other bytes go too. Null and empty texts stay as they are.
    """
    copy = grouped(docs, params, id_col, text_col, carry=True)
    cut = _remove(copy, *_found(copy, params), params, ["n_removed", "kept", "rest"])
    cut = cut.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    text = F.when(~F.col("rest.text_is_null"), F.col("kept"))
    return cut.select(*[(text.alias(c) if c == text_col else F.col("rest").getField(c).alias(c)) for c in docs.columns])
