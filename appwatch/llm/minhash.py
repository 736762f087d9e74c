"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

A document's set holds its distinct word shingles. Documents of equal sets form a class, and classes
take part in what follows, once each. A set has ``bands`` x ``rows`` MinHash values. Values of a band
hash to a bucket key; classes that share a key are candidates. All values together toggle the bits of
an odd sketch: the population count of the XOR of two sketches tells how many values differ, which
estimates high similarities well. Candidates far below the threshold are dropped by it with a margin
of over five standard deviations. A finer odd sketch holds the hash sample of a set at two sampling
rates (the whole set, if it is small): its XOR count never exceeds the number of differing members, so
for small sets it drops no link at all, and for large ones allows five standard deviations. What is
left is checked on the whole sets.

Pairs are never all written. In rounds, every class offers the partners of nearest sketch that are not
yet in its component, and of the pairs between two components a bucket offers the nearest; they are checked, links join components, and offers widen until no candidate of
another component is left unchecked. Members of one component need no check against each other, so a
group of n near copies costs about n checks, and still no link between components is lost.

Buckets above ``block`` members are dealt into blocks. In the first round the smallest member is in
each of them; later every member outside its component is, so again all pairs that matter meet.

Cases: null and empty texts, and texts of white space only, have empty sets and link with nothing.
With fewer words than a shingle, the whole sequence is one. Rows of equal id are judged by their own
text each, and give a row each. A null id takes no part: its component is null and it is kept. An empty table gives an
empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appwatch.llm import common, graph
from appwatch.llm.common import stored

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@dataclass(frozen=True)
class Params:
    """A link needs 100 * shared >= ``percent`` * union. At 80 a pair is missed once in 20 million."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    fine_bits: int = 2048
    fine_members: int = 512
    margin: float = 0.2
    block: int = 4096

    @property
    def values(self) -> int:
        return self.bands * self.rows

    @property
    def most_differing_bits(self) -> int:
        """Expected XOR count of two sketches ``margin`` below the threshold."""
        apart = 2 * self.values * (1 - self.percent / 100 + self.margin)
        return int(np.ceil(self.sketch_bits / 2 * (1 - (1 - 2 / self.sketch_bits) ** apart)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, as long as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit number per word, of all its bytes."""
    data = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~WHITE[data]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Tables.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """The distinct shingles of lower-cased (A-Z) text, as sorted 64-bit numbers."""
    words = word_hashes(raw.lower())
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(total + np.uint64(size)))


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The same as words, for exact checks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    size = min(size, len(words))
    return set(zip(*(words[k:] for k in range(size)))) if size else set()


class Signer:
    def __init__(self, params: Params):
        self.params = params
        seeds = mix(np.arange(1, 2 * params.values + 1, dtype=np.uint64) * np.uint64(_BASE))
        self.a = (seeds[: params.values] | np.uint64(1))[:, None]
        self.b = seeds[params.values :][:, None]
        self.place = np.arange(params.values, dtype=np.uint64) << np.uint64(32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        best = None
        for i in range(0, len(hashes), 2048):
            part = ((hashes[None, i : i + 2048] * self.a + self.b) >> np.uint64(32)).min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best

    def bands(self, minima: np.ndarray) -> np.ndarray:
        grouped = minima.reshape(self.params.bands, self.params.rows)
        key = np.arange(1, self.params.bands + 1, dtype=np.uint64)
        for k in range(self.params.rows):
            key = mix(key * np.uint64(_BASE) + grouped[:, k])
        return key.view(np.int64)

    def sketch(self, minima: np.ndarray) -> bytes:
        """Bit i is the parity of the number of (place, value) pairs that hash to i."""
        at = (mix(minima + self.place) % np.uint64(self.params.sketch_bits)).astype(np.int64)
        odd = np.bincount(at, minlength=self.params.sketch_bits) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()


    def fine(self, hashes: np.ndarray) -> bytes:
        """Parities of the members sampled at this set's rate, and of those sampled at half of it."""
        spread = mix(hashes ^ np.uint64(_BASE))
        level, out = fine_level(len(hashes), self.params.fine_members), b""
        for at in (level, level + 1):
            sample = spread[(spread & np.uint64((1 << at) - 1)) == 0]
            bits = ((sample >> np.uint64(40)) % np.uint64(self.params.fine_bits)).astype(np.int64)
            out += np.packbits((np.bincount(bits, minlength=self.params.fine_bits) & 1).astype(np.uint8)).tobytes()
        return out


def fine_level(size: int, members: int) -> int:
    """How often the sampling rate is halved for a set of this size."""
    return max(0, (max(size, 1) - 1) // members).bit_length()


SIGNATURES = "doc_id long, text_key long, n_shingles long, class binary, bands array<long>, sketch binary, fine binary"


def signatures(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        signer = Signer(params)
        for batch in common.slices(batches):
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "text_key": batch.column(2).to_pylist(), "n_shingles": []}
            out |= {n: [] for n in ("class", "bands", "sketch", "fine")}
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), params.shingle)
                out["n_shingles"].append(len(hashes))
                if not len(hashes):
                    for n in ("class", "bands", "sketch", "fine"):
                        out[n].append(None)
                    continue
                minima = signer.minima(hashes)
                out["class"].append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                out["bands"].append(signer.bands(minima))
                out["sketch"].append(signer.sketch(minima))
                out["fine"].append(signer.fine(hashes))
            yield common.to_batch(out, SIGNATURES)

    text = common.field(docs, text_col, "string")
    chosen = docs.select(common.field(docs, id_col, "long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    return common.map_arrow(chosen, run, SIGNATURES)


def text_key(text: Column) -> Column:
    """With the id it tells rows apart that repeat an id with other texts."""
    return F.xxhash64(text)


def offers(rows: list[tuple], params: Params, top: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Pairs (smaller, larger, rank) that the members of a bucket offer, and if any had more to offer.

    A member is (rep, component, size, sketch, fine sketch). Work is a block of rows at a time. The rank
    is the differing share of the fine sketches, in thousandths.
    """
    reps = np.array([r[0] for r in rows])
    labels = np.array([r[1] for r in rows])
    sizes = np.array([r[2] for r in rows])
    words = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
    fine = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), 2, -1)
    levels = np.array([fine_level(int(n), params.fine_members) for n in sizes])
    apart = (100 - params.percent) / (100 + params.percent)
    found: set[tuple[int, int, int]] = set()
    more = False
    for i in range(0, len(rows), 64):
        part = slice(i, i + 64)
        bits = np.zeros((len(reps[part]), len(rows)), np.int32)
        for k in range(words.shape[1]):
            bits += np.bitwise_count(words[part, k][:, None] ^ words[None, :, k])
        fits = (bits <= params.most_differing_bits) & (labels[part][:, None] != labels[None, :])
        low, high = np.minimum(sizes[part][:, None], sizes[None, :]), np.maximum(sizes[part][:, None], sizes[None, :])
        fits &= 100 * low >= params.percent * high
        left, right = np.nonzero(fits)
        if not len(left):
            continue
        level = np.maximum(levels[i + left], levels[right])
        differ = np.zeros(len(left), np.int64)
        for j in range(0, len(left), 50_000):
            a, b = i + left[j : j + 50_000], right[j : j + 50_000]
            at = level[j : j + 50_000]
            differ[j : j + 50_000] = np.bitwise_count(fine[a, at - levels[a]] ^ fine[b, at - levels[b]]).sum(axis=1)
        expected = (sizes[i + left] + sizes[right]) * apart / (1 << level)
        keep = differ <= np.where(level > 0, expected + 5 * np.sqrt(expected) + 3, expected)
        left, right, rank = left[keep], right[keep], (1000 * differ[keep] / np.maximum(expected[keep], 1e-9)).astype(np.int64)
        order = np.lexsort((reps[right], rank, left))
        left, right, rank = left[order], right[order], rank[order]
        place = np.arange(len(left)) - np.searchsorted(left, left)
        more |= bool((place >= top).any())
        for a, b, r in zip(reps[i + left[place < top]].tolist(), reps[right[place < top]].tolist(), rank[place < top].tolist()):
            found.add((min(a, b), max(a, b), r))
    # One link joins two components: of their pairs the nearest will do, and others if it is no link.
    component, offered, kept = dict(zip(reps.tolist(), labels.tolist())), Counter(), []
    for a, b, r in sorted(found, key=lambda p: (p[2], p[0], p[1])):
        between = tuple(sorted((component[a], component[b])))
        offered[between] += 1
        if offered[between] <= max(1, top // 8):
            kept.append((a, b, r))
        else:
            more = True
    return kept, more


OFFERS = "a long, b long, rank long, more boolean"


def _offer_pairs(members: DataFrame, params: Params, top: int) -> DataFrame:
    """``members`` (key, part, node, component, n_shingles, sketch) in order of (key, part).

    A pair meets in up to ``bands`` buckets, with the same rank in each: a task passes it on once.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, bool]] = set()

        def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                pairs, more = offers(rows, params, top)
                pairs = [p for p in pairs if (p[0], p[1], more) not in sent]
                if len(sent) > 1 << 20:
                    sent.clear()  # bounded; what is sent again is the same row
                sent.update((a, b, more) for a, b, _ in pairs)
                if pairs:
                    a, b, rank = map(list, zip(*pairs))
                    yield common.to_batch({"a": a, "b": b, "rank": rank, "more": [more] * len(a)}, OFFERS)

        at, rows = None, []
        for batch in common.slices(batches, 4096):
            for key, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != at:
                    yield from close(rows)
                    at, rows = (key, part), []
                rows.append(tuple(row))
        yield from close(rows)

    ordered = members.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return common.map_arrow(ordered.select("key", "part", "node", "component", "n_shingles", "sketch", "fine"), run, OFFERS)


def _confirm(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """``pairs`` (a, b) that are links on their whole sets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in common.slices(batches, 64):
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != left:
                    last = (left, shingle_set(left, params.shingle))
                other = shingle_set(right, params.shingle)
                shared = len(last[1] & other)
                if 100 * shared >= params.percent * (len(last[1]) + len(other) - shared):
                    out["a"].append(a)
                    out["b"].append(b)
            yield common.to_batch(out, "a long, b long")

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return common.map_arrow(both, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (the id is the component's)."""
    out = grouped(docs, params, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def grouped(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``text_key`` of its text, n_shingles, component_id, and ``linkable`` (it has an id and a set)."""
    signed = stored(signatures(docs, params, id_col, text_col), "signatures")
    real = signed.where("doc_id IS NOT NULL AND class IS NOT NULL")
    # One row per distinct set, with its smallest id; copies combine before the shuffle. A class is a node
    # with a number of its own, since rows may repeat an id with other texts; numbers are fixed once written.
    classes = stored(
        real.groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "sketch", "fine", "text_key"), "doc_id").alias("of"))
        .select(F.monotonically_increasing_id().alias("node"), "class", "rep", "of.*"),
        "classes",
    )
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).where("n > 1")
    meet = stored(keys.join(buckets, "key"), "buckets")
    near = meet.select("node").distinct()
    marked = stored(classes.join(near, "node", "left_semi").select("node", "n_shingles", "sketch", "fine"), "members")
    text = common.field(docs, text_col, "string")
    texts = docs.select(common.field(docs, id_col, "long").alias("rep"), text.alias("text"), text_key(text).alias("text_key"))
    wanted = stored(classes.join(near, "node", "left_semi").select("node", "rep", "text_key"), "wanted")
    # Texts that meet no other stay where they are. Repeated rows give their text once.
    texts = common.marked(texts, [F.col("rep"), F.col("text_key")], wanted.select("rep", "text_key"), "maybe").where("maybe").drop("maybe")
    texts = stored(texts.join(wanted, ["rep", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")

    labels = marked.select("node", F.col("node").alias("component"))
    tested, top, first = None, 1, True
    while True:
        members = _members(meet, marked, labels, params.block, first)
        offered = stored(_offer_pairs(members, params, top), "offers")
        pairs = offered.groupBy("a", "b").agg(F.min("rank").alias("rank"))
        if first:
            # At first one partner each will do: that of the nearest sketch over all bands.
            sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"))
            best = sides.groupBy("a").agg(F.min(F.struct("rank", "b")).alias("best")).select("a", "best.b")
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.select("a", "b")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            if first or not offered.where("more").isEmpty():
                if offered.isEmpty():
                    break
                first, top = False, top * 8
                continue
            break
        links = stored(_confirm(pairs, texts, params), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not links.isEmpty():
            labels = stored(_relabel(labels, links), "labels")
        first, top = False, top * 8

    of_node = labels.join(classes.select("node", "rep"), "node")
    least = of_node.groupBy("component").agg(F.min("rep").alias("found"))
    found = of_node.join(least, "component").select("node", "found")
    named = classes.select("class", "node", "rep").join(found, "node", "left").select("class", F.coalesce("found", "rep").alias("found"))
    out = signed.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    linkable = F.col("doc_id").isNotNull() & F.col("class").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), linkable.alias("linkable"))


def _members(meet: DataFrame, marked: DataFrame, labels: DataFrame, block: int, first: bool) -> DataFrame:
    """Bucket members with their component and the blocks of the bucket in which they take part."""
    labelled = meet.join(labels, "node")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    if first:
        everywhere = F.col("node") == F.col("center")
    else:
        center = labels.select(F.col("node").alias("center"), F.col("component").alias("center_component"))
        labelled = labelled.join(center, "center")
        # A bucket whose members all are in one component has nothing left to offer.
        mixed = labelled.where("component <> center_component").select("key").distinct()
        labelled = labelled.join(mixed, "key", "left_semi")
        everywhere = F.col("component") != F.col("center_component")
    parts = F.when(everywhere & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(own)
    placed = labelled.select("key", "node", "component", F.explode(parts).alias("part"))
    return placed.join(marked, "node").select("key", "part", "node", "component", "n_shingles", "sketch", "fine")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` between nodes have joined some of them."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = graph.components(between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return labels.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
