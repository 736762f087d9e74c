"""Alignment of two tokenizers over the same texts, and which of their tokens go together in the corpus.

A is a byte-level tokenizer given a space and the text, B a piece tokenizer that adds the space itself.
Both spell the same bytes, so byte offsets where a token of each ends cut the tokens into groups. The
two tokens that end at a cut are linked; a pair of ids counts as often as it is linked anywhere.

Fragments form a monoid. A fragment is what is known of a byte range of a document: its *open prefix* (tokens up to
the first cut in it), its *closed groups*, and its *open suffix* (tokens after the last cut); a range
without a cut is open throughout. Two neighbours compose to the fragment of the joint range: the suffix
of one and the prefix of the other become a group. That is associative, so the ranges of a long document are
encoded by different tasks and composed in a tree, ``fan_in`` at a time, by shuffles.

Tokens do not cross a single space between two other characters, whichever tokenizer: the range's
tokens come from a window that reaches to such spaces on both sides. Within a range, and for texts that are
one range, the words between such spaces are themselves fragments without open ends; each process keeps those of the words it saw,
and when they are too many, of those it saw again. New words are encoded many to a text.

1. One pass encodes short texts and cuts long ones into windows; windows are dealt over the cluster, encoded and composed.
2. Links are counted by task and summed by Spark. Linked tokens end together, so one's bytes are an end of
   the other's: there are at most as many pairs as tokens have bytes (:meth:`Tokenizers.most_pairs`), whatever
   the corpus. That table is read by tasks from shared storage.
3. A last pass looks up each document's links.

Cases: null and empty texts have no tokens: zeros and an empty digest; so have texts that a tokenizer does not
spell byte for byte, such as those with U+2581. Strings of special tokens are plain text. Texts of any length are
whole; one without any space is one range. Repeated rows count each time. An empty table gives an
empty result. Other columns are not looked at. Models in which a piece goes on after a space are refused.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.llm import common
from appwatch.llm.common import stored
from appwatch.session import scratch_path

#: A space that no token crosses from the left: it begins a token of both.
SAFE = re.compile(r" (?<=\S )(?=\S)")  # the space first, which the search then looks for


@dataclass(frozen=True)
class Params:
    range_chars: int = 1 << 16  # longer texts are encoded range by range
    fan_in: int = 16
    cached: int = 1 << 18  # words a process keeps the fragments of
    cached_chars: int = 48  # longer words are not kept


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others follow from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Fragment:
    """What a byte range of a document holds. Without a cut, all tokens are in the prefix."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    faithful: bool = True
    cut: bool = False
    prefix_a: list[int] = field(default_factory=list)
    prefix_b: list[int] = field(default_factory=list)
    closed: str = ""  # groups as text, each with a ; after it
    suffix_a: list[int] = field(default_factory=list)
    suffix_b: list[int] = field(default_factory=list)
    links: bytes = b""


def group_text(a: Iterable[int], b: Iterable[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))};"


def compose(parts: Iterable[Fragment]) -> Fragment:
    """The fragment of neighbouring ranges, in order; none give the empty fragment."""
    whole, closed, links = Fragment(), [], []
    for f in parts:
        whole.n_a, whole.n_b, whole.n_groups = whole.n_a + f.n_a, whole.n_b + f.n_b, whole.n_groups + f.n_groups
        whole.faithful &= f.faithful
        links.append(f.links)
        if not whole.cut:
            whole.prefix_a, whole.prefix_b = whole.prefix_a + f.prefix_a, whole.prefix_b + f.prefix_b
        elif f.cut:
            closed.append(group_text(whole.suffix_a + f.prefix_a, whole.suffix_b + f.prefix_b))
        else:
            whole.suffix_a, whole.suffix_b = whole.suffix_a + f.prefix_a, whole.suffix_b + f.prefix_b
        if f.cut:
            closed.append(f.closed)
            whole.cut, whole.suffix_a, whole.suffix_b = True, list(f.suffix_a), list(f.suffix_b)
    whole.closed, whole.links = "".join(closed), b"".join(links)
    return whole


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and the fragments of words seen."""

    def __init__(self, a_path: str, b_path: str, params: Params = Params()):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.params = params
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces that go on after a space: words cannot be encoded one by one")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        self.size_a, self.size_b = size_a, size_b
        self.links = np.dtype("<i4" if size_a * size_b < 1 << 31 else "<i8")
        # How an id is written inside a group and at the end of its side of it.
        self.written = [f"{i}{e}" for i in range(size_a) for e in ",|"] + [f"{i}{e}" for i in range(size_b) for e in ",;"]
        self.letters = np.array([len(w) for w in self.written])
        self.words: dict[str, tuple] = {}
        self.again: set[str] = set()  # those asked for by more than one call
        self.long: list[str] = []  # those to go at the next call

    def most_pairs(self) -> int:
        """More pairs than this cannot be linked: the bytes of one token end with those of the other, and
        at most two ids of a vocabulary have the same bytes."""
        return 2 * int(self.a_len.sum() + self.b_len.sum())

    def _arrays(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space which is not in ``texts``."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def _spelt(self, a, b, data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end at or before the last cut, as places in ``written``, in order; where groups end there; links."""
        in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        codes = np.empty(len(a) + len(b), np.int64)
        # Before a token come those of its own side, and the other side's of earlier groups (for B: of its own too).
        codes[np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")] = 2 * a + (ends_a == cuts[in_a])
        codes[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = 2 * (self.size_a + b) + (ends_b == cuts[in_b])
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = a[last_a] * self.size_b + b[last_b]
        return codes, last_a + last_b + 2, links.astype(self.links)

    def _text(self, codes: np.ndarray) -> str:
        return "".join(map(self.written.__getitem__, codes.tolist()))

    def learn(self, words: list[str], together: int = 64) -> dict[str, tuple]:
        """Words to (groups as text, links, tokens of A, of B); None for a text that is not spelt byte for byte.

        ``together`` words are encoded as one text with single spaces between them, which no token crosses. A word for which
        that does not hold, with white space at an end, is encoded alone; so are all of a text that is not spelt.
        """
        alone = [w for w in words if w.strip() != w or len(w) > self.params.cached_chars] if together > 1 else []
        found = self.learn(alone, 1) if alone else {}
        words = [w for w in words if w not in found] if alone else words
        runs = [words[i : i + together] for i in range(0, len(words), together)]
        if not runs:
            return found
        texts = [" ".join(run) for run in runs]
        a, b = self._arrays(texts)
        data = [(" " + t).encode() for t in texts]
        good = [self._spelt(x, y, d) for x, y, d in zip(a, b, data)]
        if not all(good):
            rest = [w for run, g in zip(runs, good) if not g for w in run]
            found |= self.learn(rest, 1) if together > 1 else dict.fromkeys(rest, (None, b"", 0, 0))
            a, b, runs = list(compress(a, good)), list(compress(b, good)), list(compress(runs, good))
            words = [w for run in runs for w in run]
        if not words:
            return found
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))) for ids in (a, b))
        # All words in a row: every word's end is a cut.
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True, kind="table")]
        upto = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        upto_a, upto_b = np.searchsorted(ends_a, upto) + 1, np.searchsorted(ends_b, upto) + 1
        codes, _, links = self._aligned(flat_a, flat_b, ends_a, ends_b, cuts)
        letters = np.cumsum(self.letters[codes])
        width = self.links.itemsize

        def between(whole, ends: np.ndarray) -> list:
            ends = ends.tolist()
            return [whole[low:high] for low, high in zip([0, *ends], ends)]

        groups = between(self._text(codes), letters[upto_a + upto_b - 1])
        packed = between(links.tobytes(), (np.searchsorted(cuts, upto) + 1) * width)
        counts = (np.diff(upto_a, prepend=0).tolist(), np.diff(upto_b, prepend=0).tolist())
        found.update(zip(words, zip(groups, packed, *counts)))
        return found

    def _seen(self, wanted: set[str]) -> None:
        """Put the entries of ``wanted`` among the words seen. When these are too many, those asked for once only go."""
        for w in self.long:
            del self.words[w]
        new = wanted.difference(self.words)
        held = wanted - new
        self.long = [w for w in new if len(w) > self.params.cached_chars]
        self.again |= held
        if len(self.words) + len(new) > self.params.cached:
            kept = self.again if len(self.again) <= self.params.cached // 2 else held
            self.words = {w: self.words[w] for w in kept}
            self.again = set()
        self.words.update(self.learn(list(new)))

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """Tokens of A and of B, groups, groups as text and links of whole texts."""
        split = [SAFE.split(t) if t else [] for t in texts]
        wanted = set().union(*split)
        self._seen(wanted)
        known = self.words.__getitem__
        for words in split:
            entries = list(map(known, words))
            written = [e[0] for e in entries]
            if not words or None in written:
                yield 0, 0, 0, "", b""
                continue
            links = b"".join([e[1] for e in entries])
            groups = len(links) // self.links.itemsize
            yield sum([e[2] for e in entries]), sum([e[3] for e in entries]), groups, "".join(written), links

    def fragment(self, window: str, low: int, high: int) -> Fragment:
        """The fragment of the bytes from ``low`` to ``high`` of a window that begins with a space."""
        (a,), (b,) = self._arrays([window[1:]])
        faithful = self._spelt(a, b, window.encode())
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(cuts) or not faithful:
            return Fragment(len(a), len(b), 0, faithful, False, a.tolist(), b.tolist())
        kept_a, kept_b = ends_a <= cuts[-1], ends_b <= cuts[-1]
        codes, ends, links = self._aligned(a[kept_a], b[kept_b], ends_a[kept_a], ends_b[kept_b], cuts)
        return Fragment(
            len(a), len(b), len(cuts), True, True,
            a[ends_a <= cuts[0]].tolist(), b[ends_b <= cuts[0]].tolist(), self._text(codes[ends[0] :]),
            a[~kept_a].tolist(), b[~kept_b].tolist(), links.tobytes(),
        )


def windows(text: str, size: int) -> list[tuple[str, int, int]]:
    """A text with a space before it as ranges of about ``size`` characters: window, and the range's bytes within it."""
    whole, out, at = " " + text, [], 0
    while at < len(whole):
        end = min(len(whole), at + size)
        after = SAFE.search(whole, end) if end < len(whole) else None
        right = after.start() if after else len(whole)
        if right - end > size:  # one word: its other ranges would encode it again
            end = right
        left = at
        while left and not SAFE.match(whole, left):
            left = max(whole.rfind(" ", 0, left), 0)
        low = len(whole[left:at].encode())
        out.append((whole[left:right], low, low + len(whole[at:end].encode())))
        at = end
    return out


_loaded: dict[tuple, Tokenizers] = {}


def _load(a_name: str, b_name: str, params: Params) -> Tokenizers:
    key = (a_name, b_name, params)
    if key not in _loaded:
        _loaded[key] = Tokenizers(SparkFiles.get(a_name), SparkFiles.get(b_name), params)
    return _loaded[key]


DONE = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
PARTS = DONE + ", row long, part long, parts long, window string, low long, high long"
FRAGMENTS = (
    "doc_id long, row long, part long, n_a long, n_b long, n_groups long, faithful boolean, cut boolean, prefix_a array<int>, "
    "prefix_b array<int>, closed string, suffix_a array<int>, suffix_b array<int>, links binary"
)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return common.to_batch(dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}, schema)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else ""


def encode(docs: DataFrame, names: tuple[str, str], params: Params, id_col: str, text_col: str) -> DataFrame:
    """Short texts done, long ones as the windows of their ranges; written once."""
    texts = docs.select(
        common.field(docs, id_col, "long").alias("doc_id"),
        common.field(docs, text_col, "string").cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("row"),  # only tells rows apart; fixed once written
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        both = _load(*names, params)
        for batch in common.slices(batches):
            ids, raws, rows = (c.to_pylist() for c in batch.columns)
            out, short = [], []
            for doc_id, raw, row in zip(ids, raws, rows):
                text = (raw or b"").decode("utf-8", "replace")
                if len(text) <= params.range_chars:
                    short.append((doc_id, row, text))
                    continue
                ranges = windows(text, params.range_chars)
                for i, (window, low, high) in enumerate(ranges):
                    out.append((doc_id, None, None, None, None, None, row, i, len(ranges), window, low, high))
                    if len(out) * params.range_chars > 1 << 24:
                        yield _batch(out, PARTS)
                        out = []
            for (doc_id, row, _), (a, b, groups, text, links) in zip(short, both.documents([t for _, _, t in short])):
                out.append((doc_id, a, b, groups, _digest(text), links, row, 0, 0, None, None, None))
            yield _batch(out, PARTS)

    return stored(common.map_arrow(texts, run, PARTS), "alignment-parts")


def fragments(parts: DataFrame, names: tuple[str, str], params: Params) -> DataFrame:
    """The windows of long texts, dealt over the cluster and encoded."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        both = _load(*names, params)
        for batch in common.slices(batches, 16):
            rows = []
            for doc_id, row, part, window, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                f = both.fragment(window, low, high)
                rows.append((doc_id, row, part, *(getattr(f, name) for name in f.__dataclass_fields__)))
            yield _batch(rows, FRAGMENTS)

    dealt = parts.where("parts > 0").select("doc_id", "row", "part", "window", "low", "high")
    return common.map_arrow(dealt.repartition("row", "part"), run, FRAGMENTS)


def reduce_tree(pieces: DataFrame, params: Params, most: int) -> DataFrame:
    """One fragment per long text: neighbours compose, ``fan_in`` at a time; ``most`` is the longest row of them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in common.slices(batches, 16) for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (row, part), same in groupby(rows, key=lambda r: (r[1], r[2] // params.fan_in)):
            ids: list = []
            whole = compose(Fragment(*r[3:]) for r in same if not ids.append(r[0]))
            yield _batch([(ids[0], row, part, *(getattr(whole, n) for n in whole.__dataclass_fields__))], FRAGMENTS)

    while most > 1:
        group = F.floor(F.col("part") / params.fan_in)
        pieces = common.map_arrow(pieces.repartition("row", group).sortWithinPartitions("row", "part"), run, FRAGMENTS)
        most = -(-most // params.fan_in)
    return pieces


def finish(whole: DataFrame) -> DataFrame:
    """Fragments of whole texts as finished rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16):
            rows = []
            for doc_id, _, _, *values in zip(*(c.to_pylist() for c in batch.columns)):
                f = Fragment(*values)
                text = group_text(f.prefix_a, f.prefix_b) + f.closed if f.faithful and f.cut else ""
                rows.append((doc_id, f.n_a, f.n_b, f.n_groups, _digest(text), f.links) if text else (doc_id, 0, 0, 0, "", b""))
            yield _batch(rows, DONE)

    return common.map_arrow(whole, run, DONE)


def count_pairs(done: DataFrame, kind: np.dtype) -> DataFrame:
    """``link`` and ``n``: how often each pair is linked in the corpus."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            links, counts = np.unique(np.frombuffer(b"".join(held), kind), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(links.astype(np.int64)), pa.array(counts)], ["link", "n"])

        held, size = [], 0
        for batch in batches:
            for links in batch.column(0).to_pylist():
                held.append(links)
                size += len(links)
                if size > 1 << 24:
                    yield out()
                    held, size = [], 0
        yield out()

    return common.map_arrow(done.select("links"), run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def look_up(done: DataFrame, path: str, kind: np.dtype) -> DataFrame:
    """Each document with the sums over its links of the counts in the table at ``path``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = common.side_table(path, ["link", "n", "best"]).sort_by("link")
        known, counts = table["link"].to_numpy(), table["n"].to_numpy()
        best = table["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in common.slices(batches, 2048):
            doc_id, n_a, n_b, n_groups, digest, packed = (c.to_pylist() for c in batch.columns)
            links = np.frombuffer(b"".join(packed), kind)
            at = np.searchsorted(known, links)
            ends = np.cumsum([len(p) // kind.itemsize for p in packed])
            n_links = np.diff(ends, prepend=0)

            def sums(values: np.ndarray) -> list[int]:
                running = np.concatenate([[0], np.cumsum(values)])
                return (running[ends] - running[ends - n_links]).tolist()

            columns = (doc_id, n_a, n_b, n_groups, n_links.tolist(), sums(best[at]), sums(counts[at]), digest)
            yield common.to_batch(dict(zip((f.split()[0] for f in RESULT.split(", ")), columns)), RESULT)

    return common.map_arrow(done, run, RESULT)


def align(
    docs: DataFrame, a_path: str, b_path: str, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: tokens of A and B, groups, links, how many are the best of their B id, the sum of
    their corpus-wide counts, and the digest of the groups written as ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    names = tuple(p.rsplit("/", 1)[-1] for p in (a_path, b_path))
    for path in (a_path, b_path):
        spark.sparkContext.addFile(path)
    both = Tokenizers(a_path, b_path, params)
    kind = both.links
    parts = encode(docs, names, params, id_col, text_col)
    columns = [f.split()[0] for f in DONE.split(", ")]
    done = parts.where("parts = 0").select(*columns)
    if most := parts.agg(F.max("parts")).first()[0]:
        done = done.unionByName(stored(finish(reduce_tree(fragments(parts, names, params), params, most)), "alignment-long"))
    pairs = count_pairs(done, kind)
    b = F.col("link") % both.size_b
    best = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    path = scratch_path(spark, "alignment-pairs")
    counted = pairs.withColumn("b", b).join(best, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))
    counted.write.parquet(path)
    return look_up(done, path, kind)
