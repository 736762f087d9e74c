"""Phrase collocation mining: phrases whose words stick together, per language, exact at any size.

Texts are lower-cased (A-Z) and split into pieces at punctuation and line ends, pieces into words at blanks.
A phrase of two or three words that occurs ``least`` times or more is a candidate. It scores
``floor(10^6 a a / (l r))`` at its weakest cut, where a, l and r count the phrase and the parts left
and right of the cut. A candidate goes if a longer one that holds it is at least half as frequent.

1. Rabin-Karp fingerprints: over a block of texts as one byte array, prefix sums of a polynomial
   give a number for every word and, combined, for every run of 1, 2 and 3 words of a piece. Blocks add up
   equal runs, so a very common word or phrase is one row per block; the shuffle aggregates counts and
   the least occurrence pointer, a number made of the document's id and the byte offset.
   A second polynomial checks the first: runs that collide in one and not in the other stay apart.
2. Numbers that are frequent set bits in a bitmap of fixed size (``1 << bits``), which tasks read from shared storage.
   Runs of two words count only if both words are frequent, runs of three only if both pairs are: so
   rare runs, nearly all there are, do not enter the next shuffle.
3. Only frequent phrases become text: pointers set bits as well, and a last pass over the texts cuts out the runs
   whose pointer may be wanted. Joining them with the counts leaves one text per phrase, and verifies it: of runs that collide in the
   first number each has a text of its own. What the bitmaps let pass by chance costs work and changes no count.
4. Parts, scores and ranks are joins over frequent phrases only. A part that very many phrases share
   is joined by broadcast (:func:`common.spread_join`).

Cases: null texts are empty; a null language is ``und``. Texts of any length are whole: long ones are
hashed in blocks that end where a piece ends. Repeated rows count each time. Ties are broken by
count and then by the phrase's UTF-8 bytes. Languages without a candidate, and an empty table, give no rows. Other
columns are not looked at. Counts up to 10^15 are scored exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appwatch.llm import common
from appwatch.llm.common import stored
from appwatch.llm.minhash import mix
from appwatch.session import scratch_path

# What ends a piece, and what stands between words.
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CLASS = bytes(2 if c in STOPS else 1 if c in BLANKS else 0 for c in range(256))
_STOP = re.compile(b"[" + re.escape(STOPS) + b"]")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses


@dataclass(frozen=True)
class Params:
    least: int = 10
    longest: int = 3  # words
    top: int = 2000
    bits: int = 27  # bitmap of frequent numbers: 16 MB
    block: int = 1 << 18  # bytes hashed at a time
    held: int = 1 << 19  # numbers a task holds before it passes them on
    fingerprint_bits: int = 64  # fewer only in tests, to force collisions


class _Powers:
    """Powers of the bases and of their inverses, as long as needed so far."""

    size = 0
    tables: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def upto(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if cls.size < n:
            cls.size = 1 << (n - 1).bit_length()

            def powers(base: int) -> np.ndarray:
                out = np.full(cls.size, base, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            cls.tables = [(powers(b), powers(pow(b, -1, 1 << 64))) for b in _BASES]
        return cls.tables


class Block:
    """Texts as one array: words, the piece and text each is in, and fingerprints of runs of words."""

    def __init__(self, texts: list[bytes], langs: list[bytes], params: Params, where: list[tuple[int | None, int]] | None = None):
        self.params = params
        self.where = where  # document and offset of each text
        self.raw = b"".join(t + b"\n" for t in texts).translate(LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        kinds = np.frombuffer(self.raw.translate(CLASS), np.uint8)
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = kinds == 0
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.of_text = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[self.starts]
        self.langs = langs
        self._data = data
        self._words: dict[int, np.ndarray] = {}
        self._levels: dict[tuple[int, int], np.ndarray] = {}

    def words(self, which: int) -> np.ndarray:
        """A number per word: its bytes' polynomial, from prefix sums."""
        if which in self._words:
            return self._words[which]
        up, down = _Powers.upto(len(self._data) + 1)[which]
        sums = np.zeros(len(self._data) + 1, np.uint64)
        np.cumsum((self._data + np.uint64(1)) * up[: len(self._data)], out=sums[1:])
        self._words[which] = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        return self._words[which]

    def level(self, n: int, which: int = 0) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words from each word on, those that leave the piece included."""
        if (n, which) not in self._levels:
            if n == 0:
                found = np.array([xxhash.xxh64_intdigest(lang, which) for lang in self.langs], np.uint64)[self.of_text]
            else:
                words = self.words(which)
                found = self.level(n - 1, which)[: max(0, len(words) - n + 1)] * np.uint64(_BASES[which]) + words[n - 1 :]
            self._levels[n, which] = found
        return self._levels[n, which]

    def numbers(self, n: int, which: int = 0) -> np.ndarray:
        made = mix(self.level(n, which) + np.uint64(n))
        spare = 64 - self.params.fingerprint_bits
        return made >> np.uint64(spare) << np.uint64(spare) if spare and which == 0 else made

    def checks(self, n: int) -> np.ndarray:
        return (self.numbers(n, 1) >> np.uint64(33)).astype(np.int32)

    def pointers(self) -> np.ndarray:
        """A number for the place of each word: document and byte offset."""
        docs = np.array([hash_id(doc_id) for doc_id, _ in self.where], np.uint64)
        offsets = np.array([at for _, at in self.where], np.int64) - self.text_starts
        return mix(docs[self.of_text] + (self.starts + offsets[self.of_text]).astype(np.uint64))

    def inside(self, n: int) -> np.ndarray:
        """Which runs of ``n`` words lie in one piece."""
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + n)).decode("utf-8", "replace")


def hash_id(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True))


def _cuts(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A text as parts of about ``size`` bytes, with their offsets; pieces stay whole."""
    at = 0
    while len(text) - at > size and (stop := _STOP.search(text, at + size)):
        yield at, text[at : stop.end()]
        at = stop.end()
    yield at, text[at:] if at else text


def _blocks(batches, params: Params) -> Iterator[Block]:
    texts, langs, where, size = [], [], [], 0
    for batch in common.slices(batches):
        for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for at, part in _cuts(text, params.block):
                texts.append(part)
                langs.append(lang)
                where.append((doc_id, at))
                size += len(part) + 1
                if size >= params.block:
                    yield Block(texts, langs, params, where)
                    texts, langs, where, size = [], [], [], 0
    if texts:
        yield Block(texts, langs, params, where)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _summed(numbers: np.ndarray, checks: np.ndarray, counts: np.ndarray, pointers: np.ndarray) -> Runs:
    """Equal neighbours in order of their number as one: counts added, least pointer."""
    if not len(numbers):
        return numbers, checks, counts, pointers
    order = np.argsort(numbers)
    numbers, checks = numbers[order], checks[order]
    first = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (checks[1:] != checks[:-1])])
    return numbers[first], checks[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(pointers[order], first)


_bitmaps: dict[str, np.ndarray] = {}


def _bitmap(path: str, bits: int) -> np.ndarray:
    """A stored bitmap, read once per process; processes keep those of one mining run."""
    if path not in _bitmaps:
        table = common.side_table(path, ["bucket", "bits"])
        whole = np.zeros(max(1, (1 << bits) >> 15) << 12, np.uint8)
        for bucket, part in zip(table["bucket"].to_pylist(), table["bits"].to_pylist()):
            whole[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(part, np.uint8)
        while len(_bitmaps) >= 5:
            _bitmaps.pop(next(iter(_bitmaps)))
        _bitmaps[path] = whole
    return _bitmaps[path]


def _has(place: np.ndarray, path: str, bits: int) -> np.ndarray:
    return (_bitmap(path, bits)[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent(numbers: np.ndarray, path: str, bits: int) -> np.ndarray:
    return _has(numbers >> np.uint64(64 - bits), path, bits)


def _pointed(pointers: np.ndarray, path: str, bits: int) -> np.ndarray:
    """Two bits of the map stand for a pointer."""
    return _frequent(pointers, path, bits) & _frequent(pointers << np.uint64(bits), path, bits)


RUNS = "fingerprint long, check int, n long, pointer long"


def count_runs(texts: DataFrame, n: int, below: str | None, params: Params) -> DataFrame:
    """Runs of ``n`` words whose parts are frequent by the bitmap ``below``, by task: fingerprint, check, count and least pointer."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []

        def merged() -> Runs:
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def out(numbers, checks, counts, pointers) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(numbers), 1 << 16):
                j = i + (1 << 16)
                columns = [numbers[i:j].view(np.int64), checks[i:j], counts[i:j], pointers[i:j].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fingerprint", "check", "n", "pointer"])

        for block in _blocks(batches, params):
            keep = block.inside(n)
            if below is not None and len(keep):
                parts = _frequent(block.numbers(n - 1), below, params.bits)
                keep &= parts[:-1] & parts[1:]
            at = np.flatnonzero(keep)
            held.append(_summed(block.numbers(n)[at], block.checks(n)[at], np.ones(len(at), np.int64), block.pointers()[at]))
            if sum(len(x[0]) for x in held) >= params.held:
                held = [merged()]
                if len(held[0][0]) >= params.held // 2:
                    yield from out(*held.pop())
        if held:
            yield from out(*merged())

    return common.map_arrow(texts, run, RUNS)


def frequent_runs(texts: DataFrame, n: int, below: str | None, params: Params) -> DataFrame:
    """The runs of ``n`` words that occur ``least`` times or more: ``fingerprint``, ``check``, ``f``, ``pointer``; written once."""
    counted = count_runs(texts, n, below, params).groupBy("fingerprint", "check")
    summed = counted.agg(F.sum("n").alias("f"), F.min("pointer").alias("pointer"))
    return stored(summed.where(F.col("f") >= params.least), "frequent-runs")


def _store_bitmap(numbers: DataFrame, params: Params) -> str:
    """Numbers, by their first ``bits`` bits, as a bitmap of fixed size in the shared folder."""
    place = F.shiftrightunsigned("number", 64 - params.bits) + 1
    path = scratch_path(numbers.sparkSession, "bitmap")
    bitmap = numbers.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
    bitmap.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).write.parquet(path)
    return path


PHRASES = "lang string, words int, phrase string, n long, fingerprint long, check int, pointer long, doc_id long, start long"


def materialise(texts: DataFrame, bitmaps: list[str], pointed: str, params: Params) -> DataFrame:
    """Text of the frequent runs that may be pointed at. Rows with 0 words have the words of a language in a task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        names = [f.split()[0] for f in PHRASES.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return common.to_batch(dict(zip(names, map(list, zip(*rows)))) if rows else {x: [] for x in names}, PHRASES)

        for block in _blocks(batches, params):
            for lang, words in zip(block.langs, np.bincount(block.of_text, minlength=len(block.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + words
            places, rows = block.pointers(), []
            for n in range(1, params.longest + 1):
                at = np.flatnonzero(block.inside(n) & _pointed(places[: max(0, len(places) - n + 1)], pointed, params.bits))
                at = at[_frequent(block.numbers(n)[at], bitmaps[n - 1], params.bits)]
                ids = (block.numbers(n)[at].view(np.int64).tolist(), block.checks(n)[at].tolist(), places[at].view(np.int64).tolist())
                for i, *numbers in zip(at.tolist(), *ids):
                    text = block.of_text[i]
                    doc_id, offset = block.where[text]
                    lang = block.langs[text].decode("utf-8", "replace")
                    rows.append((lang, n, block.phrase(i, n), None, *numbers, doc_id, offset + int(block.starts[i] - block.text_starts[text])))
            yield out(rows)
        yield out([(lang.decode("utf-8", "replace"), 0, "", n, *[None] * 5) for lang, n in totals.items()])

    return stored(common.map_arrow(texts, run, PHRASES), "pointed-runs")


def phrases(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All phrases of up to ``longest`` words with their exact counts, if ``least`` or more; written once."""
    texts = docs.select(
        common.field(docs, id_col, "long").alias("doc_id"),
        F.coalesce(common.field(docs, lang_col, "string"), F.lit("und")).cast("binary").alias("lang"),
        F.coalesce(common.field(docs, text_col, "string"), F.lit("")).cast("binary").alias("text"),
    )
    levels: list[DataFrame] = []
    bitmaps: list[str] = []
    for n in range(1, params.longest + 1):
        levels.append(frequent_runs(texts, n, bitmaps[-1] if bitmaps else None, params))
        bitmaps.append(_store_bitmap(levels[-1].select(F.col("fingerprint").alias("number")), params))
    runs = reduce(DataFrame.unionByName, [level.withColumn("words", F.lit(n)) for n, level in enumerate(levels, 1)])
    places = runs.select(F.explode(F.array("pointer", F.shiftleft("pointer", params.bits))).alias("number"))
    found = materialise(texts, bitmaps, _store_bitmap(places, params), params)
    key = ["words", "fingerprint", "check"]
    # Repeated rows have their pointers in common; any of them gives the text.
    named = found.where("words > 0").join(runs, [*key, "pointer"]).dropDuplicates(key)
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("f"))
    return stored(
        named.select("lang", "words", "phrase", "f", "doc_id", "start").unionByName(
            totals.select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), "f"), allowMissingColumns=True
        ),
        "phrases",
    )


def collocations(found: DataFrame, params: Params = Params()) -> DataFrame:
    """The best phrases of each language from exact counts: ``lang, rank, phrase, a, l, r, n, score``, and one occurrence."""
    counts = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1").withColumnRenamed("f", "a")
    split = candidates.select("lang", "phrase", "words", "a", F.split("phrase", " ", -1).alias("w"))

    # What a longer candidate holds: all shorter runs of its words.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")),
        )
    )
    held = split.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    split = split.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")

    cuts = split.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = stored(common.spread_join(cuts, counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]), "cuts")
    # Products pass 64 bits: decimals of 38 digits hold them.
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    product = (wide["a"] * wide["a"]).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.call_function("div", product, (wide["l"] * wide["r"]).cast("decimal(32,0)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.top)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    place = found.where("words > 1").select("lang", "phrase", "doc_id", "start")
    return ranked.join(totals, "lang").join(place, ["lang", "phrase"]).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "doc_id", "start"
    )
