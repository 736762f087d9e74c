"""Toxicity of documents by a subsequence string kernel machine over words, with Nyström landmarks.

The kernel of two words counts the subsequences of three signs they share, each weighted by
``decay`` to the power of its span, so letters that are left out, put in or separated cost a little
but do not hide a word. Spans reach ``span`` signs at most. Words are first brought to a small
alphabet of lower-case letters, with marks for their start and end.

Training takes a bounded sample of labelled sentences. Words that sentences of toxic documents have
far more often than clean ones are the first witnesses; landmarks are spread over witnesses and common clean words;
words become Nyström features, and a linear machine with squared hinge loss separates them. As in
multiple-instance learning, it then finds further witnesses, and the clean words it mistakes are added.

The machine's value of a word is a weighted sum over landmarks, each a sum over subsequences. Summed
over the landmarks once, it is one weight per subsequence, so scoring a word costs about ten table
look-ups per sign, whatever the number of landmarks. Values are calibrated on sentences that the
machine was not fitted to: each range of values has a log ratio of its rates in toxic and clean
sentences. A document's log odds are the sum over its distinct words: one plain insult is enough in a text of some
hundred words, while a word that is only like one needs company. Clean words count a little against
toxicity each, so in a text of very many different words a single insult is outvoted. If no word passes the rule for
first witnesses, there is nothing to fit and every document has the share of toxic sentences as its score.

Cases: a null or empty text has the prior score. Rows without label, and labels other than 0 and
1, do not train. Without both classes to learn from, all scores are the share of toxic labels, or 0
without labels. Ids may be null (such rows are scored, and never train) or repeated. Texts are scored
whole. Other columns, and all columns but the text, are never part of a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.llm import common

BITS = 6
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"  # fixed value: letters told apart from their plain forms
BIAS = -1.0
EDGES = np.array([-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 0.9])  # borders of the calibrated ranges
START, END, DIGIT, SIGN, OTHER = 59, 60, 61, 62, 63


@dataclass(frozen=True)
class Params:
    """The sample is bounded by documents and by sentences of each class, taken in order of a hash."""

    sample_documents: int = 2500
    sample_sentences: int = 40_000
    longest_sentence: int = 400
    span: int = 6
    decay: float = 0.6
    landmarks: int = 240
    negatives: int = 8000
    ridge: float = 1e-5
    rounds: int = 3
    prior: float = -2.0
    cache: int = 400_000


def _letter(code: int) -> int:
    c = chr(code).lower()[:1]
    if c in ACCENTED:
        return 26 + ACCENTED.index(c)
    c = unicodedata.normalize("NFKD", c)[:1]
    if "a" <= c <= "z":
        return ord(c) - 97
    return DIGIT if c.isdigit() else OTHER if c.isalpha() else SIGN


_ALPHABET = np.array([_letter(i) for i in range(0x250)] + [OTHER], np.int64)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words without signs around them."""
    return {_EDGE.sub("", w) for w in set(text.lower().split())} - {""} if text else set()


def _pairs(text: str) -> set[tuple[str, str]]:
    """Each word with the one before it."""
    tokens = [_EDGE.sub("", w) for w in text.lower().split()]
    return {(a, b) for a, b in zip(["", *tokens], tokens) if b}


def occurrences(words: list[str], span: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence number and weight of each subsequence of three signs, word by word."""
    joined = "\x01".join(["", *words, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    signs = _ALPHABET[np.minimum(codes, 0x250)]
    breaks = np.flatnonzero(codes == 1)
    # Each word is laid out as start, signs, end; one break between words becomes both marks.
    lengths = np.diff(breaks) - 1
    total = int(lengths.sum()) + 2 * len(words)
    line = np.empty(total, np.int64)
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    ends = np.cumsum(lengths + 2)
    line[ends - 1] = END
    line[ends - lengths - 2] = START
    inside = np.ones(total, bool)
    inside[ends - 1] = inside[ends - lengths - 2] = False
    line[inside] = np.delete(signs, breaks)
    found = []
    for j, k in combinations(range(1, span), 2):
        n = total - k
        if n <= 0:
            continue
        same = np.flatnonzero(owner[:n] == owner[k : k + n])
        number = line[same] << 2 * BITS | line[same + j] << BITS | line[same + k]
        found.append((owner[same], number, np.full(len(same), decay ** (k + 1))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def features(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`occurrences` with each subsequence once per word, weights scaled to unit length."""
    owner, number, weight = occurrences(words, params.span, params.decay)
    both, place = np.unique(owner << 3 * BITS | number, return_inverse=True)
    weight = np.bincount(place, weight, len(both))
    owner, number = both >> 3 * BITS, both & ((1 << 3 * BITS) - 1)
    norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
    return owner, number, weight / norm[owner]


def kernel(words: list[str], landmarks: list[str], params: Params) -> np.ndarray:
    """Normalised kernel of words (rows) and landmarks (columns)."""
    owner, number, weight = features(landmarks, params)
    used, place = np.unique(number, return_inverse=True)
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # the last row stands for all others
    table[place, owner] = weight
    out = np.zeros((len(words), len(landmarks)))
    for i in range(0, len(words), 200):
        part = words[i : i + 200]
        owner, number, weight = features(part, params)
        at = np.searchsorted(used, number)
        number = np.where(used[np.minimum(at, len(used) - 1)] == number, at, len(used))
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[i + owner[starts]] = np.add.reduceat(table[number] * weight[:, None].astype(np.float32), starts)
    return out


@dataclass
class Machine:
    """One weight per subsequence, and the value of a word that has none of them."""

    weights: np.ndarray
    bias: float
    params: Params
    constant: float | None = None
    ratios: np.ndarray | None = None

    def values(self, words: list[str]) -> np.ndarray:
        """Machine values, some thousand words at a time. Sums below zero are not scaled: none is a worst word."""
        parts = [self._values(words[i : i + 5000]) for i in range(0, len(words), 5000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _values(self, words: list[str]) -> np.ndarray:
        owner, number, weight = occurrences(words, self.params.span, self.params.decay)
        sums = np.bincount(owner, weight * self.weights[number], len(words))
        values = self.bias + np.minimum(sums, 0)
        positive = np.flatnonzero(sums > 0)
        if len(positive):
            chosen = [words[i] for i in positive]
            owner, number, weight = occurrences(chosen, self.params.span, self.params.decay)
            both, place = np.unique(owner << 3 * BITS | number, return_inverse=True)
            norm = np.sqrt(np.bincount(both >> 3 * BITS, np.bincount(place, weight, len(both)) ** 2, len(chosen)))
            values[positive] = self.bias + sums[positive] / norm
        return values

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log ratio of toxic to clean for each word."""
        return self.ratios[np.searchsorted(EDGES, self.values(words))]

    def score(self, evidence: float) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-min(max(self.params.prior + evidence, -500.0), 500.0))))


def _spread(words: list[str], n: int, params: Params) -> list[str]:
    """``n`` words, each the one least like those before it; the first is the given first."""
    if len(words) <= n:
        return list(words)
    chosen, like = [0], kernel(words, [words[0]], params)[:, 0]
    while len(chosen) < n:
        at = int(np.argmin(like))
        chosen.append(at)
        like = np.maximum(like, kernel(words, [words[at]], params)[:, 0])
        like[chosen] = 2
    return [words[i] for i in chosen]


def _separate(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge machine by Newton steps on the rows inside the margin, with its bias fixed at ``BIAS``.

    So a word that is like no landmark is harmless.
    """
    scale = ridge * cost.sum()

    def loss(w: np.ndarray) -> float:
        return float(scale * (w @ w) + cost @ np.maximum(0, 1 - y * (x @ w + BIAS)) ** 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(60):
        active = y * (x @ w + BIAS) < 1
        xa, ca, ya = x[active], cost[active], y[active]
        hessian = xa.T @ (xa * ca[:, None]) + scale * np.eye(len(w))
        step = np.linalg.solve(hessian, xa.T @ (ca * (ya - BIAS))) - w
        size = 1.0
        while (new := loss(w + size * step)) >= now and size > 1e-4:
            size /= 2
        if new >= now * (1 - 1e-6):
            break
        w, now = w + size * step, new
    return w


def train(sentences: list[tuple[int, str]], params: Params = Params()) -> Machine:
    """Fit to (label, sentence) rows.

    A word counts once for each word it follows. Copies of a document, exact or near, repeat its words
    in the same places, so they do not make a word stand out, while insults turn up anywhere.
    """
    everything = sorted(set(sentences))
    sentences = [s for s in everything if hash_of(s[1]) % 3]
    sets = [(label, words_of(text)) for label, text in sentences]
    toxic, clean = (Counter(w for _, w in {p for label, text in sentences if label == of for p in _pairs(text)}) for of in (1, 0))
    n_toxic = sum(1 for label, _ in sets if label)
    n_clean = len(sets) - n_toxic
    if not n_toxic or not n_clean:
        return Machine(np.zeros(1 << 3 * BITS), 0.0, params, float(n_toxic > 0))

    def leaning(word: str) -> float:
        """Log ratio of the word's rates in toxic and clean sentences."""
        return float(np.log((toxic[word] + 0.5) / n_toxic) - np.log((clean[word] + 0.5) / n_clean))

    # Fixed rule: seen a few times, and at least twenty times as often in toxic sentences.
    ranked = sorted(((toxic[w], w) for w in toxic if toxic[w] >= 4 and len(w) > 2 and leaning(w) > 3.0), reverse=True)
    witnesses = [w for _, w in ranked]
    first = witnesses
    if not witnesses:
        return Machine(np.zeros(1 << 3 * BITS), 0.0, params, n_toxic / len(sets))
    common_words = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    half = params.negatives // 2
    rare = sorted(common_words[half:], key=lambda w: hash_of(w))[:half]
    negatives = [w for w in common_words[:half] + rare if w not in set(witnesses)]
    landmarks = _spread(witnesses, params.landmarks // 2, params)
    landmarks += _spread(negatives[:2000], params.landmarks - len(landmarks), params)
    base = kernel(landmarks, landmarks, params)
    values, vectors = np.linalg.eigh(base)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    far = kernel(negatives, landmarks, params) @ root
    owner, number, weight = features(landmarks, params)
    machine = None
    for _ in range(params.rounds):
        near = kernel(witnesses, landmarks, params) @ root
        counts = np.sqrt([toxic[w] for w in witnesses])
        calm = np.array([clean[w] for w in negatives]) ** 0.25
        cost = np.concatenate([counts / counts.sum(), 4.0 * calm / calm.sum()])
        y = np.concatenate([np.ones(len(witnesses)), -np.ones(len(negatives))])
        w = _separate(np.vstack([near, far]), y, cost, params.ridge)
        beta = root @ w
        machine = Machine(np.bincount(number, weight * beta[owner], 1 << 3 * BITS), BIAS, params)
        # Clean words inside the margin are negatives from now on.
        left = sorted(set(clean).difference(negatives))
        hard = sorted(zip((-machine.values(left)).tolist(), left))[: params.negatives // 4] if left else []
        hard = [x for v, x in hard if v < 0.8]
        # Rarer words with the same leaning, and clearly bad to the machine, are witnesses from now on.
        seen = sorted(w for w in toxic if toxic[w] >= 2 and len(w) > 2 and leaning(w) > 3.0)
        found = zip(seen, machine.values(seen).tolist())
        again = sorted(set(first).union(w for w, v in found if v > 0.5))
        if not hard and set(again) == set(witnesses):
            break
        witnesses = again
        negatives += hard
        if hard:
            far = np.vstack([far, kernel(hard, landmarks, params) @ root])
    machine.ratios = _calibrate(machine, [s for s in everything if not hash_of(s[1]) % 3])
    return machine


def _calibrate(machine: Machine, sentences: list[tuple[int, str]]) -> np.ndarray:
    """Log ratios of the value ranges, made to rise with the value."""
    counts = np.full((2, len(EDGES) + 1), 0.5)
    for of in (0, 1):
        words = Counter(w for _, w in {p for label, text in sentences if label == of for p in _pairs(text)})
        if words:
            names = sorted(words)
            places = np.searchsorted(EDGES, machine.values(names))
            counts[of] += np.bincount(places, [words[w] for w in names], len(EDGES) + 1)
    rates = counts / counts.sum(axis=1)[:, None]
    return np.maximum.accumulate(np.log(rates[1] / rates[0]))


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "replace"))


def training_rows(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id and label of the rows that may train: those whose crc32 leaves a remainder by 5."""
    rows = labels.select(common.field(labels, "doc_id", "long").alias("doc_id"), common.field(labels, label_col, "int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_sentences(docs: DataFrame, labels: DataFrame, params: Params) -> list[tuple[int, str]]:
    """At most ``sample_sentences`` sentences of at most ``sample_documents`` documents of each label.

    Both choices are by hash order. Sentences end at full stops and line ends and are cut into pieces
    of bounded length, so what is collected is bounded, whatever the texts are.
    """
    found = []
    known = training_rows(labels, "toxic")
    for label in (0, 1):
        chosen = known.where(F.col("label") == label).select("doc_id").distinct()
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_documents)
        texts = docs.select(common.field(docs, "doc_id", "long").alias("doc_id"), common.field(docs, "text", "string").alias("text"))
        texts = texts.join(chosen, "doc_id", "left_semi")
        pieces = F.regexp_extract_all("text", F.lit(rf"([^.\n]{{1,{params.longest_sentence}}})"))
        sentences = texts.select(F.posexplode(pieces).alias("at", "sentence"), "doc_id")
        sentences = sentences.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(params.sample_sentences)
        found += [(label, r.sentence) for r in sentences.select("sentence").collect()]
    return found


SCORES = "doc_id long, score double"


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. No shuffle; values of recent words are kept, up to a fixed number."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in common.slices(batches):
            sets = [words_of(t) for t in batch.column(1).to_pylist()]
            scores = []
            if machine.constant is not None:
                scores = [machine.constant] * len(sets)
            else:
                if len(known) > machine.params.cache:
                    known.clear()
                new = sorted(set().union(*sets).difference(known))
                known.update(zip(new, machine.evidence(new).tolist()))
                for ws in sets:
                    scores.append(machine.score(sum([known[w] for w in ws])))
            yield common.to_batch({"doc_id": batch.column(0).to_pylist(), "score": scores}, SCORES)

    chosen = docs.select(common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"))
    return common.map_arrow(chosen, run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    machine = train(sample_sentences(docs, labels, params), params)
    scored = score_documents(docs, machine)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
