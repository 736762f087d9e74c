"""Quality rules: plain counts, then how far a document is from its language.

Each document gets a histogram of character classes and one of common words. Both are compared by
Jensen-Shannon distance (base 2, so between 0 and 1) with the mean histograms of its language, taken
from all documents of the corpus that pass the plain rules; a text may also be half in another known
language. Short documents have no reliable
histogram, so each comparison has a least length below which it does not judge.

Cases: a null or empty text has no words and fails the base rule. Prose of a language that is null or has no
reference is far from every reference by its letters and words, so such documents are judged by character classes alone,
with all letters, of whatever script, as one class; the distances shown are those to the nearest reference. Without
any reference (an empty table) only the base rule judges. Texts of any length are
read whole. Repeated rows give equal rows. Null ids are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appwatch.llm import common

# The characters counted as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
# Frequent function words of the languages with a reference.
COMMON_WORDS = {
    "en": "the of and to in a is that for with on as was by at are be this it from an or not he which",
    "de": "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er aus",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus ne se il elle ce",
    "es": "de la que el en y los se del las un por con no una para es al lo como más su o le sus",
}
_WORD_AT = {w.encode(): i for i, w in enumerate(sorted({w for words in COMMON_WORDS.values() for w in words.split()}))}
# Punctuation of plain prose has classes of its own; other ASCII signs share one with the symbols.
_CLASSES = {**{ord(c): 6 + i for i, c in enumerate(".,;:!?'\"-()")}, 32: 0, 10: 1}
_CLASS_OF = np.array(
    [
        _CLASSES[b] if b in _CLASSES
        else 0 if b in WHITE
        else 2 if 97 <= b <= 122
        else 3 if 65 <= b <= 90
        else 4 if 48 <= b <= 57
        else 5 if b >= 192
        else 18 if 128 <= b < 192
        else 17
        for b in range(256)
    ],
    dtype=np.uint8,
)
N_CLASSES = 19
CONTINUATION = 18  # the later bytes of a character count for nothing
LETTERS = (2, 3, 5)


@dataclass(frozen=True)
class Limits:
    """When distances speak against a document.

    A class histogram farther than ``class_far`` is enough from ``class_far_min_words`` on. From
    ``min_words`` on, one farther than ``class_distance`` counts if the word histogram is also
    farther than ``word_distance`` plus ``word_slack`` / number of words, as few words scatter more.
    """

    class_far: float = 0.25
    class_far_min_words: int = 40
    class_distance: float = 0.13
    word_distance: float = 0.24
    word_slack: float = 4.0
    min_words: int = 60

    def reject(self, n_words: int, by_class: float, by_word: float) -> bool:
        if n_words >= self.class_far_min_words and by_class > self.class_far:
            return True
        slack = self.word_slack / max(n_words, 1)
        return n_words >= self.min_words and by_class > self.class_distance and by_word > self.word_distance + slack


def base_counts(raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, then code points in words, symbols, repeated lines, words in repeated windows of five."""
    words = raw.split()
    solid = raw.translate(None, WHITE)
    chars = len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 5 - max(end, i)
                end = i + 5
    return words, chars, symbols, len(lines) - len(set(lines)), repeated


def histograms(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes, and common words with all other words in the last place."""
    classes = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES)[:CONTINUATION]
    counts = np.zeros(len(_WORD_AT) + 1)
    found = Counter(map(bytes.lower, words))
    for word, at in _WORD_AT.items():
        counts[at] = found.get(word, 0)
    counts[-1] = len(words) - counts.sum()
    return classes.astype(float), counts


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / mean), 0) + np.where(q > 0, q * np.log2(q / mean), 0)
    return float(np.sqrt(max(terms.sum() / 2, 0.0)))


def base_failed(n_words: int, repeated: int) -> bool:
    return n_words < 10 or 100 * repeated > 20 * n_words


References = dict[str, tuple[np.ndarray, np.ndarray]]


def fit_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Mean histograms of each known language over all documents that pass the base rule.

    Every task sums its documents first; what reaches the driver is one short row for each language.
    """
    size = CONTINUATION + len(_WORD_AT) + 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(size) for lang in COMMON_WORDS}
        for batch in common.slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums or not text:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                words, _, _, _, repeated = base_counts(raw)
                if not base_failed(len(words), repeated):
                    classes, counts = histograms(raw, words)
                    sums[lang] += np.concatenate([classes / classes.sum(), counts / counts.sum()])
        for lang, total in sums.items():
            yield common.to_batch({"lang": [lang] * size, "at": list(range(size)), "total": total.tolist()}, "lang string, at int, total double")

    chosen = docs.select(common.field(docs, text_col, "string").alias("text"), common.field(docs, lang_col, "string").alias("lang"))
    rows = common.map_arrow(chosen, run, "lang string, at int, total double").groupBy("lang", "at").agg(F.sum("total").alias("total")).collect()
    found = {lang: np.zeros(size) for lang in COMMON_WORDS}
    for row in rows:
        found[row.lang][row.at] = row.total
    return {lang: (v[:CONTINUATION], v[CONTINUATION:]) for lang, v in found.items() if v.sum()}


def candidates(references: References) -> dict[str | None, list[tuple[np.ndarray, np.ndarray]]]:
    """What a document of each language may look like: the language alone, or half of another one with it."""
    unit = {lang: (c / c.sum(), w / w.sum()) for lang, (c, w) in references.items()}
    pair = lambda a, b: ((unit[a][0] + unit[b][0]) / 2, (unit[a][1] + unit[b][1]) / 2)
    known = sorted(unit)
    found: dict[str | None, list] = {a: [unit[a], *(pair(a, b) for b in known if b != a)] for a in known}
    found[None] = [*unit.values(), *(pair(a, b) for i, a in enumerate(known) for b in known[i + 1 :])]
    return found


def any_letters(classes: np.ndarray) -> np.ndarray:
    """Character classes with small and capital letters and those beyond ASCII as one."""
    merged = classes.copy()
    merged[LETTERS[0]] = classes[list(LETTERS)].sum()
    merged[list(LETTERS[1:])] = 0
    return merged


def nearest(classes: np.ndarray, counts: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Both distances to the candidate whose distances have the least sum."""
    pairs = [(distance(classes, c), distance(counts, w)) for c, w in near]
    return min(pairs, key=lambda d: (d[0] + d[1], d))


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


KINDS = {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def apply_rules(
    docs: DataFrame,
    references: References,
    limits: Limits = Limits(),
    text_col: str = "text",
    lang_col: str = "lang",
    prefix: str = "",
) -> DataFrame:
    """``docs`` with the counts, distances and verdict of each row in columns ``prefix`` + name. No shuffle.

    Columns of ``docs`` that have such a name are replaced.
    """
    extra = [(f"{prefix}{n.strip()}", kind) for n, kind in (f.split() for f in FIELDS.split(","))]
    docs = common.without(docs, [n for n, _ in extra])
    names = list(docs.columns)
    at_text, at_lang = names.index(text_col), names.index(lang_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, KINDS[kind]) for n, kind in extra)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        target = common.arrow_schema(schema)
        near = candidates(references)
        scripts = [any_letters(c) for c, _ in near[None]]
        for batch in common.slices(batches):
            rows = []
            for text, lang in zip(batch.column(at_text).to_pylist(), batch.column(at_lang).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words, chars, symbols, lines, repeated = base_counts(raw)
                failed = base_failed(len(words), repeated)
                classes, counts = histograms(raw, words)
                by_class, by_word = nearest(classes, counts, near.get(lang, near[None])) if references else (None, None)
                if lang in references:
                    odd = limits.reject(len(words), by_class, by_word)
                else:
                    odd = bool(scripts) and limits.reject(len(words), min(distance(any_letters(classes), s) for s in scripts), 0.0)
                kept = not failed and not odd
                rows.append((len(words), chars, symbols, lines, repeated, failed, by_class, by_word, kept))
            new = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(target)[len(names) :])]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, target)), *new], schema=target)

    return common.map_arrow(docs, run, schema)
