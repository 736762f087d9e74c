"""Quality of documents by regularised quadratic discriminant analysis of their statistics.

A document becomes a short vector of statistics, transformed to be roughly symmetric. Each class has
a mean and a covariance, shrunk towards the pooled covariance and then towards a sphere. With
their Cholesky factors kept, a document's score comes from the difference of two Mahalanobis
log-densities and the classes' shares.

All labelled training rows count: every task sums the moments of its rows, and what meets is one
short row per class, entry and task.

Cases: null and empty texts have the statistics of no words. Labels other than 0 and 1 and null labels
do not train; a document labelled twice trains twice. Without both classes to learn from, all scores
are the share of label 1, or 0.5 without labels. Ids may be null (scored, never trained on) or
repeated. Texts are read whole. Only the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.llm import common, quality_rules
from appwatch.llm.common import stored

NAMES = (
    "log_words", "word_length", "upper", "symbols", "exclamation", "stops", "digits",
    "lines", "richness", "doubled", "top_word", "repeated", "common", "wide",
)
SIZE = len(NAMES)


@dataclass(frozen=True)
class Params:
    """``pool``: weight of the pooled covariance; ``sphere``: weight of the mean variance on the diagonal.

    ``temperature`` divides the log-density difference, since real statistics have longer tails than
    the normal distribution.
    """

    pool: float = 0.2
    sphere: float = 0.02
    temperature: float = 6.0


def _share(part: float, whole: float, least: float = 1e-3) -> float:
    """Logit of a share, kept away from 0 and 1."""
    p = (part + least) / (whole + 2 * least) if whole else 0.5 * least
    p = min(max(p, least), 1 - least)
    return float(np.log(p / (1 - p)))


_COUNTED = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", quality_rules.SYMBOLS, b"!", b".,;:", b"0123456789", b"\n")


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, chars, _, _, repeated = quality_rules.base_counts(raw)
    upper, symbols, loud, stops, digits, lines = (len(raw) - len(raw.translate(None, c)) for c in _COUNTED)
    n, size = len(words), len(raw)
    counts = Counter(words)
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    frequent = sum(v for w, v in counts.items() if w.lower() in quality_rules._WORD_AT)
    wide = size - len(raw.translate(None, bytes(range(128, 256))))
    top = max(counts.values(), default=0)
    return np.array(
        [
            np.log1p(n), np.log1p(chars / n if n else 0), _share(upper, size), _share(symbols, size), _share(loud, size),
            _share(stops, size), _share(digits, size), np.log1p(lines) - np.log1p(n),
            np.log1p(len(counts)) / np.log1p(n) if n else 0.0, _share(doubled, n), _share(top, n), _share(repeated, n),
            _share(frequent, n), _share(wide, size),
        ]
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``x``, the vector of statistics. No shuffle."""
    schema = "doc_id long, x array<double>"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = [statistics(t).tolist() for t in batch.column(1).to_pylist()]
            yield common.to_batch({"doc_id": batch.column(0).to_pylist(), "x": rows}, schema)

    chosen = docs.select(common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"))
    return common.map_arrow(chosen, run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and offsets of both classes, or a constant score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    temperature: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -500, 500)))


def moments(training: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` for each ``label``; tasks sum their rows first."""
    schema = "label int, at int, total double"
    length = 1 + SIZE + SIZE * SIZE

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros(length), 1: np.zeros(length)}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist())
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, SIZE)
            for label in (0, 1):
                own = x[labels == label]
                sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for label, total in sums.items():
            yield common.to_batch({"label": [label] * length, "at": list(range(length)), "total": total.tolist()}, schema)

    rows = common.map_arrow(training.select("label", "x"), run, schema).groupBy("label", "at").agg(F.sum("total").alias("total")).collect()
    found = {0: np.zeros(length), 1: np.zeros(length)}
    for r in rows:
        found[r.label][r.at] = r.total
    return {k: (v[0], v[1 : 1 + SIZE], v[1 + SIZE :].reshape(SIZE, SIZE)) for k, v in found.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], params: Params = Params()) -> Discriminant:
    total = sums[0][0] + sums[1][0]
    if not sums[0][0] or not sums[1][0]:
        return Discriminant([], [], [], params.temperature, sums[1][0] / total if total else 0.5)
    means = [sums[k][1] / sums[k][0] for k in (0, 1)]
    own = [sums[k][2] / sums[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(sums[k][0] * own[k] for k in (0, 1)) / total
    factors, offsets = [], []
    for k in (0, 1):
        covariance = (1 - params.pool) * own[k] + params.pool * pooled
        spread = max(np.trace(covariance) / SIZE, 1e-9)
        covariance = (1 - params.sphere) * covariance + params.sphere * spread * np.eye(SIZE)
        lower = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(sums[k][0] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets, params.temperature)


def held_out(id_col: str):
    """Rows kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. Texts are read once."""
    known = stored(document_statistics(docs), "statistics")
    rows = labels.select(common.field(labels, "doc_id", "long").alias("doc_id"), common.field(labels, "quality", "int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & ~held_out("doc_id"))
    model = fit(moments(known.join(rows, "doc_id")), params)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, SIZE)
            yield common.to_batch({"doc_id": batch.column(0).to_pylist(), "score": model.scores(x).tolist()}, "doc_id long, score double")

    scored = common.map_arrow(known, run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
