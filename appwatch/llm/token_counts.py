"""Exact token statistics for every context limit, from a histogram of encoded lengths.

Documents are aggregated by encoded length. Sums from the long end then answer, for each length L that
occurs taken as a context limit: how many documents are longer, how many tokens there are in all,
how many remain when every document is cut to L, and at which quantile L stands.

Sums run over spans of ``SPAN`` lengths and then over the spans' totals, so no single task orders all
lengths. A document of very common length costs nothing extra: counting combines before the shuffle.

Cases: null and empty texts have length 0. Texts are encoded whole. Repeated rows count each time. An
empty table gives an empty result. Ids and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appwatch.llm import common, sentencepiece
from appwatch.llm.common import stored

SPAN = 1024


def encoded_lengths(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``n_tokens`` of each text, without begin and end ids (and ``doc_id`` if asked for)."""
    name = sentencepiece.send(docs.sparkSession, model_path)
    schema = "doc_id long, n_tokens long" if id_col else "n_tokens long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.load(name)
        for batch in common.slices(batches):
            out = {"n_tokens": [model.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]}
            if id_col:
                out["doc_id"] = batch.column(0).to_pylist()
            yield common.to_batch(out, schema)

    columns = [common.field(docs, id_col, "long").alias("doc_id")] if id_col else []
    return common.map_arrow(docs.select(*columns, common.field(docs, text_col, "string").alias("text")), run, schema)


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``n_tokens`` and ``n_docs`` for each length that occurs; written once, as all answers come from it."""
    counted = lengths.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    return stored(counted, "lengths")


def limits(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    n_tokens, n_docs, docs_longer, tokens_longer (of documents longer than it), total_docs,
    total_tokens, truncated_tokens (left if all documents are cut to it), quantile (share of documents
    not longer).
    """
    rows = hist.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("span")
    )
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    later = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    spans = spans.select(
        "span",
        zero(F.sum("span_docs").over(later)).alias("later_docs"),
        zero(F.sum("span_tokens").over(later)).alias("later_tokens"),
        F.sum("span_docs").over(everything).alias("total_docs"),
        F.sum("span_tokens").over(everything).alias("total_tokens"),
    )
    after = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = rows.select("*", zero(F.sum("n_docs").over(after)).alias("d"), zero(F.sum("tokens").over(after)).alias("t"))
    joined = longer.join(spans, "span")
    docs_longer, tokens_longer = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    return joined.select(
        "n_tokens",
        "n_docs",
        docs_longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_longer + docs_longer * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_longer) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int | Column) -> DataFrame:
    """Documents, tokens, and tokens left under any one context limit, whether that length occurs or not."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return hist.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), limit)), F.lit(0)).alias("truncated_tokens"),
    )


def quantile_length(limited: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents does not exceed."""
    return limited.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
