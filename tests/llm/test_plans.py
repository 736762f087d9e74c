"""Plan shape of the training-data queries."""

from __future__ import annotations

import re

import pytest

from appwatch.llm.queries import QUERIES

# Windows without a key order all their rows in one task, so their rows must have a bound that is not the data's:
# op5: one row per source, to place its weight and level (mixing.targets);
# op7: one row per span of 1,024 token lengths, thus the longest text's tokens / 1,024 (token_counts.limits).
WHOLE_WINDOWS = {"op5_mix_sources": {"source", "source_size"}, "op7_token_counts": {"span", "span_docs", "span_tokens"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(name, spark, small):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|ArrowEval", plan)
    for line in plan.splitlines():
        if re.search(r"Window \[", line):
            spec = re.search(r"windowspecdefinition\((.*?)(ASC|DESC|specifiedwindowframe)", line)
            keyed = spec and "#" in spec.group(1) and not re.search(r"windowspecdefinition\([^,()]*#\d+L? (ASC|DESC)", line)
            assert keyed or name in WHOLE_WINDOWS, line


def test_windows_without_a_key_see_few_rows(spark, small):
    """As many rows as there are sources, and as there are spans of lengths."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from appwatch.llm import mixing, token_counts
    from appwatch.llm.queries import piece_model

    sized = docs.select("source", mixing.word_count(docs["text"]).alias("size")).groupBy("source").agg({"size": "sum"})
    plan = mixing.targets(sized.withColumnRenamed("sum(size)", "source_size"))
    assert plan.count() == docs.select("source").distinct().count()
    hist = token_counts.histogram(token_counts.encoded_lengths(docs, piece_model()))
    longest = hist.agg({"n_tokens": "max"}).first()[0]
    assert hist.selectExpr(f"n_tokens div {token_counts.SPAN}").distinct().count() <= longest // token_counts.SPAN + 1
