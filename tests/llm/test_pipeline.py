from __future__ import annotations

import glob
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from appwatch.llm import mixing, quality_rules
from appwatch.llm.common import stored
from appwatch.llm.queries import ORACLES, QUERIES
from .test_minhash import brute
from .test_sentencepiece import library, piece_model

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and what each stage made of a few documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], "unused"), f"test-{name}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stage_columns(stages):
    assert all(s.columns == DOCUMENTS for s in stages[:-1])


def test_rejected_documents_go(stages):
    before, after = stages[0], stages[1]
    judged = quality_rules.apply_rules(before, quality_rules.fit_references(before))
    assert sorted(rows(after)) == sorted(rows(judged.where("kept"))) and 0 < after.count() < before.count()


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    kept = {i for i, _, c in brute(before, 5) if i == c}
    assert {i for i, _ in after} == kept and len(after) < len(before)


def without_repeats(rows):
    """Texts less the bytes covered by 50-byte strings that start in a document of smaller id; emptied ones go."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        windows = [raw[p : p + 50] for p in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for p, w in enumerate(windows):
            if w in seen:
                gone[p : p + 50] = True
        seen.update(windows)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if kept:
            out[doc_id] = kept
    return out


def test_repeats_are_cut(stages):
    before, after = rows(stages[2]), dict(rows(stages[3]))
    want = without_repeats(before)
    assert set(after) == set(want) and after == want and after != dict(before)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_repeated_ids_lose_no_unique_text(spark):
    """An id with a copy and a unique text, one with two near texts, one with repeated rows of different source."""
    rng = random.Random(4)
    base, unique, pair, twice = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(4))
    near = pair.replace(pair.split()[40], "changed")
    data = [(1, base, "a"), (5, base, "a"), (5, unique, "a"), (6, pair, "a"), (6, near, "b"), (7, twice, "b"), (7, twice, "a"), (7, twice, "a"), (8, None, "a"), (None, base, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, stored(docs, "test-repeated"), "unused")
    got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
    one_of_six = [g for g in got if g[0] == 6]
    assert len(one_of_six) == 1 and one_of_six[0][1] in (pair, near)
    assert [g for g in got if g[0] != 6] == sorted([(1, base, "a"), (5, unique, "a"), (7, twice, "a"), (8, None, "a"), (None, base, "a")], key=str)


def test_documents_that_stay_are_not_shuffled(spark, stages):
    """Where the keys that go are too many to be broadcast, the texts of all others stay in their tasks."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, stages[1], "unused")
        assert sorted(rows(kept)) == sorted(rows(stages[2]))
        shuffled = []
        plan = kept._jdf.queryExecution().executedPlan()
        plan.execute().count()
        todo = [plan.finalPhysicalPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange" and "text" in [a.name() for a in _each(node.output())]:
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.plan()] if "QueryStage" in node.nodeName() else list(_each(node.children()))
        before, after = stages[1].count(), kept.count()
        assert shuffled and max(shuffled) <= before - after + before // 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _each(of):
    return [of.apply(i) for i in range(of.size())]


def test_run_equals_the_stages(spark, small):
    """The whole pipeline over whole texts, long ones included, against the stages' brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    judged = quality_rules.apply_rules(docs, quality_rules.fit_references(docs)).where("kept")
    left = rows(judged)
    least = {i for i, _, c in brute(left, 5) if i == c}
    cut = without_repeats([(i, t) for i, t in left if i in least])
    sources = spark.createDataFrame([(i, t) for i, t in cut.items()], "doc_id long, text string").join(docs.select("doc_id", "source"), "doc_id")
    copies = {r.doc_id: -(-r.taken // max(r.size, 1)) for r in mixing.mix(sources).collect() if r.taken}
    got: dict = {}
    for r in corpus_pipeline.run(spark, small).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.n_tokens >= 2 and len(r.ids_sha256) == len(r.decoded_sha256) == 64
    assert got == copies and max(len(t) for t in cut.values()) > 6000


def test_mixture_takes_what_it_says(stages):
    plan = {r.doc_id: r for r in mixing.mix(stages[3]).collect()}
    times: dict = {}
    for doc_id, text in rows(stages[4]):
        times.setdefault(doc_id, []).append(len(text.split()))
    assert {i: sum(n) for i, n in times.items()} == {i: r.taken for i, r in plan.items() if r.taken}


def test_encoding(stages):
    reference = library.SentencePieceProcessor(model_file=piece_model())
    want = sorted((i, len(reference.encode(t)) + 2) for i, t in rows(stages[4]))
    assert sorted((r.doc_id, r.n_tokens) for r in stages[5].collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
