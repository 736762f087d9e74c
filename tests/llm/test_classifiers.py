from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from appwatch.llm import quality_classifier as Q
from appwatch.llm import toxicity as T

INSULTS = ["nitwit", "scoundrel", "blockhead"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    syllables = ["ba", "to", "re", "mi", "la", "so", "ne", "ku", "di", "pha"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic, good = i % 3 == 0, i % 2 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        if not good:
            words = [w + rng.choice(["!!", "$$$"]) for w in words]
        text = " ".join(words[: len(words) // 2]) + ".\n" + " ".join(words[len(words) // 2 :])
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(9001, None), (9002, ""), (None, "nitwit nitwit"), (9003, "x " * 60_000), (5, docs[5][1])]
    labels += [(9001, None, None), (9002, 7, 7), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1.0D as score", "'x' as label", "array(1.0D) as x")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'en' as text")


@pytest.mark.parametrize("classify, column", [(T.classify, 2), (Q.classify, 1)])
def test_held_out_accuracy(labelled, classify, column):
    docs, labels = labelled
    truth = {r[0]: r[column] for r in labels.collect()}
    out = classify(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    test = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(test) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.97
    (null,) = [r for r in out if r.doc_id == 9001]
    (blank,) = [r for r in out if r.doc_id == 9002]
    assert null.score == blank.score


def test_toxic_words_with_gaps(labelled):
    docs, labels = labelled
    machine = T.train(T.sample_sentences(docs, labels, T.Params()), T.Params())
    plain, gapped, inserted, other = machine.values(["nitwit", "nit-wit", "nitxwit", "batore"])
    assert plain > gapped > other and plain > inserted > other


def test_kernel_and_machine_agree(labelled):
    params = T.Params()
    words = ["abcd", "abxcd", "zzzz", "a", "éa", "aaaaaa", ""]
    k = T.kernel(words, words, params)
    assert np.allclose(np.diag(k), [1, 1, 1, 1, 1, 1, 0], atol=1e-6) and np.allclose(k, k.T, atol=1e-6)
    owner, number, weight = T.features(words[:2], params)
    machine = T.Machine(np.bincount(number, weight * np.array([1.0, -0.3])[owner], 1 << 18), -1.0, params)
    assert np.allclose(machine.values(words)[:2], -1 + k[:2, 0] - 0.3 * k[:2, 1], atol=1e-5)


def test_without_labels(labelled, spark):
    docs, labels = labelled
    none = labels.where("false")
    assert {r.score for r in T.classify(docs, none).collect()} == {0.0}
    assert {r.score for r in Q.classify(docs, none).collect()} == {0.5}
    one = labels.where("toxic = 1 and quality = 1")
    assert {r.score for r in T.classify(docs, one).collect()} == {1.0}
    assert {r.score for r in Q.classify(docs, one).collect()} == {1.0}
    assert T.classify(docs.where("false"), labels).count() == 0
    assert Q.classify(docs.where("false"), labels).count() == 0


def test_discriminant_is_the_normal_density():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (500, Q.SIZE)) for k in (0, 1)}
    sums = {k: (float(len(v)), v.sum(axis=0), v.T @ v) for k, v in x.items()}
    model = Q.fit(sums, Q.Params(pool=0, sphere=0, temperature=1))
    p = x[1][:20]

    def log_density(k):
        m, c = x[k].mean(axis=0), np.cov(x[k].T, bias=True)
        d = p - m
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])

    assert np.allclose(model.scores(p), 1 / (1 + np.exp(log_density(0) - log_density(1))))
