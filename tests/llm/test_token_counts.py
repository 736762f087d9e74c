from __future__ import annotations

import pytest
import sentencepiece as library

from appwatch.llm import token_counts as T
from appwatch.llm.queries import piece_model


@pytest.fixture(scope="module")
def lengths(odd_rows):
    reference = library.SentencePieceProcessor(model_file=piece_model())
    return [len(reference.encode(t or "")) for _, t, _, _ in odd_rows]


def test_limits_equal_brute_force(odd, lengths):
    hist = T.histogram(T.encoded_lengths(odd, piece_model()))
    got = {r.n_tokens: r for r in T.limits(hist).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_longer == sum(x > limit for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > limit)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))


def test_any_limit_and_quantile(odd, lengths):
    hist = T.histogram(T.encoded_lengths(odd, piece_model()))
    for limit in (0, 3, 77, 10**6):
        r = T.truncated_total(hist, limit).first()
        assert (r.total_tokens, r.truncated_tokens) == (sum(lengths), sum(min(x, limit) for x in lengths))
    median = T.quantile_length(T.limits(hist), 0.5).first().n_tokens
    assert median == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_ids_come_along(odd, lengths):
    got = sorted(r.n_tokens for r in T.encoded_lengths(odd, piece_model(), id_col="doc_id").collect())
    assert got == sorted(lengths)


def test_empty_table(empty):
    hist = T.histogram(T.encoded_lengths(empty, piece_model()))
    assert T.limits(hist).count() == 0
    assert tuple(T.truncated_total(hist, 5).first()) == (0, 0, 0)
