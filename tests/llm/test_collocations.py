from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from appwatch.llm import collocations as C

SMALL = C.Params(least=3, top=40, bits=16, block=300, held=64)


def brute(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score from (text, lang) rows, by dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    longer = Counter()
    for (lang, w), a in f.items():
        if len(w) == 3 and a >= least:
            for sub in (w[:2], w[1:]):
                longer[lang, sub] = max(longer[lang, sub], a)
    rows = []
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least and not (longer[lang, w] and 100 * longer[lang, w] >= 50 * a):
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def mined(df, params):
    rows = C.collocations(C.phrases(df, params), params).drop("doc_id", "start").collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocab = ["Ünï", "a", "be", "See", "de", "EFF", "g h", "it's", "x-y", "日本", "ﬁ", "é"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ";"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "de", None, "und", "a-long-language-tag-1", "a-long-language-tag-2"])))
    rows += [(60, "New York City hall " * 30, "en")] * 3 + [(None, None, "en"), (61, "", None), (62, " \t . ", "xx"), (63, "New York " * 40, "fr")]
    return rows


def test_equals_brute_force(spark, prose):
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string").repartition(3)
    want = brute([(t, lang) for _, t, lang in prose], SMALL.least, SMALL.top)
    assert mined(df, SMALL) == sorted(want) and len(want) > 60


def test_collisions_do_not_change_counts(spark, prose):
    """Fingerprints of 7 bits: nearly all numbers are shared by different phrases."""
    crowded = C.Params(least=3, top=40, bits=7, block=300, held=64, fingerprint_bits=7)
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string").repartition(2)
    assert mined(df, crowded) == sorted(brute([(t, lang) for _, t, lang in prose], SMALL.least, SMALL.top))


def test_odd_rows_clashing_columns_and_production_parameters(odd, odd_rows):
    clashing = odd.selectExpr("*", "'x' as phrase", "'y' as fingerprint", "1 as n", "2 as words", "3 as start")
    assert mined(clashing, C.Params()) == sorted(brute([(t, lang) for _, t, lang, _ in odd_rows], 10, 2000))
    assert mined(odd, C.Params(least=2)) == sorted(brute([(t, lang) for _, t, lang, _ in odd_rows], 2, 2000))


def test_places_point_at_their_phrase(spark, prose):
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string")
    texts = {}
    for i, t, _ in prose:
        texts.setdefault(i, []).append((t or "").encode())
    found = C.collocations(C.phrases(df, SMALL), SMALL).collect()
    assert found
    for r in found:
        assert any(re.match(rb"\s*".join(map(re.escape, r.phrase.encode().split(b" "))), t[r.start :].translate(C.LOWER)) for t in texts[r.doc_id])


def test_long_texts_are_cut_where_a_piece_ends():
    text = b"aa bb, cc dd. ee\nff gg" * 5
    parts = list(C._cuts(text, 10))
    assert b"".join(p for _, p in parts) == text and all(text[at : at + len(p)] == p for at, p in parts)
    assert all(p[-1:] in (b",", b".", b"\n") for _, p in parts[:-1]) and len(parts) > 5
    assert list(C._cuts(b"no stop here at all", 4)) == [(0, b"no stop here at all")]


def test_large_counts_are_scored_exactly(spark):
    a, left, right = 123_456_789_012_345, 123_456_789_012_346, 987_654_321_098_765
    rows = [("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 0, "", 10**15)]
    found = spark.createDataFrame([(*r, 1, 0) for r in rows], "lang string, words int, phrase string, f long, doc_id long, start long")
    r = C.collocations(found).first()
    assert (r.score, r.l, r.r, r.n) == (1_000_000 * a * a // (left * right), left, right, 10**15)


def test_word_numbers_depend_on_the_word_only():
    block = C.Block([b"one two one", b"one"], [b"en", b"en"], C.Params())
    numbers = block.numbers(1)
    assert numbers[0] == numbers[2] == numbers[3] != numbers[1]
    assert not np.any(C.Block([b"one"], [b"de"], C.Params()).numbers(1) == numbers)


def test_empty_table(empty):
    assert mined(empty, C.Params()) == []
