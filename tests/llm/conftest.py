"""Small tables with the odd cases that every operator has to stand."""

from __future__ import annotations

import random

import pytest

CLASHING = "size long, target long, n_words long, part long, rest string, score double, component_id long, taken long, raw string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source: nulls, empty and white texts, copies, near copies, repeats, a long text."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    long_text = words(rng, 30_000)
    passage = words(rng, 30)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "de", "b"), (4, None, "en", None), (5, "", None, "b"),
        (6, " \n\t ", "fr", "a"), (7, "one", "en", "c"), (8, "one", "xx", "c"), (9, "two words", "en", "c"), (10, long_text, "es", "a"),
        (11, passage + " " + words(rng, 40), "en", "a"), (12, words(rng, 40) + "\n" + passage, "en", "b"), (12, words(rng, 25), "en", "b"),
        (13, "same row", "en", "a"), (13, "same row", "en", "a"), (None, base, "en", "a"), (None, None, None, None),
        (14, "Ünïcödé ﬁ 😀 words here and thére " * 12, "de", "a"), (-3, "a b c d e f g h i j k l m n o p", "en", "é"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows above, with extra columns whose names clash with what operators add or use inside."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").repartition(3)
    for field in CLASHING.split(", "):
        name, kind = field.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
