from __future__ import annotations

import random
import re

import numpy as np

from appwatch.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_equal_brute_force(odd, odd_rows):
    out = Q.apply_rules(odd, Q.fit_references(odd))
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    short = [(i, t) for i, t, _, _ in odd_rows if len(t or "") < 50_000]
    want = sorted(brute(t) for _, t in short)
    long_ones = [g for g in got if g[0] == 30_000]
    assert len(long_ones) == 1 and len(got) == len(odd_rows)
    assert sorted(g for g in got if g[0] != 30_000) == want


def test_repeats_lines_and_symbols():
    for text in ("a b c d e a b c d e f", "x\nx\n\n \ny\nx", "# * $ % & | < > plain", "a a a a a a a", "", "é ü x\x0by"):
        words, chars, symbols, lines, repeated = Q.base_counts(text.encode())
        assert (len(words), chars, symbols, lines, repeated, Q.base_failed(len(words), repeated)) == brute(text), text


def test_distance():
    assert Q.distance(np.array([1.0, 0]), np.array([0, 2.0])) == 1.0
    assert Q.distance(np.array([1.0, 3]), np.array([2.0, 6])) == 0.0
    assert Q.distance(np.zeros(2), np.array([1.0, 0])) == 1.0


def test_odd_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(3)
    plain = lambda: "".join(rng.choice("aeiourtnslmd") for _ in range(rng.randint(3, 8)))
    common = Q.COMMON_WORDS["en"].split()
    rows = [(i, " ".join(rng.choice(common) if k % 2 else plain() for k in range(80 + i)), "en") for i in range(60)]
    mixed = [f"w{i}$$$ z{i}&&& q{i}***" for i in range(40)]
    rows += [(100, " ".join(mixed), "en"), (101, " ".join(mixed), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = Q.Limits()
    references = Q.fit_references(docs)
    got = {r.doc_id: r for r in Q.apply_rules(docs, references, limits).collect()}
    assert not got[100].kept and not got[100].base_failed and not got[101].kept
    assert all(r.class_distance < limits.class_far for i, r in got.items() if i < 100)


def test_empty_table(empty):
    assert Q.fit_references(empty) == {}
    assert Q.apply_rules(empty, {}).count() == 0


# Plain prose in languages without a reference.
ITALIAN = (
    "La mattina presto il vecchio pescatore uscì dal porto con la sua piccola barca e remò lentamente verso il largo, mentre il sole "
    "sorgeva dietro le colline e la nebbia si alzava piano dall'acqua. Aveva portato pane, formaggio e una bottiglia di vino, perché sapeva "
    "che la giornata sarebbe stata lunga. Quando gettò le reti pensò a suo padre, che gli aveva insegnato ogni cosa, e sorrise senza "
    "dire nulla. Più tardi tornò con poche sardine ma con il cuore leggero, e la sera raccontò tutto ai nipoti davanti al fuoco."
)
RUSSIAN = (
    "Рано утром старый рыбак вышел из гавани на своей маленькой лодке и медленно поплыл в открытое море, пока солнце вставало за холмами, "
    "а туман тихо поднимался над водой. Он взял с собой хлеб, сыр и бутылку вина, потому что знал, что день будет долгим. Когда он бросил "
    "сети, он вспомнил отца, который научил его всему, и молча улыбнулся. Позже он вернулся с небольшим уловом, но с лёгким сердцем, "
    "и вечером рассказал обо всём внукам у огня, пока за окном шумел ветер и шёл дождь."
)


def test_prose_of_languages_without_a_reference_stays(spark, small):
    references = Q.fit_references(spark.read.parquet(f"{small}/documents.parquet"))
    assert references and not {"it", "ru"} & set(references)
    rows = [(ITALIAN, "it"), (RUSSIAN, "ru"), (ITALIAN, None), (RUSSIAN, None), (RUSSIAN, "xx"), (RUSSIAN, "en"), ("x1# " * 60, "it")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in Q.apply_rules(df, references).collect()}
    assert [out[i].kept for i in range(7)] == [True, True, True, True, True, False, False]
    assert all(out[i].class_distance is not None for i in range(5))


def test_distances_equal_brute_force(spark, small):
    """Jensen-Shannon distances to the candidates, and the verdict that follows from them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    references = Q.fit_references(docs)
    near = Q.candidates(references)

    def apart(p, q):
        p, q = p / p.sum() if p.sum() else p, q / q.sum()
        if not p.sum():
            return 1.0
        m = (p + q) / 2
        half = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))

    rejected = 0
    for r in Q.apply_rules(docs, references).collect():
        raw = (r.text or "").encode()
        words, *_ = Q.base_counts(raw)
        classes, counts = Q.histograms(raw, words)
        if len(words) < 20 or not counts.sum():
            continue
        best = min(((apart(classes, c), apart(counts, w)) for c, w in near.get(r.lang, near[None])), key=lambda d: (d[0] + d[1], d))
        assert abs(best[0] - r.class_distance) < 1e-6 and abs(best[1] - r.word_distance) < 1e-6
        by_distance = r.lang in references and Q.Limits().reject(r.n_words, r.class_distance, r.word_distance)
        assert r.kept == (not r.base_failed and not by_distance)
        rejected += by_distance
    assert rejected
