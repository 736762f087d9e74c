from __future__ import annotations

import random
from dataclasses import replace

import pytest

from appwatch.llm import graph, minhash
from appwatch.llm.minhash import Params


def brute(rows, size, percent=80):
    """Components by all pairs; a row is its own node, named by its id."""
    sets = [(i, minhash.shingle_set(t or "", size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            shared = len(x & y)
            if 100 * shared >= percent * len(x | y):
                parent[root(a)] = root(b)
    least: dict = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((i, len(s), least[root(a)]) for a, (i, s) in enumerate(sets) if i is not None)


def family(seed: int, n: int, edits: int, length: int = 150):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"v{rng.randint(0, 10**6)}"
        rows.append((seed * 1000 + i, " ".join(words)))
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


@pytest.mark.parametrize("size", [4, 5])
def test_odd_cases(odd, odd_rows, size):
    out = minhash.near_duplicates(odd, Params(shingle=size))
    assert result(out) == brute([(i, t) for i, t, _, _ in odd_rows], size)
    assert all(r.kept and r.component_id is None for r in out.where("doc_id is null").collect())


def test_near_copies_and_small_blocks(spark):
    rows = [r for seed in range(1, 6) for r in family(seed, 30, 9)] + [r for r in family(9, 12, 40, 1500)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert len({c for _, _, c in want}) > 10
    assert result(minhash.near_duplicates(docs, Params(shingle=4))) == want
    assert result(minhash.near_duplicates(docs, replace(Params(shingle=4), block=7))) == want


def test_sketches_estimate(spark):
    signer = minhash.Signer(Params())
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    a = minhash.shingle_hashes(" ".join(words).encode(), 5)
    changed = words[:]
    for i in rng.sample(range(400), 8):
        changed[i] = "x" + str(i)
    b = minhash.shingle_hashes(" ".join(changed).encode(), 5)
    differ = bin(int.from_bytes(signer.fine(a)[:256], "big") ^ int.from_bytes(signer.fine(b)[:256], "big")).count("1")
    assert 0.8 * len(set(a) ^ set(b)) <= differ <= len(set(a) ^ set(b))
    sketch = bin(int.from_bytes(signer.sketch(signer.minima(a)), "big") ^ int.from_bytes(signer.sketch(signer.minima(b)), "big")).count("1")
    assert sketch <= Params().most_differing_bits


def test_word_hashes_tell_words_apart():
    raw = "a b  ab ba\ta\nüa".encode()
    hashes = minhash.word_hashes(raw)
    assert len(hashes) == 6 and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 5
    assert len(minhash.word_hashes(b"")) == 0


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """An id that holds a copy and a unique text, one that holds two copies, one that repeats a row."""
    base, other, third = (t for _, t in family(1, 1, 0) + family(2, 1, 0) + family(3, 1, 0))
    near = base.replace(base.split()[70], "changed")
    rows = [(1, base), (5, near), (5, other), (7, base), (7, near), (8, third), (8, third), (9, other + " x y"), (3, other + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs, Params(shingle=4))
    assert got.count() == len(rows) and result(got) == brute(rows, 4)
    kept = sorted((r.doc_id, r.component_id, r.kept) for r in got.collect())
    assert kept == [(1, 1, True), (3, 3, True), (5, 1, False), (5, 3, False), (7, 1, False), (7, 1, False), (8, 8, True), (8, 8, True), (9, 3, False)]


def test_a_hot_id_gives_a_row_each(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)]
    rows = [(1, t) for t in texts] + [(2, texts[3]), (2, texts[3])]
    got = result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Params(shingle=4)))
    assert got == brute(rows, 4) and len(got) == 42
