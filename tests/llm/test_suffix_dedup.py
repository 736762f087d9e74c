from __future__ import annotations

import hashlib
import random
from dataclasses import replace

import numpy as np
import pytest

from appwatch.llm import suffix_dedup as S
from appwatch.llm.suffix_dedup import Params, cut_repeats, remove_repeats
from appwatch.llm.suffixes import suffix_array

SMALL = replace(Params(), group_bytes=2000, range_anchors=40, array_bytes=500)


def spans(rows, length=50):
    """Rows with their removed mask, by looking at every window."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        if i is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < i:
                    mask[p : p + length] = True
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        out.append((i, len(raw), int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2].tolist(), edges[1::2].tolist()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, list(r.starts), list(r.ends)) for r in df.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("ab é\n") for _ in range(k))
    passages = [piece(rng.randint(40, 200)) for _ in range(6)] + ["xyz " * 60]
    rows = []
    for i in range(n):
        text = piece(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages)[rng.randint(0, 30) :] + piece(rng.randint(0, 60))
        rows.append((rng.randint(-50, 1000), text))
    return rows


def test_suffix_arrays():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for s in [*texts, b"a" * 200, b"ab" * 99, b"abaab" * 40, b"ba" * 50 + b"b"]:
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = spans(rows)
    assert sum(w[2] for w in want) > 1000
    assert result(remove_repeats(df)) == want
    assert result(remove_repeats(df, SMALL)) == want


def test_anchors_with_many_stretches_are_split(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, replace(Params(), most=2))) == spans(rows)


def test_odd_cases(odd, odd_rows, empty):
    assert result(remove_repeats(odd)) == spans([(i, t) for i, t, _, _ in odd_rows])
    assert remove_repeats(empty).count() == 0


def test_cut_keeps_the_other_columns(odd, odd_rows, empty):
    got = cut_repeats(odd)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    kept = {(r.doc_id, r.lang, r.source, (r.text or "")[:20]) for r in got.collect()}
    assert (2, "en", "a", odd_rows[0][1][:20]) not in kept  # a whole copy goes
    assert (1, "en", "a", odd_rows[0][1][:20]) in kept and (4, "en", None, "") in kept
    assert [r.text for r in got.where("doc_id = 4").collect()] == [None]
    assert cut_repeats(empty).count() == 0


def test_very_many_empty_texts_do_not_hide_a_repeat(spark):
    """More than a million empty texts before two equal ones, in one task: the later one loses all its bytes."""
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(50))
    empties = spark.range(1_048_700).selectExpr("id as doc_id", "'' as text")
    docs = empties.union(spark.createDataFrame([(2_000_000, text), (2_000_001, text)], "doc_id long, text string")).coalesce(1)
    found = remove_repeats(docs, outputs=("doc_id", "n_bytes", "n_removed")).where("n_bytes > 0")
    assert sorted(tuple(r) for r in found.collect()) == [(2_000_000, len(text), 0), (2_000_001, len(text), len(text))]


def test_packed_columns_come_back():
    ends = np.array([-(1 << 63), (1 << 63) - 1, 0, -1, 1 << 40])
    columns, tail = S.unsqueezed(S.squeezed(ends, np.arange(5), tail=b"tail"))
    assert [c.tolist() for c in columns] == [ends.tolist(), [0, 1, 2, 3, 4]] and tail == b"tail"
    assert S.unsqueezed(S.squeezed(ends[:0]))[0][0].tolist() == []


def test_stretches_travel_as_one_row_for_a_group_and_range(spark):
    """Before, each stretch was a row, which was written, counted and shuffled."""
    df = spark.createDataFrame(corpus(4), "doc_id long, text string").repartition(2)
    params, bits = replace(SMALL, group_bytes=5000), 2
    copy = S.grouped(df, params, "doc_id", "text")
    shared = S._store_by_group(S._shared_hashes(S._send_hashes(copy, bits, params), bits, params), "shared")
    sent = S._stretches(copy, shared, bits, params).collect()
    assert len({(r.bucket, r.part) for r in sent}) == len(sent)
    stretches = [len(S.unsqueezed(r.packed)[0][0]) for r in sent]
    assert sum(stretches) > 10 * len(sent) > 0


def test_ids_at_the_ends_of_their_range(spark):
    text = " ".join(str(i * i) for i in range(60))
    rows = [((1 << 63) - 1, text), (-(1 << 63), "x" + text), (0, text + "y")]
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == spans(rows)


def test_hot_windows_beside_cold_stretches(spark):
    """One line in every text with other words around it is hot; passages that few texts have are not."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, passage = "one very common line of forty odd signs", " ".join(word() for _ in range(20))
    rows = [(i, " ".join([word(), word(), rng.choice([line, line + " and more of it, twice as long"]), word(), word(), passage if i % 9 == 0 else word()])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = spans(rows)
    assert sum(w[2] > 0 for w in want) > 20
    assert result(remove_repeats(df, replace(SMALL, most=12))) == want
