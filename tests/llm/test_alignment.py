from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from appwatch.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TINY = A.Params(range_chars=40, fan_in=2, cached=50, cached_chars=6)

TEXTS = [
    "plain words, some of them.  Two spaces\n\nlines\tand tabs ", " leading", "trailing ", "   ", "\n", "x", "",
    None, "<|endoftext|> and <s> </s> <unk> <0x41>", "it's we're I'll don't 's 't", "日本語のテキスト。空白なし" * 9, "a b c　d e f g\u0085h",
    "naïve café Ünï 😀😀 👩‍👩‍👧 é", "▁ a piece sign", "mixed ▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b",
    "x\x00y \x01 \x7f ﻿q", "0123456789 " * 20, "https://example.com/a?b=c&d=%20%20#x" * 3, "İstanbul ſharp ﬁ", "tab\t\tspace  \t end", "𝕏" * 50 + " 𝕏",
]


def brute(rows):
    """The contract, text by text, with whole encodings and sets of ends."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = A.byte_alphabet()
    encoded = []
    for doc_id, text in rows:
        text = text or ""
        data = (" " + text).encode()
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = (
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if not text or any(b"".join(s) != data for s in spelt):
            encoded.append((doc_id, [], [], []))
            continue
        ends = []
        for s in spelt:
            at, out = 0, []
            for t in s:
                at += len(t)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        number = {cut: i for i, cut in enumerate(cuts)}
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            at = 0
            for i, e in zip(ids[k], ends[k]):
                groups[at][k].append(i)
                at = number.get(e, at - 1) + 1
        encoded.append((doc_id, *ids, groups))
    pairs = Counter((g[0][-1], g[1][-1]) for *_, groups in encoded for g in groups)
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, x, y, groups in encoded:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), digest))
    return out


def same(df, rows):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = [t for t in TEXTS if t]
    mixed = ["".join(rng.choice(pool)[: rng.randint(1, 60)] + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    return [*enumerate(TEXTS), *enumerate(mixed, 100), (0, TEXTS[0]), (None, mixed[0])]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(A.align(df, *PATHS), rows)


def test_ranges_over_many_tasks_give_the_same(spark, rows):
    """Texts over 40 characters are cut into ranges and composed two at a time."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(A.align(df, *PATHS, TINY), rows)


def test_odd_rows_and_clashing_columns(odd, odd_rows):
    clashing = odd.selectExpr("*", "1 as row", "2 as parts", "'x' as links", "3 as n_a", "4 as window")
    same(A.align(clashing, *PATHS, A.Params(range_chars=5000)), [(i, t) for i, t, _, _ in odd_rows])


def test_empty_table(empty):
    assert A.align(empty, *PATHS).count() == 0


@pytest.fixture(scope="module")
def both():
    return A.Tokenizers(*PATHS)


def test_fragments_compose_in_any_order_of_work(both):
    rng = random.Random(2)
    open_ends = 0
    for text in [*(t for t in TEXTS if t and len(t) > 8), "words and more words, " * 20]:
        ranges = A.windows(text, rng.randint(1, 6))
        parts = [both.fragment(*r) for r in ranges]
        whole = A.compose(parts)
        open_ends += sum(bool(p.suffix_a or p.suffix_b or not p.cut) for p in parts)
        for _ in range(3):
            tree = list(parts)
            while len(tree) > 1:
                i = rng.randrange(len(tree) - 1)
                tree[i : i + 2] = [A.compose(tree[i : i + 2])]
            assert tree[0] == whole
        assert A.compose([A.Fragment(), whole, A.Fragment()]) == whole
    assert open_ends > 5  # some ranges end inside a group


def test_words_encoded_together_are_the_same(both, monkeypatch):
    plain = [f"{x}{y}{z}" for x in ("th", "ré", "日", "O'") for y in ("ing", "ea", "9") for z in ("", ",", ".\nAn", "😀", "  b")]
    odd = sorted({w for t in TEXTS if t for w in A.SAFE.split(t)})
    encoded, arrays = [], both._arrays
    monkeypatch.setattr(both, "_arrays", lambda texts: encoded.append(len(texts)) or arrays(texts))
    found = both.learn(plain)
    assert sum(encoded) == 1 and None not in (e[0] for e in found.values())
    assert found == both.learn(plain, 1)
    mixed = [w for pair in zip(odd * 3, plain) for w in pair]
    assert both.learn(mixed) == both.learn(mixed, 1)
    assert not [w for w, e in both.learn(mixed).items() if (e[0] is None) != ("▁" in w)]


def test_words_asked_for_again_stay_when_others_go():
    both = A.Tokenizers(*PATHS, A.Params(cached=60))
    fresh, learned, learn = A.Tokenizers(*PATHS), Counter(), both.learn
    both.learn = lambda words, *rest: learned.update(words) or learn(words, *rest)
    often = [f"often{i}" for i in range(10)]
    for i in range(20):
        texts = [" ".join([*often, *(f"once{i}x{j}" for j in range(12)), "y" * 60, "z" * (50 + i)]), ""]
        got = [row for _, row in zip(texts, both.documents(texts))]
        assert got == list(fresh.documents(texts))
        assert len(both.words) <= 60 and sum(len(w) > both.params.cached_chars for w in both.words) == 2
    assert all(learned[w] == 1 for w in often)


def test_ranges_cover_the_bytes_once():
    for text in (t for t in TEXTS if t):
        ranges = A.windows(text, 7)
        assert sum(high - low for _, low, high in ranges) == len((" " + text).encode())
        assert sum(len(w) for w, _, _ in ranges) <= 4 * len(text) + 40 * len(ranges)
    long_word = A.windows("x" * 1000 + " y z", 10)
    assert max(len(w) for w, _, _ in long_word) < 1010 and sum(len(w) > 900 for w, _, _ in long_word) <= 2


def test_pairs_are_bounded_by_the_vocabularies(spark, both, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = A.encode(df, _names(spark), A.Params(), "doc_id", "text")
    pairs = A.count_pairs(parts.select("links"), both.links).collect()
    assert 0 < len(pairs) < both.most_pairs() < 2_000_000
    for r in pairs:
        x, y = both.a_bytes[r.link // both.size_b], both.b_bytes[r.link % both.size_b]
        assert x.endswith(y) or y.endswith(x)


def _names(spark):
    for p in PATHS:
        spark.sparkContext.addFile(p)
    return tuple(p.rsplit("/", 1)[-1] for p in PATHS)
