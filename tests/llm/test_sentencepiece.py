from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece as library

from appwatch.llm import sentencepiece as S
from appwatch.llm.queries import piece_model


@pytest.fixture(scope="module")
def model():
    with open(piece_model(), "rb") as f:
        return S.Model(f.read())


@pytest.fixture(scope="module")
def reference():
    return library.SentencePieceProcessor(model_file=piece_model())


SIGNS = ["a", " ", "  ", "\n", "\t", "▁", "é", "ß", "中", "😀", "\0", "the", " of", "0", "12", " ⁇ ", "<s>", "</s>", "<0x41>", "\r", "ﷺ", "é"]


def test_ids_and_text_equal_the_library(model, reference):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14)))
        ids = reference.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text)[0] == ids, repr(text)
        assert model.decode(ids) == reference.decode(ids), repr(text)
        assert model.count(text) == len(ids) - 2


def test_long_chunks_use_the_agenda(model, reference):
    rng = random.Random(2)
    for _ in range(20):
        text = "".join(rng.choice("etaoinshr") for _ in range(400))
        assert model.encode(text)[0][1:-1] == reference.encode(text)


def test_spans_tile_the_source(model):
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 14)))
        ids, starts, ends = model.encode(text)
        assert starts[1] == 0 and ends[-1] == len(text.encode()) and starts[2:-1] == ends[1:-2]
        raw = text.encode()
        for i, a, b in zip(ids[2:-1], starts[2:-1], ends[2:-1]):
            piece, _, kind = model.pieces[i]
            if kind == S.NORMAL:
                assert raw[a:b].decode().replace(" ", S.SPACE) == piece
            else:
                assert raw[a:b] == bytes([int(piece[3:5], 16)])


class Seen(S.Model):
    """A model that notes what it is asked for."""

    def arrays(self, text):
        out = super().arrays(text)
        self.spans = [x.tolist() for x in out]
        return out

    def decode(self, ids):
        self.decoded = ids
        return super().decode(ids)


def test_digests_come_from_ids_with_spans_and_from_decoding(reference):
    with open(piece_model(), "rb") as f:
        model = Seen(f.read())
    rng = random.Random(6)
    for text in [None, "", *("".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 40))) for _ in range(300))]:
        got = S.encoded(model, text, ("n_tokens", "ids_sha256", "decoded_sha256"))
        ids = reference.encode(text or "", add_bos=True, add_eos=True)
        assert model.spans[0] == ids == model.decoded and model.spans == list(model.encode(text))
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(reference.decode(ids).encode()).hexdigest()


def test_any_ids_decode_as_the_library_does(model, reference):
    """Bytes that are no text, characters out of byte pieces, and control ids between them."""
    rng = random.Random(7)
    some = [*range(0, 3), *(model.bytes[b] for b in (0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xFF)), model.ids["▁the"], model.ids["a"]]
    for _ in range(2000):
        ids = [rng.choice(some) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == reference.decode(ids), ids


def test_spans_by_another_way(model):
    """Each span is that of the piece's bytes in the normalised text, taken back character by character."""
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60)))
        back, at = [0] * 3 * bool(text), 0
        for c in text:
            size = len(c.encode())
            back += [at] * 3 if c == " " else range(at, at + size)
            at += size
        back.append(at)
        edges, wide = [0], 0
        for chunk in model.cut(model.normalise(text)[0]):
            for _, size in model.pieces_of(chunk):
                wide += size
                edges.append(wide)
        _, starts, ends = model.encode(text)
        assert starts == [0, *(back[e] for e in edges[:-1]), at] and ends == [0, *(back[e] for e in edges[1:]), at]


def test_unknown_ids_join_with_their_spans():
    with open(piece_model(), "rb") as f:
        model = S.Model(f.read())
    model.fallback = False
    ids, starts, ends = model.encode("a 𐍈\n𐍈 \n the")
    assert [i for i, k in enumerate(ids) if k == model.unknown] == [3, 5]
    assert (starts[3], ends[3], starts[5], ends[5]) == (2, 11, 12, 13) and starts[2:-1] == ends[1:-2]


def test_character_map_takes_the_longest_prefix_and_keeps_offsets():
    normaliser = library.SentencePieceNormalizer(rule_name="nmt_nfkc")
    data = normaliser.serialized_model_proto()
    model = S.Model(data)
    assert model.charmap is not None
    rng = random.Random(4)
    signs = ["ﬁ", "①", "Å", "é", "ｱ", "ﾞ", " ", "　", "a", "…", "㌔", "​", "\t", "\n", "½"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 10)))
        normal, origin = model.normalise(text)
        origin = model.align(text, normal, origin)
        want = normaliser.normalize(text)
        assert normal.replace(S.SPACE, " ").strip(" ") == want.replace(S.SPACE, " ").strip(" "), repr(text)
        assert len(origin) == len(normal.encode()) + 1
        assert origin == sorted(origin) and origin[-1] <= len(text.encode())


def test_documents(spark, odd, odd_rows, empty, reference):
    out = S.encode_documents(odd, piece_model(), outputs=("ids", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256"))
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    rows = [(i, reference.encode(t or "", add_bos=True, add_eos=True)) for i, t, _, _ in odd_rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))
    assert len(got) == len(rows)
    for r, (doc_id, ids) in zip(got, rows):
        assert (r.doc_id, list(r.ids), r.n_tokens) == (doc_id, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids).encode()).hexdigest()
    texts = {r.doc_id: r.text for r in S.decode_documents(out.where("doc_id = 14"), piece_model()).collect()}
    assert texts == {14: next(t for i, t, _, _ in odd_rows if i == 14)}
    assert S.encode_documents(empty, piece_model()).count() == 0
