"""SentencePiece encoding and decoding that keeps, for every piece, its span of source bytes.

A model file is read for its pieces, scores and compiled character map. A text is normalised by the
longest prefix found in the character map at each place; each normalised byte remembers the source
byte it came from. Pairs of symbols merge by score, and pieces are projected through the alignment
to spans of the original UTF-8 bytes.

Cases: a null text counts as empty; an empty text has the begin and end ids only. Texts of any length
are encoded whole. Repeated rows give equal rows. Characters without a piece become byte pieces, or
the unknown id in models without byte fallback. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from appwatch.llm import common

SPACE = "▁"  # fixed value: stands for a space in pieces
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what the unknown id decodes to
NEVER = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie of source strings, then their targets."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.targets = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped string at ``at`` and what replaces it."""
        units = self.units
        node = units[0]
        place = (node >> 10) << ((node & 512) >> 6)
        found = None
        for i in range(at, len(source)):
            byte = source[i]
            place ^= byte
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != byte:
                break
            place ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.targets.index(0, found[1])
        return found[0], self.targets[found[1] : end]


@dataclass
class Model:
    """Pieces and settings of a model file, with the encodings of recent chunks of text."""

    data: bytes
    cache_limit: int = 300_000
    SHORT = 48
    pieces: list[tuple[str, float, int]] = field(init=False, default_factory=list)

    def __post_init__(self):
        self.charmap, self.dummy_prefix, self.squeeze, self.escape = None, True, True, True
        self.unknown, self.begin, self.end, self.fallback, self.suffix = 0, 1, 2, False, False
        for number, value in _fields(self.data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                self._training(value)
            elif number == 3:
                self._normaliser(value)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if self.suffix or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces, or with spaces as suffixes, are not supported")
        merged = [p for p in self.ids if len(p) > 1]
        self.split = None
        if all(SPACE not in p.lstrip(SPACE) for p in merged):
            # No piece runs from another character into a space, and none holds a line end: cut there.
            alone = "".join(c for c in "\n\t\r" if not any(c in p for p in merged))
            lone = f"[{re.escape(alone)}]|" if alone else ""
            self.split = re.compile(f"{lone}{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+")
        self.surfaces = [self._surface(p, kind) for p, _, kind in self.pieces]
        self.chunks = _Chunks(self)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        """What a piece decodes to; control pieces part the bytes around them, so inside a text they are no valid UTF-8."""
        if kind == BYTE:
            return bytes((int(piece[3:5], 16),))
        if kind == CONTROL:
            return b"\xff"
        return (UNKNOWN_SURFACE if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def _training(self, data: bytes) -> None:
        for n, v in _fields(data):
            if n == 3 and v != 2:
                raise ValueError("only models that merge pairs (BPE) are supported")
            self.unknown = v if n == 40 else self.unknown
            self.begin = v if n == 41 else self.begin
            self.end = v if n == 42 else self.end
            self.fallback = bool(v) if n == 35 else self.fallback
            self.suffix = bool(v) if n == 24 else self.suffix

    def _normaliser(self, data: bytes) -> None:
        for n, v in _fields(data):
            if n == 2 and v:
                self.charmap = CharacterMap(v)
            self.dummy_prefix = bool(v) if n == 3 else self.dummy_prefix
            self.squeeze = bool(v) if n == 4 else self.squeeze
            self.escape = bool(v) if n == 5 else self.escape

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and the source byte of each normalised byte and of the end.

        Without a character map and space squeezing only spaces change, so the alignment is plain;
        it is then left out and derived by :meth:`align`.
        """
        if not text:
            return "", [0]
        space = SPACE if self.escape else " "
        if self.charmap is None and not self.squeeze:
            return (space if self.dummy_prefix else "") + text.replace(" ", space), None
        source = text.encode()
        out, origin = bytearray(), []
        wide = space.encode()
        at, end = 0, len(source)
        before = True  # at the start or after a space: further spaces go if squeezed
        started = False
        while at < end:
            size, target = self._step(source, at)
            if self.squeeze and before:
                target = target.lstrip(b" ")
            if target:
                if not started and self.dummy_prefix:
                    out += wide
                    origin += [at] * len(wide)
                started = True
                for byte in target:
                    chunk = wide if byte == 32 else bytes((byte,))
                    out += chunk
                    origin += [at] * len(chunk)
                before = target.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(wide):
                del out[-len(wide) :]
                at = origin[-len(wide)]
                del origin[-len(wide) :]
        return out.decode(), [*origin, at]

    def _step(self, source: bytes, at: int) -> tuple[int, bytes]:
        found = self.charmap.longest(source, at) if self.charmap else None
        if found:
            return found
        size = 1
        while at + size < len(source) and source[at + size] & 0xC0 == 0x80:
            size += 1
        return size, source[at : at + size]

    def align(self, text: str, normal: str, origin: list[int] | None) -> list[int]:
        """The source byte of each normalised byte and of the end."""
        return self._origin(text, origin).tolist()

    def _origin(self, text: str, origin: list[int] | None) -> np.ndarray:
        if origin is not None:
            return np.array(origin, dtype=np.int64)
        source = np.frombuffer(text.encode(), dtype=np.uint8)
        space = len(SPACE.encode()) if self.escape else 1
        plain = np.repeat(np.arange(len(source)), np.where(source == 32, space, 1))
        return np.concatenate([np.zeros(space * self.dummy_prefix, dtype=np.int64), plain, [len(source)]])

    def cut(self, normal: str) -> list[str]:
        """Chunks that no piece crosses."""
        return self.split.findall(normal) if self.split else [normal] * bool(normal)

    def merge(self, chunk: str) -> list[str]:
        """Surfaces of the pieces of a chunk: the pair of best score merges first, ties from the left."""
        symbols: list[str | None] = list(chunk)
        scores = self.scores
        if len(symbols) <= self.SHORT:
            return self._merge_short(symbols)
        left = list(range(-1, len(symbols) - 1))
        right = list(range(1, len(symbols))) + [-1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                pair = symbols[i] + symbols[j]
                score = scores.get(pair)
                if score is not None:
                    heapq.heappush(agenda, (-score, i, j, pair))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s is not None]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same for few symbols, where looking at every pair again is cheaper than an agenda."""
        score, none = self.scores.get, NEVER
        pairs = [a + b for a, b in zip(symbols, symbols[1:])]
        ranks = [score(p, none) for p in pairs]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] = joined = pairs[i]
            del symbols[i + 1], pairs[i], ranks[i]
            if i < len(pairs):
                pairs[i] = pair = joined + symbols[i + 1]
                ranks[i] = score(pair, none)
            if i:
                pairs[i - 1] = pair = symbols[i - 1] + joined
                ranks[i - 1] = score(pair, none)
        return symbols

    def pieces_of(self, chunk: str) -> list[tuple[int, int]]:
        """Ids of a chunk, each with the number of normalised bytes it covers; a byte piece covers one."""
        out = []
        for surface in self.merge(chunk):
            known = self.ids.get(surface)
            raw = surface.encode()
            if known is not None:
                out.append((known, len(raw)))
            elif self.fallback:
                out += [(self.bytes[b], 1) for b in raw]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + len(raw))
            else:
                out.append((self.unknown, len(raw)))
        return out

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids with begin and end, and the first and past-the-last source byte of each.

        Begin and end have empty spans. The space put before a text has an empty span at its start.
        """
        ids, starts, ends = self.arrays(text)
        return ids.tolist(), starts.tolist(), ends.tolist()

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What :meth:`encode` gives, as arrays."""
        text = text or ""
        normal, origin = self.normalise(text)
        origin = self._origin(text, origin)
        parts = [self.chunks[c] for c in self.cut(normal)]
        ids = np.frombuffer(b"".join([p[0] for p in parts]), dtype=np.uint32)
        edges = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), dtype=np.uint32), out=edges[1:])
        bounds = origin[edges]
        starts, ends = bounds[:-1], bounds[1:]
        if not self.fallback:  # unknown ids join over chunks
            apart = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            first = np.concatenate([[True] * bool(len(ids)), apart]).astype(bool)
            last = np.concatenate([apart, [True] * bool(len(ids))]).astype(bool)
            ids, starts, ends = ids[first], starts[first], ends[last]
        end = origin[-1]
        return np.concatenate([[self.begin], ids, [self.end]]), np.concatenate([[0], starts, [end]]), np.concatenate([[0], ends, [end]])

    def surface(self, ids) -> bytes:
        """Pieces joined; bytes that are no valid UTF-8 become replacement characters one by one."""
        low, high = 0, len(ids)
        while low < high and self.pieces[ids[low]][2] == CONTROL:
            low += 1
        while low < high and self.pieces[ids[high - 1]][2] == CONTROL:
            high -= 1
        raw = b"".join([*map(self.surfaces.__getitem__, ids[low:high])])
        try:
            raw.decode()
            return raw  # whole, so each run of byte pieces between other pieces is valid too
        except UnicodeDecodeError:
            pass
        out, pending = bytearray(), bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                pending.append(int(piece[3:5], 16))
                continue
            out += _valid(pending)
            pending.clear()
            if kind == UNKNOWN:
                out += UNKNOWN_SURFACE.encode()
            elif kind != CONTROL:
                out += piece.replace(SPACE, " ").encode()
        return bytes(out + _valid(pending))

    def trim(self, surface: bytes) -> bytes:
        if self.squeeze:
            return surface.lstrip(b" ")
        return surface[1:] if self.dummy_prefix and surface.startswith(b" ") else surface

    def decode(self, ids) -> str:
        surface = self.surface(ids)
        first = next((self.pieces[i] for i in ids if self.pieces[i][2] != CONTROL), ("", 0.0, CONTROL))
        return (self.trim(surface) if first[0].startswith(SPACE) else surface).decode()

    def count(self, text: str | None) -> int:
        """Number of ids without begin and end."""
        if not self.fallback:
            return len(self.encode(text)[0]) - 2
        return sum([len(self.chunks[c][0]) // 4 for c in self.cut(self.normalise(text or "")[0])])


class _Chunks(dict):
    """Packed ids, and the normalised bytes that each covers, by chunk. When full, what was not asked for since the last time goes."""

    LONG = 200

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        found = self.old.get(chunk)
        if found is None:
            pieces = self.model.pieces_of(chunk)
            found = array("I", [p[0] for p in pieces]).tobytes(), array("I", [p[1] for p in pieces]).tobytes()
        if len(chunk) <= self.LONG:
            if len(self) >= self.model.cache_limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _valid(raw: bytes) -> bytes:
    """``raw`` if it is UTF-8; else its valid characters, with a replacement for each other byte."""
    out, at = bytearray(), 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                bytes(raw[at : at + size]).decode()
            except UnicodeDecodeError:
                continue
            out += raw[at : at + size]
            at += size
            break
        else:
            out += "�".encode()
            at += 1
    return bytes(out)


_models: dict[str, Model] = {}


def load(name: str) -> Model:
    """The model of a file sent with :func:`send`, once per process."""
    if name not in _models:
        with open(SparkFiles.get(name), "rb") as f:
            _models[name] = Model(f.read())
    return _models[name]


def send(spark, path: str) -> str:
    """Ship a model file to every executor; its name there is returned."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


FIELDS = {
    "ids": "array<int>",
    "starts": "array<int>",
    "ends": "array<int>",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encoded(model: Model, text: str | None, outputs) -> dict:
    """The chosen ``outputs`` of a text. All come from its ids and spans; the decoded text comes from the ids."""
    ids, starts, ends = model.arrays(text)
    made = {
        "ids": ids.tolist,
        "starts": starts.tolist,
        "ends": ends.tolist,
        "n_tokens": lambda: len(ids),
        "ids_sha256": lambda: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest(),
    }
    return {o: made[o]() for o in outputs}


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs=("ids", "starts", "ends", "n_tokens")
) -> DataFrame:
    """One row per document: its id and the chosen ``outputs``.

    ``ids`` come with begin and end ids; ``starts`` and ``ends`` are byte spans in the original text;
    ``ids_sha256`` and ``decoded_sha256`` are digests of the ids and of the text decoded from them.
    Ids and spans are made for every text, whichever outputs are chosen.
    One pass, no shuffle; each process keeps the encodings of recent chunks, up to a fixed number.
    """
    name = send(docs.sparkSession, model_path)
    schema = ", ".join(["doc_id long", *(f"{o} {FIELDS[o]}" for o in outputs)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = load(name)
        for batch in common.slices(batches):
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), **{o: [] for o in outputs}}
            for text in batch.column(1).to_pylist():
                for o, value in encoded(model, text, outputs).items():
                    out[o].append(value)
            yield common.to_batch(out, schema)

    chosen = docs.select(common.field(docs, id_col, "long").alias("doc_id"), common.field(docs, text_col, "string").alias("text"))
    return common.map_arrow(chosen, run, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and the ``text`` that the ``ids`` decode to; null ids give an empty text."""
    name = send(encoded.sparkSession, model_path)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = load(name)
        for batch in common.slices(batches):
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield common.to_batch({"doc_id": batch.column(0).to_pylist(), "text": texts}, "doc_id long, text string")

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
