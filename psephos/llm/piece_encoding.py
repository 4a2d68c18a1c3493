"""SentencePiece BPE encoding and decoding that keep byte offsets.

A text is first normalised: at each position the longest prefix found in the
model's compiled character map (a double-array trie) is replaced by its
image, else one character is copied; every output character records the
source byte it came from.  Blanks become the blank mark, one is put in front.
The tokenizer library segments the normalised text as it is (its own
normaliser is switched off).  Texts over ``CHUNK`` characters go to it in
chunks that start at a blank mark, which no piece reaches over (this is
checked for the model), so memory stays bounded.  Characters outside the
vocabulary are byte pieces.  Every piece is then projected to a span of bytes
of the source text, with array operations over a text's pieces.

A null text counts as empty; an empty text has no pieces and decodes to "".
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import ship

BLANK = "▁"
#: Characters that the library segments at once, or up to the next blank mark.
CHUNK = 500_000


def _fields(buf: bytes):
    """(number, wire type, value) of a serialised message's fields."""
    i, end = 0, len(buf)

    def varint():
        nonlocal i
        shift = out = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, buf[i : i + 8]
            i += 8
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[i : i + n]
            i += n
        elif kind == 5:
            yield key >> 3, buf[i : i + 4]
            i += 4
        else:
            raise ValueError(f"unknown wire type {kind}")


def read_pieces(blob: bytes) -> tuple[list[str], list[float], list[int], bytes, bool]:
    """Pieces, scores and kinds of a model file, its character map, and whether bytes stand in for unknown characters."""
    pieces, scores, kinds, charmap, fallback = [], [], [], b"", False
    for number, value in _fields(blob):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, 1))
        elif number == 2:
            fallback = bool(dict(_fields(value)).get(35, 0))
        elif number == 3:
            charmap = dict(_fields(value)).get(2, b"")
    return pieces, scores, kinds, charmap, fallback


class CharMap:
    """The compiled character map: longest-prefix lookups in a double array."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.images = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` in the map, and its image."""
        units, found = self.units, None
        pos = 0
        unit = units[0]
        pos ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            pos ^= data[k]
            if pos >= len(units):
                break
            unit = units[pos]
            if unit & 0x800000FF != data[k]:
                break
            pos ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (k + 1 - at, units[pos] & 0x7FFFFFFF)
        if found is None:
            return None
        n, where = found
        return n, self.images[where : self.images.index(b"\0", where)]


class Model:
    """What encoding needs of a ``.model`` file."""

    def __init__(self, blob: bytes):
        self.pieces, _, self.kinds, charmap, fallback = read_pieces(blob)
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(blob):
            if number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.charmap = CharMap(charmap)
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim_blanks = bool(normalizer.get(4, 1))
        #: The bytes each id stands for in a text.
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.special = frozenset(i for i, k in enumerate(self.kinds) if k in (2, 3))
        plain = [p for p, k in zip(self.pieces, self.kinds) if k == 1]
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not normalizer.get(5, 1) or not fallback:
            raise ValueError("only BPE models with byte pieces that mark blanks in front of a word are handled")
        if any(k in (4, 5) for k in self.kinds) or any(BLANK in p.lstrip(BLANK) or len(p) > 255 for p in plain):
            raise ValueError("models with user-defined or unused pieces, or with pieces of several words, are not handled")


def load_model(path: str) -> bytes:
    """The bytes of a model file, read by the driver (a vocabulary, of bounded size)."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    def __init__(self, blob: bytes):
        self.m = Model(blob)
        self.names = [str(i) for i in range(len(self.m.pieces))]
        #: Characters of each piece; for byte pieces -1 less the byte.
        self.chars = np.array([-1 - int(p[3:5], 16) if k == 6 else len(p) for p, k in zip(self.m.pieces, self.m.kinds)], np.int64)
        # The library gets normalised text: the library gets them with its own normaliser switched off.
        # A field that comes again in a serialised message replaces the earlier one.
        off = b"\x12\x00\x18\x00\x20\x00"
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob + b"\x1a" + bytes([len(off)]) + off)

    # -- normalisation -------------------------------------------------
    def normalise(self, text: str) -> tuple[str, list[int] | None, int]:
        """Marked text; the source byte at which each character starts, with the end last
        (None: every character stands for itself, in order); marks put in front."""
        m = self.m
        if not m.charmap.units and not m.trim_blanks:
            front = 1 if m.dummy_prefix and text else 0
            return (BLANK if front else "") + text.replace(" ", BLANK), None, front
        data = text.encode()
        out: list[str] = []
        at: list[int] = []
        i, before = 0, m.trim_blanks
        while i < len(data):
            hit = m.charmap.longest(data, i) if m.charmap.units else None
            if hit:
                n, image = hit
            else:
                n = _width(data[i])
                image = data[i : i + n]
            for c in image.decode():
                if c == " " and m.trim_blanks and before:
                    continue
                out.append(BLANK if c == " " else c)
                at.append(i)
                before = c == " "
            i += n
        end = len(data)
        if m.trim_blanks:
            while out and out[-1] == BLANK:
                out.pop()
                end = at.pop()
        front = 1 if m.dummy_prefix and out else 0
        if front:
            out.insert(0, BLANK)
            at.insert(0, at[0])
        return "".join(out), [*at, end], front

    # -- results -------------------------------------------------------
    def chunks(self, marked: str) -> list[str]:
        if len(marked) <= CHUNK:
            return [marked]
        out, at = [], 0
        while at < len(marked):
            end = marked.find(BLANK, at + CHUNK)
            while end > 0 and marked[end - 1] == BLANK:  # not within a run of marks
                end = next((k for k in range(end, len(marked)) if marked[k] != BLANK), -1)
                end = marked.find(BLANK, end) if end > 0 else -1
            out.append(marked[at : end if end > 0 else len(marked)])
            at = end if end > 0 else len(marked)
        return out

    def ids(self, marked: str) -> list[int]:
        """Ids of a normalised text."""
        return [i for c in self.chunks(marked) for i in self.library.encode(c)]

    def project(self, text: str, at: list[int] | None, front: int, ids: list[int]):
        """Start and end byte in ``text`` of every piece, as arrays."""
        num = np.array(ids, np.int64)
        if at is None:
            offsets = np.arange(-front, len(text) + 1)
            if front:
                offsets[0] = 0
            if not text.isascii():
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                offsets = np.concatenate([np.zeros(front + 1, np.int64), np.cumsum(width)])
        else:
            offsets = np.array(at, np.int64)
        took = self.chars[num]  # characters each piece takes; a character's byte pieces: the last one takes it
        is_byte = took < 0
        if not is_byte.any():
            after = np.cumsum(took)
            return offsets[after - took], offsets[after]
        value = -took - 1
        lead = is_byte & ((value < 0x80) | (value >= 0xC0))
        width = np.where(lead, 1 + (value >= 0xC0) + (value >= 0xE0) + (value >= 0xF0), 0)
        first = np.maximum.accumulate(np.where(lead, np.arange(len(num)), 0))
        place, total = np.arange(len(num)) - first, width[first]
        took = np.where(is_byte, place == total - 1, took)
        after = np.cumsum(took)
        before = after - took
        starts, ends = offsets[before], offsets[np.where(is_byte, before + 1, after)]
        own = is_byte & (ends - starts == total)  # a character copied as it is: a byte for each byte piece
        return np.where(own, starts + place, starts), np.where(own, starts + place + 1, ends)

    def encode_arrays(self, text: str | None):
        """The ids (a list), and the arrays of start and end bytes."""
        if not text:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        marked, at, front = self.normalise(text)
        ids = self.ids(marked)
        return ids, *self.project(text, at, front, ids)

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the start and end byte in the source of every piece."""
        ids, starts, ends = self.encode_arrays(text)
        return ids, starts.tolist(), ends.tolist()

    def decode(self, ids) -> str:
        """The text of ids: blank marks become blanks, runs of byte pieces are read as UTF-8
        (each byte that is not part of a character becomes U+FFFD), the mark in front goes."""
        ids = list(ids)
        if not ids or self.m.trim_blanks or not self.m.special.isdisjoint(ids):
            return self._decode_slow(ids)
        raw = b"".join([self.m.surface[i] for i in ids])
        if self.m.dummy_prefix and raw[:1] == b" " and self.m.kinds[ids[0]] == 1:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # bytes that are no character
            return self._decode_slow(ids)

    def _decode_slow(self, ids) -> str:
        """Piece by piece."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in [*ids, None]:
            if i is not None and self.m.kinds[i] == 6:
                raw.append(int(self.m.pieces[i][3:5], 16))
                first = False
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i is None:
                break
            kind = self.m.kinds[i]
            if kind == 3:
                continue
            piece = self.m.unk_surface if kind == 2 else self.m.pieces[i].replace(BLANK, " ")
            if first and kind != 2 and self.m.dummy_prefix and piece[:1] == " ":
                piece = piece[1:]
            first = first and self.m.trim_blanks and not piece
            out.append(piece)
        return "".join(out)


def _width(first: int) -> int:
    """Bytes of a UTF-8 character by its first byte."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _utf8(raw: bytes) -> str:
    """Characters of ``raw``; each byte that starts none becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        n = _width(raw[i])
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("\ufffd")
            i += 1
    return "".join(out)


PIECES = "array<struct<id:int,start:int,end:int>>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>"


#: A Python worker's encoder, kept between its tasks.
_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _with_encoder(model: bytes, make, kind: str):
    """An Arrow UDF that maps each text by ``make(encoder, text)``."""

    @F.arrow_udf(kind)
    def mapped(texts: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        return pa.array([make(encoder, t.as_py()) for t in texts], type=ARROW[kind])

    return mapped


ARROW = {
    PIECES: pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])),
    DIGEST: pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())]),
}


def _pieces(encoder: Encoder, text: str | None) -> list[dict]:
    return [{"id": i, "start": a, "end": b} for i, a, b in zip(*encoder.encode(text))]


def _digest(encoder: Encoder, text: str | None) -> dict:
    ids, starts, ends = encoder.encode_arrays(text)
    hexa = lambda b: hashlib.sha256(b).hexdigest()
    written = ",".join([encoder.names[i] for i in ids]).encode()
    spans = np.stack([starts, ends], 1).astype("<i4").tobytes()
    return {"n_tokens": len(ids), "ids_sha256": hexa(written), "decoded_sha256": hexa(encoder.decode(ids).encode()), "spans_sha256": hexa(spans)}


def encode_pieces(docs: DataFrame, model: bytes, text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with ``out``: id, start byte and end byte of every piece (a column of that name is replaced)."""
    ship(docs.sparkSession)
    return docs.withColumn(out, _with_encoder(model, _pieces, PIECES)(F.col(f"`{text}`")))


def encode_digest(docs: DataFrame, model: bytes, text: str = "text", out: str = "encoded") -> DataFrame:
    """``docs`` with ``out``: number of ids, and digests of ids, decoded text and spans."""
    ship(docs.sparkSession)
    return docs.withColumn(out, _with_encoder(model, _digest, DIGEST)(F.col(f"`{text}`")))


def decode_ids(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        return pa.array([None if r.as_py() is None else encoder.decode(r.as_py()) for r in rows], type=pa.string())

    return decoded(ids)
