"""SentencePiece encoding that keeps, for every piece, the bytes of the source it stands for, and decoding.

The normaliser is written here: at each place the longest entry of the compiled character map (a double-array trie in the model
file) is replaced, and every normalised byte keeps the source byte it comes from; then white space is trimmed, escaped and prefixed as the
model asks. The merges are done on the normalised text by the model stripped of its own normaliser. Lengths of pieces, summed and
sent through the alignment, are the spans.

Null texts count as empty. Every row is kept, whatever its id.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, ready

SPACE = "▁"


def _fields(raw: bytes):
    """Field number and value of each entry of a protocol-buffer message, with the bytes it takes."""

    def varint(i):
        value = shift = 0
        while True:
            byte = raw[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        began = i
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value, raw[began:i]


class Normaliser:
    """Longest-prefix replacement by a compiled map, with the source position of every byte."""

    def __init__(self, spec: bytes):
        values = {number: value for number, value, _ in _fields(spec)}
        charmap = values.get(2, b"")
        self.prefix, self.trim, self.escape = bool(values.get(3, 1)), bool(values.get(4, 1)), bool(values.get(5, 1))
        size = struct.unpack("<I", charmap[:4])[0] if charmap else 0
        self.units = struct.unpack(f"<{size // 4}I", charmap[4 : 4 + size])
        self.strings = charmap[4 + size :]

    @property
    def plain(self) -> bool:
        """Only escapes and prefixes."""
        return not self.units and self.prefix and self.escape and not self.trim

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry of the map at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = 0 ^ self._jump(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte."""
        raw, out, source, at = text.encode(), bytearray(), [], 0
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit is None:
                size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                hit = size, raw[at : at + size]
            out += hit[1]
            source += [at] * len(hit[1])
            at += hit[0]
        source.append(at)
        spaces = np.frombuffer(bytes(out), np.uint8) == 32
        keep = np.ones(len(out), bool)
        if self.trim and len(out):
            keep[1:] = ~(spaces[1:] & spaces[:-1])
            keep[0] = not spaces[0]
            ends = np.flatnonzero(~spaces)
            keep[ends[-1] + 1 if len(ends) else 0 :] = False
        index = np.flatnonzero(keep)
        kept, source = bytes(np.frombuffer(bytes(out), np.uint8)[index]), np.asarray(source, np.int64)
        source = np.append(source[index], source[index[-1] + 1] if len(index) else at)
        if self.prefix and kept:
            kept, source = b" " + kept, np.insert(source, 0, source[0])
        if self.escape:
            wide = np.where(np.frombuffer(kept, np.uint8) == 32, 3, 1)
            kept, source = kept.replace(b" ", SPACE.encode()), np.append(np.repeat(source[:-1], wide), source[-1])
        return kept.decode(), source


class PieceModel:
    """A model file without its normaliser for the merges, and the normaliser beside it."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        spec = b"".join(value for number, value, _ in _fields(raw) if number == 3)
        bare = b"".join(entry for number, _, entry in _fields(raw) if number != 3)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # name; no prefix, no trimming, no escapes
        self.model = sentencepiece.SentencePieceProcessor(model_proto=bare + b"\x1a" + bytes([len(plain)]) + plain)
        self.normalise = Normaliser(spec)
        count = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(count)]
        self.end = self.model.eos_id()
        #: Bytes that an id stands for in a decoded text, and in the normalised text.
        self.bytes = [b"" if self.model.is_control(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [f"{i} " for i in range(count)]

    def clean(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and its alignment (None: prefix and escapes are the only change)."""
        if self.normalise.plain and SPACE not in text:
            return (SPACE + text.replace(" ", SPACE) if text else ""), None
        return self.normalise(text)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, bytes, np.ndarray | None]:
        """Ids, the bytes of normalised text each stands for, the bytes they decode to before the prefix is dropped, and the alignment."""
        clean, source = self.clean(text)
        ids = self.model.encode(clean) if clean else []
        raw = b"".join([self.bytes[i] for i in ids])
        if len(raw) == len(clean.encode()):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
        else:  # pieces that aren't in the vocabulary stand for their own surface
            sizes = np.array([len(p.surface.encode()) for p in self.model.encode(clean, out_type="immutable_proto").pieces], np.int64)
        return ids, sizes, raw, source

    def spans(self, text: str, sizes: np.ndarray, source: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte in the source of every piece."""
        ends = np.cumsum(sizes, dtype=np.int64)
        if source is None:  # each escape takes three bytes for one, and the first stands for nothing
            raw = (SPACE + text.replace(" ", SPACE)).encode()
            extra = np.cumsum(np.frombuffer(raw, np.uint8) == 0xE2) if raw.count(SPACE.encode()) == raw.count(b"\xe2") else None
            if extra is None:
                clean = np.frombuffer(raw, np.uint8)
                extra = np.cumsum((clean[:-2] == 0xE2) & (clean[1:-1] == 0x96) & (clean[2:] == 0x81))
                extra = np.append(extra, [extra[-1]] * 2) if len(extra) else np.zeros(len(raw), np.int64)
            ends = np.maximum(ends - 2 * extra[ends - 1] - 1, 0) if len(ends) else ends
        else:
            ends = source[ends]
        return np.append(0 if source is None or not len(source) else source[0], ends[:-1]) if len(ends) else ends, ends

    def decoded(self, raw: bytes) -> str:
        """What the library's decode makes of the ids."""
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.normalise.prefix and text[:1] == " " else text


_loaded: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (with the end id), begins and ends (source bytes of every piece but the end id)."""
    ready(docs.sparkSession)

    def step(batch):
        own, out = piece_model(model), {"ids": [], "begins": [], "ends": []}
        texts = batch.column("text").to_pylist()
        for text in texts:
            ids, sizes, _, source = own.encode(text or "")
            begins, ends = own.spans(text or "", sizes, source)
            for k, v in (("ids", [*ids, own.end]), ("begins", begins), ("ends", ends)):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "text": texts} | out

    return in_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id long, text string, ids array<int>, begins array<long>, ends array<long>", step)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The encoded rows with the decoded text."""

    def step(batch):
        own = piece_model(model)
        texts = [own.decoded(b"".join(own.bytes[i] for i in ids or [])) for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": texts}

    return in_batches(encoded.select("doc_id", "ids"), "doc_id long, ids array<int>, decoded string", step)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """encode and decode in one step, without keeping their outputs: token count, digests of ids, decoded text and spans."""
    ready(docs.sparkSession)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def step(batch):
        own = piece_model(model)
        out: dict = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_crc32")}
        for text in batch.column("text").to_pylist():
            text = text or ""
            ids, sizes, raw, source = own.encode(text)
            begins, ends = own.spans(text, sizes, source)
            out["n_tokens"].append(len(ids) + 1)
            out["ids_sha256"].append(sha(("".join([own.decimal[i] for i in ids]) + str(own.end)).encode()))
            out["decoded_sha256"].append(sha(own.decoded(raw).encode()))
            out["n_source_bytes"].append(int((ends - begins).sum()))
            out["spans_crc32"].append(zlib.crc32(ends.astype("<i8").tobytes()))
        return {"doc_id": batch.column("doc_id")} | out

    return in_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long, spans_crc32 long", step)
