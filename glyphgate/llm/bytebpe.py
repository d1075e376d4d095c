"""Byte-level BPE with a sentencepiece model written straight from the rank table.

Every byte is mapped to one printable character by rule, every token of the rank table becomes a piece of such
characters with the score minus its rank, and the model file is those pieces with BPE as its kind and the identity as
its normaliser. Of all neighbouring pieces sentencepiece then joins the pair whose joint piece has the best score, the
leftmost first, which is the merge by lowest rank. Piece ids are ranks plus one, as piece 0 is the unknown piece.

Texts are split into pre-tokens first; each is encoded for itself. A pre-token that is a token is that token. Every
Python worker keeps pre-tokens that it has encoded, up to a fixed number. Decoding maps ids to pieces and characters
back to bytes.

Defined results. Null text: as an empty text: no ids; the sha256 of no bytes. Repeated rows: each its own row. Null
doc_id: kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map

#: Pre-tokens that one worker keeps at most.
KEPT = 400_000
#: Longer pre-tokens are not kept.
KEPT_LENGTH = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()
_TO_CHARACTERS = dict(enumerate(CHARACTERS))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARACTERS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(no: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, float or whole number."""
    if isinstance(value, bytes):
        return _varint(no << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    return _varint(no << 3) + _varint(value)


def model_file(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: pieces (1), trainer settings (2), normaliser settings (3)."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, mapped(t).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces))  # the kind: BPE; the size
    trainer += _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)  # ids: unk 0, no bos, eos, pad
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, spaces stay, no escapes
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or model_file(ranks))
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        back = {ord(c): b for b, c in enumerate(CHARACTERS)}
        self.bytes_of = [bytes(back[ord(c)] for c in self.processor.id_to_piece(i + 1)) for i in range(len(ranks))]
        self.kept: dict[str, list[int]] = {}

    def _new(self, tokens: list[str]) -> None:
        """Encode pre-tokens that are not kept yet."""
        if len(self.kept) + len(tokens) > KEPT:
            self.kept.clear()
        raw = [t.encode() for t in tokens]
        whole = [self.ranks.get(r) for r in raw]
        rest = [mapped(r) for r, id_ in zip(raw, whole) if id_ is None]
        encoded = iter(self.processor.encode(rest, num_threads=1) if rest else ())
        for token, id_ in zip(tokens, whole):
            self.kept[token] = [id_] if id_ is not None else [i - 1 for i in next(encoded)]

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        kept = self.kept
        new = {t for t in tokens if t not in kept}
        if new:
            if len(new) + len(kept) > KEPT:
                new = set(tokens)
            self._new(list(new))
            kept = self.kept
        out: list[int] = []
        for ids in map(kept.__getitem__, tokens):
            out += ids
        if len(kept) > KEPT:
            kept.clear()
        elif new:
            for t in new:
                if len(t) > KEPT_LENGTH:
                    del kept[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a rank file, made once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _coders[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text; the vocabulary file is on every machine."""
    narrow = docs.select("doc_id", F.col("text").alias("__text"))
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        numbers = [str(i) for i in range(len(bpe.ranks))]
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(numbers.__getitem__, ids)).encode()))
                decoded_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(narrow, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text."""
    narrow = docs.select("doc_id", F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(narrow, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")
