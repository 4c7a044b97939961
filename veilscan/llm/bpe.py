"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from the vocabulary.

Each token's bytes become characters (byte b is chr(256 + b)), its score is the negative rank, and the text
passes the model unchanged: identity normalisation, no dummy blank, no escapes. sentencepiece merges the adjacent pair of
the highest score, leftmost first, which is the rank order of byte-level BPE. A pre-token that is a vocabulary entry is that entry.
Decoding maps ids to pieces and pieces back to bytes.

* Null texts count as empty; empty texts have no tokens. Repeated rows are encoded alike. Other columns are not read.
* Texts are encoded whole, in the tasks that read them, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from veilscan.llm.common import in_small_batches
from veilscan.llm.units import KEPT_FIELDS, Units

VOCABULARY = "byte_bpe_50k.tiktoken"
SHIFT = 256
#: Pre-tokens encoded at a time, so that a huge text needs no list of all its parts.
PART = 1 << 16
#: Rows whose ids are held and sent on together, and fields that a task keeps beside ids that it sends on.
ROWS = 512
KEPT_WITH_IDS = 100_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))]


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


def to_bytes(chars: str) -> bytes:
    return bytes(ord(c) - SHIFT for c in chars)


_UP = {b: b + SHIFT for b in range(256)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: a length-delimited string, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_of(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose id i is tokens[i]; the unknown piece, which no byte needs, comes last."""
    # Fixed values of the model format: a piece is (1 text, 2 score, 3 type; type 2 unknown), the model (1 pieces, 2 trainer, 3 normaliser),
    # the trainer (3 model type, 2 for BPE; 4 size; 40 to 43 unknown, begin, end, pad), the normaliser (1 name, 3 dummy blank, 4 squeeze blanks, 5 escape blanks).
    pieces = [_field(1, _field(1, to_chars(t).encode()) + _field(2, float(-rank))) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(tokens))
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.pieces = [to_bytes(self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.pattern = regex.compile(pattern)

    def units(self, kept: int = KEPT_FIELDS) -> Units:
        """A store of fields, which a task gives up at its end, so that idle workers hold none."""
        return Units(self._encode_all, kept=kept)

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        out = [self.whole.get(p) for p in parts]
        rest = {parts[k] for k, ids in enumerate(out) if ids is None}
        found = {p: struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(rest, self.model.encode([to_chars(p) for p in rest]), strict=True)}
        return [found[p] if ids is None else ids for p, ids in zip(parts, out, strict=True)]

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        """Pre-tokens of all texts, PART at a time, go through the model in one call."""
        out = [b""] * len(texts)
        matches = ((k, m.group().encode()) for k, text in enumerate(texts) for m in self.pattern.finditer(text))
        while part := list(itertools.islice(matches, PART)):
            found: dict[int, list[bytes]] = {}
            for (k, _), ids in zip(part, self._encode_parts([p for _, p in part]), strict=True):
                found.setdefault(k, []).append(ids)
            for k, ids in found.items():
                out[k] += b"".join(ids)
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.units().encode_all(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The coder of this Python worker, built once."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str = "", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with_ids the ids themselves (little-endian unsigned 32-bit)."""

    def rows(batches):
        bpe = coder(path or public_tokenizers.path(VOCABULARY))
        units = bpe.units(KEPT_WITH_IDS if with_ids else KEPT_FIELDS)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            counts, id_sums, text_sums, kept = [], [], [], []
            for ids in units.encode_all(text.as_py() or "" for text in batch.column(1)):
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(rows, schema + (", ids binary" if with_ids else ""))
