"""Token ids in bit-packed files.

Each id takes the bits that the vocabulary's largest id needs. A file holds blocks of BLOCK ids, each packed and starting at a byte;
then an index: document ids, where each document starts, where each block starts; then a footer. Reading ids from a to b means
the blocks around them, unpacked at once with numpy. Files stand in the order of document ids, one per sorted partition.

    magic, bits u32, ids in a block u32 | blocks | doc ids i64, absent flags u8, starts u64 (one more than documents), block places u64 (one more than blocks) | documents u64, blocks u64, index place u64, magic

* Null texts count as empty; every document ends with END. Documents without an id come last.
* Rows that repeat an id stand side by side, by text. An empty table gives no documents. Other columns are not read.
* A task writes its own file and then its row of the manifest; a file of a lost task is in no manifest. Files are reached through
  pyarrow's file systems, so the folder may be any that it knows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import new_path, settle
from veilscan.llm.units import IdUnits

VOCABULARY = "byte_bpe_50k.json"
END = 2
BLOCK = 1 << 16
MAGIC = b"VSIDS01\n"
HEADER = struct.Struct("<8sII")
FOOTER = struct.Struct("<QQQ8s")
#: Fields that a Python worker keeps.
KEPT = 1_000_000
#: Texts that the library is given in one call.
ASKED = 64
#: Documents read from a file at a time.
AT_ONCE = 512


def bits_for(size: int) -> int:
    """Bits of the ids 0 to size - 1."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids at a time fill ``bits`` words of 64 bits; id j of each group goes to the same place of its words, for all groups at once."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    columns = np.ascontiguousarray(groups.T)
    words = np.zeros((bits, len(groups)), np.uint64)
    for j, column in enumerate(columns):
        word, shift = divmod(j * bits, 64)
        words[word] |= column << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    n_groups = -(-n // 64)
    words = np.ascontiguousarray(np.frombuffer(data.ljust(n_groups * bits * 8, b"\0"), "<u8").reshape(n_groups, bits).T)
    out, mask = np.empty((64, n_groups), "<u4"), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[j] = value & mask
    return out.T.reshape(-1)[:n]


class Writer:
    """Writes one file, block by block; the index is kept until the end."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.docs, self.absent, self.starts, self.places = array("q"), bytearray(), array("Q", [0]), array("Q", [HEADER.size])
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(HEADER.pack(MAGIC, bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.absent.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(ids[k : k + self.block])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.places.append(self.places[-1] + len(data))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        for part in (self.docs, self.absent, self.starts, self.places):
            self.out.write(bytes(part))
        self.out.write(FOOTER.pack(len(self.docs), len(self.places) - 1, self.places[-1], MAGIC))


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block = HEADER.unpack(file.read_at(HEADER.size, 0))
        n_docs, n_blocks, at, end = FOOTER.unpack(file.read_at(FOOTER.size, file.size() - FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a file of packed ids, or not a whole one")
        index = file.read_at(file.size() - FOOTER.size - at, at)
        self.docs = np.frombuffer(index, "<i8", n_docs)
        self.absent = np.frombuffer(index, np.bool_, n_docs, 8 * n_docs)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)
        self.places = np.frombuffer(index, "<u8", n_blocks + 1, 17 * n_docs + 8).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The file's ids from begin to before end."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.places[last + 1] - self.places[first]), int(self.places[first]))
        out = []
        for k in range(first, last + 1):
            n = min(self.block, int(self.starts[-1]) - k * self.block)
            at = int(self.places[k] - self.places[first])
            out.append(unpack(data[at : at + int(self.places[k + 1] - self.places[k])], n, self.bits))
        return np.concatenate(out)[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_LOADED: dict[str, tuple[IdUnits, int]] = {}


def tokenizer(path: str) -> tuple[IdUnits, int]:
    """Texts to ids by the tokenizers library, and the vocabulary's size; once in a Python worker.

    A text with the string of an added token goes through the library whole."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        added = [t.content for t in library.get_added_tokens_decoder().values()]

        lengths = np.zeros(library.get_vocab_size(), np.int64)
        for token, k in library.get_vocab().items():
            lengths[k] = len(token)  # a byte-level token has a character for each byte

        def encode(texts: list[str]) -> list[list[int]]:
            parts = (texts[k : k + ASKED] for k in range(0, len(texts), ASKED))
            return [e.ids for part in parts for e in library.encode_batch_fast(part, add_special_tokens=False)]

        _LOADED[path] = IdUnits(encode, lengths, not any(" " in a for a in added), lambda text: any(a in text for a in added), KEPT), library.get_vocab_size()
    return _LOADED[path]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, path: str = "", end: int = END) -> DataFrame:
    """Writes the documents' ids to files in the folder; the manifest: part, file, n_docs, n_ids."""

    def files(batches):
        units, size = tokenizer(path or public_tokenizers.path(VOCABULARY))
        system, place = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.ids"
        writer, stream = None, None
        last = np.asarray([end], "<u4")
        for batch in batches:
            if writer is None:
                system.create_dir(place, recursive=True)
                stream = system.open_output_stream(f"{place}/{name}")
                writer = Writer(stream, bits_for(max(size, end + 1)))
            ids = batch.column(0).to_pylist()
            for doc_id, found in zip(ids, units.encode_all(t.as_py() or "" for t in batch.column(1)), strict=True):
                writer.add(doc_id, np.concatenate([found, last]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.starts[-1]], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    in_order = F.col("doc_id").asc_nulls_last()
    placed = rows.repartitionByRange(in_order).sortWithinPartitions(in_order, F.col("text").asc_nulls_first())
    return settle(placed.mapInArrow(files, "part int, file string, n_docs bigint, n_ids bigint"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files.

    The manifest has a row per file; where a file starts is a running sum over these."""

    def documents(batches):
        system, place = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{place}/{row['file']}") as file:
                    reader = Reader(file)
                    for k in range(0, len(reader.docs), AT_ONCE):
                        to = min(k + AT_ONCE, len(reader.docs))
                        starts = reader.starts[k : to + 1]
                        data = reader.ids(int(starts[0]), int(starts[-1]))
                        sums = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts[:-1] - starts[0], starts[1:] - starts[0], strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.docs[k:to], pa.int64(), mask=reader.absent[k:to]), pa.array(starts[:-1] + row["first"], pa.int64()),
                            pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = rows.repartition(max(1, manifest.count()))
    return spread.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written_and_read(docs: DataFrame, path: str = "", folder: str | None = None) -> DataFrame:
    folder = folder or new_path(docs.sparkSession, "ids")
    return read(write(docs, folder, path), folder)
