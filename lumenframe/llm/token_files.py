"""Binary token files: ids bit-packed at the width of the vocabulary, in blocks with offsets for random access.

A segment is a self-contained byte string:

    magic 4s | version u1 | bits u1 | pad u2 | block u4 | n_docs u4 | n_null u4 | n_ids u8 | first u8
    doc_id i8[n_docs] | n_tokens u8[n_docs] | block_offset u8[n_blocks + 1] | payload

All numbers are little-endian. Block b holds ids b*block and on, each in ``bits`` bits, lowest bit first, and starts
at payload byte block_offset[b]. ``first`` counts the ids of the same shard before the segment. Segments hold whole
documents in ascending doc_id, are ordered by (shard, segment), and lie in the rows of a Parquet table, so Spark's
commit protocol decides which of two attempts of a task counts, on any file system.

Null and empty texts are a document of the end id alone. Rows with the same doc_id are documents of their own, in order of
their texts. Rows without a doc_id come first; n_null counts them, and they are read back without one. A text of any length
is one document, in the memory of one task. An empty table makes no segment and reads back empty. Only the two named
columns are written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch_path, table
from .tokens import default_tokenizer, encoder, vocabulary_bits

HEAD = struct.Struct("<4sBBHIIIQQ")
MAGIC = b"LFTB"

#: Ids of a block: the unit of random access.
BLOCK = 4096

#: Ids after which a segment ends, at the next document.
SEGMENT = 1 << 18


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The inverse of pack()."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_segment(doc_ids: list[int | None], ids: list[bytes], bits: int, first: int, block: int = BLOCK) -> bytes:
    """A segment of documents, those without an id first; ``ids``: of each, as unsigned 32-bit bytes."""
    every = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(every[i : i + block], bits) for i in range(0, len(every), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = HEAD.pack(MAGIC, 2, bits, 0, block, len(doc_ids), sum(d is None for d in doc_ids), len(every), first)
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Reads a segment; only the blocks that a range touches are unpacked."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, _, self.block, n, self.n_null, self.n_ids, self.first = HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.lengths = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 16 * n).astype(np.int64)
        self.payload = memoryview(data)[at + 16 * n + 8 * (n_blocks + 1) :]

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the segment."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (start + n - 1) // self.block + 1
        parts = [unpack(self.payload[self.offsets[i] : self.offsets[i + 1]], min(self.block, self.n_ids - i * self.block), self.bits) for i in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : start - a * self.block + n]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.lengths[i]))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """Tokenizes whole texts and writes their segments to ``path`` in ascending key, one shard for each task.

    The texts are dealt out by ranges of the key first, which needs a scan for the ranges and one shuffle.
    """
    name = tokenizer or default_tokenizer()
    bits = vocabulary_bits(name)
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode, shard, number, first = encoder(name), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            row = [[shard], [number], [size // 4], [write_segment(keys, parts, bits, first)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "segment", "n_ids", "data"])

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                keys.append(k)
                parts.append(ids + end)
                size += len(ids) + 4
                if size >= 4 * SEGMENT:
                    yield segment()
                    number, first = number + 1, first + size // 4
                    keys, parts, size = [], [], 0
        if keys:
            yield segment()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    map_batches(rows, each, "shard int, segment int, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files at ``path``, from unpacked ids.

    Starts within a shard are in the files; those of shards are a running sum over one row for each shard, of which
    there are as many as writing tasks, so that table may be broadcast.
    """
    segments = spark.read.parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(data.as_py())
                crc = []
                ids = s.read(0, s.n_ids)
                for at, n in zip(s.starts.tolist(), s.lengths.tolist(), strict=True):
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=np.arange(len(s.doc_ids)) < s.n_null), pa.array(s.starts + (base + s.first)), pa.array(s.lengths), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    rows = segments.join(F.broadcast(starts), "shard").select("base", "data")
    return map_batches(rows, each, f"{key} long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: documents written as token files and read back."""
    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
