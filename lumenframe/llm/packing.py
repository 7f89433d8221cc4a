"""Best-fit packing of token pieces into sequences, online and in bounded space.

Documents become ids and an end id; only those longer than a sequence are cut. Pieces arrive in the order of a hash,
which is independent of where they come from and the same on every run. A packer keeps at most OPEN bins open. The
free spaces that occur among them are the bits of one number, so the tightest bin that a piece fits is the lowest set
bit at or above its length. If none fits and OPEN bins are open, the fullest one closes first.

Packers work side by side on pieces dealt out by hash; each leaves at most OPEN bins that are not full, so their
number follows the count of pieces (PIECES each). Only lengths and checksums travel to them; ids stay in the table of
pieces, from which sequences() puts whole sequences together.

Null and empty texts are a piece of the end id alone. Rows with the same doc_id are packed each for itself, and a row
without one like any other; its pieces have none. Pieces whose hashes tie go by id and number. A text of any length is
encoded whole, in one task. Only the id and the text are read, so other columns may have any names. An empty table makes
no piece and no sequence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, table
from .token_files import pack, unpack
from .tokens import default_tokenizer, encoder, vocabulary_bits

#: Tokens of a sequence.
LENGTH = 2048

#: Bins that a packer keeps open.
OPEN = 512

#: Pieces for a packer.
PIECES = 150_000


class BestFit:
    """The packer. put(n) returns (bin, offset)."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN, first: int = 0) -> None:
        self.length, self.most, self.next = length, most_open, first
        self.free = 0  # bit f: a bin with f free tokens is open
        self.bins: dict[int, list[int]] = {}
        self.n_open = 0

    def _take(self, space: int) -> int:
        found = self.bins[space]
        out = found.pop()
        if not found:
            self.free ^= 1 << space
        self.n_open -= 1
        return out

    def put(self, n: int) -> tuple[int, int]:
        fits = self.free >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if n < self.length and self.n_open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            at, space, self.next = self.next, self.length, self.next + 1
        left = space - n
        if left:
            self.bins.setdefault(left, []).append(at)
            self.free |= 1 << left
            self.n_open += 1
        return at, self.length - space


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): every document's ids and end id, cut where longer than ``length``.

    ``ids`` is bit-packed at the width of the vocabulary.
    """
    name = tokenizer or default_tokenizer()
    bits = vocabulary_bits(name)
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = encoder(name)
        for b in batches:
            rows: list[tuple] = []
            for k, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                every = ids + end
                for i, at in enumerate(range(0, len(every) // 4, length)):
                    part = every[4 * at : 4 * (at + length)]
                    rows.append((k, i, at, len(part) // 4, zlib.crc32(part), pack(np.frombuffer(part, "<u4"), bits)))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[key, "piece", "start", "length", "ids_crc32", "ids"])

    return map_batches(docs.select(F.col(key).cast("long").alias("k"), text), each, f"{key} long, piece int, start long, length long, ids_crc32 long, ids binary")


def assign(rows: DataFrame, length: int = LENGTH, most_open: int = OPEN, key: str = "doc_id") -> DataFrame:
    """``rows`` (key, piece, start, length, ids_crc32) with sequence_id and offset."""
    packers = max(1, math.ceil(rows.count() / PIECES))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        packer = BestFit(length, most_open, TaskContext.get().partitionId() << 40)
        for b in batches:
            at = [packer.put(n) for n in b.column(3).to_pylist()]
            added = [pa.array([x[i] for x in at], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "sequence_id", "offset"])

    dealt = rows.select(key, "piece", "start", "length", "ids_crc32").repartition(packers, F.xxhash64(key, "piece", "ids_crc32"))
    return map_batches(dealt.sortWithinPartitions(F.xxhash64(key, "piece", "ids_crc32"), key, "piece"), each, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(made: DataFrame, assigned: DataFrame, tokenizer: str | None = None, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): whole sequences from pieces() and assign(), for keys that are unique.

    A sequence has at most LENGTH pieces, so grouping by it is bounded.
    """
    bits = vocabulary_bits(tokenizer or default_tokenizer())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([unpack(p["ids"], p["length"], bits) for p in x]).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["sequence_id", "ids"])

    joined = assigned.select(key, "piece", "sequence_id", "offset").join(made.select(key, "piece", "length", "ids"), [key, "piece"])
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return map_batches(rows, each, "sequence_id long, ids array<long>")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every piece of every document with its sequence and place."""
    made = materialise(pieces(table(spark, sf_dir, "documents")), "pieces")
    return assign(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
