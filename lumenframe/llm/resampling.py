"""Importance resampling to a target distribution, over hashed runs of words.

A text's features are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. No run is
ever put together as a string: the CRC of a word is computed once a worker, with and without a space before it, and the
CRC of a run follows from those of its parts, for appending n bytes multiplies a CRC by a 32 x 32 matrix over GF(2) that
depends on n alone, and adds the CRC of what is appended. The matrices of words of up to SHORT bytes are kept as tables by
byte; those of longer words are powers by squaring.

Counts of all documents and of all target texts are summed in the tasks, then by bucket: BUCKETS rows leave a task. The
gains, a number for each bucket, are the only thing that goes to all tasks, so their size is a parameter. A second pass
over the texts adds the gains of each document's features; reading twice is cheaper than keeping all features. Ranks come
from a distributed sort: each row has its place in its sorted partition, and only the partitions' counts meet.

Null, empty and wordless texts have no feature and weight 0. Texts of any length are read whole, CHUNK words at a time.
Documents without an id are counted in the corpus but have no score and are not drawn. Repeated rows are rows of their
own, ranked one after the other. Only id and text are read, so other columns may have any names. An empty table gives an
empty one; an empty target gives gains that follow from the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, settled, table

#: Buckets of features, and words of a run at most.
BUCKETS, RUN = 10_000, 3

#: Bytes of an appended word, space included, whose matrices are kept as tables; words in a worker's table; words at a time.
SHORT, KNOWN, CHUNK = 48, 1_000_000, 1 << 20

#: Bytes that belong to words, put in lower case; all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _zero_byte(c: np.ndarray) -> np.ndarray:
    """CRC registers after a zero byte: the matrix of one byte, applied."""
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


@cache
def _tables() -> np.ndarray:
    """For each length up to SHORT the images of all values of each of the four bytes, in one row."""
    at = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    rows = [at]
    for _ in range(SHORT):
        rows.append(_zero_byte(rows[-1]))
    return np.concatenate(rows)


def _times(columns: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A matrix, given by its 32 columns, times CRCs."""
    out = np.zeros_like(c)
    for i in range(32):
        out ^= columns[i] * ((c >> np.uint32(i)) & np.uint32(1))
    return out


@cache
def _power(n: int) -> np.ndarray:
    """The columns of the matrix of n bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, step = unit, _zero_byte(unit)
    while n:
        out = _times(step, out) if n & 1 else out
        step, n = _times(step, step), n >> 1
    return out


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs ``c`` multiplied by the matrices of ``n`` appended bytes."""
    base, t = np.minimum(n, SHORT).astype(np.int64) << 10, _tables()
    out = t[base + (c & 255)]
    for k in (1, 2, 3):
        out ^= t[base + ((c >> np.uint32(8 * k)) & 255) + 256 * k]
    long = np.flatnonzero(n > SHORT)
    if len(long):
        for length in np.unique(n[long]).tolist():
            these = long[n[long] == length]
            out[these] = _times(_power(length), c[these])
    return out


class Words:
    """Indexes of words, with the CRC of each, the CRC after a space, and the bytes of both."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.crc, self.after, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.bytes = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        if fresh and (len(self.known) + len(fresh) > KNOWN or self.bytes > 48 * KNOWN):
            self.clear()
            fresh = list(set(words))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.bytes += sum(map(len, fresh))
            crc = np.fromiter(map(zlib.crc32, fresh), np.uint32, len(fresh))
            size = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            space = np.full(len(fresh), zlib.crc32(b" "), np.uint32)
            self.crc, self.size = np.concatenate([self.crc, crc]), np.concatenate([self.size, size])
            self.after = np.concatenate([self.after, shifted(space, size - 1) ^ crc])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def features(index: Words, batch: list[list[bytes]], run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, bucket) of every feature of a batch of texts, in parts."""
    sizes = [len(w) for w in batch]
    flat = [x for w in batch for x in w]
    of = np.repeat(np.arange(len(batch)), sizes)
    for start in range(0, len(flat), CHUNK):
        more = min(len(flat), start + CHUNK + run - 1)
        at, text = index(flat[start:more]), of[start:more]
        n = min(CHUNK, len(flat) - start)
        c, begin = index.crc[at[:n]], np.arange(n)
        yield text[:n], c % np.uint32(buckets)
        for k in range(1, run):
            begin = begin[(begin + k < len(at))]
            begin, c = begin[same := text[begin] == text[begin + k]], c[: len(begin)][same]
            word = at[begin + k]
            c = shifted(c, index.size[word]) ^ index.after[word]
            yield text[begin], c % np.uint32(buckets)


def counts(texts: DataFrame, column: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket, over all texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index, total = Words(), np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket in features(index, [words(t) for t in b.column(0).to_pylist()], run, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(texts.select(column), each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's share to the corpus's), both smoothed by one a bucket."""
    s_all, t_all, number = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + number) / ((s + 1) * (t_all + number)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets, added = len(gain), gain.astype(float)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index = Words()
        for b in batches:
            batch = [words(t) for t in b.column(1).to_pylist()]
            weight, number = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for text, bucket in features(index, batch, run, buckets):
                weight += np.bincount(text, added[bucket], len(batch))
                number += np.bincount(text, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in batch], pa.int64()), pa.array(number), pa.array(weight.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, seed: int = 42, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): weight plus Gumbel noise that follows from seed and id."""
    made = weighed(docs, gains(counts(docs, run=run, buckets=buckets), counts(target, run=run, buckets=buckets)), run)
    h = f"(cast(conv(substr(sha2(concat('{seed}:', cast(doc_id AS string)), 256), 1, 8), 16, 10) AS double) + 0.5D)"
    return made.withColumn("score", F.expr(f"weight + floor(-1000 * ln(-ln({h} / 4294967296D)))"))


def ranked(rows: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``rows`` with a rank: 1, 2, 3 ... of the highest ``percent`` of the rows with enough words and an id, null for others.

    The sort is by range, so no task has all rows; the number of a partition's rows before is a sum over partitions.
    """
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    order = materialise(rows.where(fit).orderBy(F.desc("score"), "doc_id", "n_features", "weight").withColumn("at", F.monotonically_increasing_id()), "order")
    parts = sorted((r["part"], r["n"]) for r in order.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before = [0, *np.cumsum([n for _, n in parts]).tolist()]
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(parts, before, strict=False)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = order.withColumn("part", F.shiftright("at", 33)).join(starts, "part").withColumn("rank", rank)
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * before[-1] // 100, F.col("rank")))
    return drawn.select(*rows.columns, "rank").unionAll(rows.where(~fit).select("*", F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) that are drawn; rows that share a drawn id stay together."""
    drawn = ranked(materialise(scored(docs, target, seed), "scored"), percent, least_words).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(*docs.columns)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: weight, score and rank of every document, with the benchmark's texts as the target."""

    def make() -> DataFrame:
        rows = materialise(scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "scored")
        return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")

    return settled(spark, make, "resampled")
