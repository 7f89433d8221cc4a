"""SimHash near-duplicates: a segment-popcount grid finds candidates, exact Hamming distance decides.

A fingerprint of 64 bits is cut into segments; the count of ones in each segment embeds it in a small grid. The
Manhattan distance of two embeddings is never over the Hamming distance of the fingerprints. Fingerprints within two
bits therefore lie within Manhattan distance two, and then some grid cell is within one step of both. So each distinct
fingerprint is sent to its own cell and the cells one step away, and fingerprints that meet in a cell are compared.

A crowded cell would mean all pairs of a group. Its fingerprints go to the finest grid instead, with segments of one
bit, where a cell and one step are a fingerprint and one flipped bit: at most 65 fingerprints can meet there, all of
them within two bits of each other, so a star of links to the smallest joins them without pairs.

Copies of a text share a fingerprint and are one row until the end. Null, empty and white texts have fingerprint zero. A
bit that is set in exactly half of the hashes is 0. Rows with the same id are rows of their own. A row without an id has
the component of the rows it links to, null where none has an id, and always stays in first_of_each(). Texts of any
length are read whole. Only the id and the text are read, so other columns may have any names. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, table
from .components import components

#: Segments of the coarse grid, each of 64 / SEGMENTS bits.
SEGMENTS = 16

#: Distinct fingerprints that a coarse cell may hold before its members go to the finest grid.
CROWDED = 48


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the hashes of all shingles, repeats included."""
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): each document's fingerprint as a signed long. ASCII letters are lower-cased, nothing else changes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint((t or "").encode().lower().split(), shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=[key, "fp"])

    return map_batches(docs.select(F.col(key).cast("long"), text), each, f"{key} long, fp long")


def _grid(fps: DataFrame, segments: int) -> DataFrame:
    """(cell, fp): the cell of each fingerprint and those one step away. Counts are packed with room for -1."""
    width = 64 // segments
    mask = (1 << width) - 1
    own = " + ".join(f"shiftleft(cast(bit_count(shiftrightunsigned(fp, {i * width}) & {mask}L) + 1 AS bigint), {3 * i})" for i in range(segments))
    steps = [0, *(s << (3 * i) for i in range(segments) for s in (1, -1))]
    at = fps.select("fp", F.expr(own).alias("own"))
    return at.select("fp", "own", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step")).select((F.col("own") + F.col("step")).alias("cell"), "fp")


def _flips(fps: DataFrame) -> DataFrame:
    """(cell, fp): the finest grid, a segment for each bit."""
    bits = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    return fps.select("fp", F.explode(F.array(*[F.lit(b).cast("long") for b in bits])).alias("bit")).select(F.col("fp").bitwiseXOR(F.col("bit")).alias("cell"), "fp")


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) over distinct fingerprints ``fps`` (fp): within two bits, enough of them to connect all that are.

    In a sparse cell every pair within two bits is returned; in a crowded one a star for each finest cell.
    """
    cells = _grid(fps, SEGMENTS)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the exploded cells for as small as the fingerprints' file and would broadcast them by way of the driver
    shared = materialise(cells.hint("merge").join(sizes, "cell"), "cells")
    close = lambda x, y: F.expr(f"bit_count({x} ^ {y}) <= 2")
    met = shared.where(F.col("n") <= crowded).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    pairs = met.select(F.explode(F.expr("filter(flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> struct(x AS a, y AS b)))), p -> bit_count(p.a ^ p.b) <= 2)")).alias("p")).select("p.a", "p.b")
    many = shared.where(F.col("n") > crowded).select("fp").distinct()
    star = _flips(many).groupBy("cell").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("f")).where("size(f) > 1").select("a", F.explode("f").alias("b")).where("a <> b").where(close("a", "b"))
    return pairs.unionAll(star).distinct()


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of two bits or fewer, itself included."""
    fps = materialise(fingerprints(docs, text, key, shingle), "fingerprints")
    reps = materialise(fps.groupBy("fp").agg(F.min(key).alias("least")), "representatives")
    roots = components(links(reps.select("fp")))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "root").select("fp", "component_id")
    return fps.join(lookup, "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) whose id is the smallest of their group.

    Texts are not shuffled where Spark can broadcast the ids that go, else once. Rows with a null id stay.
    """
    g = groups(docs, shingle=shingle)
    gone = g.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    g = groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
