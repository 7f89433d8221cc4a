"""What the operators on vectors share: which rows count, bounded samples, and slices of vectors packed for NumPy.

A slice is one row of a table with up to some thousands of vectors as bytes. Work on pairs of rows is done on pairs of
slices, each in a call that has two slices in memory, so neither a crowded group nor a hot one meets in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a fit sees, at most about; everything else sees all rows.
SAMPLE = 20_000


def finite(column: str) -> Column:
    """Whether the vector has components, none of them null, NaN or infinite."""
    return F.coalesce(F.expr(f"size(`{column}`) > 0 AND forall(`{column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"), F.lit(False))


def dimension(vectors: DataFrame, column: str = "v") -> int:
    """The most common length of the vectors (the smaller of two as common), 0 for none."""
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(top["d"]) if top else 0


def sample(vectors: DataFrame, rows: int, dims: int, column: str = "v", most: int = SAMPLE) -> np.ndarray:
    """A matrix of about ``most`` of the ``rows`` vectors, drawn by a hash of the vector."""
    step = max(1, math.ceil(rows / most))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(11), column), F.lit(step)) == 0) if step > 1 else vectors
    got = [np.array(r[0], float) for r in drawn.select(column).limit(2 * most).collect()]
    return np.array(got).reshape(len(got), dims)


def matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """The vectors of an Arrow list column, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dims)


def sliced(placed: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """``placed`` with a column slice: the rows of each key are dealt by a hash of ``by`` to slices of about ``most`` rows."""
    number = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_slices"))
    return placed.join(number, keys).withColumn("slice", F.pmod(F.xxhash64(by), F.col("_slices")).cast("int")).drop("_slices")


def packed(rows: DataFrame, keys: list[str], fill: Callable[[pa.Table], dict[str, object]], schema: str) -> DataFrame:
    """A row for each combination of ``keys`` (int), with what ``fill`` makes of its rows; ``schema`` describes that."""

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        made = {k: pa.array([x.as_py()], pa.int32()) for k, x in zip(keys, key, strict=True)}
        return pa.table(made | {k: pa.array([v]) for k, v in fill(t).items()})

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + ", " + schema)


def each_row(df: DataFrame, work: Callable[[dict[str, object]], Iterable[dict[str, np.ndarray]]], schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    """What ``work`` yields for each row of ``df``, as rows with the columns ``kinds``; one row of ``df`` is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                for got in work(row):
                    yield pa.RecordBatch.from_arrays([pa.array(got[c], kind) for c, kind in kinds.items()], names=list(kinds))

    return df.mapInArrow(run, schema)
