"""What the text operators share: tables, Arrow batches and intermediate tables.

Intermediate results go to Parquet in the folder that ``spark.checkpoint.dir`` names, which every executor can
read. A lost executor then costs the rerun of its own tasks, not of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, in all operators here.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch handed to Python: bounds a worker's memory where texts are long.
BATCH_ROWS = 500

#: Bytes of an Arrow batch, for tables whose texts are very long.
BATCH_BYTES = 32 << 20

#: Spark's setting by which a query's shuffle files go as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bits that mark the rows to be shuffled, 32768 to a row: others stay where they are.
MARKS = 1 << 22


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or, on one machine only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lumenframe-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Paths of the tables made within each open scratch(), the innermost last.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, and survives lost executors."""
    spark = session(df)
    path = scratch_path(spark, name)
    _write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet; its shuffle files are deleted at the end. Other queries of the session keep to its setting."""
    conf = session(df).conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the scratch() that it is asked for in, if any."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing will read again."""
    for t in tables:
        _delete(session(t), t.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that materialise() has made within it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it made on the way are deleted."""
    path = scratch_path(spark, name)
    with scratch(spark):
        df = make()
        _write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from the columns ``taken``."""
    names = {x.lower() for x in taken}
    while name.lower() in names:
        name += "_"
    return name


def marked(rows: DataFrame, ids: DataFrame, keys: list[str], there: bool = True, bits: int = MARKS) -> DataFrame:
    """The rows of which ``keys`` are in ``ids`` (keys; written), and few others; or the rest, none of which is there.

    ``bits`` hashed bits, which are broadcast, tell: nothing is shuffled. A null key is one like any other.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(bits))
    made = ids.groupBy(F.bitmap_bucket_number(mark).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits"))
    at = rows.withColumns({"row": F.bitmap_bucket_number(mark), "at": F.bitmap_bit_position(mark)}).join(F.broadcast(made), "row", "inner" if there else "left")
    bit = "shiftright(cast(conv(hex(substring(bits, cast(at div 8 AS int) + 1, 1)), 16, 10) AS int), cast(at % 8 AS int)) % 2"
    return at.where(f"coalesce({bit}, 0) = {int(there)}").select(*rows.columns)


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts.

    The two settings hold for the session from then on: a plan reads them when it runs, not when it is made.
    """
    conf = session(df).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(each, schema)
