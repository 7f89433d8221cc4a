"""Batches over a growing folder of light curves that can stop anywhere and go on: work for each object, stored once.

A file-source stream hands over the files that are new since its checkpoint, some at a time. For each batch the objects in
those files are worked on by ``work`` (a period search, features, documents: any function from a long table to rows with
objectid), and two things are written into folders named by the batch: the rows, and what was seen (objects, files, and a
fingerprint of each object's points). A batch that is run again, since the last run stopped before its commit, overwrites
its folders, so nothing is lost or doubled.

Rows are keyed by object, name of the work and its parameters. An object whose points come in several files, late ones
among them, is worked on again over all its points up to then, and current() returns the newest rows of each key. An
object whose points are the same as before (a file delivered again, under another name perhaps) is left out. Several works,
or one with other parameters, share a folder of results; each has its own checkpoint, so a new one starts at the first file.

Points that are equal in all of objectid, t, m, e and seq count once. Folders may be on any file system that Spark knows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import periodograms
from ..operators.series import KEY
from ..sources import readers

POINTS = "objectid string, t double, m double, e double, seq long"

Work = Callable[[DataFrame], DataFrame]


def key_of(name: str, parameters: dict) -> str:
    """The name and a hash of the parameters, whatever their order."""
    return f"{name}-{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _opened(found: DataFrame, layout: str) -> DataFrame:
    """(objectid, t, m, e, seq, file) of a batch of Parquet rows, or of files (path, content)."""
    if layout == "parquet":
        return found
    return readers.parsed(found.select("path", "content"), layout).select(KEY, "t", "m", "e", "seq", F.regexp_replace("file", "^file:/+", "/").alias("file"))


def _source(reader, source: str, layout: str, schema: str):  # noqa: ANN001, ANN202
    """What a reader or a stream reader finds under ``source``, with the file of each row."""
    if layout == "parquet":
        return reader.schema(schema).parquet(source).withColumn("file", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
    return reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", readers.FORMATS[layout].glob).load(source).select("path", "content")


def seen(spark: SparkSession, results: str, key: str, before: int | None = None) -> DataFrame:
    """(objectid, file, points, batch): the files of each object and a fingerprint of its points after each batch."""
    path = f"{results}/{key}/seen"
    if not _there(spark, path):
        return spark.createDataFrame([], "objectid string, file string, points string, batch int")
    out = spark.read.schema("objectid string, file string, points string, batch int").parquet(path)
    return out if before is None else out.where(F.col("batch") < before)


def _fingerprints(points: DataFrame) -> DataFrame:
    """(objectid, points): number of points and sum of their hashes; no order is needed."""
    h = F.xxhash64("t", "m", "e", "seq").cast("decimal(38,0)")
    return points.groupBy(KEY).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(h)).alias("points"))


def _one_batch(spark: SparkSession, batch: DataFrame, number: int, source: str, results: str, key: str, work: Work, layout: str, schema: str) -> None:
    rows = _opened(batch, layout).withColumn(KEY, F.col(KEY).cast("string"))
    known = seen(spark, results, key, number)
    new = rows.select(KEY, "file").distinct()
    # files that came before for objects of this batch: none, as a rule
    earlier = known.join(new.select(KEY).distinct(), KEY, "left_semi").select(KEY, "file").distinct()
    if earlier.limit(1).count():
        old = _opened(_source(spark.read, source, layout, schema), layout).withColumn(KEY, F.col(KEY).cast("string"))
        rows = rows.unionByName(old.join(earlier, [KEY, "file"], "left_semi").select(*rows.columns))
    points = rows.drop("file").dropDuplicates([KEY, "t", "m", "e", "seq"])
    prints = _fingerprints(points)
    last = known.groupBy(KEY).agg(F.max(F.struct("batch", "points"))["points"].alias("last"))
    changed = prints.join(last, KEY, "left").where("last IS NULL OR last <> points").select(KEY)
    done = work(points.join(changed, KEY, "left_semi"))
    done.write.mode("overwrite").parquet(f"{results}/{key}/rows/batch={number}")
    # last: a batch counts as seen only when its rows are there
    new.join(prints, KEY).select(KEY, "file", "points").write.mode("overwrite").parquet(f"{results}/{key}/seen/batch={number}")


def start(spark: SparkSession, source: str, results: str, name: str, parameters: dict, work: Work, layout: str = "parquet", schema: str = POINTS, files_a_batch: int = 1000, until_done: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Starts ``work``, or goes on with it, over the files of ``source``: until all that are there are done, or for ever.

    ``layout`` is "parquet" (a long table) or a format of readers.FORMATS.
    """
    key = key_of(name, parameters)
    stream = _source(spark.readStream.option("maxFilesPerTrigger", files_a_batch), source, layout, schema)
    run = lambda batch, number: _one_batch(batch.sparkSession, batch, number, source, results, key, work, layout, schema)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{results}/{key}/checkpoint").queryName(f"{key}-{hashlib.sha256(results.encode()).hexdigest()[:8]}")
    return (writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime=every)).start()


def current(spark: SparkSession, results: str, name: str, parameters: dict) -> DataFrame:
    """The newest rows of every object, with the batch that made them; those of batches that did not finish don't count."""
    key = key_of(name, parameters)
    rows = spark.read.parquet(f"{results}/{key}/rows").join(seen(spark, results, key).select("batch").distinct(), "batch", "left_semi")
    newest = rows.groupBy(KEY).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [KEY, "batch"])


def progress(spark: SparkSession, results: str, name: str, parameters: dict) -> DataFrame:
    """(batch, objects, files) of each finished batch."""
    return seen(spark, results, key_of(name, parameters)).groupBy("batch").agg(F.count_distinct(KEY).alias("objects"), F.count_distinct("file").alias("files"))


def search_periods(spark: SparkSession, source: str, results: str, methods: list[str], layout: str = "parquet", files_a_batch: int = 1000, until_done: bool = True, **options: object) -> StreamingQuery:
    """find_periods() over a growing folder; ``options`` are its other arguments, and part of the key."""
    work = lambda lc: periodograms.find_periods(lc, methods, **options)
    return start(spark, source, results, "periods", {"methods": methods, **options}, work, layout, files_a_batch=files_a_batch, until_done=until_done)


def found_periods(spark: SparkSession, results: str, methods: list[str], **options: object) -> DataFrame:
    """(objectid, batch, method, rank, period, score) that search_periods() has stored."""
    return current(spark, results, "periods", {"methods": methods, **options})
