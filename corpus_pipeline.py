"""The corpus pipeline: quality classifier, near duplicates, substring dedup, decontamination, packing.

Each stage works on all that the one before kept, and reads it back from Parquet in the folder that
spark.checkpoint.dir names. All but the last return the columns of documents. Rows with a null id pass through the
filtering stages as their operators say. Null and empty texts are documents: the classifier gives them weight one and
keeps them, the near-duplicate stage leaves one of them, the substring and decontamination stages find nothing in them,
and each is a piece of one id in the end. Very long texts are read whole by every stage. No documents give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, near_copies, packing, quality_classifier, substring_dedup
from lumenframe.llm.common import discard, materialise, settled, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return near_copies.first_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has; those that lose all their words go."""
    cut = substring_dedup.remove(docs)
    n_words, n_removed = (F.col(f"`{c}`") for c in cut.columns[-3:-1])
    left = cut.where((n_words > n_removed) | (n_removed == 0))
    return left.withColumn("n_chars", F.when(n_removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    made = materialise(packing.pieces(docs), "pieces")
    return packing.assign(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Tokenizers and fitted models are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents. What a stage leaves is deleted once the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        left = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = left
    return docs
