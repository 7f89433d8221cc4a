"""Choosing variables: robust thresholds by magnitude bin, recovery scores, set operations, classification."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import matthews, precision, recall
from .series import KEY, MAD_STD


def magnitude_bin(mag: Column, low: float = 8.0, high: float = 16.25, step: float = 0.25) -> Column:
    """Number of the bin from 1; 0 below the range, the last plus one above it."""
    n = round((high - low) / step)
    return F.when(mag < low, 0).when(mag >= high, n + 1).otherwise(F.floor((mag - low) / step) + 1).cast("int")


def variability_threshold(features: DataFrame, indices: list[str], sigma: float = 4.0, low: float = 8.0, high: float = 16.25, step: float = 0.25, least: int = 5, accuracy: int | None = None) -> DataFrame:
    """``features`` (objectid, mag, indices) with magbin, ``<index>_cut``, ``<index>_var`` and all_var.

    A bin with ``least`` objects or more has a cut of median + sigma 1.483 MAD for each index. Objects meet their own
    bin's cut, so an empty bin moves nothing. Exact medians hold a bin's distinct values in one task; with ``accuracy`` they
    are sketches of bounded size, within 1 / accuracy of the rank.
    """
    median = F.median if accuracy is None else lambda c: F.percentile_approx(c, 0.5, accuracy)
    f = features.withColumn("magbin", magnitude_bin(F.col("mag"), low, high, step))
    med = f.groupBy("magbin").agg(F.count(F.lit(1)).alias("_n"), *[median(F.col(i)).alias(f"_med_{i}") for i in indices]).where(F.col("_n") >= least)
    j = f.join(med, "magbin")
    mads = j.groupBy("magbin").agg(*[median(F.abs(F.col(i) - F.col(f"_med_{i}"))).alias(f"_mad_{i}") for i in indices])
    j = j.join(mads, "magbin")
    for i in indices:
        j = j.withColumn(f"{i}_cut", F.col(f"_med_{i}") + sigma * MAD_STD * F.col(f"_mad_{i}")).withColumn(f"{i}_var", F.coalesce(F.col(i) > F.col(f"{i}_cut"), F.lit(False)))
    every = F.lit(True)
    for i in indices:
        every = every & F.col(f"{i}_var")
    return j.withColumn("all_var", every).drop("_n", *[f"_{a}_{i}" for a in ("med", "mad") for i in indices])


def confusion(flags: DataFrame, by: list[str], actual: str = "actual", found: str = "found") -> DataFrame:
    """Counts tp, fp, tn, fn and precision, recall, mcc of boolean columns, for each group."""
    a, f = F.col(actual), F.col(found)
    g = flags.groupBy(*by).agg(F.count_if(a & f).alias("tp"), F.count_if(~a & f).alias("fp"), F.count_if(~a & ~f).alias("tn"), F.count_if(a & ~f).alias("fn"))
    c = [F.col(x) for x in ("tp", "tn", "fp", "fn")]
    return g.withColumns({"precision": precision(c[0], c[2]), "recall": recall(c[0], c[3]), "mcc": matthews(*c)})


def threshold_grid(features: DataFrame, index: str, cuts: list[float], actual: str = "actual") -> DataFrame:
    """confusion() for each magbin and cut: one pass over the rows for all cuts, which are a short list."""
    f = features.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).withColumn("found", F.coalesce(F.col(index) > F.col("cut"), F.lit(False)))
    return confusion(f, ["magbin", "cut"], actual)


def recovery_tallies(found: DataFrame, by: list[str]) -> DataFrame:
    """Recovered share (``recovered`` boolean) by every combination of the columns of ``by``, all together included."""
    return found.cube(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("recovered").alias("n_recovered")).withColumn("share", F.try_divide("n_recovered", "n"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).intersect(b.select(KEY))


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).distinct().join(b.select(KEY), KEY, "left_anti")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).union(b.select(KEY)).distinct()


def distinct_periods(candidates: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(objectid, rank, period): periods over all methods, each over ``tolerance`` (relative) above the one before."""
    w = Window.partitionBy(KEY).orderBy("period")
    new = candidates.where("period > 0").withColumn("_b", F.lag("period").over(w)).where(F.col("_b").isNull() | (F.col("period") - F.col("_b") > tolerance * F.col("_b")))
    return new.select(KEY, F.row_number().over(w).alias("rank"), "period")


def feature_vectors(features: DataFrame, names: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(objectid, features, label): missing values are 0, objects without a label too."""
    f = features.fillna(0.0, names)
    f = f.join(labels.select(KEY, "label"), KEY, "left").withColumn("label", F.coalesce(F.col("label").cast("double"), F.lit(0.0))) if labels is not None else f
    return VectorAssembler(inputCols=names, outputCol="features").transform(f).select(KEY, "features", *(["label"] if labels is not None else []))


def train_classifier(vectors: DataFrame, seed: int = 7, folds: int = 3, trees: tuple[int, ...] = (50, 100), depths: tuple[int, ...] = (3, 5)) -> tuple[RandomForestClassificationModel, dict[str, float]]:
    """(model, scores on a held-out quarter): random forests by cross-validation over a grid, split by a hash of the id."""
    split = vectors.withColumn("_r", F.shiftrightunsigned(F.xxhash64(KEY, F.lit(seed)), 11).cast("double") / float(1 << 53))
    rf = RandomForestClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    best = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed).fit(split.where("_r < 0.75")).bestModel
    test = best.transform(split.where("_r >= 0.75"))
    return best, {m: MulticlassClassificationEvaluator(metricName=m).evaluate(test) for m in ("weightedPrecision", "weightedRecall", "f1", "accuracy")}


def classify(model: RandomForestClassificationModel, vectors: DataFrame) -> DataFrame:
    """(objectid, label, probability)."""
    return model.transform(vectors).select(KEY, F.col("prediction").alias("label"), F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1).alias("probability"))

