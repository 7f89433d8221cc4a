"""Hard negatives: k-means inverted lists with radii, searched in the order of a Cauchy-Schwarz bound.

Centroids are fitted on a bounded sample (LISTS of them at most, SAMPLE rows); every row is in the list of its nearest
centroid, and a list keeps its radius, the largest distance of a row from the centroid. For an anchor a and a row x of a
list with centroid c and radius r the score a.x lies within |a| r of a.c. So a list whose upper bound is below the window
of scores that is asked for, or whose lower bound is above it, holds nothing, and once an anchor has its k rows a list
counts only if its upper bound is not strictly below the k-th score.

Anchors of neighbouring lists search together, in blocks of about BLOCK; the rows of a list are in slices of about SLICE. A block
meets a slice in one call, so hot lists, copies and many anchors only make more calls. Lists are visited in two rounds:
FIRST lists by the bound give k-th scores, then all others whose bound these do not rule out. The search has no cap, so it
is exact (recall 1).

Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do rows whose vector has not
the table's most common length. Of rows that share an id the first by label and vector counts, so repeated rows count
once. Ties go to the smaller id. Inner products are exact: in doubles while they stay below 2^53, else in Python's
integers, clipped to the range of a long. Only id, label and vector are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, settled, table
from .vectors import dimension, each_row, finite, matrix, packed, sample, sliced

#: Inverted lists at most, rows of a slice, anchors of a block, lists of the first round.
LISTS, SLICE, BLOCK, FIRST = 256, 8192, 1024, 8

#: Scores beyond these are clipped.
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_RELABELLED = "CASE WHEN vec_id % 7 = 0 THEN (cast(label AS bigint) + 1) % 10 ELSE cast(label AS bigint) END"


def rows_of(embeddings: DataFrame, scale: float = 256.0, relabel: str = _RELABELLED) -> DataFrame:
    """(id, label, v) of the rows that take part; components are scaled and floored, labels follow from ``relabel``."""
    kept = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL").where(finite("embedding"))
    known = kept.select(F.col("vec_id").cast("long").alias("id"), F.expr(relabel).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    once = known.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
    return once.select("id", "x.label", F.transform("x.v", lambda x: _floored(F.lit(scale) * x)).alias("v"))


def _floored(x: Column) -> Column:
    """The floor as a double; doubles from 2^52 on are whole, and those over 1e150 are taken as 1e150."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-1e150), F.least(F.lit(1e150), x)))


def centroids(points: np.ndarray, number: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means of a sample, from distinct points of it."""
    start = np.unique(points, axis=0)
    c = start[np.random.default_rng(7).permutation(len(start))[:number]]
    for _ in range(rounds):
        at = nearest(points, c)[0]
        held = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, points)
        c = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], c)
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, and the distance from it."""
    at = np.argmin((c * c).sum(1) - 2.0 * points @ c.T, axis=1)
    return at, np.sqrt(((points - c[at]) ** 2).sum(1))


def placed_in_lists(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """(list, id, label, v, far): the list of every row and its distance from the centroid."""
    dims = c.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            at, far = nearest(matrix(b.column(2), dims), c)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns, pa.array(far)], names=["list", "id", "label", "v", "far"])

    return map_batches(rows.select("id", "label", "v"), each, "list int, id long, label long, v array<double>, far double")


def _bytes(t: pa.Table, name: str, kind: type) -> bytes:
    return t.column(name).to_numpy().astype(kind, copy=False).tobytes()


def _vectors(t: pa.Table, dims: int) -> bytes:
    return matrix(t.column("v").combine_chunks(), dims).tobytes()


def products(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``v`` and ``a``, exact."""
    if len(v) == 0 or np.abs(v).max() * np.abs(a).max() * v.shape[1] < 2.0**53:
        return (v @ a.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in v], [[int(x) for x in r] for r in a]
    return np.array([[min(max(sum(map(int.__mul__, x, y)), _LOW), _HIGH) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(v), len(a))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _met(row: dict, dims: int, k: int, same: bool) -> Iterator[dict[str, np.ndarray]]:
    """A block of anchors against a slice: the k best rows of each window of each anchor."""
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    of, names = np.frombuffer(row["a_labels"], np.int64), np.frombuffer(row["a_ids"], np.int64)
    windows = [np.frombuffer(row[c], np.int64) for c in ("w_at", "w_name", "w_low", "w_high")]
    s = products(np.frombuffer(row["v"], float).reshape(-1, dims), np.frombuffer(row["a_v"], float).reshape(-1, dims))
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for at, name, low, high in zip(*(w.tolist() for w in windows), strict=True):
        mine = s[:, at]
        fit = np.flatnonzero(((labels == of[at]) == same) & (mine >= low) & (mine <= high) & (ids != names[at]))
        top = fit[best(mine[fit], ids[fit], k)]
        if len(top):
            out.append((names[at], name, ids[top], mine[top]))
    if out:
        sizes = [len(x[2]) for x in out]
        yield {"anchor": np.repeat([x[0] for x in out], sizes), "name": np.repeat([x[1] for x in out], sizes), "id": np.concatenate([x[2] for x in out]), "score": np.concatenate([x[3] for x in out])}


def _needed(row: dict, c: np.ndarray, radii: np.ndarray, first: int, ahead: bool) -> Iterator[dict[str, np.ndarray]]:
    """The lists that a block of anchors visits: its ``first`` ones by the bound (ahead), or all others not ruled out.

    Both rounds must agree on the first lists, so these follow from the anchors alone.
    """
    a = np.frombuffer(row["a_v"], float).reshape(-1, c.shape[1])
    middle, reach = a @ c.T, np.sqrt((a * a).sum(1))[:, None] * radii
    reach = reach * (1 + 1e-9) + 1e-9 * (1 + np.abs(middle))
    at, low, high = (np.frombuffer(row[x], np.int64) for x in ("w_at", "w_low", "w_high"))
    fits = ((middle + reach)[at] >= low[:, None]) & ((middle - reach)[at] <= high[:, None])
    early = np.zeros(len(c), bool)
    early[np.argsort(-(middle + reach).max(0), kind="stable")[:first]] = True
    asked = np.flatnonzero(fits.any(0) & (early if ahead else ~early) & (radii >= 0))
    yield {"block": np.full(len(asked), row["block"]), "list": asked}


class Index:
    """Inverted lists of all rows of ``rows`` (id, label, v), written."""

    def __init__(self, rows: DataFrame, lists: int = LISTS, size: int = SLICE) -> None:
        rows = materialise(rows, "rows")
        self.dims = dimension(rows)
        rows = rows.where(F.size("v") == self.dims)
        n = rows.count() if self.dims else 0
        seen = sample(rows, n, self.dims) if n else np.zeros((1, max(1, self.dims)))
        self.c = centroids(seen if len(seen) else np.zeros((1, self.dims)), min(lists, max(1, math.isqrt(n))))
        self.dims = self.c.shape[1]
        self.rows = materialise(placed_in_lists(rows, self.c), "placed")
        self.radii = np.full(len(self.c), -1.0)
        for r in self.rows.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row for each list
            self.radii[r["list"]] = r["far"]
        dims = self.dims
        fill = lambda t: {"ids": _bytes(t, "id", np.int64), "labels": _bytes(t, "label", np.int64), "v": _vectors(t, dims)}
        self.slices = materialise(packed(sliced(self.rows, ["list"], "id", size).select("list", "slice", "id", "label", "v"), ["list", "slice"], fill, "ids binary, labels binary, v binary"), "slices")

    def blocks(self, anchors: DataFrame, size: int) -> DataFrame:
        """(block, a_ids, a_labels, a_v, w_*) of ``anchors`` (list, id, label, v, windows): those of neighbouring lists together."""
        dims = self.dims
        held = {r["list"]: r["n"] for r in anchors.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
        group, n, of = 0, 0, []
        for x in np.argsort(self.c @ np.linalg.svd(self.c, full_matrices=False)[2][0], kind="stable").tolist():
            group, n = (group + 1, 0) if n + held.get(x, 0) > size else (group, n)
            n += held.get(x, 0)
            of.append((x, group))
        anchors = anchors.join(anchors.sparkSession.createDataFrame(of, "list int, `group` int"), "list")

        def fill(t: pa.Table) -> dict[str, object]:
            w = t.column("windows").to_pylist()
            at = [i for i, x in enumerate(w) for _ in x]
            flat = [np.array([y[c] for x in w for y in x], np.int64).tobytes() for c in ("name", "low", "high")]
            return {"a_ids": _bytes(t, "id", np.int64), "a_labels": _bytes(t, "label", np.int64), "a_v": _vectors(t, dims), "w_at": np.array(at, np.int64).tobytes(), **dict(zip(("w_name", "w_low", "w_high"), flat, strict=True))}

        made = packed(sliced(anchors, ["group"], "id", size).select("group", "slice", "id", "label", "v", "windows"), ["group", "slice"], fill, "a_ids binary, a_labels binary, a_v binary, w_at binary, w_name binary, w_low binary, w_high binary")
        return made.withColumn("block", F.expr("cast(`group` AS bigint) * 4294967296 + slice")).drop("group", "slice")

    def _visits(self, blocks: DataFrame, k: int, same: bool, ahead: bool, first: int) -> DataFrame:
        """(anchor, name, id, score): for each window the k best rows of every slice visited."""
        c, radii, dims = self.c, self.radii, self.dims
        asked = each_row(blocks.select("block", "a_v", "w_at", "w_low", "w_high"), lambda row: _needed(row, c, radii, first, ahead), "block long, list int", {"block": pa.int64(), "list": pa.int32()})
        units = asked.join(self.slices.select("list", "slice"), "list").withColumn("unit", F.xxhash64("block", "list", "slice"))
        left = units.join(blocks, "block").drop("list", "slice")
        right = units.join(self.slices, ["list", "slice"]).drop("list", "slice")
        longs = {x: pa.int64() for x in ("anchor", "name", "id", "score")}
        return each_row(left.join(right, ["unit", "block"]), lambda row: _met(row, dims, k, same), "anchor long, name long, id long, score long", longs)

    def search(self, anchors: DataFrame, k: int, same: bool, block: int = BLOCK, first: int = FIRST) -> DataFrame:
        """(anchor, name, rank, id, score) of ``anchors`` (list, id, label, v, windows of name, low, high).

        For each window the first k rows, of the anchor's label or of others, whose score lies in it.
        """
        blocks = materialise(self.blocks(anchors, block), "blocks")
        early = materialise(_first(self._visits(blocks, k, same, True, first), k), "early")
        kth = early.where(F.col("rank") == k).select(F.col("anchor").alias("id"), "name", F.col("score").alias("kth"))
        opened = anchors.select("id", F.explode("windows").alias("w")).select("id", "w.*")
        raised = opened.join(kth, ["id", "name"], "left").select("id", F.struct("name", F.greatest("low", F.coalesce("kth", "low")).alias("low"), "high").alias("w"))
        again = anchors.drop("windows").join(raised.groupBy("id").agg(F.collect_list("w").alias("windows")), "id")
        late = self._visits(materialise(self.blocks(again, block), "blocks"), k, same, False, first)
        return _first(early.drop("rank").unionAll(late), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "name").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, lists: int = LISTS, size: int = SLICE, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, v).

    Anchors are the rows whose id is divisible by ``every``; negatives score from ``share`` percent of the positive's score
    to the whole of it.
    """
    index = Index(rows, lists, size)
    anchors = index.rows.where(F.col("id") % every == 0).drop("far")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high")))
    near = materialise(index.search(anchors.withColumn("windows", whole), positives, True, block, first), "positives")
    # scores below zero have no window: 80 % of them is above them
    window = near.where("score >= 0").select(F.col("anchor").alias("id"), F.struct(F.col("rank").cast("long").alias("name"), F.expr(f"(cast(score AS decimal(38,0)) * {share} + 99) div 100").cast("long").alias("low"), F.col("score").alias("high")).alias("w"))
    asking = materialise(anchors.join(window.groupBy("id").agg(F.collect_list("w").alias("windows")), "id"), "asking")
    far = index.search(asking, negatives, False, block, first)
    named = near.select("anchor", F.col("rank").cast("long").alias("name"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor", "name"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every anchor and positive of the embeddings."""
    return settled(spark, lambda: mine(rows_of(table(spark, sf_dir, "embeddings"))), "hard-negatives")


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
