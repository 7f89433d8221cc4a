"""Near duplicates among vectors: a pigeonhole join over blocks of rotated coordinates.

Two unit vectors have a cosine of c or more if their squared distance is 2 - 2c or less. A rotation (principal axes of a
bounded sample, dealt out to blocks in turn there and back) gives blocks of about WIDTH coordinates; the squared distance
is the sum over the blocks. Each block has a budget, its share of the sample's variance times 2 - 2c, so a pair that links
is within budget in at least one block. Each block is a range join: a tree of cuts at medians of the sample deals the
vectors to leaves, leaves are cut into slices of about SLICE rows by a hash, slices keep their bounding boxes, and two
slices meet unless their boxes are further apart than the budget. In a call, distances of the block come from one matrix
product; pairs within budget are verified over all coordinates. The union over blocks is kept whole by a rule: a pair
counts in the first block in which it is within budget, so it counts once.

Vectors are compared in single precision there, and pairs within SURE of the limit go on to a comparison in double
precision of the vectors as given, so the links are exact. A call returns a count for each row and, instead of the pairs, a
link of each row to the first of its part of the graph: rows out grow with rows in, whatever the size of a group.
Equal vectors are one row until the end, with their number.

The time of the range joins grows with the number of pairs of slices that boxes can't tell apart: for vectors with
structure (clusters, few strong axes) those are near ones, for vectors that fill all directions evenly all of them.

Vectors that are null, empty or zero, hold a null or non-finite component, or have not the table's most common length, link
with nothing and are kept. Repeated rows and equal vectors are vectors of their own and link. A row without an id links
like any other, has the smallest id of its component (null if there is none) and is kept. Only id and vector are read; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, settled, table
from .components import components
from .vectors import dimension, each_row, finite, matrix, packed, sample, sliced

#: Coordinates of a block, rows of a slice, and of a part of a slice in one matrix product.
WIDTH, SLICE, PART = 16, 16_384, 512

#: Pairs whose cosine in single precision is nearer to the limit than this are decided in double precision.
SURE = 1e-5

#: Cuts from the root of a block's tree to a leaf, at most.
DEPTH = 10

#: Pairs within budget in one matrix product beyond which they are verified by products over the other blocks, too.
DENSE = 1 << 17

#: What budgets are raised by, against rounding.
_SLACK = 1e-5


def units(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so squares stay in range."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Plan:
    """Rotation, blocks, budgets and trees, from a sample."""

    def __init__(self, points: np.ndarray, rows: int, cosine: float, width: int = WIDTH, size: int = SLICE) -> None:
        dims = points.shape[1]
        power, axes = np.linalg.eigh(points.T @ points / max(1, len(points)) - np.outer(points.mean(0), points.mean(0)))
        power, axes = np.maximum(power[::-1], 0), axes[:, ::-1]
        spread = power.sum() ** 2 / max((power * power).sum(), 1e-300)  # axes that count, in effect
        number = max(1, min(round(dims / width), int(spread / width)))
        turn = np.arange(dims) % (2 * number)
        of = np.where(turn < number, turn, 2 * number - 1 - turn)
        order = np.argsort(of, kind="stable")
        self.rotation, self.ends = axes[:, order], np.cumsum(np.bincount(of, minlength=number))
        self.starts = self.ends - np.bincount(of, minlength=number)
        share = np.array([power[of == b].sum() for b in range(number)])
        share = share / share.sum() if share.sum() > 0 else np.full(number, 1 / number)
        self.limit, self.budget = 2 - 2 * cosine, (2 - 2 * cosine) * share + _SLACK
        self.number, self.depth = number, min(DEPTH, max(0, math.ceil(math.log2(max(1, rows) / size))))
        turned = points @ self.rotation
        self.trees = [self._tree(turned[:, s:e]) for s, e in zip(self.starts, self.ends, strict=True)]

    def _tree(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(axis, cut) of each inner node, the children of i being 2 i + 1 and 2 i + 2."""
        inner = (1 << self.depth) - 1
        axis, cut, held = np.zeros(inner, int), np.zeros(inner), {0: x}
        for i in range(inner):
            mine = held.pop(i)
            if len(mine):
                axis[i] = int(np.argmax(mine.var(0)))
                cut[i] = float(np.median(mine[:, axis[i]]))
            over = mine[:, axis[i]] > cut[i]
            held[2 * i + 1], held[2 * i + 2] = mine[~over], mine[over]
        return axis, cut

    def leaf(self, b: int, x: np.ndarray) -> np.ndarray:
        at, (axis, cut) = np.zeros(len(x), int), self.trees[b]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > cut[at])
        return at - ((1 << self.depth) - 1)


def placed(reps: DataFrame, plan: Plan) -> DataFrame:
    """(block, leaf, rid, n, x): each vector once for each block; x: all rotated coordinates, as bytes."""
    dims = len(plan.rotation)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x = (units(matrix(b.column(2), dims)) @ plan.rotation).astype(np.float32)
            row = pa.array([r.tobytes() for r in x], pa.binary())
            for k, (s, e) in enumerate(zip(plan.starts, plan.ends, strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(plan.leaf(k, x[:, s:e]).astype(np.int32)), b.column(0), b.column(1), row], names=["block", "leaf", "rid", "n", "x"])

    return map_batches(reps.select("rid", "n", "v"), each, "block int, leaf int, rid long, n long, x binary")


def _slices(rows: DataFrame, plan: Plan, size: int) -> DataFrame:
    """(block, leaf, slice, ids, ns, x, low, high): slices and, over their block's coordinates, their boxes."""
    dims, starts, ends = len(plan.rotation), plan.starts.tolist(), plan.ends.tolist()

    def fill(t: pa.Table) -> dict[str, object]:
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, dims)
        b = t.column("block")[0].as_py()
        own = x[:, starts[b] : ends[b]]
        longs = {k: t.column(c).to_numpy().astype(np.int64).tobytes() for k, c in (("ids", "rid"), ("ns", "n"))}
        return longs | {"x": x.tobytes(), "low": own.min(0).astype(float).tolist(), "high": own.max(0).astype(float).tolist()}

    return packed(sliced(rows, ["block", "leaf"], "rid", size), ["block", "leaf", "slice"], fill, "ids binary, ns binary, x binary, low array<double>, high array<double>")


def _firsts(number: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``number`` nodes the first node that links (i, j) lead to."""
    label = np.arange(number)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dense(x: np.ndarray, y: np.ndarray, plan: Plan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the pairs of ``x`` and ``y`` that certainly link and count in block k, places of those to be looked at one by one).

    Distances in each block come from matrix products, whose rounding is far below the room that is left around every limit.
    """
    total, clear, here, room = np.zeros((len(x), len(y)), np.float32), np.ones((len(x), len(y)), bool), np.ones((len(x), len(y)), bool), np.float32(2e-5)
    for b, (s, e) in enumerate(zip(plan.starts, plan.ends, strict=True)):
        u, v = np.ascontiguousarray(x[:, s:e]), np.ascontiguousarray(y[:, s:e])
        gap = (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * (u @ v.T)
        total += gap
        if b <= k:
            within = gap <= np.float32(plan.budget[b])
            here &= within if b == k else ~within
            clear &= np.abs(gap - np.float32(plan.budget[b])) > room
    over = 0.5 * (np.float32(plan.limit) - total)  # cosine less the limit
    yes = here & clear & (over >= SURE + room)
    return yes, np.flatnonzero((~clear | here & ~yes) & (over > -(SURE + room)))


def _compared(row: dict, plan: Plan) -> Iterator[dict[str, np.ndarray]]:
    """Two slices: (a, b, links) rows with a link to the first of its part and a count, and unsure pairs, links null."""
    dims, k = len(plan.rotation), row["block"]
    s, e, budgets = plan.starts, plan.ends, plan.budget
    ids, ns, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ns"], np.int64), np.frombuffer(row["x"], np.float32).reshape(-1, dims)
    same = row["same"]
    jds, jns, y = (ids, ns, x) if same else (np.frombuffer(row["ids_b"], np.int64), np.frombuffer(row["ns_b"], np.int64), np.frombuffer(row["x_b"], np.float32).reshape(-1, dims))
    own_x, own_y = np.ascontiguousarray(x[:, s[k] : e[k]]), np.ascontiguousarray(y[:, s[k] : e[k]])
    half_y = 0.5 * (own_y * own_y).sum(1)
    links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    sure: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(0, len(x), PART):
        # |x|^2 / 2 + |y|^2 / 2 - x.y within half the budget, with room for rounding
        room = 0.5 * (own_x[p : p + PART] ** 2).sum(1) - (0.5 * budgets[k] + 1e-5)
        near = own_x[p : p + PART] @ own_y.T
        near -= half_y
        at = np.flatnonzero(near >= room[:, None])
        if len(at) > DENSE:
            yes, at = _dense(x[p : p + PART], y, plan, k)
            if same:
                yes[np.arange(len(yes))[:, None] + p >= np.arange(len(y))] = False
            links_x[p : p + PART] += np.round(yes @ jns.astype(float)).astype(np.int64)
            links_y += np.round(ns[p : p + PART].astype(float) @ yes).astype(np.int64)
            if yes.any():
                i, j = np.nonzero(yes)
                sure.append(_forest(len(x) + (0 if same else len(y)), [(i + p, j if same else j + len(x))]))
        for q in range(0, len(at), 1 << 16):
            i, j = np.divmod(at[q : q + (1 << 16)], len(y))
            i += p
            if same:
                i, j = i[i < j], j[i < j]
            gap = x[i].astype(float) - y[j]
            parts = np.add.reduceat(gap * gap, s, axis=1) if len(i) else np.zeros((0, len(s)))
            counts_here = (parts[:, k] <= budgets[k]) & ~(parts[:, :k] <= budgets[:k]).any(1)
            cosine = 1 - 0.5 * parts.sum(1)
            limit = 1 - 0.5 * plan.limit
            yes, unsure = counts_here & (cosine >= limit + SURE), counts_here & (np.abs(cosine - limit) < SURE)
            np.add.at(links_x, i[yes], jns[j[yes]])
            np.add.at(links_y, j[yes], ns[i[yes]])
            if yes.any():
                sure.append((i[yes], j[yes] if same else j[yes] + len(x)))
            if unsure.any():
                yield {"a": ids[i[unsure]], "b": jds[j[unsure]], "links": np.full(int(unsure.sum()), -1)}
        if len(sure) > 64:
            sure = [_forest(len(x) + (0 if same else len(y)), sure)]
    if sure:
        names = ids if same else np.concatenate([ids, jds])
        label = _firsts(len(names), *(np.concatenate(z) for z in zip(*sure, strict=True)))
        number = links_x + links_y if same else np.concatenate([links_x, links_y])
        has = np.flatnonzero(number)
        yield {"a": names[has], "b": names[label[has]], "links": number[has]}


def _forest(number: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    label = _firsts(number, *(np.concatenate(z) for z in zip(*pairs, strict=True)))
    moved = np.flatnonzero(label != np.arange(number))
    return label[moved], moved


def links(reps: DataFrame, plan: Plan, cosine: float, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((a, b) links that connect what is connected, (rid, links) the links of each vector) of ``reps`` (rid, n, v)."""
    s = materialise(_slices(materialise(placed(reps, plan), "placed"), plan, size), "slices")
    boxes = s.select("block", F.struct("leaf", "slice").alias("at"), "low", "high")
    gap = "aggregate(zip_with(zip_with(low, o_high, (u, v) -> u - v), zip_with(o_low, high, (u, v) -> u - v), (p, q) -> greatest(p, q, 0D)), 0D, (s, d) -> s + d * d)"
    budget = F.element_at(F.array(*[F.lit(float(x)) for x in plan.budget + 1e-5]), F.col("block") + 1)
    other = boxes.select("block", F.col("at").alias("o_at"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    met = boxes.join(other, "block").where(F.col("at") <= F.col("o_at")).where(F.expr(gap) <= budget).select("block", "at", "o_at").withColumn("unit", F.xxhash64("block", "at", "o_at"))
    met = materialise(met, "met")
    data = s.select("block", F.struct("leaf", "slice").alias("at"), "ids", "ns", "x")
    left = met.withColumn("same", F.col("at") == F.col("o_at")).join(data, ["block", "at"]).select("unit", "block", "at", "o_at", "same", "ids", "ns", "x")
    # a slice that meets itself is sent once
    right = met.where("at <> o_at").join(data.select("block", F.col("at").alias("o_at"), F.col("ids").alias("ids_b"), F.col("ns").alias("ns_b"), F.col("x").alias("x_b")), ["block", "o_at"]).select("unit", "block", "at", "o_at", "ids_b", "ns_b", "x_b")
    both = left.join(right, ["unit", "block", "at", "o_at"], "left").select("block", "same", "ids", "ns", "x", "ids_b", "ns_b", "x_b")
    longs = {c: pa.int64() for c in ("a", "b", "links")}
    found = materialise(each_row(both, lambda row: _compared(row, plan), "a long, b long, links long", longs), "found")
    unsure = found.where("links < 0").select("a", "b")
    vectors = lambda c: reps.select(F.col("rid").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}"))
    dot = lambda p, q: f"aggregate(zip_with({p}, {q}, (u, w) -> u * w), 0D, (s, d) -> s + d)"
    exact = unsure.join(vectors("a"), "a").join(vectors("b"), "b").withColumn("cosine", F.expr(f"{dot('va', 'vb')} / (sqrt({dot('va', 'va')}) * sqrt({dot('vb', 'vb')}))"))
    close = materialise(exact.where(~F.isnan("cosine") & (F.col("cosine") >= cosine)).select("a", "b", "na", "nb"), "close")
    edges = found.where("links > 0 AND a <> b").select("a", "b").unionAll(close.select("a", "b"))
    number = found.where("links > 0").select(F.col("a").alias("rid"), "links").unionAll(close.select("a", F.col("nb"))).unionAll(close.select("b", F.col("na")))
    return edges, number.groupBy("rid").agg(F.sum("links").alias("links"))


def groups(embeddings: DataFrame, cosine: float = 0.9, width: int = WIDTH, size: int = SLICE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = rows.where(finite("v")).where(F.exists("v", lambda x: x != 0))
    dims = dimension(fit)
    fit = fit.where(F.size("v") == dims)
    reps = materialise(fit.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    number = reps.count()
    if number == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    plan = Plan(units(sample(reps, number, dims)) if number else np.zeros((0, dims)), number, cosine, width, size)
    edges, count = links(reps, plan, cosine, size)
    roots = components(edges)
    named = materialise(reps.select("rid", "n", "least").join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(count, "rid", "left").select("rid", "least", F.coalesce("root", "rid").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = reps.select("v", "rid").join(named.join(least, "root"), "rid").select("v", "n_links", "component_id", F.lit(True).alias("fit"))
    out = rows.join(known, "v", "left")
    component = F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def first_of_each(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """The rows of ``embeddings`` whose id is the smallest of their component; rows without an id stay."""
    gone = groups(embeddings, cosine).where("NOT kept").select("vec_id").distinct()
    return embeddings.join(gone, "vec_id", "left_anti").select(*embeddings.columns)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: links and component of every embedding."""
    return settled(spark, lambda: groups(table(spark, sf_dir, "embeddings")), "embedding-groups")


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""
