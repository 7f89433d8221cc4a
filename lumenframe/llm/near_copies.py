"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: SimHash, then the rest.

SimHash fingerprints of the sets are linked by op10's popcount grid, and an exact check of the sets decides. Within its two
bits that finds copies with few edits only: at 0.8 two fingerprints of 64 bits are some ten bits apart, and a popcount grid
of that radius has more cells for a fingerprint than a corpus has documents. So an exact join by prefix filtering finds the
rest, between the groups that the fingerprints have made. All shingles are put
in one order, rare ones first. If two sets of n and m <= n shingles are similar, they share 0.8 n shingles or more, and
4/9 (n + m) or more; so the first shingle in order that they share is among the first n - 0.8 n + 1 of the larger set (its
probes) and among the first m - 8/9 m + 1 of the smaller (its index), and after it there are enough left in both. A
shingle that a page template or a quoted passage repeats is at the end of the order, so texts that share no more than that
are never compared.

Rarity is counted over all documents in BUCKETS hashed counters; the counters are summed in the tasks and are all that is
sent to them. Any order gives right results, so collisions cost time only. Shingles that no second set has are dropped as
they go by in order; those whose counter is far above the mean skip that, and so never meet in one task.

A group of n near copies has n^2 pairs, of which n - 1 connect it. So in each of some rounds, each group found so far has
one member compared with one other: with the member that leads the most common shingle that the group shares with another
group. The leader is the one in which that shingle comes first, so has the fewest rare ones of its own: an original rather
than its edited copies; in every second round it is drawn by a hash. Then all pairs that the filter leaves between
different groups are compared. Nothing is capped or left out: rounds only save pairs whose ends are connected already.

Pairs are compared in two steps. A set has PARITY bits, each the parity of the number of its shingles that fall there; where
two sets differ in as many bits, they differ in as many shingles at least, so most pairs that are not similar are told by
128 bytes a set, and none that is similar is lost. Only for the others sets are made from the texts and shuffled.

Documents with one set of shingles are one row until the end. Null, empty and white texts have the empty set and are copies
of each other. Texts with fewer words have one shingle, all of them. Shingles are compared by 64-bit hashes. Rows without an
id are no members of any group and stay. Rows that share an id and a text are one; texts of any length are read whole. Only
the id and the text are read, so other columns may have any names and are returned as they are. An empty table gives an
empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, discard, map_batches, marked, materialise, settled
from .components import components
from .simhash import links as simhash_links
from .simhash import majority

#: Words of a shingle.
SHINGLE = 5

#: Counters of shingles (a power of two), and parts of the table that are summed each by itself.
BUCKETS, PARTS = 1 << 20, 64

#: A counter over HOT[0] and over HOT[1] times the mean marks shingles that skip the search for a second set.
HOT = (1000, 32)

#: Rounds, at most, that connect groups before all pairs between them are compared; they end with one in which no more than
#: one comparison in WORTH found a link.
ROUNDS, WORTH = 3, 10

#: Bits of a set that bound from below how many shingles it has that another has not, and the reverse.
PARITY = 1024

#: Words in a worker's table, and rows of a batch of shingles.
KNOWN, ROWS = 200_000, 50_000

_TIMES, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingles:
    """Sets of shingles of texts: sorted distinct hashes, made from a hash of each word that a worker computes once."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle, self.known, self.hashes, self.bytes = shingle, {}, np.zeros(0, np.uint64), 0

    def _words(self, words: list[bytes]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        if fresh and (len(self.known) + len(fresh) > KNOWN or self.bytes > 48 * KNOWN):
            self.known, self.hashes, self.bytes = {}, np.zeros(0, np.uint64), 0
            fresh = list(set(words))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.bytes += sum(map(len, fresh))
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
        return self.hashes[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").encode().lower().split() for t in texts]
        h, at, out = self._words([w for x in split for w in x]), 0, []
        for x in split:
            mine, at = h[at : at + len(x)], at + len(x)
            k = min(self.shingle, len(mine))
            runs = np.full(len(mine) - k + 1 if k else 0, k, np.uint64)
            for i in range(k):
                runs = runs * _TIMES + mine[i : len(mine) - k + 1 + i]
            runs = (runs ^ (runs >> np.uint64(32))) * _MIX
            out.append(np.unique(runs ^ (runs >> np.uint64(32))))
        return out


def _name(s: np.ndarray) -> int:
    """A hash of the whole set, as a long; 0 for the empty one."""
    h = xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0
    return h - (1 << 64) if h >> 63 else h


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """The PARITY bits of each set, as longs."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) & np.uint64(PARITY - 1)).astype(np.int64) if len(sets) else row
    n = np.bincount(row * PARITY + at, minlength=len(sets) * PARITY)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(sets), PARITY // 64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, fp, parity, part, counts): of each document's set its name, size, SimHash and parity; with a part, a task's counters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        made, total = Shingles(), np.zeros(BUCKETS, np.uint32)
        names = ["doc_id", "sid", "n", "fp", "parity", "part", "counts"]
        for b in batches:
            sets = made(b.column(1).to_pylist())
            if len(sets):
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)), pa.FixedSizeListArray.from_arrays(parity(sets).ravel(), PARITY // 64).cast(pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if total.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(PARTS, pa.int64()) for _ in range(4)), pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, sid long, n long, fp long, parity array<long>, part int, counts binary")


def _summed(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in t.column("counts").to_pylist())
    return pa.table([t.column("part").slice(0, 1).cast(pa.int32()), pa.array([zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], names=["part", "counts"])


def rarity(made: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up: by part and a sixty-fourth of the tasks first, then by part."""
    shape = "part int, counts binary"
    tasks = made.where("part IS NOT NULL").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("some"))
    some = tasks.groupBy("part", "some").applyInArrow(_summed, shape)
    out = np.zeros((PARTS, BUCKETS // PARTS), np.uint32)
    for r in some.groupBy("part").applyInArrow(_summed, shape).collect():  # PARTS rows
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.ravel()


def prefixes(docs: DataFrame, rare: np.ndarray) -> DataFrame:
    """(token, sid, n, pos, hot): the probes of each document's set, in order of rarity."""
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    limit = max(HOT[0], HOT[1] * float(rare.mean()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        made, df = Shingles(), shared.value
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for s in made(b.column(0).to_pylist()):
                n = len(s)
                probes = n - (4 * n + 4) // 5 + 1
                count = df[_bucket(s)]
                first = np.lexsort((s, count))[:probes] if n else np.zeros(0, np.int64)
                out.append((s[first], np.full(len(first), _name(s)), np.full(len(first), n), np.arange(len(first)), count[first] > limit))
            token, sid, n, pos, hot = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.uint64).view(np.int64)), pa.array(sid.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(hot.astype(bool))], names=["token", "sid", "n", "pos", "hot"])

    return map_batches(docs.select("text"), each, "token long, sid long, n int, pos int, hot boolean")


def _indexed(n: np.ndarray) -> np.ndarray:
    """The number of shingles in the index of a set of n."""
    return n - (8 * n + 8) // 9 + 1


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of rows in order of token and set those whose token two sets have, one of them in its index; each set once."""

    def kept(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, sid, n, pos = rows
        fresh = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])][: len(token)]
        token, sid, n, pos = (x[fresh] for x in rows)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        if len(starts):
            size = np.diff(np.r_[starts, len(token)])
            keep = np.repeat((size > 1) & np.logical_or.reduceat(pos < _indexed(n), starts), size)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, sid, n, pos)], names=["token", "sid", "n", "pos"])

    held = [np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.int32)]
    for b in batches:
        rows = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
        end = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last token may go on
        yield from kept([x[:end] for x in rows])
        held = [x[end:] for x in rows]
    yield from kept(held)


def cells(docs: DataFrame, rare: np.ndarray) -> DataFrame:
    """(token, sid, n, pos): the probes that two sets or more share, written."""
    probes = prefixes(docs, rare)
    conf = docs.sparkSession.conf
    shape = "token long, sid long, n int, pos int"
    hot = probes.where("hot").drop("hot").dropDuplicates(["token", "sid"])
    cold = probes.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token", "sid").mapInArrow(_repeated, shape)
    both = cold.unionAll(hot)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    try:
        return materialise(both, "probes")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sets_of(docs: DataFrame) -> DataFrame:
    """(sid, s): the sets of the documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        made = Shingles()
        for b in batches:
            sets = made(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "s"])

    return map_batches(docs.select("text"), each, "sid long, s array<long>")


@dataclass
class Sets:
    """Documents (doc_id, text) and their sets: (sid, least, n, parity), ``least`` a document that has the set."""

    docs: DataFrame
    about: DataFrame


def possible(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """(a, b, al, bl): the rows of ``pairs`` (a, b; written) that sizes and parities do not rule out, and documents that have them."""

    def of(x: str) -> DataFrame:
        return marked(about, pairs.select(F.col(x).alias("sid")), ["sid"]).select(F.col("sid").alias(x), F.col("least").alias(f"{x}l"), F.col("n").alias(f"{x}n"), F.col("parity").alias(f"{x}p"))

    differ = "aggregate(zip_with(ap, bp, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return pairs.join(of("b"), "b").join(of("a"), "a").where(f"5 * least(an, bn) >= 4 * greatest(an, bn) AND 9 * {differ} <= an + bn").select("a", "b", "al", "bl")


def similar(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The rows of ``pairs`` (a, b; written) whose sets have a Jaccard similarity of 0.8 or more."""
    left = materialise(possible(pairs, sets.about), "possible")
    asked = left.select(F.col("a").alias("sid"), F.col("al").alias("doc_id")).unionAll(left.select("b", "bl")).distinct()
    made = sets_of(marked(sets.docs, asked.select("doc_id"), ["doc_id"]))
    made = marked(made, asked.select("sid"), ["sid"]).dropDuplicates(["sid"])  # one shuffle by sid, which both joins read
    of = lambda x: made.select(F.col("sid").alias(x), F.col("s").alias(f"s{x}"))
    both = left.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(5 * shared >= 4 * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _mixed(probes: DataFrame, labels: DataFrame, at: int) -> DataFrame:
    """(token, sid, n, pos, label, members, leader): the probes whose token more than one group has."""
    e = probes.join(labels, "sid")
    order = F.struct("pos", F.xxhash64("sid")) if at % 2 == 0 else F.struct(F.lit(0).alias("pos"), F.xxhash64(F.lit(at), "sid"))
    per = e.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.min(F.struct(order.alias("o"), F.col("sid").alias("sid"), F.col("n").alias("n"), F.col("label").alias("label"))).alias("c"))
    return e.join(per.where("low <> high").select("token", "members", F.struct("c.sid", "c.n", "c.label").alias("leader")), "token")


def _joined(labels: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``labels`` (sid, label) with the groups that the links make."""
    roots = components(_union(found)).select(F.col("node").alias("sid"), "root")
    return materialise(labels.join(roots, "sid", "left").select("sid", F.coalesce("root", "label").alias("label")), "labels")


def close(fps: DataFrame) -> DataFrame:
    """(a, b): sets (sid, fp) to be compared, as the popcount grid links their fingerprints; equal ones by a star."""
    first = materialise(fps.groupBy("fp").agg(F.min("sid").alias("first")), "fingerprints")
    same = fps.join(first, "fp").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    grid = simhash_links(first.select("fp"))
    for x in ("a", "b"):
        grid = grid.join(first.select(F.col("fp").alias(x), F.col("first").alias(f"s{x}")), x)
    return materialise(same.unionAll(grid.select(F.col("sa").alias("a"), F.col("sb").alias("b"))), "close")


def links(probes: DataFrame, sets: Sets, fps: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): similar pairs among the sets of ``probes``, with fingerprints ``fps``, enough of them to connect the groups."""
    labels = probes.select("sid").distinct()
    found = [materialise(similar(close(fps.join(labels, "sid", "left_semi")), sets), "links")]
    labels = _joined(labels.select("sid", F.col("sid").alias("label")), found)
    for at in range(rounds):
        mixed = _mixed(probes, labels, at).where("label <> leader.label AND 5 * least(n, leader.n) >= 4 * greatest(n, leader.n)")
        one = mixed.groupBy("label").agg(F.max(F.struct("members", "token", F.col("sid").alias("sid"), F.col("leader.sid").alias("of"))).alias("x"))
        one = materialise(one.select(F.col("x.sid").alias("a"), F.col("x.of").alias("b")), "star")
        star = materialise(similar(one, sets), "links")
        gained, tried = star.count(), one.count()
        if gained:
            found.append(star)
            labels = _joined(labels, found)
        if WORTH * gained <= tried:
            break
    mixed = materialise(_mixed(probes, labels, 0).drop("members", "leader"), "mixed")
    y = mixed.where("pos < n - (8 * n + 8) div 9 + 1").select("token", F.col("label").alias("other"), F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    # what a group has to offer for a shingle bounds what any of its members has
    offers = y.groupBy("token", "other").agg(F.min("bn").alias("least_n"), F.max("bn").alias("most_n"), F.max(F.col("bn") - F.col("bp")).alias("room"))
    fits = "label <> other AND least_n <= n AND 5 * most_n >= 4 * n AND 9 * least(n - pos, room) >= 4 * (n + greatest(least_n, (4 * n + 4) div 5))"
    x = mixed.join(offers, "token").where(fits).select("token", "other", F.col("sid").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    larger = "(bn < an OR bn = an AND b < a) AND 5 * bn >= 4 * an"
    enough = "9 * least(an - ap, bn - bp) >= 4 * (an + bn)"
    pairs = materialise(x.join(y, ["token", "other"]).where(f"{larger} AND {enough}").select("a", "b").distinct(), "pairs")
    found.append(materialise(similar(pairs, sets), "links"))
    return _union(found)


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest id reachable over similar pairs, itself included."""
    known = docs.where("doc_id IS NOT NULL")
    made = materialise(sketches(known), "sketches")
    rare = rarity(made)
    made_of = made.where("part IS NULL").select("doc_id", "sid")
    reps = materialise(made.where("part IS NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("parity").alias("parity")), "representatives")
    probes = cells(known, rare)
    sets = Sets(known.select(F.col("doc_id").cast("long"), "text"), reps.select("sid", "least", "n", "parity"))
    roots = components(links(probes, sets, reps.select("sid", "fp")))
    discard(probes)
    named = materialise(reps.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "named")
    lookup = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id")
    return made_of.join(lookup, "sid").select("doc_id", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) whose id is the smallest of their group; null ids stay."""
    gone = settled(docs.sparkSession, lambda: groups(docs).where("doc_id > component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
