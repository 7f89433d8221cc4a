"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

Words are lower-cased and stripped of punctuation. The CGK embedding walks over a word sequence: step j writes the
word it stands on and moves on or stays, as a random bit of (j, word) says; after the end it writes padding. Sequences
at a small edit distance fall into step again after each edit, so their embeddings have a small Hamming distance. A
table of the LSH samples SAMPLED coordinates of a walk of its own; equal samples make a candidate. The number of
tables is the least that finds RECALL of the items after random edits of EDITS of their words, tried out when the
index is built; an unedited passage is found by any table. Candidates are verified by the edit distance of the item
to the best stretch around the window, which must be at most EDITS of the item's words.

Before the walk, windows are passed over that can't be within that distance: each edit breaks at most two of an
item's word pairs, so a window needs the rest of its pairs among those of the items, where a pair that repeats the one
before it counts once. No true window is lost by that.

The items are the query set: they are gathered in blocks of about BLOCK items and BLOCK_BYTES bytes and every document is
scanned against each block. Items with no word are not searched; those too short for one edit must occur as they are. An
item without an id is searched like any other, its hits have a null item_id, and all such items count as one. Equal items
under several ids are each found. Null and empty texts have no hits, whatever the length of others; texts are read whole.
Rows with the same id are scanned each for itself. Of stretches with the same distance the first counts. Where no number
of tables up to TABLES reaches RECALL, every window that may match is verified. Empty tables are allowed on either side.
Columns of the documents are returned as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_batches, table

#: Share of an item's words that may be edited.
EDITS = 0.15

#: Coordinates of a table's sample, share of edited items to find, tables beyond which windows are verified without them.
SAMPLED, RECALL, TABLES = 3, 0.95, 200

#: Items and bytes of a block: bound what is sent to the executors.
BLOCK, BLOCK_BYTES = 20_000, 16 << 20

#: Words that a worker remembers.
KNOWN = 1_200_000

_EDGE = re.compile(r"^\W+|\W+$")
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
_HIT_DDL = "array<struct<item_id:bigint,start:int,end:int,distance:int>>"


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def plain(word: str) -> str:
    w = word.lower().strip(_MARKS)
    return w if w.isalnum() else _EDGE.sub("", w)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """One table: a CGK walk over sequences of n words and the coordinates sampled from it."""

    def __init__(self, number: int, n: int, sampled: int = SAMPLED) -> None:
        rng = np.random.default_rng((number, n))
        span = max(2, 3 * n // 2)  # later coordinates are padding for most walks
        self.at = set(rng.choice(span, min(sampled, span), replace=False).tolist())
        self.odd = rng.integers(1 << 63, size=max(self.at) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.n = n

    def samples(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of the sampled coordinates for each window ids[start : start + n]."""
        wide = np.full((len(starts), self.n + 1), -1, np.int64)
        wide[:, :-1] = ids[starts[:, None] + np.arange(self.n)]
        flat = _mix((wide + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1)
        row = np.arange(len(starts)) * (self.n + 1)
        i, end = row.copy(), row + self.n
        out = np.zeros(len(starts), np.uint64)
        for j, odd in enumerate(self.odd):
            word = flat[i]
            if j in self.at:
                out = _mix(out ^ word)
            i = np.minimum(i + ((word * odd) >> np.uint64(63)).astype(np.int64), end)
        return out


def stretch(item: list[int], words: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``words`` with the least edit distance to ``item``, the first of such."""
    row = [(0, j) for j in range(len(words) + 1)]
    for i, a in enumerate(item, 1):
        last, row = row, [(i, 0)]
        for j, b in enumerate(words, 1):
            swap, skip, add = last[j - 1], last[j], row[j - 1]
            row.append(min((swap[0] + (a != b), swap[1]), (skip[0] + 1, skip[1]), (add[0] + 1, add[1])))
    d, end = min((d, j) for j, (d, _) in enumerate(row))
    return d, row[end][1], end


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True for the keys that are in ``ordered``."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _near(places: np.ndarray, n: int, width: int) -> bool:
    """Whether ``n`` of the ordered places lie within ``width``."""
    return len(places) >= n and bool((places[n - 1 :] - places[: len(places) - n + 1] < width).any())


class Index:
    """Walks, samples and words of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], edits: float = EDITS, recall: float = RECALL, most: int = TABLES) -> None:
        self.edits, self.ids, self.items = edits, {}, []
        for key, text in items:
            words = [w for w in map(plain, (text or "").split()) if w]
            if words:
                self.items.append((key, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]))
        self.width = len(self.ids) + 1
        pairs = [a * self.width + b for _, w in self.items for a, b in zip(w, w[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.by_length: dict[int, list[int]] = {}
        for at, (_, w) in enumerate(self.items):
            self.by_length.setdefault(len(w), []).append(at)
        self.pairs_of = {n: np.unique(np.array([a * self.width + b for m in members for a, b in zip(self.items[m][1], self.items[m][1][1:], strict=False)], np.int64)) for n, members in self.by_length.items()}
        self.need = {n: max(0, n - 1 - 2 * self.allowed(n) - max(sum(a == b == c for a, b, c in zip(w, w[1:], w[2:], strict=False)) for w in (self.items[m][1] for m in members))) for n, members in self.by_length.items()}
        self.fewest = min(self.need.values(), default=0)
        self.longest = max(self.by_length, default=0)
        self.tables, self.exact = self._tables(recall, most)
        self.found: dict[int, list[tuple[Walk, dict[int, list[int]]]]] = {n: [self._table(t, n) for t in range(self.tables)] for n in self.by_length}

    def allowed(self, n: int) -> int:
        return math.floor(self.edits * n)

    def _table(self, number: int, n: int) -> tuple[Walk, dict[int, list[int]]]:
        walk, found = Walk(number, n), {}
        members = self.by_length[n]
        for at, s in zip(members, walk.samples(np.array([x for m in members for x in self.items[m][1]], np.int64), np.arange(len(members)) * n).tolist(), strict=True):
            found.setdefault(s, []).append(at)
        return walk, found

    def _tables(self, recall: float, most: int, tried: int = 400) -> tuple[int, bool]:
        """The least number of tables that finds ``recall`` of randomly edited items; or none, and True, if none up to
        ``most`` does."""
        rng = np.random.default_rng(5)
        left = []
        for at in rng.choice(len(self.items), min(tried, len(self.items)), replace=False).tolist() if self.items else []:
            w = self.items[at][1]
            e = list(w)
            for _ in range(self.allowed(len(w))):
                p, kind = int(rng.integers(len(e))), int(rng.integers(3))
                e[p : p + (kind != 1)] = [] if kind == 2 else [0]
            if e != w:
                left.append((w, np.array((e + [0] * len(w))[: len(w)], np.int64)))
        groups: dict[int, list[tuple[list[int], np.ndarray]]] = {}
        for w, e in left:
            groups.setdefault(len(w), []).append((w, e))
        lost = {n: np.ones(len(x), bool) for n, x in groups.items()}
        t = 0
        while t == 0 or sum(x.sum() for x in lost.values()) > (1 - recall) * len(left):
            if t == most:
                return 0, True
            for n, x in groups.items():
                walk, starts = Walk(t, n), np.arange(len(x)) * n
                lost[n] &= walk.samples(np.concatenate([w for w, _ in x]), starts) != walk.samples(np.concatenate([e for _, e in x]), starts)
            t += 1
        return t, False

    def hits(self, ids: np.ndarray) -> list[dict]:
        """The items in a text, the best stretch of each, ordered by item; places are word numbers."""
        if not self.items or len(ids) == 0:
            return []
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        key = ids[both] * self.width + ids[both + 1]
        common = _among(key, self.pairs)
        both, key = both[common], key[common]
        if len(key):
            # a pair that repeats the one before it counts once, in the items' needs as well
            new = np.append(True, (key[1:] != key[:-1]) | (both[1:] != both[:-1] + 1))
            both, key = both[new], key[new]
        if self.fewest and not _near(both, self.fewest, self.longest):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for n, tables in self.found.items():
            if n > len(ids) + self.allowed(n):
                continue
            k = self.allowed(n)
            need = self.need[n]
            padded = np.concatenate([ids, np.zeros(max(0, n - len(ids)) + k, np.int64)])
            places = np.arange(len(padded) - n + 1)
            if need:
                if not _near(both, need, n):
                    continue
                own = both[_among(key, self.pairs_of[n])]
                if not _near(own, need, n):
                    continue
                starts = places[np.searchsorted(own, places + n - 1) - np.searchsorted(own, places) >= need]
            else:
                starts = places[padded[places] > 0]
            if not len(starts):
                continue
            tried = {(at, p) for at in self.by_length[n] for p in starts.tolist()} if self.exact else set()
            for walk, found in tables:
                for p, s in zip(starts.tolist(), walk.samples(padded, starts).tolist(), strict=True):
                    for at in found.get(s, ()):
                        tried.add((at, p))
            for at, p in sorted(tried):
                if at in best and best[at][1] <= p and p < best[at][2]:
                    continue
                low = max(0, p - k)
                item, around = self.items[at][1], ids[low : p + n + k].tolist()
                if len(item) - sum(map(set(around).__contains__, item)) > k:
                    continue  # each edit loses a word at most
                d, start, end = stretch(item, around)
                got = (d, low + start, low + end)
                if d <= k and (at not in best or got < best[at]):
                    best[at] = got
        by_item: dict[int, tuple[int, int, int]] = {}
        for at, got in best.items():
            key = self.items[at][0]
            by_item[key] = min(got, by_item.get(key, got))
        return [{"item_id": key, "start": s, "end": e, "distance": d} for key, (d, s, e) in sorted(by_item.items(), key=lambda x: (x[0] is not None, x[0] or 0))]


class Ids(dict):
    """A worker's table from words to ids; -1: no word."""

    def __init__(self, index: Index) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        w = plain(word)
        self[word] = out = self.index.ids.get(w, 0) if w else -1
        return out


def mark(docs: DataFrame, items: list[tuple[int, str | None]], text: str = "text", column: str = "hits") -> DataFrame:
    """``docs`` with a column of the items found in each text: array of (item_id, start, end, distance).

    start and end count the words of the text that have a letter or digit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))
    where = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index = shared.value
        known = Ids(index)
        for b in batches:
            out = []
            for t in b.column(where).to_pylist():
                ids = np.fromiter(map(known.__getitem__, (t or "").split()), np.int64)
                out.append(index.hits(ids[ids >= 0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _HIT)], names=[*b.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, each, f"{fields}, `{column}` {_HIT_DDL}")


def blocks(benchmark: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about ``block`` items and ``block_bytes`` bytes; one empty block if there are none."""
    count, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n = max(1, math.ceil(count / block), math.ceil(size / block_bytes))
    for i in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == i) if n > 1 else benchmark
        yield [(x[0], x[1]) for x in part.select(F.col(key).cast("long"), text).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every item in every document."""
    out = None
    for part in blocks(benchmark):
        found = mark(docs.select(F.col("doc_id").cast("long"), "text"), part).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    hits = fresh("hits", docs.columns)
    for part in blocks(benchmark):
        docs = mark(docs, part, column=hits).where(F.size(f"`{hits}`") == 0).drop(hits)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the benchmark items in every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
