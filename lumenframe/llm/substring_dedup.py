"""Substring dedup: a De Bruijn graph of token k-mers, its non-branching paths compacted through joins, verified at
the source.

A window is WINDOW consecutive words of one document; each word covered by a window whose words also start in a
document with a smaller id is removed. Windows are judged on the input.

Edges of the graph are k-mers of K words. Of the k-mers in a window, the one with the smallest hash stands for it, so
equal windows are stood for by equal k-mers, and about one k-mer in twenty is an edge. The windows that one edge
stands for lie in a row: with the words they cover they are a node of the compacted graph, named by the edge and a
hash of the words. The nodes of a document follow each other without gaps; those that it comes to more than once, as
where words repeat themselves, are one row with all their places.

* Only edges that occur in two documents are looked at further.
* Occurrences of a node are summed: first document, their number, the least and greatest node before it. Where
  all occurrences of a node come after one and the same node that occurs as often, neither branches. A join of the
  nodes with their predecessors finds these links, and the coordinates in the first document confirm them. Chains of
  links are compacted to one node: all of a chain's nodes have the same documents, so they lie in a row in the first of
  them, and a running count along that document numbers the chains, without a round for each doubling of their length.
* Only the head of a chain meets its occurrences again, so a copy costs a row for each chain it shares, not for each
  node: one row for a copy of a whole document, and one for a passage that many documents share.
* Where an edge has several nodes (a branch: a shared passage begins, ends or was edited), each node's first
  occurrence is verified at its coordinates in the source text: its windows are hashed one by one, and a window goes
  if a smaller document has it.

All joins are by node or by document, of tables that are written before, so Spark can split a hot key on their side of
many rows. No group is gathered in one place but the spans of one document.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return, unchanged.
A null or empty text has no words. A text of any length is read whole, and its words are held in memory by one task.
Rows that share an id are judged each for itself and are no sources for each other (ties keep both). A row with a null
id is kept whole and is no source. An empty table gives an empty one. Columns of the input are returned as they are; a
result of the same name gets an underscore.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, map_batches, marked, materialise, table

#: Words of a window and of a k-mer.
WINDOW, K = 50, 10

#: Bits (4 MB) that tell which texts are to meet their spans.
MARKS = 1 << 25

_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B, np.uint64), np.full(n, _B_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of all runs of a text's words: polynomials over word hashes, modulo 2^64, then mixed."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        size = 1 << max(12, (n + 1).bit_length())
        up, self.down = _powers(size)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def held(edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, positions): where the least of ``width`` edges changes from window to window, and to which position.

    Of equal edges the last one is taken and held while it is least and in the window, so words that repeat themselves
    change it once in ``width`` windows and not at every word.
    """
    n = len(edges) - width + 1
    backwards = np.lib.stride_tricks.sliding_window_view(edges[::-1].copy(), width).argmin(1) + np.arange(n)
    last = (len(edges) - 1 - backwards)[::-1]
    value = edges[last]
    falls = np.flatnonzero(value[1:] < value[:-1]) + 1
    at, i, k = 0, int(last[0]), 0
    windows, positions, falls = [0], [i], falls.tolist()
    while True:
        while k < len(falls) and falls[k] <= at:
            k += 1
        at = min(i + 1, falls[k] if k < len(falls) else n)
        if at >= n:
            return np.array(windows), np.array(positions)
        i = int(last[at])
        windows.append(at)
        positions.append(i)


def paths(words: list[bytes], window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """(edge, path, first window, windows) of a text: in order, covering all its windows."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    r = Rolling(words)
    at = np.arange(len(words) - k + 1)
    edges = r.of(at, at + k)
    low, position = held(edges, window - k + 1)
    high = np.append(low[1:], n)
    return edges[position], r.of(low, high - 1 + window), low, high - low


def occurrences(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(edge, path, b0, b1, doc_id, th, low, more, n) of ``docs`` (doc_id, th, text): one row for a node and document.

    th tells rows with one id apart. low is the first window of the node in the text, more has those of its other
    occurrences. A node is named edge XOR path; b0 and b1 are the least and greatest names of the nodes in front of its
    occurrences, 0 at the start of a text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            more: list[list[int] | None] = []
            for text in b.column(2).to_pylist():
                e, p, low, n = paths(words_of(text), window, k)
                e, p = e.view(np.int64), p.view(np.int64)
                before = np.concatenate([[0], (e ^ p)[:-1]]).astype(np.int64)[: len(e)]
                b0 = b1 = before
                rest: list[list[int] | None] = [None] * len(e)
                if len(set(p.tolist())) < len(p):
                    first, of = np.unique(np.stack([e, p], 1), axis=0, return_index=True, return_inverse=True)[1:]
                    of = of.ravel()
                    b0, b1 = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
                    np.minimum.at(b0, of, before)
                    np.maximum.at(b1, of, before)
                    rest = [None] * len(first)
                    for i in np.flatnonzero(first[of] != np.arange(len(e))).tolist():
                        if rest[of[i]] is None:
                            rest[of[i]] = []
                        rest[of[i]].append(int(low[i]))
                    e, p, low, n = (x[first] for x in (e, p, low, n))
                parts.append((e, p, b0, b1, low.astype(np.int32), n.astype(np.int32)))
                more += rest
            sizes = [len(x[0]) for x in parts]
            cols = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64 if i < 4 else np.int32) for i in range(6)]
            ids = [b.column(i).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:4]), *ids, pa.array(cols[4]), pa.array(more, pa.list_(pa.int32())), pa.array(cols[5])], names=["edge", "path", "b0", "b1", "doc_id", "th", "low", "more", "n"])

    return map_batches(docs.select("doc_id", "th", "text"), each, "edge long, path long, b0 long, b1 long, doc_id long, th long, low int, more array<int>, n int")


def nodes_of(at: DataFrame) -> DataFrame:
    """(edge, path, rep, last, times, p0, p1, edge_first): the sums of each node's occurrences."""
    times = F.sum(1 + F.coalesce(F.size("more"), F.lit(0)))
    return at.groupBy("edge", "path").agg(F.min(F.struct("doc_id", "th", "low", "n")).alias("rep"), F.max("doc_id").alias("last"), times.alias("times"), F.min("b0").alias("p0"), F.max("b1").alias("p1"), F.min("edge_first").alias("edge_first"))


def chains(nodes: DataFrame) -> DataFrame:
    """(edge, path, first, run, ask) of the heads of chains and of nodes to verify, from ``nodes``.

    ``run`` is the number of windows of the chain, null if the node is not the head of one that a later document has.
    ``ask``: windows of the first document are to be verified, because a smaller one has the edge.
    """
    last = nodes.where("rep.doc_id < last")
    before = last.select(F.expr("edge ^ path").alias("p0"), F.col("times").alias("b_times"), F.col("rep.doc_id").alias("b_doc"), F.col("rep.th").alias("b_th"), (F.col("rep.low") + F.col("rep.n")).alias("b_end"))
    after = last.where("p0 = p1 AND p0 <> 0").select("edge", "path", "p0", "times", "rep")
    inner = after.join(before, "p0").where("b_times = times AND b_doc = rep.doc_id AND b_th = rep.th AND b_end = rep.low").select("edge", "path", F.lit(1).alias("inner"))
    marked = last.join(inner, ["edge", "path"], "left").select("edge", "path", "rep", F.coalesce("inner", F.lit(0)).alias("inner"))
    along = Window.partitionBy("rep.doc_id", "rep.th").orderBy("rep.low")
    numbered = marked.select("edge", "path", F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t"), F.col("rep.low").alias("low"), F.col("rep.n").alias("n"), F.sum(1 - F.col("inner")).over(along).alias("chain"))
    heads = numbered.groupBy("d", "t", "chain").agg(F.min(F.struct("low", "edge", "path")).alias("h"), F.sum("n").cast("int").alias("run")).select("h.edge", "h.path", "run")
    asking = nodes.select("edge", "path", F.col("rep.doc_id").alias("first"), (F.col("rep.doc_id") > F.col("edge_first")).alias("ask"))
    return asking.join(heads, ["edge", "path"], "left").where("ask OR run IS NOT NULL")


_SPAN = pa.list_(pa.struct([("low", pa.int32()), ("n", pa.int32())]))
_ASKED = pa.list_(pa.struct([("edge", pa.int64()), ("window", pa.int64()), ("at", pa.int32())]))
_GIVEN = pa.list_(pa.struct([("edge", pa.int64()), ("window", pa.int64())]))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_text(text: str, gone: np.ndarray) -> str:
    """``text`` without its words that are ``gone``: kept words keep the white space between them; where words went, there
    is a line break if one went with them, else a space."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
    parts = [(at[a][0], at[b - 1][1]) for a, b in edges.reshape(-1, 2).tolist()]
    out = []
    for i, (a, b) in enumerate(parts):
        out += (["\n" if "\n" in text[parts[i - 1][1] : a] else " "] if i else []) + [text[a:b]]
    return "".join(out)


def removed_mask(n_words: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each of the words that a span [start, end) covers."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def remove(docs: DataFrame, window: int = WINDOW, k: int = K, carry: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, more columns) without its repeated passages.

    Returns the columns of ``docs`` and, as the last three, n_words, n_removed and kept_sha256 (of the kept words joined
    by a space). Rows that lose no word keep their text. Without ``carry`` only doc_id and the three figures are
    returned. Texts that lose nothing are not stored on the way; with ``carry`` they are read again with the result, and
    only texts with a span, and few others, are shuffled.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text", F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("rest"))
    found = materialise(occurrences(rows.where("doc_id IS NOT NULL"), window, k), "nodes")
    repeated = materialise(found.groupBy("edge").agg(F.min("doc_id").alias("edge_first"), F.max("doc_id").alias("edge_last")).where("edge_first < edge_last").select("edge", "edge_first"), "edges")
    at = materialise(found.join(repeated, "edge"), "repeated")
    discard(found, repeated)
    nodes = materialise(nodes_of(at), "classes")
    named = materialise(chains(nodes), "chains")
    met = at.join(named, ["edge", "path"]).where("(doc_id > first AND run IS NOT NULL) OR (doc_id = first AND ask)")
    span = met.select("doc_id", "th", F.struct(F.when(F.col("doc_id") > F.col("first"), 0).otherwise(1).alias("kind"), "edge", "low", "more", F.when(F.col("doc_id") > F.col("first"), F.col("run")).otherwise(F.col("n")).alias("n")).alias("s"))
    branching = nodes.where("rep.doc_id > edge_first").select("edge").distinct()
    give = nodes.join(branching, "edge").select("rep.doc_id", "rep.th", F.struct(F.lit(2).alias("kind"), "edge", F.col("rep.low").alias("low"), F.lit(None).cast("array<int>").alias("more"), F.col("rep.n").alias("n")).alias("s"))
    spans = span.unionAll(give).groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans"))
    keys = ["doc_id", "th"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, ss in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                words, by = words_of(text), {0: [], 1: [], 2: []}
                for s in ss or ():
                    by[s["kind"]] += [{"edge": s["edge"], "low": low, "n": s["n"]} for low in (s["low"], *(s["more"] or ()))]
                touched = bool(by[0] or by[1])
                hashed: dict[int, list] = {1: [], 2: []}
                if by[1] or by[2]:
                    r = Rolling(words)
                    for kind in (1, 2):
                        for s in by[kind]:
                            p = np.arange(s["low"], s["low"] + s["n"])
                            hashed[kind] += zip([s["edge"]] * len(p), r.of(p, p + window).view(np.int64).tolist(), p.tolist(), strict=True)
                for c, v in zip(out, (text if touched else None, len(words), None if touched else _digest(words), [{"low": s["low"], "n": s["n"]} for s in by[0]], [{"edge": e, "window": w, "at": p} for e, w, p in hashed[1]], [{"edge": e, "window": w} for e, w, _ in hashed[2]]), strict=True):
                    c.append(v)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), _SPAN, _ASKED, _GIVEN), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cols[0], b.column(3), *cols[1:]], names=["doc_id", "th", "text", "rest", "n_words", "sha", "late", "ask", "give"])

    kind = rows.schema["rest"].dataType.simpleString()
    if carry:
        spans = materialise(spans, "spans")
        joined = marked(rows, spans, keys, bits=MARKS).join(spans, keys).select(*keys, "text", "rest", "spans")
    else:
        joined = rows.join(spans, keys, "left").select(*keys, "text", "rest", "spans")
    seen = materialise(map_batches(joined, verify, f"doc_id long, th long, text string, rest {kind}, n_words long, sha string, late array<struct<low:int,n:int>>, ask array<struct<edge:long,window:long,at:int>>, give array<struct<edge:long,window:long>>"), "verified")

    discard(at, nodes, named, *([spans] if carry else []))
    asked = seen.where("size(ask) > 0").select("doc_id", "th", F.explode("ask").alias("a")).select("doc_id", "th", "a.edge", "a.window", "a.at")
    given = seen.where("size(give) > 0").select("doc_id", F.explode("give").alias("g")).groupBy("g.edge", "g.window").agg(F.min("doc_id").alias("first"))
    hits = asked.join(given, ["edge", "window"]).where("first < doc_id").groupBy("doc_id", "th").agg(F.collect_set("at").alias("hits"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(3)]
            for text, spans_, hits_ in zip(*(b.column(i).to_pylist() for i in (1, 4, 5)), strict=True):
                words = words_of(text)
                starts = [s["low"] for s in spans_] + (hits_ or [])
                ends = [s["low"] + s["n"] - 1 + window for s in spans_] + [p + window for p in hits_ or []]
                gone = removed_mask(len(words), np.array(starts, np.int64), np.array(ends, np.int64))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for c, v in zip(out, (kept_text(text, gone) if gone.any() else text, int(gone.sum()), _digest(kept)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), b.column(2), b.column(3), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "text", "rest", "n_words", "n_removed", "kept_sha256"])

    touched = seen.where("sha IS NULL").join(hits, ["doc_id", "th"], "left").select("doc_id", "text", "rest", "n_words", "late", "hits")
    shape = f"doc_id long, text string, rest {kind}, n_words long, n_removed long, kept_sha256 string"
    changed = map_batches(touched, finish, shape)
    if not carry:
        same = seen.where("sha IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
        return same.unionAll(changed.select("doc_id", "n_words", "n_removed", "kept_sha256"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            split = [words_of(text) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, split), pa.int64()), pa.array([0] * len(split), pa.int64()), pa.array(map(_digest, split), pa.string())], names=["doc_id", "text", "rest", "n_words", "n_removed", "kept_sha256"])

    lost = materialise(seen.where("sha IS NULL").select(*keys).distinct(), "lost")
    changed = materialise(changed, "changed")
    discard(seen)
    # no left_anti: Spark would move it in front of the marks and shuffle all rows
    perhaps = marked(rows, lost, keys, bits=MARKS).join(lost.withColumn("lost", F.lit(True)), keys, "left").where("lost IS NULL").drop("lost")
    stay = marked(rows, lost, keys, there=False, bits=MARKS).unionAll(perhaps.select(*rows.columns))
    every = map_batches(stay.select("doc_id", "text", "rest"), whole, shape).unionAll(changed)
    back = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(rest)}
    return every.select(*[back.get(c, F.col(c)) for c in docs.columns], *[F.col(c).alias(fresh(c, docs.columns)) for c in ("n_words", "n_removed", "kept_sha256")])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: what every document loses and keeps."""
    return remove(table(spark, sf_dir, "documents"), carry=False)


#: The same rows by brute force over all windows.
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM v) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range({WINDOW}) q(j)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.i = words.i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
