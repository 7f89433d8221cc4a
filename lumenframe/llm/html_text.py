"""Main text of web pages: markup cuts pages into blocks, a host's suffix array tells which of them are boilerplate.

Blocks. A block lies in the article (an article element or, failing that, a main element), in page furniture, or in
neither. Furniture is what an element says (nav, header, footer, aside, form ...) or a class, id or role all of whose
words say it or say nothing ("ad", "cookie-notice", "site-footer"), or one that names reader comments. A name of which
only some words do ("share-price", "related-work") is a hint, and decides nothing by itself.

Repeats. The token streams of a host's pages are concatenated, each page's end a token of its own, and their suffixes
ranked by prefix doubling to a depth of DEPTH tokens. Suffixes that rank alike share their first DEPTH tokens: a run. For
each run the distinct pages that have it are counted (equal pages count once), at every position of every page. A block
of fewer than DEPTH tokens is, as a whole, a run of its own.

Decision. A block repeats if half or more of its tokens lie in runs that another page has, and is common if they lie in
runs that more than half of the host's distinct pages have, where the host has MANY pages or more. A block of fewer than
DEPTH tokens does so as a whole only, since runs that begin in the block before may end in it.

* Furniture goes.
* A block of the article stays, unless it is common, or has a hint and repeats. So a share line or notice on most pages
  goes, whatever its markup, and an article that is published at several addresses stays.
* On a page that has an article, blocks in neither go. On others they stay unless they repeat.
* A page that would lose everything this way keeps its blocks of the article or, without one, what is not furniture.

Hosts are dealt out in buckets of about BUCKET bytes of markup by a hash of the text, so a hot host takes many tasks and equal
pages meet. Where a host has several buckets, each counts its own runs and deals them out by hash to as many shards as the
host has buckets; a shard sums the counts of the runs that several buckets have and sends them back to these, so results do
not depend on BUCKET. A shard has about as many runs as a bucket, each at most once for each bucket.

A null or empty page has an empty text. A page of any length is parsed whole, in time linear in its length. Repeated rows
are each returned, and are one page to the counts. Rows without a host (a null or relative address) share one. Ids and
addresses are returned as they are and need not be distinct. Only the three named columns are read. An empty table
gives an empty one.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, table

#: Tokens of a run; a power of two.
DEPTH = 16

#: Neighbouring runs of which chosen() takes one.
WINNOW = 16

#: Distinct pages that a host needs for a run to be common.
MANY = 8

#: Bytes of markup for a task.
BUCKET = 16 << 20

#: Hosts that may be broadcast with their numbers of buckets; beyond it they are joined by a shuffle.
HOSTS = 200_000

ARTICLE, FURNITURE, OTHER = 1, 2, 0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "noembed", "noframes", "xmp", "canvas", "audio", "video", "select", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset", "label"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main"}
#: Words of a class, id or role that name furniture.
_NAMES = set("ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside widget related recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments disqus reply replies login search form hidden legal copyright skip complementary contentinfo advertbox teaser teasers".split())
#: Words that leave a name's meaning as it is.
_NEUTRAL = set("site page main top bottom left right box block bar wrap wrapper container section area list item items link links inner outer content global primary secondary slot unit space zone post posts entry user reader readers article articles story stories news blog more row col column grid panel head body title text heading toggle btn icon icons buttons field input id js the".split())
#: Words that are never a part of an article, unique as their text may be.
_NEVER = {"comment", "comments", "disqus", "reply", "replies"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(attrs: dict[str, str]) -> tuple[bool, bool]:
    """(furniture, hint) of an element's class, id and role."""
    sure = hint = False
    for k in ("class", "id", "role"):
        for name in attrs.get(k, "").split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & _NAMES:
                hint = True
                sure = sure or words <= _NAMES | _NEUTRAL or bool(words & _NEVER)
    return sure, hint


class _Open:
    """An open element: what its blocks are, and where the elements are that the next tags may close."""

    __slots__ = ("article", "block", "furniture", "hint", "main", "marks", "name")

    def __init__(self, name: str, furniture: bool, hint: bool, article: bool, main: bool, block: int, marks: dict[str, int]) -> None:
        self.name, self.furniture, self.hint, self.article, self.main, self.block, self.marks = name, furniture, hint, article, main, block, marks


class _Page:
    """Collects blocks while the tags of a page go by."""

    def __init__(self) -> None:
        self.out: list[tuple[int, bool, str]] = []
        self.words: list[str] = []
        self.stack = [_Open("", False, False, False, False, 0, {})]
        self.places: dict[str, list[int]] = {}

    def close(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            o = self.stack[-1]
            self.out.append((FURNITURE if o.furniture else 3 if o.article else 4 if o.main else OTHER, o.hint, text))

    def pop(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def end(self, name: str) -> None:
        if self.places.get(name):
            at = self.places[name][-1]
            if self.stack[-1].block >= at:  # a block ends with it
                self.close()
            self.pop(at)
        elif name == "p":
            self.close()
        elif name == "br":
            self.words.append(" ")
        if name in ("td", "th"):
            self.words.append(" ")

    def start(self, name: str, raw: str) -> None:
        if name in _BLOCK:
            self.close()
            near = self.stack[-1].block
            if self.stack[near].name == "p":
                self.pop(near)
        elif name in ("br", "td", "th", "img"):
            self.words.append(" ")
        closed = [self.stack[-1].marks[x] for x in _CLOSED_BY.get(name, ()) if x in self.stack[-1].marks]
        if closed:
            self.pop(min(closed))
        if name in _VOID or raw.rstrip().endswith("/"):
            return
        o, at = self.stack[-1], len(self.stack)
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)}
        furniture, hint = o.furniture, o.hint
        if name not in ("html", "body", "article", "main"):
            sure, some = _named(attrs)
            furniture = furniture or sure or name in _FURNITURE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            hint = hint or some
        marks = {} if name in _SCOPE else {**o.marks, name: at} if name in _CLOSED_BY else o.marks
        article = o.article or name == "article" or attrs.get("itemprop") == "articleBody"
        main = o.main or name == "main" or "main" in _WORD.findall(attrs.get("role", ""))
        self.stack.append(_Open(name, furniture, hint, article, main, at if name in _BLOCK else o.block, marks))
        self.places.setdefault(name, []).append(at)


def blocks(page: str | None) -> list[tuple[int, bool, str]]:
    """(region, hint, text) of a page's blocks in order; white space is one space, empty blocks are left out."""
    page = page or ""
    p, at, end = _Page(), 0, len(page)
    last, last_cdata = page.rfind(">"), page.rfind("]]>")
    while at < end:
        if at > last:  # no tag ends any more
            tag = re.compile(r"<[a-zA-Z/!?]").search(page, at)
            p.words.append(entities.unescape(page[at : tag.start() if tag else end]))
            break
        if page.startswith("<![CDATA[", at) and at < last_cdata:
            stop = page.find("]]>", at)
            p.words.append(page[at + 9 : stop])
            at = stop + 3
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] == "<" and page[at : at + 1].isalpha() | page.startswith("/", at):
            at = page.find(">", at) + 1 or end  # a tag with an open quote
        elif m["text"] is not None:
            p.words.append(entities.unescape(m["text"]))
        elif m["end"]:
            p.end(m["end"].lower())
        elif m["start"]:
            name = m["start"].lower()
            if name not in _RAW:
                p.start(name, m["attrs"])
            elif not m["attrs"].rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
    p.close()
    best = 3 if any(r == 3 for r, _, _ in p.out) else 4
    return [(ARTICLE if r == best else OTHER if r in (3, 4) else r, hint, t) for r, hint, t in p.out]


def suffix_ranks(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens (a power of two); equal ranks share them all."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


def pages_of_runs(streams: list[np.ndarray], depth: int = DEPTH) -> list[np.ndarray]:
    """For each stream and position the number of distinct streams that have its run of ``depth`` tokens; zero where fewer
    are left."""
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(s.tobytes(), len(distinct)) for s in streams]
    pages = [np.frombuffer(b, np.int64) for b in distinct]
    sizes = np.array([len(p) for p in pages], np.int64)
    owner = np.repeat(np.arange(len(pages)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(len(owner), np.int64)
    inside = np.ones(len(owner), bool)
    inside[ends] = False
    tokens[inside] = np.concatenate([*pages, np.zeros(0, np.int64)])
    tokens[ends] = -1 - np.arange(len(pages))  # every end differs, so no run crosses it
    rank = suffix_ranks(tokens, depth)
    order = np.lexsort((owner, rank))  # the suffix array, pages in order among equals
    new_rank = np.append(True, rank[order][1:] != rank[order][:-1])[: len(order)]
    new_page = new_rank | np.append(True, owner[order][1:] != owner[order][:-1])[: len(order)]
    n = np.zeros(len(order), np.int64)
    n[order] = np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new_rank))[np.cumsum(new_rank) - 1] if len(order) else 0
    firsts = ends - sizes
    out = []
    for w in which:
        own = n[firsts[w] : ends[w]].copy()
        own[max(0, len(own) - depth + 1) :] = 0
        out.append(own)
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def run_names(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A hash of each run of ``depth`` of a page's word hashes."""
    h, width = _mix(words), 1
    while width < depth and len(h) > width:
        h, width = _mix(h[:-width] * _ODD + h[width:]), 2 * width
    return h if width == depth else np.zeros(0, np.uint64)


def chosen(names: np.ndarray, winnow: int = WINNOW) -> np.ndarray:
    """Positions of the runs that have the least hash among ``winnow`` neighbours."""
    if len(names) < winnow:
        return np.array([int(names.argmin())] if len(names) else [], np.int64)
    return np.unique(np.arange(len(names) - winnow + 1) + np.lib.stride_tricks.sliding_window_view(names, winnow).argmin(1))


class Host:
    """The pages of a host, or of a bucket of it: their blocks, tokens and runs."""

    def __init__(self, pages: list[list[tuple[int, bool, str]]]) -> None:
        self.pages = pages
        ids: dict[str, int] = {}
        streams = [np.array([ids.setdefault(w, len(ids)) for _, _, t in p for w in t.split(" ")], np.int64) for p in pages]
        hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in ids], np.uint64)
        names = [run_names(hashes[s]) for s in streams]
        self.ends = np.cumsum([len(n) for n in names], dtype=np.int64)
        self.runs = np.concatenate([*names, np.zeros(0, np.uint64)])
        self.n = np.concatenate([*(n[: len(k)] for n, k in zip(pages_of_runs(streams), names, strict=True)), np.zeros(0, np.int64)])
        self.short = [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 7) if t.count(" ") + 1 < DEPTH else None for _, _, t in p] for p in pages]
        self.n_short: dict[int, int] = {}
        seen: set[bytes] = set()
        for s, short in zip(streams, self.short, strict=True):
            if s.tobytes() not in seen:
                seen.add(s.tobytes())
                for h in set(short) - {None}:
                    self.n_short[h] = self.n_short.get(h, 0) + 1
        self.distinct = len(seen)

    @property
    def counts(self) -> dict[int, int]:
        """Pages by run."""
        return dict(zip(self.runs.tolist(), self.n.tolist(), strict=True)) | self.n_short

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(runs, pages): each run once, in order."""
        runs, at = np.unique(np.concatenate([self.runs, np.array(list(self.n_short), np.uint64)]), return_index=True)
        return runs, np.concatenate([self.n, np.array(list(self.n_short.values()), np.int64)])[at]

    def with_others(self, runs: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Pages of each run and by short block, where those in order in ``runs`` have ``pages``, the others what is here."""
        if not len(runs):
            return self.n, self.n_short
        at = np.minimum(np.searchsorted(runs, self.runs), len(runs) - 1)
        short = np.array(list(self.n_short), np.uint64)
        there = np.minimum(np.searchsorted(runs, short), len(runs) - 1)
        more = runs[there] == short
        return np.where(runs[at] == self.runs, pages[at], self.n), self.n_short | dict(zip(short[more].tolist(), pages[there][more].tolist(), strict=True))

    def texts(self, counts: dict[int, int], distinct: int) -> list[str]:
        """Main texts, by the counts of all the host's pages."""
        return self.decided(np.array([counts[r] for r in self.runs.tolist()], np.int64), counts, distinct)

    def decided(self, pages: np.ndarray, short_pages: dict[int, int], distinct: int) -> list[str]:
        """Main texts, by the pages that have the run of each position, and each short block, of ``distinct`` in all."""
        many = distinct // 2 if distinct >= MANY else distinct
        out = []
        for page, n, short in zip(self.pages, np.split(pages, self.ends[:-1]) if len(self.ends) else [], self.short, strict=True):
            total = sum(t.count(" ") + 1 for _, _, t in page)
            over = [self._covered(np.flatnonzero(n > least), total) for least in (1, many)]
            kept, article, spare, start = [], [], [], 0
            explicit = any(r == ARTICLE for r, _, _ in page)
            for (region, hint, text), whole in zip(page, short, strict=True):
                size = text.count(" ") + 1
                least_in = size if whole is not None else (size + 1) // 2
                repeats, common = (int(o[start + size] - o[start]) >= least_in or whole is not None and short_pages[whole] > least for o, least in zip(over, (1, many), strict=True))
                start += size
                if region == ARTICLE:
                    article.append(text)
                    if not (common or hint and repeats):
                        kept.append(text)
                elif region == OTHER and not explicit:
                    spare.append(text)
                    if not repeats:
                        kept.append(text)
            out.append("\n\n".join(kept or article or spare))
        return out

    @staticmethod
    def _covered(starts: np.ndarray, total: int) -> np.ndarray:
        """How many tokens before each position lie in one of the runs."""
        steps = np.zeros(total + DEPTH + 1, np.int64)
        steps[starts] += 1
        steps[starts + DEPTH] -= 1
        return np.concatenate([[0], np.cumsum(np.cumsum(steps)[:total] > 0)])


def _pack(page: list[tuple[int, bool, str]], press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(json.dumps([[r, int(h), t] for r, h, t in page], ensure_ascii=False).encode("utf-8", "surrogatepass"))


def _unpack(packed: pa.ChunkedArray) -> list[list[tuple[int, bool, str]]]:
    press = zstandard.ZstdDecompressor()
    return [[(r, bool(h), x) for r, h, x in json.loads(press.decompress(p.as_py()))] for p in packed]


def _squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers; those in order have equal first bytes, which take no room."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _spread(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1)


_COUNTS = "hid long, bucket int, shard int, runs binary, n binary"


def _counts(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    cols = zip(*((h, b, s, _squeeze(r), _squeeze(n)) for h, b, s, r, n in rows), strict=True) if rows else [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["hid", "bucket", "shard", "runs", "n"])


def _summed(t: pa.Table) -> pa.Table:
    """Of the counts of a shard by bucket those of runs that several buckets have, summed, for each of these buckets; shard -1
    has the distinct pages of the buckets."""
    hid, shard, buckets = t.column("hid")[0].as_py(), t.column("shard")[0].as_py(), t.column("bucket").to_pylist()
    runs, n = ([_spread(x.as_py(), k) for x in t.column(c)] for c, k in (("runs", np.uint64), ("n", np.int64)))
    ends = np.cumsum([len(x) for x in runs])[:-1]
    _, which, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    total = np.zeros(len(times), np.int64)
    np.add.at(total, which, np.concatenate(n))
    rows = [(hid, b, shard, r[times[w] > 1], total[w][times[w] > 1]) for b, r, w in zip(buckets, runs, np.split(which, ends), strict=True)]
    return _counts([x for x in rows if len(x[3])])


_OUT = "page_id {0}, url string, text string, n_chars long"


def _rows(t: pa.Table, texts: list[str]) -> list[pa.Array]:
    texts = [x.encode("utf-8", "replace").decode() for x in texts]
    return [t.column("page_id"), t.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", bucket: int = BUCKET) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    large = rows.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("n")).where(F.col("n") > bucket).select("host", F.ceil(F.col("n") / bucket).cast("int").alias("buckets"))
    large = materialise(large, "hosts")
    some = large.limit(HOSTS + 1).count()
    if some <= HOSTS:
        large = F.broadcast(large)
    dealt = rows.join(large, "host", "left").select("page_id", "url", "host", F.coalesce("buckets", F.lit(0)).alias("buckets"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            made = [blocks(x) for x in b.column(4).to_pylist()]
            packed = [_pack(x, press) for x in made]
            bucket = [xxhash.xxh64_intdigest(" ".join(t for _, _, t in x).encode("utf-8", "replace")) % n if n else 0 for x, n in zip(made, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "buckets", "bucket", "blocks"])

    shape = "page_id long, url string, host string, buckets int, bucket int, blocks binary"
    result = _OUT.format("long")

    def alone(t: pa.Table) -> pa.Table:
        h = Host(_unpack(t.column("blocks")))
        return pa.table(_rows(t, h.decided(h.n, h.n_short, h.distinct)), names=["page_id", "url", "text", "n_chars"])

    if not some:
        return map_batches(dealt, parse, shape).groupBy("host").applyInArrow(alone, result)
    small = map_batches(dealt.where("buckets = 0"), parse, shape).groupBy("host").applyInArrow(alone, result)
    parts = materialise(map_batches(dealt.where("buckets > 0"), parse, shape), "blocks")

    def count(t: pa.Table) -> pa.Table:
        h = Host(_unpack(t.column("blocks")))
        hid, bucket, shards = (t.column(c)[0].as_py() for c in ("hid", "bucket", "buckets"))
        runs, n = h.table()
        shard = (((runs >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(shard)) + 1
        rows = [(hid, bucket, int(s[0]), r, k) for s, r, k in zip(*(np.split(x, at) for x in (shard, runs, n)), strict=True) if len(r)]
        return _counts([(hid, bucket, -1, np.zeros(1, np.uint64), np.array([h.distinct])), *rows])

    parts = parts.withColumn("hid", F.xxhash64("host"))
    found = parts.groupBy("hid", "bucket").applyInArrow(count, _COUNTS)
    # a run that one bucket has needs no way back
    known = materialise(found.groupBy("hid", "shard").applyInArrow(_summed, _COUNTS), "known")

    def together(t: pa.Table, k: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.string(), pa.string(), pa.int64())], names=["page_id", "url", "text", "n_chars"])
        h = Host(_unpack(t.column("blocks")))
        distinct, runs, pages = h.distinct, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, shard, r, n in sorted(zip(*(k.column(c).to_pylist() for c in ("hid", "shard", "runs", "n")), strict=True)):
            if shard < 0:
                distinct = int(_spread(n, np.int64)[0])
            else:
                runs.append(_spread(r, np.uint64))
                pages.append(_spread(n, np.int64))
        return pa.table(_rows(t, h.decided(*h.with_others(np.concatenate(runs), np.concatenate(pages)), distinct)), names=["page_id", "url", "text", "n_chars"])

    return small.unionAll(parts.groupBy("hid", "bucket").cogroup(known.groupBy("hid", "bucket")).applyInArrow(together, result))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
