"""Language identification by Bayesian evidence fusion.

Three kinds of evidence meet in one posterior per text:

* the text: likelihood under trigram models of UTF-8 bytes, one for each language, hashed to BUCKETS;
* the declared language (of the markup or the table): how often each declaration goes with each language of the texts,
  smoothed, from grouped counts over all rows;
* the place: a prior for the host, smoothed towards its address suffix, which is smoothed towards all rows; these, too,
  from grouped counts over all rows of the languages that the texts alone suggest.

Declarations are all that there is to learn the text models from, so they serve twice: as labels of a sample, and as
evidence whose weight follows from how often text and declaration agree. A declaration that says nothing gets no weight.

The trigram models are fitted on at most SAMPLE rows of each declared language, those with the smallest hashes of their
ids, so how common a language is does not decide whether it has a model: LEAST rows in the whole table do. The MODELS
most common ones are modelled, which bounds what the driver gathers; declarations of all others count together.

Counts by place are one row for each host before they meet the rows again, and that join is of two written tables, so
Spark can split the rows of a hot host. A null or empty text has no likelihood of its own and takes the language of
declaration and place; a null or unreadable declaration counts as "und". Hosts and suffixes may be null, too: such rows
share a prior. Markup is read in one pass whatever it holds: the text has its character references decoded and leaves out
tags, comments, scripts and styles; one that never ends goes on to the end of the page. Of languages with the same posterior the first in order of the alphabet is taken. Repeated rows are each
judged. Texts of any length are read whole. An empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialise, settled, table
from .url_filters import host_of

#: Rows that the model of a language is fitted on, at most.
SAMPLE = 1000

#: Buckets of the trigram hash.
BUCKETS = 1 << 16

#: Overlapping trigrams count a text's bytes three times; likelihoods are divided by it.
OVERLAP = 3.0

#: Weight of the wider prior, in rows.
TO_SUFFIX, TO_ALL = 5.0, 20.0

#: Languages with fewer rows in the table than this are not modelled, and no more than MODELS are, unless identify() is told
#: otherwise; the driver gathers BUCKETS counts for each.
LEAST, MODELS = 5, 256

_RAW_END = {name: re.compile(f"</{name}", re.I) for name in ("script", "style")}
_ROOT = re.compile(r"<html(?=[\s/>])", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible(page: str | None) -> str | None:
    """The text of markup, in time that grows with its length alone."""
    if page is None:
        return None
    out, at = [], 0
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end, size = page.find("-->", start + 4), 3
        elif page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("/", "!", "?"):
            end, size = page.find(">", start + 1), 1
            name = page[start + 1 : start + 7].lower()
            raw = next((x for x in _RAW_END if name.startswith(x) and not page[start + 1 + len(x) : start + 2 + len(x)].isalnum()), None)
            if raw and end >= 0:
                close = _RAW_END[raw].search(page, end)
                end = page.find(">", close.start()) if close else -1
        else:  # a sign, not a tag
            out.append("<")
            at = start + 1
            continue
        out.append(" ")
        if end < 0:
            at = len(page)
            break
        at = end + size
    out.append(page[at:])
    return html.unescape("".join(out))


def declared_language(page: str | None) -> str | None:
    """The lang attribute of the first html tag."""
    tag = _ROOT.search(page) if page else None
    end = page.find(">", tag.start()) if tag else -1
    found = _LANG.search(page, tag.end(), end) if end >= 0 else None
    return found.group(1) if found else None


def opened(pages: DataFrame) -> DataFrame:
    """(key, text, declared, host, suffix) of ``pages`` (page_id, url, html)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            markup = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([visible(x) for x in markup], pa.string()), pa.array([declared_language(x) for x in markup], pa.string())], names=["key", "host", "text", "declared"])

    rows = pages.select(F.col("page_id").cast("long").alias("key"), host_of(F.col("url")).alias("host"), "html")
    made = map_batches(rows, each, "key long, host string, text string, declared string")
    return made.select("key", "text", "declared", "host", F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of bytes of the text in lower case, a space before and after it."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * 65_599 + b[1:-1] * 263 + b[2:]) * np.uint32(2_654_435_761) >> np.uint32(16)) if text else np.zeros(0, np.uint32)


def sampled(rows: DataFrame, sample: int = SAMPLE, models: int = MODELS) -> DataFrame:
    """(text, declared): of each modelled language the rows with the smallest hashes of their keys.

    If no language has LEAST rows, the most common ones are modelled all the same. A threshold on the hash, from the
    language's count, leaves about twice the sample before the rows of a language meet to be ranked.
    """
    told = rows.where("declared <> 'und' AND text IS NOT NULL").select("key", "text", "declared")
    counts = told.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "declared").limit(models)
    counts = materialise(counts, "declared")
    enough = counts.where(F.col("n") >= LEAST)
    counts = enough if enough.limit(1).count() else counts
    share = (F.shiftrightunsigned(F.xxhash64("key"), 11).cast("double") + 0.5) / float(1 << 53)
    few = told.withColumn("share", share).join(F.broadcast(counts), "declared").where(F.col("share") * F.col("n") < 2 * sample + 50)
    ranked = few.withColumn("at", F.row_number().over(Window.partitionBy("declared").orderBy("share", "key")))
    return ranked.where(F.col("at") <= sample).select("text", "declared")


def fit(rows: DataFrame, sample: int = SAMPLE, models: int = MODELS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities BUCKETS x languages) from ``rows`` (key, text, declared)."""
    chosen = materialise(sampled(rows, sample, models), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[d] = n.get(d, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
                texts[d] = texts.get(d, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([texts[d] for d in n], pa.int64()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in n.values()], pa.binary())], names=["declared", "texts", "counts"])

    total: dict[str, list] = {}
    for x in map_batches(chosen.coalesce(4), count, "declared string, texts long, counts binary").collect():
        t = total.setdefault(x["declared"], [0, np.zeros(BUCKETS, np.int64)])
        t[0] += x["texts"]
        t[1] += np.frombuffer(zlib.decompress(x["counts"]), "<i8")
    found = sorted(total) or ["und"]
    counts = np.stack([total[d][1] if d in total else np.zeros(BUCKETS, np.int64) for d in found], 1).astype(np.float64)
    p = (counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)
    discard(chosen)
    return found, np.log(p).astype(np.float32)


def identify(rows: DataFrame, sample: int = SAMPLE, models: int = MODELS) -> DataFrame:
    """(key, lang, confidence, text_lang, declared, host) from ``rows`` (key, text, declared, host, suffix)."""
    rows = rows.select("key", "text", F.coalesce(F.nullif(F.lower(F.regexp_extract("declared", "^[A-Za-z]+", 0)), F.lit("")), F.lit("und")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    languages, logs = fit(rows, sample, models)
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    n = len(languages)
    kind = rows.schema["key"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out, best = [], []
            for t in b.column(0).to_pylist():
                g, total = trigrams(t), np.zeros(n)
                for i in range(0, len(g), 1 << 16):
                    total += model[g[i : i + (1 << 16)]].sum(0, dtype=np.float64)
                out.append((total / OVERLAP).tolist())
                best.append(int(total.argmax()) if len(g) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.list_(pa.float64())), pa.array(best, pa.int32())], names=["key", "declared", "host", "suffix", "ll", "best"])

    # best: place of the best language by the text alone; null where the text says nothing
    scored = materialise(map_batches(rows.select("text", "key", "declared", "host", "suffix"), score, f"key {kind}, declared string, host string, suffix string, ll array<double>, best int"), "likelihoods")
    told = scored.where("best IS NOT NULL")
    each = [F.count_if(F.col("best") == i) for i in range(n)]
    added = lambda: F.array(*[F.sum(F.col("c")[i]) for i in range(n)])
    smoothed = lambda counts, wider, weight: F.zip_with(counts, wider, lambda c, w: (c + weight * w) / (F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) + weight))

    by_host = told.groupBy("host", "suffix").agg(F.array(*each).alias("c"))
    by_suffix = materialise(by_host.groupBy("suffix").agg(added().alias("c")), "suffixes")
    every = [x or 0 for x in by_suffix.agg(added().alias("c")).first()[0]]
    base = [(x + 1.0) / (sum(every) + n) for x in every]
    flat = F.array(*[F.lit(x) for x in base])
    of_suffix = by_suffix.select("suffix", smoothed(F.col("c"), flat, TO_ALL).alias("wider"))
    priors = by_host.join(of_suffix, "suffix").select("host", "suffix", F.transform(smoothed(F.col("c"), F.col("wider"), TO_SUFFIX), lambda x: F.log(x)).alias("prior"))
    priors = materialise(priors, "priors")

    # declarations that are no modelled language count together, so this table has a row for each language and one more
    declared = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise("und")
    pairs = {x[0]: x[1] for x in told.groupBy(declared.alias("d")).agg(F.array(*each)).collect()}
    names = [*languages, *(["und"] if "und" not in languages else [])]
    said = [(d, [float(np.log((pairs.get(d, [0] * n)[i] + 1.0) / (every[i] + len(names)))) for i in range(n)]) for d in names]
    evidence = rows.sparkSession.createDataFrame(said, "said string, evidence array<double>")
    joined = scored.join(priors, ["host", "suffix"], "left").withColumn("said", declared).join(F.broadcast(evidence), "said")
    logit = joined.withColumn("x", F.zip_with(F.zip_with("ll", F.coalesce("prior", F.transform(flat, lambda x: F.log(x))), lambda a, b: a + b), "evidence", lambda a, b: a + b)).withColumn("top", F.array_max("x"))
    at = F.array_position("x", F.col("top")).cast("int")
    mass = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names_of = F.array(*[F.lit(x) for x in languages])
    return logit.select("key", F.element_at(names_of, at).alias("lang"), (F.lit(1.0) / mass).alias("confidence"), F.get(names_of, F.col("best")).alias("text_lang"), "declared", "host")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every page: its text, the lang attribute of the markup, host and address suffix."""
    return settled(spark, lambda: identify(materialise(opened(table(spark, sf_dir, "pages")), "opened")).select(F.col("key").alias("page_id"), "lang", "confidence", "text_lang", "declared", "host"), "languages")


def language_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; its declared language is column lang, its place column source, without a suffix."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))
    return settled(spark, lambda: identify(rows).select(F.col("key").alias("doc_id"), "lang", "confidence", "text_lang", F.col("host").alias("source")), "languages")
