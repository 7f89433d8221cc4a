"""Quality classifier: importance resampling with hashed n-gram models, by Gumbel top-k.

Two generative models over BUCKETS hashed n-grams: of target text, counted over labelled documents that are good and not
toxic, and of raw text, counted over all documents. An n-gram is present in a text or not. N-grams are words in lower
case without outer punctuation, pairs of such words that follow each other, and shapes: the punctuation that a word ends
with, words all of punctuation, words in capitals, each once, three and eight times, and runs of 2, 4, 8 and 12 equal
words.

Where the target has c texts with an n-gram and the raw model expects e of them, the ratio of the models is
(c + PRIOR) / (e + PRIOR), the mean of the rate under a Gamma prior of mean one. Ratios for which c is within SURE
standard deviations of e count as one, since sums over thousands of them would measure the length of a text and the luck
of the sample. The logarithm of a text's importance weight is the sum of the logarithms of its n-grams' ratios.

Resampling keeps k documents by Gumbel top-k: the k largest of log weight / TEMPERATURE plus Gumbel noise, which is
sampling without replacement in proportion to the (tempered) weights. Unless given, k is the number of documents whose
log weight reaches a cut found on labelled documents that the target model has not seen. The noise of a document is a
hash of its id, so reruns agree.

Null and empty texts and those of white space have no n-grams and weight one: they are treated like any text of
average quality, and kept as a rule. Texts of any length are read whole, in pieces of PIECE words. Documents that tie
at the k-th key are all kept, so repeated rows share a fate. Without labels, or with those of one kind only, all weights
are what the counts give and the cut is -4. An empty table gives an empty one. The input's columns are returned as they
are, whatever their names; resample() reads doc_id and text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, map_batches, materialise, table

#: Labelled documents that the target model and the cut are fitted on, at most: those with the smallest hashes of ids.
SAMPLE = 9000

#: Buckets of the n-gram hash: bounds both models, a row for each on the driver at most.
BUCKETS = 1 << 19

#: Divides log weights before the noise is added.
TEMPERATURE = 1.0

#: Texts that the prior on a ratio is worth; standard deviations that a ratio must be from one.
PRIOR, SURE = 1.0, 4.0

#: Share of held-out good documents that the cut may cost, at most.
LOSS = 0.001

#: Words that are looked at together.
PIECE = 1 << 18

#: Lengths of runs of equal words, and counts of a shape, that are n-grams of their own.
RUNS, TIMES = (2, 4, 8, 12), (1, 3, 8)

_EDGE = re.compile(r"^\W+|\W+$")
_TAIL = re.compile(r"\W+$")

#: What str.split() takes for white space, besides that of ASCII.
_SPACES = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x)


def _buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Grams:
    """The n-grams of texts, a batch at a time; with log-ratios, those only whose ratio is not one."""

    def __init__(self, ratios: np.ndarray | None = None) -> None:
        self.told = None if ratios is None else ratios != 0
        self.runs = _buckets(np.array([_hash(f"r{n}") for n in RUNS], np.uint64))

    @staticmethod
    def _words(words: list[str]) -> tuple[np.ndarray, ...]:
        """Of each word: hash without outer punctuation, its bucket (-1: nothing left), hash of the tail (0: none), capitals."""
        size, lower = len(words), [w.lower() for w in words]
        low = [x if x.isalnum() else _EDGE.sub("", x) for x in lower]
        tails = [None if w.isalnum() else _TAIL.search(w) for w in words]
        digest = xxhash.xxh64_intdigest
        whole = np.array([digest("w" + x) if x else 0 for x in low], np.uint64)
        bucket = np.where(np.fromiter(map(bool, low), bool, size), _buckets(whole), np.int32(-1))
        shape = np.array([digest("t" + t[0][:8]) if t else 0 for t in tails], np.uint64)
        return whole, bucket, shape, np.array([x != w and len(y) > 1 and w.upper() == w for w, x, y in zip(words, lower, low, strict=True)], bool)

    def keys(self, texts: pa.Array) -> np.ndarray:
        """row * BUCKETS + bucket of the n-grams in each text, each once, in order. Distinct words of a piece are looked at once."""
        kind = np.int32 if len(texts) * BUCKETS < 1 << 31 else np.int64
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, _SPACES)).as_py():
            texts = pc.replace_substring_regex(texts, _SPACES, " ")
        split = pc.ascii_split_whitespace(texts)
        words, rows = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(kind)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            words, rows = words.filter(pa.array(full)), rows[full]
        found, shapes = [np.zeros(0, kind)], []

        def add(row: np.ndarray, bucket: np.ndarray) -> None:
            if self.told is not None:
                told = self.told[bucket]
                row, bucket = row[told], bucket[told]
            found.append(row * kind(BUCKETS) + bucket)

        for i in range(0, len(words), PIECE):
            back = min(i, max(RUNS))  # what lies across the border is seen again
            part, row = words[i - back : i + PIECE].dictionary_encode(), rows[i - back : i + PIECE]
            ids = part.indices.to_numpy()
            of_whole, of_bucket, of_shape, of_capital = self._words(part.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist() is ten times as slow
            whole, bucket, near = of_whole[ids], of_bucket[ids], row[1:] == row[:-1]
            there = bucket >= 0
            pair = there[:-1] & there[1:] & near
            add(row[there], bucket[there])
            add(row[1:][pair], _buckets((whole[:-1] * _ODD + whole[1:])[pair] | np.uint64(1)))
            shape, capital, own = of_shape[ids[back:]], of_capital[ids[back:]], row[back:]
            shapes += [(own[shape > 0], shape[shape > 0]), (own[capital], np.full(int(capital.sum()), _hash("U"), np.uint64))]
            same = near & (ids[1:] == ids[:-1])
            if same.any():
                ends = np.flatnonzero(np.append(~same, True))
                length = np.diff(ends, prepend=-1)
                for n, r in zip(RUNS, self.runs, strict=True):
                    at = row[ends[length >= n]]
                    add(at, np.full(len(at), r))
            if sum(map(len, found)) > 1 << 22:
                found = [_once(np.concatenate(found))]
        if shapes:
            row, shape = (np.concatenate(x) for x in zip(*shapes, strict=True))
            kinds, at = np.unique(shape, return_inverse=True)
            seen, n = np.unique(row.astype(np.int64) * max(1, len(kinds)) + at, return_counts=True)
            row, shape = (seen // max(1, len(kinds))).astype(kind), kinds[seen % max(1, len(kinds))]
            for t in TIMES:
                add(row[n >= t], _buckets(shape[n >= t] * np.uint64(2 * t + 1)))
        return _once(np.concatenate(found))

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of the n-grams in a text, each once, in order."""
        return self.keys(pa.array([text], pa.string()))


def counted(texts: DataFrame) -> DataFrame:
    """(gram, n): in how many rows of ``texts`` (text) each n-gram is; summed within tasks, then between them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        grams, n = Grams(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            n += np.bincount(grams.keys(b.column(0)) % BUCKETS, minlength=BUCKETS)
        seen = np.flatnonzero(n)
        for i in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[i : i + (1 << 16)], pa.int64()), pa.array(n[seen[i : i + (1 << 16)]])], names=["gram", "n"])

    return map_batches(texts.select("text"), each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_weights(texts: pa.Array, grams: Grams, ratios: np.ndarray) -> np.ndarray:
    """The sum of the log-ratios of each text's n-grams."""
    row, bucket = np.divmod(grams.keys(texts), BUCKETS)
    return np.bincount(row, ratios[bucket], len(texts)).astype(np.float64)


def ratios_of(target: DataFrame, raw: DataFrame, n_target: int, n_raw: int) -> np.ndarray:
    """Log-ratios by bucket, zero where the counts (gram, n) of target and raw text do not tell them apart."""
    e = F.col("raw") * (n_target / max(1, n_raw))
    both = raw.withColumnRenamed("n", "raw").join(target.withColumnRenamed("n", "target"), "gram", "full").na.fill(0)
    apart = both.where(F.abs(F.col("target") - e) > SURE * F.sqrt(e + PRIOR)).select("gram", F.log((F.col("target") + PRIOR) / (e + PRIOR)).alias("r"))
    out = np.zeros(BUCKETS, np.float32)
    for x in apart.collect():
        out[x["gram"]] = x["r"]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(log-ratios by bucket, cut). Of conflicting labels of a document the worse one counts.

    Two thirds of the sample give the target model, the rest the cut. Parts are drawn by id, so a text with many copies has
    its share in the target model as it has in the raw one.
    """
    chosen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(0)) * (1 - F.coalesce(F.max("toxic"), F.lit(0)))).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("good").cast("int").alias("good"), F.expr("pmod(xxhash64(1, doc_id), 3)").alias("part")), "sample")
    seen = texts.where("part < 2 AND good = 1")
    raw = materialise(counted(docs), "raw")
    ratios = ratios_of(counted(seen), raw, seen.count(), docs.count())
    held = weights(texts.where("part = 2"), ratios, keep=["good"]).collect()
    discard(texts, raw)
    return ratios, cut([x["log_weight"] for x in held if x["good"]], [x["log_weight"] for x in held if not x["good"]])


def cut(good: list[float], bad: list[float], loss: float = LOSS) -> float:
    """The cut that the most bad documents fall under, of those that cost at most ``loss`` of the good ones."""
    if not good or not bad:
        return -4.0
    highest = np.sort(good)[int(loss * len(good))]
    under = [b for b in bad if b < highest]
    # between the good documents it spares and the bad ones it catches, close to the former
    return float(0.8 * highest + 0.2 * max(under)) if under else float(highest)


def weights(docs: DataFrame, ratios: np.ndarray, keep: list[str], text: str = "text", out: str = "log_weight") -> DataFrame:
    """(columns in ``keep``, log_weight) of every row; ``ratios`` is broadcast, BUCKETS floats."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = shared.value
        grams = Grams(model)
        for b in batches:
            got = log_weights(b.column(0), grams, model)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.float64())], names=[*keep, out])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    chosen = docs.select(F.col(f"`{text}`").alias(fresh("_", keep)), *[F.col(f"`{c}`") for c in keep])
    return map_batches(chosen, each, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` double"]))


def gumbel(key: str = "doc_id", seed: int = 7):  # noqa: ANN201
    """Standard Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, small: int = 10_000) -> float:
    """The k-th largest of ``keys`` (g: double, no NaN), by ever finer histograms of at most 4096 bins."""
    low, high = keys.agg(F.min("g"), F.max("g")).first()
    left = k
    while True:
        inside = keys.where((F.col("g") >= low) & (F.col("g") <= high))
        n = inside.count()
        if n <= small or low == high:
            return float(inside.orderBy(F.desc("g")).limit(left).agg(F.min("g")).first()[0]) if low < high else float(low)
        step = (high - low) / 4096
        if low + step <= low:
            return float(low)
        bins = inside.groupBy(F.least(F.floor((F.col("g") - low) / step), F.lit(4095)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("a"), F.max("g").alias("z")).collect()
        for x in sorted(bins, key=lambda x: -x["b"]):
            if left <= x["n"]:
                low, high = x["a"], x["z"]
                break
            left -= x["n"]


def kept(scored: DataFrame, k: int, temperature: float = TEMPERATURE, key: str = "doc_id", weight: str = "log_weight", seed: int = 7):  # noqa: ANN201
    """A column that tells which rows of ``scored`` Gumbel top-k keeps. Rows that tie with the k-th are kept."""
    if k <= 0:
        return F.lit(False)
    g = F.col(f"`{weight}`") / temperature + gumbel(key, seed)
    return g >= F.lit(kth_largest(scored.select(g.alias("g")), k))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, log_weight, kept) of every document."""
    ratios, at = fit(docs, labels, sample)
    scored = materialise(weights(docs, ratios, ["doc_id"]), "weights")
    k = scored.where(F.col("log_weight") >= at).count() if k is None else k
    return scored.select("doc_id", "log_weight", kept(scored, k, temperature).alias("kept"))


def accept(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, with their columns.

    Texts stay where they are: they are weighed again as the result is read, so no join brings them and no copy is stored.
    """
    ratios, at = fit(docs, labels, sample)
    name = fresh("log_weight", docs.columns)
    scored = materialise(weights(docs, ratios, ["doc_id"], out=name), "weights")
    k = scored.where(F.col(f"`{name}`") >= at).count() if k is None else k
    passed = kept(scored, k, temperature, weight=name)
    return weights(docs, ratios, docs.columns, out=name).where(passed).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: weight and verdict of every document."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
