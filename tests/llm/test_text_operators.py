"""Text operators against brute force, on rows with nulls, empty and white texts, ties, repeated rows, very long texts,
empty tables and extra columns with clashing names."""

import collections
import datetime
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.llm import components, decontaminate, html_text, language_id, near_copies, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_files, tokens, url_filters

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, cell long, edge string, th string"


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(60)]
    passage = [r.choice(vocabulary) for _ in range(80)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = [None, "", " \n\t ", "one", "Two words", "The The The", " ".join(make(49)), " ".join(make(50))]
    base = make(120)
    out += [" ".join(base)] * 5 + [" ".join(base[:60] + ["X"] + base[60:])] + ["\n".join(base)]
    out += [" ".join(make(r.randint(0, 60)) + passage[r.randint(0, 20) :] + make(r.randint(0, 60))) for _ in range(12)]
    out += [" ".join(passage + ["q"] + passage), " ".join(["same"] * 400), " ".join(make(30_000)), "line one here\nline one here\nother | line #1 $5", " nb sp \u0085x"]
    return [(i, t) for i, t in enumerate(out)] + [(3, "one"), (8, out[8])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "e", "t") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_counts(docs, texts, none):
    want = []
    for i, t in texts:
        w, t = words(t), t or ""
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base))
    got = [tuple(r)[:7] for r in quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got) == sorted(want)
    assert quality_rules.judge(none).count() == 0
    assert all(not r.kept for r in quality_rules.judge(docs).where("base_failed").collect())


def test_substring_dedup(docs, texts, none):
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove(docs, carry=False).collect()]
    assert sorted(got) == sorted(want)
    full = substring_dedup.remove(docs)
    assert full.columns[: len(docs.columns)] == docs.columns
    assert {(r.doc_id, tuple(words(r.text))) for r in full.where("n_removed > 0").collect()} <= {(i, tuple(words(t))) for i, t in [(r.doc_id, r.text) for r in full.collect()]}
    assert substring_dedup.remove(none).count() == 0


def test_substring_results_beside_columns_of_their_names(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base), 5, "s"), (2, "head\n" + " ".join(base) + "\nmid  dle tail", 7, "s"), (None, " ".join(base), 9, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept_sha256 string")
    out = substring_dedup.remove(d)
    assert out.columns == [*d.columns, "n_words_", "n_removed", "kept_sha256_"]
    got = {r.doc_id: (r.text, r.n_words, r.n_words_, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == {1: (rows[0][1], 5, 60, 0, "s"), 2: ("head\nmid  dle tail", 7, 64, 60, "s"), None: (rows[2][1], 9, 60, 0, "s")}


def test_words_that_repeat_themselves_are_few_nodes(spark):
    """A text of one word has a row or two, not one for each window; results are those of brute force all the same."""
    same = [(i, " ".join(["osas"] * (300 + 7 * i) + [f"t{i}"] + ["a", "b", "c"] * (60 + i))) for i in range(12)]
    d = spark.createDataFrame(same, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    assert substring_dedup.occurrences(d).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 24
    first, want = {}, {}
    for i, t in same:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(d.drop("th"), carry=False).collect()} == want


def test_chains_compact_copies_to_one_row(spark):
    """Many copies of a document and a passage that many share are one node each; the rows that meet it are the copies."""
    r = random.Random(21)
    make = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    base, hot = make(2000), make(200)
    rows = [(i, " ".join(base)) for i in range(20)] + [(100 + i, " ".join(make(60) + hot + make(60))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    at = substring_dedup.occurrences(d)
    first = at.groupBy("edge").agg(F.min("doc_id").alias("edge_first"), F.max("doc_id").alias("l")).where("edge_first < l").drop("l")
    at = at.join(first, "edge").cache()
    nodes = substring_dedup.nodes_of(at)
    heads = substring_dedup.chains(nodes).where("run IS NOT NULL").collect()
    assert len(heads) == 2
    assert sorted((h["first"], h.run >= 100) for h in heads) == [(0, True), (100, True)] and max(h.run for h in heads) == 1951
    late = at.join(substring_dedup.chains(nodes), ["edge", "path"]).where("doc_id > first AND run IS NOT NULL")
    assert late.count() == 19 + 29


def brute_fingerprint(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if x]
    runs = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_simhash(docs, texts, none):
    fps = {i: brute_fingerprint(t) for i, t in texts}
    want = groups_of(fps)
    got = simhash.groups(docs).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}
    kept = {r.doc_id for r in simhash.first_of_each(docs).collect()}
    assert kept == {i for i in want if want[i] == i}
    assert simhash.groups(none).count() == 0


@pytest.mark.parametrize("crowded", [1, 48])
def test_links_connect_as_all_pairs_do(spark, crowded):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:8]:
        x = b
        for _ in range(25):
            x ^= 1 << r.randrange(64) | (1 << r.randrange(64) if r.random() < 0.7 else 0)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowded)).collect()
    got = {x: x for x in signed} | {r.node: r.root for r in found}
    want = groups_of(dict(zip(signed, fps, strict=True)))
    same = lambda g: {frozenset(k for k in g if g[k] == v) for v in set(g.values())}
    assert same(got) == same(want)


def test_exploded_cells_do_not_pass_through_the_driver(spark, monkeypatch, tmp_path):
    plans = {}
    real = simhash.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "materialise", seen)
    spark.range(500).select((F.col("id") * 7919).alias("fp")).write.parquet(f"{tmp_path}/fps")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    simhash.links(spark.read.parquet(f"{tmp_path}/fps")).count()
    assert "SortMergeJoin" in plans["cells"] and "BroadcastHashJoin" not in plans["cells"]


def jaccard(a, b):
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    x, y = runs(words(a.lower())), runs(words(b.lower()))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize(("rounds", "hot"), [(0, (1000, 32)), (1, (2, 0.5)), (3, (1000, 32))])
def test_near_copies_of_the_whole_band(spark, rounds, hot, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (rounds,))
    monkeypatch.setattr(near_copies, "HOT", hot)
    r = random.Random(11)
    texts = {}
    for i in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([40, 120, 300]))]
        texts[1000 - i] = " ".join(base)
        copy = list(base)
        for k in r.sample(range(len(base)), max(1, round(len(base) * r.choice([0.005, 0.015, 0.022, 0.04, 0.1])))):
            copy[k] = "X"
        texts[i] = " ".join(copy)
    hot = [f"h{k}" for k in range(200)]
    for i in range(60):
        texts[2000 + i] = " ".join(hot[: 50 + i] + ["Y"] + hot[50 + i :])
    texts |= {3000: "", 3001: " \n", 3002: "two Words", 3003: "TWO words"}
    ids = sorted(texts)
    root = {i: i for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    assert sum(jaccard(texts[a], texts[b]) < 0.9 and a < 2000 for a, b in pairs) > 10
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, texts[i], "en") for i in ids] + [(None, texts[3000], "en")], "doc_id long, text string, lang string")
    import corpus_pipeline

    got = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in got if x is not None) == [i for i in ids if root[i] == i]
    assert None in got
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_components_of_a_long_path_and_of_none(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def encoded(texts):
    t = tokens.tokenizer(tokens.default_tokenizer())
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in texts]


def test_encoder_equals_the_library():
    r = random.Random(1)
    alphabet = list("abcXYZ 's'T\n\t́éÅΣσςİßÇ0129.,!?-_\x1c\x85  #$%ſK한글ｱ") + ["<|endoftext|>", "don't", "I'll"]
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [None, ""]
    t = tokens.tokenizer(tokens.default_tokenizer())
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in some]
    assert tokens.Encoder(tokens.default_tokenizer())(some) == want


def test_encoder_looks_at_distinct_words_once_and_outlives_a_task(monkeypatch):
    given = []
    e = tokens.Encoder(tokens.default_tokenizer())
    of_words = e._of_words
    monkeypatch.setattr(e, "_of_words", lambda words, plain: given.extend(words.to_pylist()) or of_words(words, plain))
    some = ["Stone, stone stone. ſtone", None, "", " STONE stone, "] * 50
    t = tokens.tokenizer(tokens.default_tokenizer())
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in some]
    assert e(pa.array(some)) == want
    assert sorted(given) == sorted(["", "stone", "ſtone", ",", "."])
    monkeypatch.setattr(tokens, "KNOWN", 2)
    assert e(some + [f"{x} word{i}" for i, x in enumerate(some)])[: len(some)] == want
    assert tokens.encoder(tokens.default_tokenizer()) is tokens.encoder(tokens.default_tokenizer())


def test_token_files(spark, docs, encoded, none, tmp_path):
    token_files.write(docs, str(tmp_path / "a"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "a")).collect())
    want = sorted((i, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in encoded)
    assert sorted(g[1:] for g in got) == want
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert [g[0] for g in got] == list(np.cumsum([0, *[g[2] for g in got]])[:-1])
    token_files.write(none, str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_token_files_keep_rows_without_an_id(spark, tmp_path):
    d = spark.createDataFrame([(None, "b", 1), (5, "a", 2), (None, None, 3), (-(1 << 63), "c", 4), (5, "a", 5)], "doc_id long, text string, shard int")
    token_files.write(d, str(tmp_path / "n"))
    got = token_files.read(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 5, 5]
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (1, 9000, 0, 17)]
    s = token_files.Segment(token_files.write_segment([5, 6, 6, 9], [x.tobytes() for x in ids], bits, 77))
    assert [s.document(i).tolist() for i in range(4)] == [x.tolist() for x in ids]
    assert s.read(4090, 20).tolist() == np.concatenate(ids)[4090:4110].tolist()
    with pytest.raises(ValueError, match="does not fit"):
        token_files.pack(np.array([1 << 13], "<u4"), 13)


def test_packing(docs, encoded, none):
    made = packing.pieces(docs)
    rows = packing.assign(made).collect()
    want = collections.Counter()
    for i, x in encoded:
        e = np.array([*x, 0], "<u4")
        for p in range(0, len(e), 2048):
            want[i, p // 2048, p, len(e[p : p + 2048]), zlib.crc32(e[p : p + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.assign(packing.pieces(none)).count() == 0


def test_sequences_hold_the_ids(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "doc_id long, text string")
    made = packing.pieces(d)
    got = packing.sequences(made, packing.assign(made)).collect()
    t = tokens.tokenizer(tokens.default_tokenizer())
    want = sorted(x for s in ("alpha beta", "gamma", "") for x in [*t.encode(s, add_special_tokens=False).ids, 0])
    assert sorted(x for r in got for x in r.ids) == want


def test_best_fit_bounds_open_bins_and_fills_well():
    r = random.Random(3)
    p = packing.BestFit(100, 16)
    sizes, used = [r.randint(1, 100) for _ in range(5000)], collections.Counter()
    for n in sizes:
        b, at = p.put(n)
        assert at == used[b]
        used[b] += n
        assert p.n_open <= 16 and used[b] <= 100
    assert sum(sizes) / (100 * len(used)) > 0.93


def test_classifier_keeps_good_and_rejects_bad(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the of and to in a that it with for".split()) + r.choice(["", "er", "ing"]) for _ in range(60))
    rows = [(i, good() if i % 5 else good() + " vile nasty grim", 1, 0 if i % 5 else 1) for i in range(600)] + [(1000, None, 1, 0), (1001, "", 1, 0)]
    d = spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t, _, _ in rows], "doc_id long, text string, good string, log_weight double, _ string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 400], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.resample(d, labels).collect()}
    assert len(got) == 602
    weight = lambda bad: [got[i].log_weight for i in range(600) if (i % 5 == 0) == bad]
    assert max(weight(True)) < -4 < -1 < min(weight(False)) and got[1000].log_weight == got[1001].log_weight == 0
    assert sum(got[i].kept != (i % 5 > 0) for i in range(600)) <= 8 and got[1000].kept and got[1001].kept
    assert {x.doc_id for x in quality_classifier.accept(d, labels).collect()} == {i for i in got if got[i].kept}
    assert quality_classifier.accept(d, labels, k=0).count() == 0
    assert quality_classifier.accept(d, labels, k=50).columns == d.columns
    assert quality_classifier.resample(d, labels, k=50).where("kept").count() == 50
    assert quality_classifier.resample(d.limit(0), labels).count() == 0
    assert quality_classifier.resample(d, labels.limit(0)).count() == 602


def test_raw_model_counts_rows_without_labels(spark):
    rows = [(i, f"calm plain words here n{i}" if i < 300 else f"calm plain spam here n{i}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.log_weight for x in quality_classifier.resample(d, labels).collect()}
    assert got[0] > 0 > got[599]


def test_grams_equal_brute_force():
    r = random.Random(4)
    some = [" ".join(r.choice(["a", "B,", "CC", "x.!", "&&&", "and", "e"]) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["A A A A A b", "", None]
    g = quality_classifier.Grams()
    h = lambda x: xxhash.xxh64_intdigest(x.encode())
    m64, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    for t in some:
        w = (t or "").split()
        low = [re.sub(r"^\W+|\W+$", "", x.lower()) for x in w]
        found = {h("w" + x) for x in low if x}
        found |= {(h("w" + a) * odd + h("w" + b)) & m64 | 1 for a, b in zip(low, low[1:]) if a and b}
        shapes = collections.Counter(h("t" + re.search(r"\W+$", x)[0][:8]) for x in w if re.search(r"\W+$", x))
        shapes += collections.Counter(h("U") for x, y in zip(low, w) if len(x) > 1 and y.upper() == y and y.lower() != y)
        found |= {x * (2 * k + 1) & m64 for x, n in shapes.items() for k in (1, 3, 8) if n >= k}
        longest = max((len(list(v)) for _, v in itertools.groupby(w)), default=0)
        found |= {h(f"r{n}") for n in (2, 4, 8, 12) if n <= longest}
        want = sorted({(((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m64) >> 40) % quality_classifier.BUCKETS for x in found})
        assert g.of(t).tolist() == want


@pytest.mark.parametrize("piece", [20, 1 << 18])
def test_grams_of_a_batch_equal_those_of_each_text(monkeypatch, piece):
    """The words of a batch are looked at once each, and no n-gram goes from one text to the next."""
    r = random.Random(5)
    some = ["".join(r.choice(["a", "B,", "CC", "x.!", "&&&", "é", "e", " ", " ", "\t", "\x1c", "\x85", "\xa0", "\u2003"]) for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", " ", "a a", "a a a", "b " * 50]
    g = quality_classifier.Grams()
    want = [g.of(t).tolist() for t in some]
    split = [g.of(" ".join((t or "").split())).tolist() for t in some]
    looked = []
    words = g._words
    monkeypatch.setattr(g, "_words", lambda x: looked.append(x) or words(x))
    monkeypatch.setattr(quality_classifier, "PIECE", piece)
    rows, buckets = np.divmod(g.keys(pa.array(some)), quality_classifier.BUCKETS)
    assert [buckets[rows == i].tolist() for i in range(len(some))] == want == split
    assert all(len(x) == len(set(x)) for x in looked) and (piece < 100 or len(looked) == 1)
    ratios = np.where(np.arange(quality_classifier.BUCKETS) % 3 == 0, 0.5, 0).astype(np.float32)
    got = quality_classifier.log_weights(pa.array(some), quality_classifier.Grams(ratios), ratios)
    assert got.tolist() == [0.5 * sum(b % 3 == 0 for b in x) for x in want]


def test_gumbel_top_k_samples_in_proportion(spark):
    """Inclusion rates against drawing one after the other without replacement."""
    weights, k, runs = [1.0, 2.0, 3.0, 6.0], 2, 4000
    want = [0.0] * 4
    for a in range(4):
        for b in range(4):
            if a != b:
                p = weights[a] / sum(weights) * weights[b] / (sum(weights) - weights[a])
                want[a], want[b] = want[a] + p, want[b] + p
    d = spark.range(runs * 4).selectExpr("id AS doc_id", "id DIV 4 AS run", "int(id % 4) AS i").withColumn("log_weight", F.element_at(F.array(*[F.lit(float(np.log(w))) for w in weights]), F.col("i") + 1))
    g = d.withColumn("g", F.col("log_weight") / quality_classifier.TEMPERATURE + quality_classifier.gumbel())
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("g")))
    got = {x.i: x.n / runs for x in g.withColumn("r", rank).where(F.col("r") <= k).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[i] - want[i]) < 0.03 for i in range(4))


def test_kth_largest(spark):
    r = random.Random(1)
    v = [r.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000
    d = spark.createDataFrame([(x,) for x in v], "g double")
    for k in (1, 700, 1500, 3999, 5000):
        assert quality_classifier.kth_largest(d, k, small=50) == sorted(v, reverse=True)[k - 1]


def test_decontamination(spark, none):
    r = random.Random(8)
    filler = ["".join(r.choice("klmnop") for _ in range(r.randint(2, 6))) for _ in range(300)]
    items = [(i, " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(r.randint(12, 40)))) for i in range(30)] + [(90, None), (91, "..."), (92, "solo")]
    pad = lambda: " ".join(r.choices(filler, k=50))
    rows = [(i, f"{pad()} {t.title().replace(' ', ', ', 2)}. {pad()}") for i, t in items[:30]] + [(100 + i, pad()) for i in range(20)] + [(200, None), (201, ""), (202, "say Solo!"), (203, items[0][1])]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, hits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(d, b).collect()}
    assert got == {(i, i): 0 for i in range(30)} | {(202, 92): 0, (203, 0): 0}
    assert {x.doc_id for x in decontaminate.clean(d, b).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(none, b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_items_without_an_id_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "so alpha beta gamma delta it is", 7), (2, "nothing at all", 8), (None, "alpha beta gamma delta", 9)], "doc_id long, text string, hits int")
    b = spark.createDataFrame([(None, "Alpha beta, gamma delta"), (3, "alpha beta gamma delta")], "item_id long, text string")
    assert sorted((x.doc_id or 0, x.item_id or 0) for x in decontaminate.contaminated(d, b).collect()) == [(0, 0), (0, 3), (1, 0), (1, 3)]
    left = decontaminate.clean(d, b.where("item_id IS NULL"))
    assert [(x.doc_id, x.hits) for x in left.collect()] == [(2, 8)] and left.columns == d.columns


def test_windows_are_verified_where_no_tables_suffice():
    r = random.Random(14)
    items = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(24))) for i in range(40)]
    few, exact = decontaminate.Index(items), decontaminate.Index(items, most=0)
    assert not few.exact and exact.exact and few.tables > 0
    for i, t in items:
        w = t.split()
        w[5], w[15] = "zz", "zz"
        ids = np.array([exact.ids.get(x, 0) for x in ["z"] * 9 + w + ["z"] * 9])
        assert any(h["item_id"] == i and h["distance"] == 2 for h in exact.hits(ids))
        assert few.hits(ids) == [] or few.hits(ids) == exact.hits(ids)


def test_edited_items_are_found_and_far_ones_not():
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(30))) for i in range(100)]
    index = decontaminate.Index(items)
    ids = decontaminate.Ids(index)
    found = 0
    for i, t in items:
        w = t.split()
        for _ in range(4):
            p = r.randrange(len(w))
            w[p : p + r.randint(0, 1)] = [f"x{r.randrange(9)}"] * r.randint(0, 1)
        hits = index.hits(np.array([ids[x] for x in ["z"] * 30 + w + ["z"] * 30]))
        found += any(h["item_id"] == i and h["distance"] <= 4 for h in hits)
        far = [x if k % 3 else "q" for k, x in enumerate(t.split())]
        assert not index.hits(np.array([ids[x] for x in far]))
    assert found >= 90


def test_stretch_is_the_least_edit_distance():
    assert decontaminate.stretch([1, 2, 3], [9, 1, 2, 3, 9]) == (0, 1, 4)
    assert decontaminate.stretch([1, 2, 3, 4], [9, 1, 3, 4]) == (1, 1, 4)
    assert decontaminate.stretch([1], []) == (1, 0, 0)


def test_languages(spark):
    r = random.Random(6)
    w = {"en": "the and of with there".split(), "de": "der und von mit nicht".split()}
    rows = [(i, " ".join(r.choices(w[x], k=30)), x, f"h{i % 3}", "com") for i, x in ((i, "en" if i % 2 else "de") for i in range(60))]
    rows += [(100, None, "de-AT", "h1", None), (101, "the and of with", None, None, "com"), (102, "der und von mit nicht der", "en", "h1", "com")]
    got = {x.key: x for x in language_id.identify(spark.createDataFrame(rows, "key long, text string, declared string, host string, suffix string")).collect()}
    assert all(got[i].lang == ("en" if i % 2 else "de") for i in range(60))
    assert (got[100].lang, got[100].text_lang, got[101].lang, got[102].lang) == ("de", None, "en", "de")
    assert all(0 < x.confidence <= 1 + 1e-9 for x in got.values())
    empty = spark.createDataFrame([], "key long, text string, declared string, host string, suffix string")
    assert language_id.identify(empty).count() == 0


def test_posterior_equals_brute_force(spark):
    r = random.Random(16)
    w = {"en": "the and of with there".split(), "de": "der und von mit nicht".split(), "fr": "les des avec pour une".split()}
    rows = []
    for i in range(240):
        x = r.choice(list(w))
        said = r.choice([x, x, x, "en", None, "q1", "zz"])
        rows.append((i, r.choice([" ".join(r.choices(w[x] + w["en"], k=r.choice([1, 3, 20]))), None, ""]) if i % 9 == 0 else " ".join(r.choices(w[x], k=8)), said, f"h{i % 7}.{x}", r.choice([x, None])))
    rows += [rows[0], rows[5]]
    d = spark.createDataFrame(rows, "key long, text string, declared string, host string, suffix string")
    languages, logs = language_id.fit(d.withColumn("declared", F.coalesce(F.nullif(F.lower(F.regexp_extract("declared", "^[A-Za-z]+", 0)), F.lit("")), F.lit("und"))))
    n = len(languages)
    ll = [logs[language_id.trigrams(t)].astype(float).sum(0) / language_id.OVERLAP if t else np.zeros(n) for _, t, *_ in rows]
    best = [int(x.argmax()) if t else None for x, (_, t, *_) in zip(ll, rows, strict=True)]
    said = [(re.match("[a-z]*", (x[2] or "").lower())[0] or "und") for x in rows]
    said = [x if x in languages else "und" for x in said]
    place = [(x[3] or "", x[4] or "") for x in rows]
    tally = lambda test: np.array([sum(b == j and test(i) for i, b in enumerate(best)) for j in range(n)], float)
    every = tally(lambda i: True)
    base = (every + 1) / (every.sum() + n)
    names = [*languages, "und"]
    got = language_id.identify(d).collect()
    assert len(got) == len(rows)
    by = {x.key: x for x in got}
    for i, (key, t, *_) in enumerate(rows):
        s = tally(lambda j: place[j][1] == place[i][1])
        wider = (s + language_id.TO_ALL * base) / (s.sum() + language_id.TO_ALL)
        h = tally(lambda j: place[j] == place[i])
        prior = (h + language_id.TO_SUFFIX * wider) / (h.sum() + language_id.TO_SUFFIX) if h.sum() else base
        e = (tally(lambda j: said[j] == said[i]) + 1) / (every + len(names))
        x = ll[i] + np.log(prior) + np.log(e)
        p = np.exp(x - x.max())
        assert by[key].lang == languages[int(x.argmax())]
        assert abs(by[key].confidence - p.max() / p.sum()) < 1e-4
        assert by[key].text_lang == (languages[best[i]] if t else None)


def test_rare_languages_are_modelled(spark):
    r = random.Random(8)
    w = {"en": "the and of with there".split(), "de": "der und von mit nicht".split(), "fi": "ja oli joka mutta kun".split(), "xx": ["zz"]}
    kinds = ["en"] * 500 + ["de"] * 200 + ["fi"] * language_id.LEAST + ["xx"] * (language_id.LEAST - 1)
    rows = [(i, " ".join(r.choices(w[x], k=30)), x, f"h{i % 3}", "com") for i, x in enumerate(kinds)]
    d = spark.createDataFrame([*rows, (9000, "joka oli mutta kun ja", None, "h9", "com")], "key long, text string, declared string, host string, suffix string")
    size = collections.Counter(x.declared for x in language_id.sampled(d.select("key", "text", "declared"), 100).collect())
    assert size == {"en": 100, "de": 100, "fi": language_id.LEAST}
    got = {x.key: x.lang for x in language_id.identify(d, 100).collect()}
    assert all(got[i] == x for i, x in enumerate(kinds) if x != "xx")
    assert got[9000] == "fi"


def test_url_list_as_of_fetch(spark):
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    e = spark.createDataFrame([("a.org", ts(2), "add"), ("a.org", ts(3), "add"), ("a.org", ts(5), "remove"), ("a.org", ts(8), "add"), ("x.a.org", ts(4), "add"), (None, ts(1), "add"), ("b.org", ts(1), "remove"), ("c.org", ts(1), "add"), ("c.org", ts(1), "remove")], "pattern string, at string, action string").selectExpr("pattern", "cast(at AS timestamp_ntz) AS at", "action")
    c = [("http://A.org/p", 1), ("http://a.org:80/", 2), ("https://u@a.org./q", 4), ("http://a.org", 5), ("http://a.org", 9), ("http://x.a.org/", 4), ("http://xa.org/", 4), (None, 4), ("/relative", 4), ("http://b.org", 4), ("http://c.org", 4), ("http://a.org", None)]
    d = spark.createDataFrame([(i, u, ts(t) if t else None, f"k{i}", "h", i, "s", "t") for i, (u, t) in enumerate(c)], "page_id long, url string, t string, pattern string, Host string, hit int, spans string, at string").selectExpr("page_id", "url", "cast(t AS timestamp_ntz) AS fetched_at", "pattern", "Host", "hit", "spans", "at")
    out = url_filters.matches(d, e)
    assert out.columns == [*d.columns, "host_", "blocked", "pattern_", "since"]
    got = {r.page_id: (r.blocked, r.pattern_) for r in out.collect()}
    yes = {1: "a.org", 2: "a.org", 4: "a.org", 5: "x.a.org"}
    assert got == {i: (i in yes, yes.get(i)) for i in range(len(c))}
    assert all((r.pattern, r.Host, r.hit, r.spans) == (f"k{r.page_id}", "h", r.page_id, "s") for r in out.collect())
    assert out.where("page_id = 5").first().host_ == "x.a.org"
    assert url_filters.matches(d, e.limit(0)).where("blocked").count() == 0
    assert url_filters.matches(d.limit(0), e).count() == 0


def test_as_of_join_equals_brute_force(spark):
    r = random.Random(12)
    day = lambda n: datetime.datetime(2023, 1, 1) + datetime.timedelta(hours=n)
    names = ["a.org", "b.a.org", "c.b.a.org", "org", "d.net"]
    entries = [(r.choice(names), day(r.randrange(9000)), r.choice(["add", "remove"])) for _ in range(150)]
    captures = [(i, f"http://{r.choice(['c.b.a.org', 'b.a.org', 'x.org', 'q.d.net', 'none.com'])}/{i}", day(r.randrange(9500))) for i in range(300)]
    captures += [(900, *captures[0][1:]), (901, *captures[0][1:])]
    d = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(entries, "pattern string, at timestamp_ntz, action string")
    got = {x.page_id: (x.pattern, x.since) for x in url_filters.matches(d, e).collect()}
    for i, u, at in captures:
        host, want = u.split("/")[2], (None, None)
        for p in sorted(names, key=len):
            if host == p or host.endswith("." + p):
                on = None
                for t in sorted({x[1] for x in entries if x[0] == p and x[1] <= at}):
                    acts = {x[2] for x in entries if x[0] == p and x[1] == t}
                    on = None if "remove" in acts else on or t
                want = (p, on) if on else want
        assert got[i] == want


PAGE = '<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="ad">Buy</div>{0}<div id="comments">nice</div><script>var a="</p>";</script><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (PAGE.format("<article><h1>A&nbsp;b</h1><p>One<br>two <b>x</b>.<p>Three<ul><li>i<li>j</ul></article>"), "A b\n\nOne two x.\n\nThree\n\ni\n\nj"),
        (PAGE.format("<main><p>M <form>q</form></p><aside>s</aside><p>N</main>"), "M\n\nN"),
        ("<article><p>a<!-- c --><script>x</script>b</p><div class='cookie-notice'>no</div></article", "ab"),
        ("<p>1 < 2 &lt; 3 <unclosed", "1 < 2 < 3"),
    ],
)
def test_main_text_of_a_page(html, want):
    assert main_texts([html]) == [want]


def main_texts(pages):
    h = html_text.Host([html_text.blocks(x) for x in pages])
    return h.texts(h.counts, h.distinct)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article><div class="share-price">The share price fell</div><p class="related-work">Work</p></article>', "The share price fell\n\nWork"),
        ('<div class="search-results-article"><p>main</p></div>', "main"),
        ("<article><p>E <math><mi>m</mi><mo>c</mo></math> <svg><text>t</text></svg></p></article>", "E mc t"),
        ('<article><p>a</p><div class="ad">x</div><section id="post-comments"><p>unique</p></section><div class="site-footer">y</div></article>', "a"),
        ("<article><![CDATA[a < b]]><p>c</p><![CDATA[d</article>", "a < b\n\nc"),
        ("<article><ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nb\n\nc\n\n1 2\n\n3"),
    ],
)
def test_names_that_hint_and_names_that_decide(html, want):
    assert main_texts([html]) == [want]


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "</q>" * 60_000, "<div>" + "<b>" * 60_000 + "<hr>" * 60_000, "<!" * 400_000, "<![CDATA[>" * 100_000, "<a '" * 200_000, "<ul><li>" + "<b>" * 60_000 + "<li/>" * 60_000, "word " * 1_000_000])
def test_long_and_hostile_pages_take_seconds(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 10


def _host(spark, r, n=12):
    notice = "please keep in touch with all of us by any of the many means that are listed here"
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(n)]
    quote = " ".join(f"q{r.randrange(10**6)}" for _ in range(40))
    return own, quote, [f"<article><p>{own[i]}</p><p>{notice} {notice}</p>{f'<p>{quote}</p>' if i < 4 else ''}<p class='share-this-now'>tell {'all' if i < 6 else f'x{i}'}</p></article>" for i in range(n)]


def test_repeats_inside_articles(spark):
    """A notice on most pages goes whatever its markup, a hint goes where it repeats, a quote on a few pages stays."""
    own, quote, pages = _host(spark, random.Random(3))
    want = ["\n\n".join([own[i], *([quote] if i < 4 else []), *([f"tell x{i}"] if i >= 6 else [])]) for i in range(12)]
    assert main_texts(pages) == want
    h = html_text.Host([html_text.blocks(x) for x in pages])
    off = h.texts(dict.fromkeys(h.counts, 1), h.distinct)
    assert all("keep in touch" in x and "tell" in x for x in off)
    assert "keep in touch" in main_texts(pages[:5])[0]  # too few pages to tell


@pytest.mark.parametrize("bucket", [600, 3000, 10**9])
def test_texts_do_not_depend_on_the_bucket(spark, bucket):
    r = random.Random(5)
    _, _, pages = _host(spark, r, 40)
    same = " ".join(f"menu{i}" for i in range(30))
    rows = [(i, f"http://h.org/{i}", x) for i, x in enumerate(pages + pages[:3])]
    rows += [(100 + i, f"http://g.org/{i}", f"<div><p>{same}</p><p>{' '.join(f'v{r.randrange(10**6)}' for _ in range(40))}</p></div>") for i in range(9)]
    rows += [(200, None, None), (201, "http://h.org/z", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((x.page_id, x.url or "", x.text, x.n_chars) for x in html_text.main_text(d, bucket=bucket).collect())
    want = []
    for name in ("http://h.org", "http://g.org", ""):
        own = [x for x in rows if (x[1] or "").startswith(name) and (name or not x[1])]
        want += [(i, u or "", t, len(t)) for (i, u, _), t in zip(own, main_texts([x[2] for x in own]), strict=True)]
    assert got == sorted(want)


@pytest.mark.parametrize("bucket", [1500, 10**9])
def test_every_position_of_a_page_counts(spark, bucket):
    """Passages little longer than a run, of two pages each, go wherever they stand."""
    r = random.Random(9)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(24):
        passage = words(17 + i % 4)
        for k in (2 * i, 2 * i + 1):
            a, b = words(r.randint(20, 50)), words(r.randint(20, 50))
            rows.append((k, f"http://h.org/{k}", f"<div><p>{a}</p><p>{passage}</p><p>{b}</p></div>"))
            want[k] = f"{a}\n\n{b}"
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), bucket=bucket).collect()
    assert {x.page_id: x.text for x in got} == want


def test_host_boilerplate_goes_where_there_is_no_article(spark):
    r = random.Random(7)
    same = " ".join(f"menu{i}" for i in range(30))
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, f"http://h.org/{i}", f"<div><p>{same}</p><p>{t}</p></div>") for i, t in enumerate(own)] + [(9, None, None), (10, "http://h.org/0", f"<div><p>{same}</p><p>{own[0]}</p></div>")]
    d = spark.createDataFrame([(*x, "h", 3, 4) for x in rows], "page_id long, url string, html string, host string, bucket int, blocks int")
    got = {x.page_id: x.text for x in html_text.main_text(d).collect()}
    assert got == {i: t for i, t in enumerate(own)} | {9: "", 10: own[0]}
    assert html_text.main_text(d.limit(0)).count() == 0


def test_runs_equal_brute_force():
    r = random.Random(3)
    pages = [[r.randrange(3) for _ in range(r.randint(0, 60))] for _ in range(8)]
    pages += [pages[0][:], []]
    got = html_text.pages_of_runs([np.array(p, np.int64) for p in pages], 4)
    distinct = {tuple(p) for p in pages}
    has = lambda q, run: any(q[k : k + 4] == run for k in range(len(q) - 3))
    for p, n in zip(pages, got, strict=True):
        assert n.tolist() == [sum(has(q, tuple(p[k : k + 4])) for q in distinct) if k + 4 <= len(p) else 0 for k in range(len(p))]
    names = html_text.run_names(np.arange(50, dtype=np.uint64) % np.uint64(7), 4)
    assert len(names) == 47 and len(set(names.tolist())) == 7
    at = html_text.chosen(names, 8)
    assert max(np.diff(at)) <= 8 and at[0] < 8 and at[-1] >= 47 - 8
