"""Every text operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; the
pipeline's stages and the pipeline against plain Python."""

import random
import zlib

import numpy as np
import pytest

from lumenframe.llm import decontaminate, html_text, language_id, near_copies, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_files, tokens, url_filters

#: Columns with the names of results and of working columns.
CLASH = {c: "string" for c in "n_words n_removed kept_sha256 log_weight kept hits fp component_id sequence_id offset piece start length ids_crc32 rest cell sid bands edge path low more run spans seen label g k share".split()}
DDL = "doc_id long, text string, " + ", ".join(f"{c} {t}" for c, t in CLASH.items())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    long = " ".join(f"w{r.randrange(50_000)}" for _ in range(170_000))
    assert len(long) > 1_000_000
    texts = [None, "", " \t\n", "one", "one", "same words in a row " * 30, "same words in a row " * 30, long, long, "a " * 60_000, "\n\n\n", "é ü 한글 \U0001f600"]
    ids = [*range(len(texts) - 2), 3, None]
    return list(zip(ids, texts, strict=True)) + [(3, "one"), (None, None), (-(1 << 63), "least id"), ((1 << 63) - 1, "greatest id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *(f"{c}-{n}" for c in CLASH)) for n, (i, t) in enumerate(rows)], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (5, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "least id"), (1, "one")], "item_id long, text string")


def identified(d):
    return language_id.identify(d.selectExpr("doc_id AS key", "text", "edge AS declared", "path AS host", "label AS suffix"))


def packed(d):
    return packing.assign(packing.pieces(d)).where("piece = 0")


ONE_ROW_EACH = {
    "op2": lambda d, lab, b: substring_dedup.remove(d),
    "op2 bare": lambda d, lab, b: substring_dedup.remove(d, carry=False),
    "op3": lambda d, lab, b: identified(d),
    "op4": lambda d, lab, b: packed(d),
    "op5": lambda d, lab, b: quality_rules.judge(d),
    "op6": lambda d, lab, b: quality_classifier.resample(d, lab),
    "op10": lambda d, lab, b: simhash.groups(d.where("doc_id IS NOT NULL")),
    "op8": lambda d, lab, b: decontaminate.mark(d, [(1, "one"), (None, "x")], column="found"),
}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_every_row_has_a_result(docs, labels, benchmark, rows, name):
    f = ONE_ROW_EACH[name]
    got = f(docs, labels, benchmark)
    assert got.count() == sum(i is not None for i, _ in rows) if name == "op10" else len(rows)
    assert f(docs.limit(0), labels, benchmark).count() == 0


@pytest.mark.parametrize("name", ["op2", "op6", "op8", "near"])
def test_rows_that_stay_keep_their_columns(docs, labels, benchmark, rows, name):
    f = {"op2": lambda: substring_dedup.remove(docs).select(*docs.columns), "op6": lambda: quality_classifier.accept(docs, labels), "op8": lambda: decontaminate.clean(docs, benchmark), "near": lambda: near_copies.first_of_each(docs)}[name]
    got = f()
    assert got.columns == docs.columns
    kept = [(r.doc_id, *(r[c] for c in CLASH)) for r in got.collect()]
    assert kept and all(len({x.rsplit("-", 1)[1] for x in k[1:]}) == 1 for k in kept)
    assert all(k[1] == f"n_words-{n}" and rows[n][0] == k[0] for k in kept for n in [int(k[1].rsplit("-", 1)[1])])


def test_decontamination_of_the_odd_rows(docs, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(3, 1), (4, 1), (-(1 << 63), None)}


def test_files_of_the_odd_rows(spark, docs, rows, tmp_path):
    token_files.write(docs, str(tmp_path / "f"))
    got = token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    key = lambda x: (x is not None, x or 0)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=key)


def test_pages_and_addresses_that_are_odd(spark):
    long = "<p>" + "word " * 300_000 + "</p>"
    d = spark.createDataFrame([(1, None, None, "h", 1), (1, "", "", "h", 1), (None, "no address", "<p>x", "h", 1), (2, "http://h/", long, "h", 1), (2, "http://h/", long, "h", 1), (3, "HTTP://U@H:80/x", "<", "h", 1)], "page_id long, url string, html string, host string, buckets int")
    got = html_text.main_text(d).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 1_499_999, 1_499_999]
    seen = url_filters.matches(d.selectExpr("page_id", "url", "cast(NULL AS timestamp_ntz) AS fetched_at", "host"), spark.createDataFrame([], "pattern string, at timestamp_ntz, action string"))
    assert seen.columns == ["page_id", "url", "fetched_at", "host", "host_", "blocked", "pattern", "since"] and seen.where("NOT blocked").count() == 6
    assert {r.host_ for r in seen.collect()} == {None, "h"}


# ------------------------------------------------------------------------------------------------------- the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(17)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "", "ll")]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, item = make(70), make(25)
    texts, kind = {}, {}
    for i in range(300):
        texts[i], kind[i] = make(r.randint(60, 200)), "clean"
    for i in range(300, 360):
        texts[i], kind[i] = make(100) + ["vile", "nasty", "grim"] * 2, "bad"
    for i in range(360, 370):
        texts[i], kind[i] = list(texts[i - 360]), "copy"
    for i in range(370, 380):
        texts[i], kind[i] = list(texts[i - 370 + 20]), "near"
        texts[i][5] = "zzz"
    for i in range(380, 390):
        texts[i], kind[i] = make(80) + passage + make(80), "shares"
    for i in range(390, 396):
        texts[i], kind[i] = make(80) + item + make(80), "leaks"
    d = str(tmp_path_factory.mktemp("corpus"))
    doc_rows = [(i, " ".join(w) if i % 2 else "\n".join(w), "en", "s", len(" ".join(w))) for i, w in texts.items()]
    spark.createDataFrame(doc_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    lab = [(i, 0 if kind[i] == "bad" else 1, int(kind[i] == "bad")) for i in texts if i % 4 < 3]
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, kind, passage


def test_stages_do_their_work_and_keep_the_rest(spark, corpus):
    import corpus_pipeline

    d, texts, kind, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name, x: {r.doc_id: r.text for r in stages[name](spark, x, d).select("doc_id", "text").collect()}
    got = left("quality_classifier", docs)
    assert sum(kind[i] == "bad" for i in got) <= 2 and sum(kind[i] != "bad" for i in got) >= 334
    got = left("near_dedup", docs)
    assert set(texts) - set(got) == {i for i in texts if kind[i] in ("copy", "near")}
    got = left("substring_dedup", docs.where("doc_id < 360 OR doc_id >= 380"))
    hits = {i: passage[10] in t.split() and " ".join(passage) in " ".join(t.split()) for i, t in got.items() if kind[i] == "shares"}
    assert hits == {i: i == 380 for i in range(380, 390)}
    assert all(got[i] == (" " if i % 2 else "\n").join(texts[i]) for i in got if kind[i] != "shares")
    assert all(("\n" in got[i]) == (i % 2 == 0) for i in range(380, 390))
    got = left("decontamination", docs)
    assert set(texts) - set(got) == {i for i in texts if kind[i] == "leaks"}
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, d).dtypes == docs.dtypes and stages[name](spark, docs.limit(0), d).count() == 0


def test_the_pipeline_packs_what_the_stages_leave(spark, corpus):
    import corpus_pipeline

    d, texts, kind, passage = corpus
    got = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
    t = tokens.tokenizer(tokens.default_tokenizer())
    want = {}
    for x in docs.collect():
        ids = np.array([*t.encode(x.text, add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 2048):
            want[x.doc_id, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in got} == want
    assert {kind[x.doc_id] for x in got} == {"clean", "shares"} or {kind[x.doc_id] for x in got} == {"clean", "shares", "bad"}
    fill = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == fill.get(x.sequence_id, 0)
        fill[x.sequence_id] = x.offset + x.length
    assert max(fill.values()) <= 2048


# --------------------------------------------------------------------------------------- what is left behind, and size


def in_shared_folder(spark):
    import os

    from lumenframe.llm.common import shared_dir

    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_the_pipeline_leaves_its_result_alone(spark, corpus):
    import corpus_pipeline

    before = in_shared_folder(spark)
    got = corpus_pipeline.run(spark, corpus[0])
    left = in_shared_folder(spark) - before
    assert len(left) == 1 and got.stored_at.endswith(left.pop()) and got.count() > 300


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_best_fit_packing", "op6_quality_classifier", "op9_token_files", "op10_simhash", "op12_importance_resampling"])
def test_queries_leave_their_result_alone(spark, corpus, name):
    from lumenframe.llm import registry

    before = in_shared_folder(spark)
    got = registry.queries()[name](spark, corpus[0])
    left = in_shared_folder(spark) - before
    assert len(left) == 1 and got.stored_at.endswith(left.pop()) and got.count() > 300


@pytest.mark.parametrize("part", ["<", "<script>", "<!--", "<a", "<html lang ", "</", "<script></scrip", "<style", "a<b>", "&amp;", "<![CDATA["])
def test_markup_that_never_ends_takes_no_time(part):
    import time

    page = part * (1_000_000 // len(part))
    began = time.time()
    language_id.visible(page), language_id.declared_language(page)
    assert time.time() - began < 5


def test_text_and_declaration_of_markup():
    page = '<!doctype html><HTML xml:lang=fr class=x><title>T&auml;</title><style>s{}</style><p>1 < 2<!-- no --> a<SCRIPT a="b">bad()</script >b<scripted>c</p><script>rest'
    assert language_id.visible(page).split() == "Tä 1 < 2 a b c".split() and language_id.declared_language(page) == "fr"
    assert language_id.visible(None) is None and language_id.visible("") == "" and language_id.declared_language("<html") is None


def jaccard_groups(texts):
    runs = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 5 * (n := len(runs[a] & runs[b])) >= 4 * (len(runs[a]) + len(runs[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_templates_chains_and_copies_against_all_pairs(spark):
    r = random.Random(4)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    template, texts = own(120), {}
    for i in range(150):  # a template with tails that are too long for most pairs
        texts[i] = " ".join(template + own(r.randint(8, 22)))
    chain = own(100)
    for i in range(200, 260):  # each like the next, the ends alike in nothing
        chain = chain[6:] + own(6)
        texts[i] = " ".join(chain)
    original = own(110)
    for i in range(300, 420):  # copies with edits, of each other or only of the original
        w = list(original)
        for k in r.sample(range(len(w)), r.choice([1, 2, 3, 5])):
            w[k] = own(1)[0]
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.groups(docs).collect()}
    assert got == jaccard_groups(texts) and 20 < len(set(got.values())) < 200


def test_six_thousand_pages_of_a_template_make_no_pairs(spark):
    r = random.Random(5)
    template = [f"t{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(template + [f"w{r.randrange(10**7)}" for _ in range(35)])) for i in range(6000)], "doc_id long, text string")
    probes = near_copies.cells(docs, near_copies.rarity(near_copies.sketches(docs)))
    indexed = probes.where("pos < n - (8 * n + 8) div 9 + 1").count()
    assert probes.count() > 40_000 and indexed < 6000
    assert near_copies.first_of_each(docs).count() == 6000


def test_near_copies_take_the_links_of_simhash_first(spark, monkeypatch):
    """Few edits are found by fingerprints and checked, whatever the prefix filter does; fingerprints alone link nothing."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    texts = {i: " ".join([*base[:-1], f"x{i}"] if i else base) for i in range(6)} | {10: "a b c", 11: "d e f"}
    tried = []
    real = near_copies.close
    monkeypatch.setattr(near_copies, "close", lambda fps: tried.append(real(fps)) or tried[-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = []
    similar = near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, sets: kept.append(pairs.count()) or similar(pairs, sets))
    assert {x.doc_id: x.component_id for x in near_copies.groups(docs).collect()} == jaccard_groups(texts) | {10: 10, 11: 11}
    assert tried[0].count() >= 5 and kept[0] >= 5 and not any(kept[1:])


def test_parities_rule_out_pairs_but_no_similar_one(spark):
    """Sets are made for pairs only that parities leave; 300 words of which 10 or 200 differ, in repeated rows too."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    change = lambda n: " ".join(f"x{r.random()}" if i < n else w for i, w in enumerate(base))
    rows = [(0, " ".join(base)), (0, " ".join(base)), (1, change(10)), (1, change(10)), (2, change(200)), (3, ""), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = near_copies.sketches(docs).where("sid IS NOT NULL")
    about = made.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("parity").alias("parity"))
    sids = [x.sid for x in about.collect()]
    pairs = spark.createDataFrame([(a, b) for a in sids for b in sids if a < b], "a long, b long")
    sets = near_copies.Sets(docs, about)
    left = {(x.a, x.b) for x in near_copies.possible(pairs, about).collect()}
    got = {(x.a, x.b) for x in near_copies.similar(pairs, sets).collect()}
    shingles = {x.sid: set(x.s) for x in near_copies.sets_of(docs).collect()}
    want = {(a, b) for a in sids for b in sids if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    assert got == want and len(got) == 3 and got <= left and len(left) < 6
