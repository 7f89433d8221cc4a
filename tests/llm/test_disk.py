"""What the pipeline's stages leave on disk: no second copy of texts that stay as they are, and no shuffle files."""

import gc
import os
import random
import time

from pyspark.sql import functions as F

from lumenframe.llm import quality_classifier, substring_dedup
from lumenframe.llm.common import CLEANUP, marked, materialise, shared_dir


def stored_texts(spark, before):
    """Rows with a text in the tables that are new in the shared folder."""
    top = shared_dir(spark).removeprefix("file://")
    tables = [spark.read.parquet(f"{top}/{x}") for x in set(os.listdir(top)) - before]
    return sum(t.where("text IS NOT NULL").count() for t in tables if "text" in t.columns)


def corpus(spark):
    r = random.Random(12)
    make = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = make(60)
    texts = {i: make(80) for i in range(40)} | {i: f"{make(20)} {passage} {make(20)}" for i in range(40, 44)}
    return passage, spark.createDataFrame([*texts.items(), (None, texts[41]), (3, None), (44, texts[0]), (44, "other"), (44, texts[0])], "doc_id long, text string")


def test_substring_dedup_stores_no_text_that_stays(spark):
    passage, docs = corpus(spark)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    got = substring_dedup.remove(docs)
    lost = got.where("n_removed > 0")
    assert {(r.doc_id, r.n_removed) for r in lost.collect()} == {(41, 60), (42, 60), (43, 60), (44, 80)} and lost.count() == 5
    assert not got.where("n_removed > 0 AND doc_id IS NULL").count() and got.count() == docs.count()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256)
    assert stored_texts(spark, before) <= 2 * 5
    assert sorted(map(key, got.collect())) == sorted(map(key, substring_dedup.remove(docs, carry=False).collect()))


def test_the_classifier_stores_no_texts(spark):
    _, docs = corpus(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(44)], "doc_id long, quality int, toxic int")
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    got = quality_classifier.accept(docs, labels)
    assert 0 < got.count() <= docs.count() and stored_texts(spark, before) == 0
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in quality_classifier.resample(docs, labels).where("kept").collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == kept


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(2)
    setting, before = spark.conf.get(CLEANUP, None), files()
    df = spark.range(100_000).groupBy(F.xxhash64("id").alias("k")).count()
    made = materialise(df, "counts")
    assert spark.conf.get(CLEANUP, "false") == (setting or "false")
    until = time.time() + 5
    while files() > before and time.time() < until:
        time.sleep(0.5)
    assert files() <= before and made.count() == df.count() == 100_000


def test_marks_lose_no_row(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "x"), (5, "other"), (7, None)], "a long, b string")
    ids = rows.where("a % 10 = 0 OR a IS NULL OR b IS NULL").select("a", "b")
    for bits in (1 << 22, 1 << 15, 8):
        there, rest = (set(map(tuple, marked(rows, ids, ["a", "b"], there=t, bits=bits).collect())) for t in (True, False))
        assert set(map(tuple, ids.collect())) <= there and not there & rest and len(there | rest) == 303
        assert bits < 1000 or len(there) < 40
    assert marked(rows, ids.limit(0), ["a", "b"]).count() == 0 and marked(rows, ids.limit(0), ["a", "b"], there=False).count() == 303
