"""Batches that stop and go on, and the data source of light-curve files."""

import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import datasource, readers, writers
from lumenframe.streaming import resumable

DDL = "objectid string, t double, m double, e double, seq long"


def points(name, first=0, n=20):
    return [(name, 100.0 + 0.37 * i, 1.0 + (i % 7), 0.1, i) for i in range(first, first + n)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def counted(calls=None, fail=None):
    """Work that counts points, and may fail on an object."""

    def work(lc):
        out = lc.groupBy("objectid").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))
        names = [r[0] for r in out.select("objectid").collect()]
        if fail in names:
            raise RuntimeError("stopped")
        if calls is not None:
            calls.update(names)
        return out

    return work


def test_a_search_that_stops_goes_on_without_loss_or_repeats(spark, tmp_path):
    src, res = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        put(spark, src, points(f"a{k}") + points(f"b{k}", n=15))
    run = lambda work: resumable.start(spark, src, res, "count", {"p": 1}, work, schema=DDL, files_a_batch=1)
    calls = Counter()
    with pytest.raises(Exception, match="stopped"):
        run(counted(calls, fail="b2")).awaitTermination()
    done = {r.objectid for r in resumable.current(spark, res, "count", {"p": 1}).collect()}
    assert 0 < len(done) < 8 and "b2" not in done
    run(counted(calls)).awaitTermination()
    got = {(r.objectid, r.n, r.total) for r in resumable.current(spark, res, "count", {"p": 1}).collect()}
    assert got == {(f"a{k}", 20, 190) for k in range(4)} | {(f"b{k}", 15, 105) for k in range(4)}
    assert set(calls.values()) == {1}
    assert sum(r.objects for r in resumable.progress(spark, res, "count", {"p": 1}).collect()) == 8


def test_a_batch_that_was_written_but_not_committed_is_written_over(spark, tmp_path):
    src, res = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, points("a"))
    run = lambda: resumable.start(spark, src, res, "count", {}, counted(), schema=DDL).awaitTermination()
    run()
    key = resumable.key_of("count", {})
    (commit,) = (tmp_path / "out" / key / "checkpoint" / "commits").glob("[0-9]*")
    commit.unlink()
    for crc in (tmp_path / "out" / key / "checkpoint" / "commits").glob(".*"):
        crc.unlink()
    run()
    assert [(r.objectid, r.n) for r in resumable.current(spark, res, "count", {}).collect()] == [("a", 20)]


def test_late_and_repeated_files(spark, tmp_path):
    src, res = str(tmp_path / "in"), str(tmp_path / "out")
    calls = Counter()
    run = lambda p=1: resumable.start(spark, src, res, "count", {"p": p}, counted(calls), schema=DDL).awaitTermination()
    state = lambda p=1: {(r.objectid, r.n, r.batch) for r in resumable.current(spark, res, "count", {"p": p}).collect()}
    put(spark, src, points("a") + points("b"))
    run()
    put(spark, src, points("a", 20, 5))  # late points of a
    run()
    assert state() == {("a", 25, 1), ("b", 20, 0)} and calls == {"a": 2, "b": 1}
    put(spark, src, points("b"))  # the same points again
    run()
    run()
    assert state() == {("a", 25, 1), ("b", 20, 0)} and calls == {"a": 2, "b": 1}
    run(2)  # other parameters start at the first file
    assert {x[:2] for x in state(2)} == {("a", 25), ("b", 20)} and calls == {"a": 3, "b": 2}


def test_period_search_over_files_of_a_format(spark, tmp_path):
    import math

    rows = [(f"{k}", 0.21 * i + 0.01 * (i * i % 7), 10 + math.sin(2 * math.pi * (0.21 * i + 0.01 * (i * i % 7)) / (2.0 + k)), 0.01, i) for k in range(3) for i in range(80)]
    folder, res = tmp_path / "files", str(tmp_path / "out")
    writers.store(writers.encode(spark.createDataFrame(rows, DDL), "hat-csv", pack=".gz"), f"file://{folder}")
    options = {"best": 1, "sigma": None}
    resumable.search_periods(spark, f"file://{folder}", res, ["gls", "pdm"], "hat-csv", files_a_batch=2, **options).awaitTermination()
    got = {(r.objectid, r.method): r.period for r in resumable.found_periods(spark, res, ["gls", "pdm"], **options).collect()}
    assert len(got) == 6 and all(got[str(k), "gls"] == pytest.approx(2.0 + k, rel=0.02) for k in range(3))


# ------------------------------------------------------------------------------------------------------ the data source

COLUMNS = {"rjd": "double", "aep_000": "double", "stf": "int"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("lc")
    lc = spark.createDataFrame([r for k in range(6) for r in points(f"{k}", n=10 + k)], DDL)
    writers.store(writers.encode(lc, "hat-sql", pack=".gz"), f"file://{out}")
    (out / "notes.txt").write_text("no light curve")
    return f"file://{out}"


def test_filters_and_columns_reach_the_files(spark, folder, capsys):
    every = datasource.scan(spark, folder, "hat-sql", COLUMNS, r"^(\d+)-hatlc")
    assert every.rdd.getNumPartitions() == 6 and every.count() == sum(10 + k for k in range(6))
    some = every.where("objectid IN ('2', '5') AND rjd > 101.0 AND stf < 9")
    assert some.rdd.getNumPartitions() == 2
    want = {(str(k), 100.0 + 0.37 * i, i) for k in (2, 5) for i in range(9) if 100.0 + 0.37 * i > 101.0}
    assert {(r.objectid, r.rjd, r.stf) for r in some.collect()} == want
    capsys.readouterr()
    some.explain()
    plan = capsys.readouterr().out
    test = plan[plan.index("Filter") : plan.index("BatchScan")]
    # the comparison of rjd and the ids are done in the source; the one of a whole number is done there and again here
    assert "101.0" not in test and " IN " not in test and "stf" in test
    assert datasource.scan(spark, folder, "hat-sql", {"aep_000": "double"}).columns == ["objectid", "file", "aep_000"]


def test_only_the_asked_columns_are_read_from_sqlite(folder, monkeypatch):
    asked = []
    connect = sqlite3.connect

    def watched(*a, **b):
        db = connect(*a, **b)
        db.set_trace_callback(asked.append)
        return db

    monkeypatch.setattr(datasource.sqlite3, "connect", watched)
    from pyspark.sql.datasource import GreaterThan, In
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([StructField("objectid", StringType()), StructField("rjd", DoubleType()), StructField("absent", DoubleType())])
    r = datasource.LightCurveReader(schema, folder, readers.FORMATS["hat-sql"], r"^(\d+)-hatlc")
    left = list(r.pushFilters([GreaterThan(("rjd",), 102.0), In(("objectid",), ("4",))]))
    (part,) = r.partitions()
    rows = list(r.read(part))
    assert left == [] and [x[0] for x in rows] == ["4"] * 8 and all(x[1] > 102.0 and x[2] is None for x in rows)
    (select,) = [x for x in asked if "FROM lightcurve" in x]
    assert "aep_000" not in select and '"rjd" >' in select


def test_files_without_rows_or_with_odd_values(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x-hatlc.sqlite")
    db.executescript("CREATE TABLE objectinfo (objectid TEXT); INSERT INTO objectinfo VALUES ('x'); CREATE TABLE lcinfo (version INT, lccols TEXT, sortcol TEXT); INSERT INTO lcinfo VALUES (1, 'rjd,aep_000', 'rjd'); CREATE TABLE lightcurve (rjd REAL, aep_000 REAL, \"odd name\" TEXT); INSERT INTO lightcurve VALUES (2.0, NULL, 'b'), (1.0, 'nan', 'a'), (NULL, 5.0, 'c');")
    db.close()
    path = f"file://{tmp_path}"
    got = datasource.scan(spark, path, "hat-sql", {"rjd": "double", "aep_000": "double", "odd name": "string"}).collect()
    assert [(r.objectid, r.rjd, r.aep_000, r["odd name"]) for r in got] == [("x", None, 5.0, "c"), ("x", 1.0, None, "a"), ("x", 2.0, None, "b")]
    assert datasource.scan(spark, path, "hat-sql", {"rjd": "double"}).where("rjd >= 1.5").count() == 1
    assert datasource.scan(spark, path, "kep-fits").count() == 0


HAND_WRITTEN = {
    "lcc-csv": ("x-csvlc", 'LCC-CSVLC-V1\n#\n# OBJECT METADATA\n# {"objectid": {"val": "HAT-1", "desc": "id"}}\n# COLUMN DEFINITIONS\n# {"rjd": {"colnum": 0}, "aep_000": {"colnum": 2}, "aie_000": {"colnum": 1}}\n# LIGHTCURVE\n1.5,0.1,10.25\n2.5,0.2,nan\n', [("HAT-1", 1.5, 10.25), ("HAT-1", 2.5, None)]),
    "k2-csv": ("x-k2lc.csv", "# objectid = EPIC-7\n# 00 BJD\n# 01 IM00\n# 02 IE00\n# LIGHTCURVE\n1.25,9.5,0.01\n,9.75,0.01\n", [("EPIC-7", 1.25, 9.5), ("EPIC-7", None, 9.75)]),
}


@pytest.mark.parametrize("layout", sorted(HAND_WRITTEN))
def test_samples_written_by_hand(spark, tmp_path, layout):
    name, text, want = HAND_WRITTEN[layout]
    (tmp_path / name).write_text(text)
    t, m, _ = readers.FORMATS[layout].columns[0]
    got = datasource.scan(spark, f"file://{tmp_path}", layout).collect()
    assert [(r.objectid, r[t], r[m]) for r in got] == want
    assert [(r.objectid, r.t, r.m) for r in readers.read(spark, f"file://{tmp_path}", layout).orderBy("seq").collect()] == want
