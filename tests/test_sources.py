"""Readers on small files written here, registry round trip, and streams."""

import gzip
import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from lumenframe import streaming
from lumenframe.sources import readers


def test_text(spark, tmp_path):
    line = "1.5 ab-12c_4 HAT-123-0000001 " + " ".join(["1"] * 12) + " 9.5 0.02 G 1 1 1 1 G 1 1 1 1 G 9.1 9.2 9.3 9.0"
    parts = line.split()
    assert len(parts) == 34 or parts
    cols = dict(zip([*readers.TEXT_COLUMNS, "itf1"], range(31), strict=True))
    row = [str(i) for i in range(31)]
    row[cols["frk"]], row[cols["hat"]] = "1-000123d_5", "HAT-123-0000001"
    (tmp_path / "HAT-123-0000001.tfalc.TF1.gz").write_bytes(gzip.compress(("# c\n" + " ".join(row) + "\n").encode()))
    r = readers.read(spark, str(tmp_path), "hp-txt").first()
    assert (r.objectid, r.t, r.m) == ("HAT-123-0000001", 0.0, 27.0)
    assert (r.ext["stf"], r.ext["cfn"], r.ext["ccd"]) == ("1", "000123", "5")


def test_csv(spark, tmp_path):
    (tmp_path / "x-hatlc.csv").write_text("# objectid = HAT-1\n# columns = rjd,aep_000,aie_000\n# LIGHTCURVE\n1.0,9.0,0.1\n2.0,nan,0.1\n")
    rows = readers.read(spark, str(tmp_path), "hat-csv").orderBy("seq").collect()
    assert [(r.objectid, r.t, r.m) for r in rows] == [("HAT-1", 1.0, 9.0), ("HAT-1", 2.0, None)]


def make_sqlite(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE objectinfo (objectid TEXT)")
    db.execute("INSERT INTO objectinfo VALUES ('HAT-7')")
    db.execute("CREATE TABLE lcinfo (version INT, lccols TEXT, sortcol TEXT)")
    db.execute("INSERT INTO lcinfo VALUES (2, 'rjd,aep_000,aie_000,stf', 'rjd')")
    db.execute("CREATE TABLE lightcurve (rjd REAL, aep_000 REAL, aie_000 REAL, stf INT)")
    db.executemany("INSERT INTO lightcurve VALUES (?, ?, ?, ?)", [(2.0, 9.5, 0.1, 5), (1.0, None, 0.1, 6)])
    db.commit()
    db.close()


def test_sqlite_with_a_filter(spark, tmp_path):
    make_sqlite(tmp_path / "a-hatlc.sqlite")
    rows = readers.read(spark, str(tmp_path), "hat-sql").orderBy("seq").collect()
    assert [(r.objectid, r.t, r.m) for r in rows] == [("HAT-7", 1.0, None), ("HAT-7", 2.0, 9.5)]
    assert readers.read(spark, str(tmp_path), "hat-sql", where="stf = 5").count() == 1


def test_sqlite_refuses_other_sql(tmp_path):
    make_sqlite(tmp_path / "a.sqlite")
    with pytest.raises(ValueError, match="not an allowed filter"):
        readers.parse_sqlite("a", (tmp_path / "a.sqlite").read_bytes(), "1 = 1; drop table lightcurve")


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80)


def fits_file(rows):
    head = "".join([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), f"{'OBJECT':<8}= 'TIC 5   '".ljust(80), "END".ljust(80)]).ljust(2880)
    cols = [("TIME", "D"), ("SAP_FLUX", "E"), ("SAP_FLUX_ERR", "E"), ("QUALITY", "J")]
    t = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 20), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 4)]
    for i, (n, f) in enumerate(cols, 1):
        t += [card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{f}'")]
    body = b"".join(struct.pack(">dffi", *r) for r in rows)
    return head.encode() + "".join([*t, "END".ljust(80)]).ljust(-(-80 * (len(t) + 1) // 2880) * 2880).encode() + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits(spark, tmp_path):
    (tmp_path / "k_llc.fits").write_bytes(fits_file([(1.5, 100.0, 1.0, 0), (2.5, float("nan"), 1.0, 8)]))
    rows = readers.read(spark, str(tmp_path), "kep-fits").orderBy("seq").collect()
    assert [(r.objectid, r.t, r.m, r.ext["quality"]) for r in rows] == [("TIC 5", 1.5, 100.0, "0"), ("TIC 5", 2.5, None, "8")]


def test_registry():
    f = readers.LightCurveFormat("own", "*.lc", "text", [("rjd", "iep1", "ire1")])
    assert readers.from_json(readers.to_json(f)) == f
    readers.register(f)
    with pytest.raises(ValueError, match="there already"):
        readers.register(f)
    del readers.FORMATS["own"]
    with pytest.raises(ValueError, match="no parser"):
        readers.register(readers.LightCurveFormat("own", "*", "pickle", []))


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-0{d} 0{h}:10:00", 1.0 * h) for d in (1, 9) for h in (1, 2)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "objectid string, ts string, m double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("objectid string, ts timestamp, m double").parquet(str(src))
    for i, (made, n) in enumerate(((streaming.live_time_bins(stream), 4), (streaming.live_timegroups(stream), 2))):
        q = made.writeStream.outputMode("complete").format("memory").queryName(f"live{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"live{i}").count() == n


def test_json_values_survive(spark):
    assert json.loads(readers.to_json(readers.FORMATS["kep-fits"]))["is_flux"] is True
