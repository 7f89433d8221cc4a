"""Queries over light-curve files: the events as files of every format, read back, with SQL over the events themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import periodograms
from ..sources import datasource, readers, writers
from ..streaming import resumable
from .series_queries import LC, rounded
from .series_queries import Q as SERIES
from .tables import events

Q: dict[str, tuple] = {}

ROWS = f"{LC} SELECT {{key}} AS objectid, round(t, 6) AS t, round(m, 6) AS m, round(e, 6) AS e FROM lc"


def _read(fmt: str, pack: str = "", where: str | None = None, named: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        lc = events(s, d)
        lc = lc.withColumn("objectid", F.format_string(named, "objectid")) if named else lc
        return rounded(readers.parsed(writers.encode(lc, fmt, pack=pack), fmt, where=where).select("objectid", "t", "m", "e"))

    return run


Q["read_text"] = (_read("hp-txt", ".gz", named="HAT-123-%07d"), ROWS.format(key="format('HAT-123-{:07d}', objectid)"))
for _name, _fmt, _pack in (("read_csv", "hat-csv", ".gz"), ("read_lcc_csv", "lcc-csv", ""), ("read_k2_csv", "k2-csv", ".bz2"), ("read_kepler_fits", "kep-fits", ""), ("read_tess_fits", "tess-fits", ".gz"), ("read_k2sff", "k2sff-fits", "")):
    Q[_name] = (_read(_fmt, _pack), ROWS.format(key="objectid::VARCHAR"))
Q["read_sqlite"] = (_read("hat-sql", ".gz"), ROWS.format(key="objectid::VARCHAR"))
Q["read_sqlite_filtered"] = (_read("hat-sql", where="stf > 100 and (rjd < 60320.0 or aep_000 > 50.0)"), ROWS.format(key="objectid::VARCHAR") + " WHERE seq > 100 AND (t < 60320.0 OR m > 50.0)")


def fits_headers(s: SparkSession, d: str) -> DataFrame:
    found = readers.headers(writers.encode(events(s, d), "kep-fits"), ["object", "quarter", "channel", "naxis2", "exposure"])
    return found.withColumn("file", F.regexp_extract("file", r"(\d+)_", 1))


Q["fits_headers"] = (fits_headers, f"{LC}, o AS (SELECT objectid::VARCHAR AS file, count(*) AS n FROM lc GROUP BY 1) SELECT file, 0 AS unit, 'OBJECT' AS key, file AS value, 'name' AS comment FROM o UNION ALL SELECT file, 0, 'QUARTER', '1', NULL FROM o UNION ALL SELECT file, 0, 'CHANNEL', '4', NULL FROM o UNION ALL SELECT file, 1, 'NAXIS2', n::VARCHAR, NULL FROM o UNION ALL SELECT file, 1, 'EXPOSURE', '0.02', 'days' FROM o")


def _quarters(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d).withColumn("quarter", F.floor((F.col("t") - 60310.0) / 10).cast("int"))
    return readers.parsed(writers.encode(lc, "kep-fits", ["quarter"]), "kep-fits")


Q["consolidate"] = (
    lambda s, d: rounded(readers.consolidated(_quarters(s, d)).select("objectid", "lcn", "seq", "t", "m", "e"), m=9, e=12),
    f"{LC}, q AS (SELECT *, floor((t - 60310.0) / 10)::INT AS quarter FROM lc), n AS (SELECT *, median(m) OVER (PARTITION BY objectid, quarter) AS med FROM q) SELECT objectid::VARCHAR AS objectid, (dense_rank() OVER (PARTITION BY objectid ORDER BY quarter) - 1)::INT AS lcn, row_number() OVER (PARTITION BY objectid ORDER BY t, quarter, seq) - 1 AS seq, round(t, 6) AS t, round(m / nullif(med, 0), 9) AS m, round(e / nullif(med, 0), 12) AS e FROM n",
)
Q["describe_files"] = (
    lambda s, d: rounded(readers.describe(_quarters(s, d))),
    f"{LC} SELECT objectid::VARCHAR AS objectid, count(*) AS ndet, round(min(t), 6) AS mintime, round(max(t), 6) AS maxtime, count(DISTINCT floor((t - 60310.0) / 10)) AS files, 'cadenceno' AS columns FROM lc GROUP BY 1",
)


def merged_apertures(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    of = lambda x: readers.parsed(writers.encode(x, "hp-txt"), "hp-txt")
    some = lc.where("seq % 3 <> 0").withColumns({"m": F.col("m") * 2, "e": F.col("e") * 2})
    got = readers.merged_apertures({"1": of(lc.where("seq % 5 <> 0")), "2": of(some)})
    return rounded(got.select("objectid", "frk", "t", "m_1", "m_2"))


Q["merged_apertures"] = (merged_apertures, f"{LC} SELECT objectid::VARCHAR AS objectid, '1-' || seq || '_5' AS frk, round(t, 6) AS t, round(CASE WHEN seq % 5 <> 0 THEN m END, 6) AS m_1, round(CASE WHEN seq % 3 <> 0 THEN 2 * m END, 6) AS m_2 FROM lc WHERE seq % 5 <> 0 OR seq % 3 <> 0")


def document_pictures(s: SparkSession, d: str) -> DataFrame:
    """Pictures in documents: binary to base64 and back."""
    docs = events(s, d).groupBy("objectid").agg(F.min("seq").alias("seq")).withColumn("picture", F.encode(F.concat(F.lit("png-"), F.col("seq").cast("string")), "UTF-8"))
    text = writers.documents_to_base64(docs, "picture").withColumn("base64", F.col("picture"))
    return writers.base64_to_binary(text, "picture").select("objectid", "base64", F.decode("picture", "UTF-8").alias("picture"))


Q["document_pictures"] = (document_pictures, f"{LC} SELECT objectid, base64(encode('png-' || min(seq))) AS base64, 'png-' || min(seq) AS picture FROM lc GROUP BY 1")


def folder(s: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; on one machine, where that is unset, under the temporary one."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    if not shared and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='lumenframe-')}/{name}-{uuid.uuid4().hex}"


def _scanned(layout: str, columns: dict[str, str], name: str, where: str) -> Callable[[SparkSession, str], DataFrame]:
    """The events as files in a folder, read by the data source: only ``columns``, and rows and files by a pushed filter."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s, layout)
        writers.store(writers.encode(events(s, d), layout), path)
        t, m, e = columns
        found = datasource.scan(s, path, layout, dict(columns), name).where(where)
        return rounded(found.select("objectid", F.col(t).alias("t"), F.col(m).alias("m"), F.col(e).alias("e")))

    return run


Q["scan_sqlite_pushed"] = (_scanned("hat-sql", {"rjd": "double", "aep_000": "double", "aie_000": "double"}, r"^(\d+)-hatlc", "rjd < 60320.0 AND aep_000 > 50.0 AND objectid IN ('1', '3', '7', '40', '149')"), ROWS.format(key="objectid::VARCHAR") + " WHERE t < 60320.0 AND m > 50.0 AND objectid IN (1, 3, 7, 40, 149)")
Q["scan_csv_pushed"] = (_scanned("hat-csv", {"rjd": "double", "aep_000": "double", "aie_000": "double"}, r"^(\d+)-hatlc", "rjd >= 60325.0 AND aep_000 <= 200.0"), ROWS.format(key="objectid::VARCHAR") + " WHERE t >= 60325.0 AND m <= 200.0")
Q["scan_fits_pushed"] = (_scanned("kep-fits", {"time": "double", "sap_flux": "double", "sap_flux_err": "double"}, r"^kplr(\d+)_llc", "time > 60330.5 AND objectid LIKE '1%'"), ROWS.format(key="objectid::VARCHAR") + " WHERE t > 60330.5 AND objectid::VARCHAR LIKE '1%'")


def resumable_periods(s: SparkSession, d: str) -> DataFrame:
    """find_periods over the events as files by third of the time, one file a batch: each object comes three times, twice late."""
    periodograms.register_method("pdm5", periodograms.pdm_kernel(5, 5), "theta", False)
    source, results = folder(s, "events"), folder(s, "results")
    lc = events(s, d).select(F.col("objectid").cast("string"), "t", "m", "e", "seq", F.floor((F.col("t") - 60310.0) / 10).alias("third"))
    lc.repartition("third").drop("third").write.parquet(source)
    options = {"best": 3, "sigma": None}
    resumable.search_periods(s, source, results, ["gls", "pdm5"], files_a_batch=1, **options).awaitTermination()
    got = resumable.found_periods(s, results, ["gls", "pdm5"], **options)
    return rounded(got.select(F.col("objectid").cast("long"), F.when(F.col("method") == "pdm5", "pdm").otherwise(F.col("method")).alias("method"), "rank", "period", "score"), period=5, score=4)


Q["resumable_periods"] = (resumable_periods, SERIES["find_periods"][1])
