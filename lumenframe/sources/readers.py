"""Light-curve files as long tables: one row is one observation, with the object and the file it came from.

Files are listed and read by Spark (any file system it knows), one file at a time; pickles are never loaded, Parquet
takes their place.
"""

from __future__ import annotations

import bz2
import gzip
import json
import os
import re
import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import checked_filter

LONG = "objectid string, file string, seq long, t double, m double, e double, ext map<string,string>"

#: Columns of the whitespace text format, in order; a trend-filtered magnitude may follow.
TEXT_COLUMNS = "rjd frk hat xcc ycc xic yic fsv fdv fkv bgv bge ifl1 ife1 irm1 ire1 irq1 ifl2 ife2 irm2 ire2 irq2 ifl3 ife3 irm3 ire3 irq3 iep1 iep2 iep3".split()


def unpacked(name: str, data: bytes) -> bytes:
    """The bytes of a file, gzip and bzip2 undone by the name's ending."""
    return gzip.decompress(data) if name.endswith(".gz") else bz2.decompress(data) if name.endswith(".bz2") else data


def number(text: object) -> float | None:
    """A finite number, or None."""
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if x == x and abs(x) != float("inf") else None


def parse_text(name: str, data: bytes) -> tuple[str, list[dict]]:
    """Whitespace text: comment lines have a hash; the id is in the file's name or the third column."""
    rows = [x.split() for x in data.decode("utf-8", "replace").split("\n") if x.strip() and "#" not in x]
    out = []
    for r in rows:
        cols = [*TEXT_COLUMNS, *[f"itf{i}" for i in range(1, len(r) - len(TEXT_COLUMNS) + 1)]]
        d = dict(zip(cols, r, strict=False))
        if m := re.match(r"(\w+)-(\d+)(\w?)_(\d+)", d.get("frk", "")):
            d |= {"stf": m[1], "cfn": m[2], "cfs": m[3], "ccd": m[4]}
        out.append(d)
    found = re.search(r"HAT-\d{3}-\d{7}", name)
    return (found[0] if found else out[0].get("hat", "unknown") if out else "unknown"), out


def parse_csv(name: str, data: bytes) -> tuple[str, list[dict]]:
    """CSV with a ``#`` header that ends with the line LIGHTCURVE; both the plain and the JSON header."""
    lines = data.decode("utf-8", "replace").split("\n")
    mark = lines[1].strip() if lines[0].startswith("LCC-CSVLC") and len(lines) > 1 else "#"
    start = next((i for i, x in enumerate(lines) if x.strip() == f"{mark} LIGHTCURVE"), None)
    if start is None:
        raise ValueError(f"{name}: no light curve")
    header = [x[len(mark) :].strip() for x in lines[:start] if x.startswith(mark)]
    body = [x for x in lines[start + 1 :] if x.strip()]
    if mark != "#" or lines[0].startswith("LCC-CSVLC"):
        blocks = [json.loads(b) for b in re.findall(r"\{.*?\}(?=\s*\n[A-Z]|\s*$)", "\n".join(header), re.S)]
        meta, columns = blocks[0], blocks[1]
        sep = next((x.split("=", 1)[1].strip() for x in header if x.startswith("SEPARATOR")), ",")
        names = {v["colnum"]: k for k, v in columns.items()}
        return str(meta.get("objectid", {}).get("val", "unknown")), [{names[i]: v.strip() for i, v in enumerate(x.split(sep)) if i in names} for x in body]
    meta = dict(x.split(" = ", 1) for x in header if " = " in x)
    cols = [m[1] for x in header if (m := re.match(r"\d+\s*-?\s*(\w+)", x))] or [c.strip() for c in meta.get("columns", "").split(",") if c.strip()]
    return meta.get("objectid", meta.get("hatid", "unknown")), [dict(zip(cols, (v.strip() for v in x.split(",")), strict=False)) for x in body]


def parse_sqlite(name: str, data: bytes, where: str | None = None) -> tuple[str, list[dict]]:
    """SQLite light curve: column list and sort column from lcinfo, rows from lightcurve that pass an allowed filter."""
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            db.row_factory = sqlite3.Row
            info = db.execute("SELECT * FROM lcinfo ORDER BY version DESC LIMIT 1").fetchone()
            cols = json.loads(info["lccols"]) if info["lccols"].startswith("[") else [c.strip() for c in info["lccols"].split(",")]
            word = re.compile(r"^\w+$")
            if not all(word.match(c) for c in [*cols, info["sortcol"]]):
                raise ValueError(f"{name}: odd column names")
            ok = checked_filter(where, cols) if where else None
            if where and ok is None:
                raise ValueError(f"not an allowed filter: {where!r}")
            rows = db.execute(f"SELECT {', '.join(cols)} FROM lightcurve" + (f" WHERE {ok}" if ok else "") + f" ORDER BY {info['sortcol']}").fetchall()
            one = db.execute("SELECT * FROM objectinfo LIMIT 1").fetchone()
            key = next((one[k] for k in ("objectid", "hatid") if one and k in one.keys()), "unknown")  # noqa: SIM118
            return str(key), [{k: r[k] for k in r.keys()} for r in rows]  # noqa: SIM118
        finally:
            db.close()


_FITS = {"D": "d", "E": "f", "J": "i", "I": "h", "K": "q", "B": "B"}


def fits_units(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, data) of every unit of a FITS file; a card's comment is under its key and " /"."""
    at = 0
    while at + 2880 <= len(data):
        header: dict[str, str] = {}
        done = False
        while not done and at + 2880 <= len(data):
            for i in range(at, at + 2880, 80):
                card = data[i : i + 80].decode("ascii", "replace")
                if card.startswith("END") and not card[3:].strip():
                    done = True
                    break
                if card[8:10] == "= ":
                    v = card[10:].strip()
                    m = re.match(r"('(?:[^']|'')*'|[^/]*)(?:/(.*))?$", v)
                    key, value = card[:8].strip(), m[1].strip()
                    header[key] = value[1:-1].replace("''", "'").rstrip() if value.startswith("'") else value
                    if m[2]:
                        header[f"{key} /"] = m[2].strip()
            at += 2880
        axes = [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]
        n = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1))
        size = 0
        if axes:
            size = n * int(header.get("PCOUNT", 0))
            total = n
            for a in axes:
                total *= a
            size += total
        yield header, data[at : at + size]
        at += -(-size // 2880) * 2880


def parse_fits(name: str, data: bytes) -> tuple[str, list[dict]]:
    """First binary table of a FITS light curve; scalar numeric columns in lower case."""
    key, rows = "unknown", []
    for header, body in fits_units(data):
        key = header.get("OBJECT", header.get("TICID", header.get("KEPLERID", key))) if key == "unknown" else key
        if header.get("XTENSION") != "BINTABLE" or rows:
            continue
        width, n, at, cols = int(header["NAXIS1"]), int(header["NAXIS2"]), 0, []
        for i in range(1, int(header["TFIELDS"]) + 1):
            m = re.match(r"(\d*)([A-Z])", header[f"TFORM{i}"])
            count, kind = int(m[1] or 1), m[2]
            if kind in _FITS and count == 1:
                cols.append((header.get(f"TTYPE{i}", f"col{i}").lower(), at, ">" + _FITS[kind]))
            at += count * {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}[kind]
        rows = [{c: struct.unpack_from(f, body, r * width + o)[0] for c, o, f in cols} for r in range(n)]
    return key, rows


@dataclass
class LightCurveFormat:
    """How files of a format are found and read, and which columns are time, magnitude and error."""

    name: str
    glob: str
    parser: str
    columns: list[tuple[str, str, str]]
    is_flux: bool = False
    options: dict[str, str] = field(default_factory=dict)


PARSERS: dict[str, Callable[..., tuple[str, list[dict]]]] = {"text": parse_text, "csv": parse_csv, "sqlite": parse_sqlite, "fits": parse_fits}

FORMATS: dict[str, LightCurveFormat] = {
    f.name: f
    for f in (
        LightCurveFormat("hat-sql", "*-hatlc.sqlite*", "sqlite", [("rjd", "aep_000", "aie_000"), ("rjd", "atf_000", "aie_000")]),
        LightCurveFormat("hat-csv", "*-hatlc.csv*", "csv", [("rjd", "aep_000", "aie_000"), ("rjd", "atf_000", "aie_000")]),
        LightCurveFormat("hp-txt", "HAT-*tfalc.TF1*", "text", [("rjd", "iep1", "ire1"), ("rjd", "itf1", "ire1")]),
        LightCurveFormat("lcc-csv", "*-csvlc*", "csv", [("rjd", "aep_000", "aie_000"), ("rjd", "atf_000", "aie_000")]),
        LightCurveFormat("k2-csv", "*-k2lc.csv*", "csv", [("BJD", "IM00", "IE00"), ("BJD", "CF00", "IE00"), ("BJD", "TF00", "IE00")]),
        LightCurveFormat("hat-old", "*.hatlc*", "text", [("rjd", "iep1", "ire1")]),
        LightCurveFormat("hat-epd", "*.epdlc*", "text", [("rjd", "iep1", "ire1")]),
        LightCurveFormat("k2sff-fits", "hlsp_k2sff_*.fits", "fits", [("t", "fcor", "ferr"), ("t", "fraw", "ferr")], is_flux=True),
        LightCurveFormat("kep-fits", "*_llc.fits", "fits", [("time", "sap_flux", "sap_flux_err"), ("time", "pdcsap_flux", "pdcsap_flux_err")], is_flux=True),
        LightCurveFormat("tess-fits", "*_lc.fits", "fits", [("time", "sap_flux", "sap_flux_err"), ("time", "pdcsap_flux", "pdcsap_flux_err")], is_flux=True),
    )
}


def register(fmt: LightCurveFormat, replace: bool = False) -> None:
    """Adds a format; the parser must be one of PARSERS."""
    if fmt.parser not in PARSERS:
        raise ValueError(f"no parser {fmt.parser!r}")
    if fmt.name in FORMATS and not replace:
        raise ValueError(f"{fmt.name!r} is there already")
    FORMATS[fmt.name] = fmt


def to_json(fmt: LightCurveFormat) -> str:
    return json.dumps(asdict(fmt), indent=1)


def from_json(text: str) -> LightCurveFormat:
    d = json.loads(text)
    return LightCurveFormat(**d | {"columns": [tuple(c) for c in d["columns"]]})


def files(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(path, content) of the files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def parsed(found: DataFrame, fmt: str | LightCurveFormat, columns: tuple[str, str, str] | None = None, where: str | None = None) -> DataFrame:
    """Files (path, content) as a long table (objectid, file, seq, t, m, e, ext); other columns are in ``ext`` as text."""
    f = FORMATS[fmt] if isinstance(fmt, str) else fmt
    tc, mc, ec = columns or f.columns[0]
    parser = PARSERS[f.parser]
    options = dict(f.options) | ({"where": where} if where else {})

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                key, rows = parser(os.path.basename(name), unpacked(name, bytes(data)), **options)
                yield pd.DataFrame({
                    "objectid": [key] * len(rows), "file": [name] * len(rows), "seq": range(len(rows)), "t": [number(r.get(tc)) for r in rows], "m": [number(r.get(mc)) for r in rows], "e": [number(r.get(ec)) for r in rows],
                    "ext": [{k: str(v) for k, v in r.items() if k not in (tc, mc, ec) and v is not None} for r in rows],
                })

    return found.mapInPandas(each, LONG)


def read(spark: SparkSession, path: str, fmt: str | LightCurveFormat, columns: tuple[str, str, str] | None = None, recursive: bool = True, where: str | None = None) -> DataFrame:
    """Files under ``path`` as a long table: files() and parsed()."""
    f = FORMATS[fmt] if isinstance(fmt, str) else fmt
    return parsed(files(spark, path, f.glob, recursive), f, columns, where)


def headers(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(file, unit, key, value, comment) of the header cards of FITS files (path, content): all, or those named."""
    wanted = {k.upper() for k in keys} if keys else None

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                rows = [(name, unit, k, v, header.get(f"{k} /")) for unit, (header, _) in enumerate(fits_units(unpacked(name, bytes(data)))) for k, v in header.items() if not k.endswith(" /") and (wanted is None or k in wanted)]
                yield pd.DataFrame(rows, columns=["file", "unit", "key", "value", "comment"])

    return found.mapInPandas(each, "file string, unit int, key string, value string, comment string")


def consolidated(lc: DataFrame, normalize: bool = True) -> DataFrame:
    """The files of each object (quarters, sectors) as one series in order of time, times that are missing last.

    Adds ``lcn``, the number of the file in order of its first time. With ``normalize`` values and errors are divided by the
    file's median, where that is not zero.
    """
    by_file = Window.partitionBy("objectid", "file")
    c = lc.withColumns({"_first": F.min("t").over(by_file), "_med": F.median("m").over(by_file)})
    c = c.withColumn("lcn", (F.dense_rank().over(Window.partitionBy("objectid").orderBy("_first", "file")) - 1).cast("int"))
    if normalize:
        c = c.withColumns({x: F.try_divide(x, F.when(F.col("_med") != 0, F.col("_med"))) for x in ("m", "e")})
    order = Window.partitionBy("objectid").orderBy(F.col("t").asc_nulls_last(), "lcn", "seq")
    return c.withColumn("seq", F.row_number().over(order).cast("long") - 1).drop("_first", "_med")


def merged_apertures(curves: dict[str, DataFrame], key: str = "frk") -> DataFrame:
    """(objectid, key, t, m_<aperture>, e_<aperture>): the series of several apertures side by side, a row for each frame.

    ``key`` is a column of ``ext`` that names the frame.
    """
    out = None
    for name, lc in curves.items():
        part = lc.select("objectid", F.col("ext")[key].alias(key), F.col("t").alias(f"t_{name}"), F.col("m").alias(f"m_{name}"), F.col("e").alias(f"e_{name}"))
        out = part if out is None else out.join(part, ["objectid", key], "full")
    return out.select("objectid", key, F.coalesce(*[f"t_{n}" for n in curves]).alias("t"), *[f"{c}_{n}" for n in curves for c in "me"])


def read_table(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """A downloaded model table in text."""
    return spark.read.schema(schema).option("sep", sep).option("comment", "#").option("ignoreLeadingWhiteSpace", "true").csv(path)


def catalog_header(text: str) -> dict:
    """The JSON in the comment lines at the top of an external catalog: its columns' keys, names, types and units."""
    head = []
    for line in text.split("\n"):
        if not line.startswith("#"):
            break
        head.append(line.replace("#", "").strip())
    if not head:
        raise ValueError("no catalog definition")
    return json.loads(" ".join(head))


_CATALOG_TYPES = {"f8": "double", "f4": "float", "i8": "long", "i4": "int"}


def catalog_columns(lines: DataFrame, header: dict, columns: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """``lines`` (value) of an external catalog as the named columns of its header, typed; comment lines are left out."""
    known = header["columns"]
    keys = [c["key"] for c in known]
    wanted = [c for c in columns or keys if c in keys]
    schema = ", ".join(f"`{c['key']}` {_CATALOG_TYPES.get(c['dtype'], 'string')}" for c in known)
    rows = lines.where("value NOT LIKE '#%' AND trim(value) <> ''").select(F.from_csv("value", schema, {"sep": sep or header.get("colsep", ",")}).alias("r"))
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in wanted])


def read_catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An external catalog in text, packed or not; only its first lines are read for the header."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.where("value LIKE '#%'").limit(1000).collect()]
    return catalog_columns(lines, catalog_header("\n".join(head)), columns)


def write(lc: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Sink: Parquet (or JSON, CSV without maps), repeated runs overwrite."""
    lc.write.mode("overwrite").format(fmt).save(path)


def from_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def describe(lc: DataFrame) -> DataFrame:
    """(objectid, ndet, mintime, maxtime, files, columns): what a collection holds."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("ext")))))
    return lc.groupBy("objectid").agg(F.count(F.lit(1)).alias("ndet"), F.min("t").alias("mintime"), F.max("t").alias("maxtime"), F.count_distinct("file").alias("files"), F.array_join(names, ",").alias("columns"))
