"""Light curves as files: one file for each object, encoded in tasks.

encode() makes (path, content) rows of a long table (objectid, t, m, e, seq), which readers.parsed() reads back and store()
puts on a file system. An object's points meet in one task, as its file does.
"""

from __future__ import annotations

import bz2
import gzip
import json
import sqlite3
import struct
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import TEXT_COLUMNS


def text_file(key: str, p: pd.DataFrame) -> bytes:
    """The whitespace text format; what a long table does not have is 0."""
    at = {c: i for i, c in enumerate(TEXT_COLUMNS)}
    lines = ["# " + " ".join(TEXT_COLUMNS)]
    for t, m, e, seq in zip(p["t"], p["m"], p["e"], p["seq"], strict=True):
        row = ["0"] * len(TEXT_COLUMNS)
        row[at["rjd"]], row[at["frk"]], row[at["hat"]], row[at["iep1"]], row[at["ire1"]] = repr(t), f"1-{seq}_5", key, repr(m), repr(e)
        lines.append(" ".join(row))
    return ("\n".join(lines) + "\n").encode()


def _csv(head: list[str], p: pd.DataFrame, sep: str = ",") -> bytes:
    return ("\n".join([*head, *[sep.join((repr(t), repr(m), repr(e), str(s))) for t, m, e, s in zip(p["t"], p["m"], p["e"], p["seq"], strict=True)]]) + "\n").encode()


def csv_file(key: str, p: pd.DataFrame) -> bytes:
    """The CSV format with a plain header."""
    return _csv([f"# objectid = {key}", "# columns = rjd,aep_000,aie_000,stf", "# LIGHTCURVE"], p)


def lcc_file(key: str, p: pd.DataFrame) -> bytes:
    """The CSV format with a JSON header."""
    names = ("rjd", "aep_000", "aie_000", "stf")
    columns = {c: {"colnum": i, "dtype": "f8" if i < 3 else "i8", "desc": c} for i, c in enumerate(names)}
    head = ["LCC-CSVLC-V1", "#", "# OBJECT METADATA", *[f"# {x}" for x in json.dumps({"objectid": {"val": key, "desc": "object"}}, indent=1).split("\n")], "# COLUMN DEFINITIONS", *[f"# {x}" for x in json.dumps(columns, indent=1).split("\n")], "# SEPARATOR=,", "# LIGHTCURVE"]
    return _csv(head, p)


def k2_file(key: str, p: pd.DataFrame) -> bytes:
    """The K2 CSV format: a header with numbered columns."""
    return _csv(["# OBJECT", "#", f"# objectid = {key}", "#", "# COLUMNS", "#", "# 00 - BJD", "# 01 - IM00", "# 02 - IE00", "# 03 - FRN", "#", "# LIGHTCURVE"], p)


def sqlite_file(key: str, p: pd.DataFrame) -> bytes:
    """The SQLite format: objectinfo, lcinfo and lightcurve."""
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
        db = sqlite3.connect(f.name)
        db.execute("CREATE TABLE objectinfo (objectid TEXT)")
        db.execute("INSERT INTO objectinfo VALUES (?)", (key,))
        db.execute("CREATE TABLE lcinfo (version INT, lccols TEXT, sortcol TEXT)")
        db.execute("INSERT INTO lcinfo VALUES (1, 'rjd,aep_000,aie_000,stf', 'rjd')")
        db.execute("CREATE TABLE lightcurve (rjd REAL, aep_000 REAL, aie_000 REAL, stf INT)")
        db.executemany("INSERT INTO lightcurve VALUES (?, ?, ?, ?)", zip(p["t"].tolist(), p["m"].tolist(), p["e"].tolist(), p["seq"].tolist(), strict=True))
        db.commit()
        db.close()
        f.seek(0)
        return f.read()


def _card(key: str, value: object, comment: str = "") -> bytes:
    v = f"'{value}'".ljust(20) if isinstance(value, str) else str(value).rjust(20)
    return (f"{key:<8}= {v}" + (f" / {comment}" if comment else "")).ljust(80)[:80].encode("ascii", "replace")


def _unit(cards: list[tuple], body: bytes = b"") -> bytes:
    head = b"".join(_card(*c) for c in cards) + b"END".ljust(80)
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def fits_file(columns: tuple[str, str, str], top: list[tuple] | None = None) -> Callable[[str, pd.DataFrame], bytes]:
    """A FITS format: a primary unit with the object's name and a binary table of ``columns`` and a cadence number."""

    def make(key: str, p: pd.DataFrame) -> bytes:
        body = b"".join(struct.pack(">dddi", *r) for r in zip(p["t"].tolist(), p["m"].tolist(), p["e"].tolist(), np.arange(len(p)).tolist(), strict=True))
        first = _unit([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("OBJECT", key, "name"), *(top or [])])
        names = [c.upper() for c in (*columns, "cadenceno")]
        table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 28), ("NAXIS2", len(p)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 4)]
        table += [x for i, (c, f) in enumerate(zip(names, "DDDJ", strict=True), 1) for x in ((f"TTYPE{i}", c), (f"TFORM{i}", f))]
        return first + _unit([*table, ("EXPOSURE", 0.02, "days")], body)

    return make


WRITERS: dict[str, tuple[str, Callable[[str, pd.DataFrame], bytes]]] = {
    "hp-txt": ("{0}.tfalc.TF1", text_file), "hat-csv": ("{0}-hatlc.csv", csv_file), "lcc-csv": ("{0}-csvlc", lcc_file), "k2-csv": ("{0}-k2lc.csv", k2_file), "hat-sql": ("{0}-hatlc.sqlite", sqlite_file),
    "kep-fits": ("kplr{0}_llc.fits", fits_file(("time", "sap_flux", "sap_flux_err"), [("QUARTER", 1), ("CHANNEL", 4)])), "tess-fits": ("tess{0}_lc.fits", fits_file(("time", "sap_flux", "sap_flux_err"), [("SECTOR", 1), ("CAMERA", 2)])),
    "k2sff-fits": ("hlsp_k2sff_{0}.fits", fits_file(("t", "fcor", "ferr"))),
}


def encode(lc: DataFrame, fmt: str, by: list[str] | None = None, pack: str = "") -> DataFrame:
    """(path, content): a file for each object, or for each object and value of ``by``; ``pack`` is "", ".gz" or ".bz2"."""
    name, make = WRITERS[fmt]
    keys = ["objectid", *(by or [])]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["t", "seq"], kind="stable")
        data = make(str(p["objectid"].iloc[0]), p)
        data = gzip.compress(data) if pack == ".gz" else bz2.compress(data) if pack == ".bz2" else data
        return pd.DataFrame({"path": [name.format("-".join(str(p[k].iloc[0]) for k in keys)) + pack], "content": [data]})

    return lc.select(*keys, "t", "m", "e", "seq").groupBy(*keys).applyInPandas(run, "path string, content binary")


def store(found: DataFrame, folder: str) -> None:
    """Writes files (path, content) into ``folder``, a URI that every executor can write. A rerun of a task writes the same."""

    def put(rows) -> None:  # noqa: ANN001
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for r in rows:
            with system.open_output_stream(f"{root}/{r['path']}", compression=None) as out:
                out.write(bytes(r["content"]))

    found.foreachPartition(put)


def documents_to_base64(documents: DataFrame, column: str) -> DataFrame:
    """A binary column as base64 text, as documents carry pictures."""
    return documents.withColumn(column, F.base64(column))


def base64_to_binary(documents: DataFrame, column: str) -> DataFrame:
    """The inverse of documents_to_base64()."""
    return documents.withColumn(column, F.unbase64(column))
