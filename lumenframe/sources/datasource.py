"""Light-curve files as a Python Data Source: ``spark.read.format("lightcurves")``.

A partition is a file, or many small ones, read one after another. The schema that is asked for says which columns are read: a SQLite file is asked for these
alone, and text, CSV and FITS rows are cut down to them before they leave the parser. Filters that Spark pushes down
prune files, where they are on the object's id and the format's file names hold it, and rows: in SQLite by its own WHERE,
elsewhere before rows become Python objects for Spark. What a file can't decide as Spark would stays with Spark.

Files are listed once, on the driver, and read in the tasks, through Arrow's file systems (local, HDFS, object stores);
for others use readers.read(), which goes through Spark's own. Columns besides ``objectid`` and ``file`` have the names of
the file's columns. A value that is no finite number is null in a numeric column. Packed files are unpacked by their ending.
"""

from __future__ import annotations

import fnmatch
import json
import math
import operator
import os
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from . import readers

_COMPARE: dict[type, tuple[str, Callable[[object, object], bool]]] = {
    ds.EqualTo: ("=", operator.eq), ds.GreaterThan: (">", operator.gt), ds.GreaterThanOrEqual: (">=", operator.ge), ds.LessThan: ("<", operator.lt), ds.LessThanOrEqual: ("<=", operator.le),
}

#: Columns that are no columns of the file.
_OURS = ("objectid", "file")


#: Bytes of a partition's files, where there are several, what opening a file counts as, and partitions that are not made fewer.
PARTITION, OPENING, LEAST = 1 << 24, 1 << 18, 64


class Files(ds.InputPartition):
    """Some files."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _system(path: str):  # noqa: ANN202
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _listed(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, in order."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
    return sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob))


def _cast(kind: object, value: object) -> object:
    """A value of a file in a column's type; null where it has none there."""
    if value is None or isinstance(kind, StringType):
        return None if value is None else str(value)
    x = readers.number(value)
    if x is None or isinstance(kind, (DoubleType, FloatType)):
        return x
    return int(value) if isinstance(value, int) else math.trunc(x)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite(data: bytes, columns: list[str], where: list[tuple[str, str, object]]) -> tuple[str, Iterator[tuple]]:
    """(object, rows of ``columns``) of a SQLite light curve; columns that it lacks are null."""
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            db.row_factory = sqlite3.Row
            info = db.execute("SELECT sortcol FROM lcinfo ORDER BY version DESC LIMIT 1").fetchone()
            there = {r["name"] for r in db.execute("PRAGMA table_info(lightcurve)")}
            one = db.execute("SELECT * FROM objectinfo LIMIT 1").fetchone()
            key = next((one[k] for k in ("objectid", "hatid") if one and k in one.keys()), "unknown")  # noqa: SIM118
            if any(c not in there for c, _, _ in where):
                return str(key), iter(())
            asked = ", ".join(_quoted(c) if c in there else "NULL" for c in columns) or "NULL"
            test = " AND ".join(f"typeof({_quoted(c)}) IN ('integer', 'real') AND {_quoted(c)} {op} ?" for c, op, _ in where)
            rows = db.execute(f"SELECT {asked} FROM lightcurve" + (f" WHERE {test}" if test else "") + f" ORDER BY {_quoted(info['sortcol'])}", [v for _, _, v in where]).fetchall()
            return str(key), iter([tuple(r)[: len(columns)] for r in rows])
        finally:
            db.close()


class LightCurveReader(ds.DataSourceReader):
    """Reads the files of a folder; see the module."""

    def __init__(self, schema: StructType, path: str, fmt: readers.LightCurveFormat, id_in_name: str | None) -> None:
        self.schema, self.path, self.format, self.id_in_name = schema, path, fmt, id_in_name
        self.objects: list[Callable[[str], bool]] = []
        self.rows: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        kinds = {f.name: f.dataType for f in self.schema.fields}
        numeric = (DoubleType, LongType, IntegerType)
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "objectid" and isinstance(f, (ds.EqualTo, ds.In)):
                wanted = frozenset([f.value] if isinstance(f, ds.EqualTo) else f.value)
                self.objects.append(wanted.__contains__)
            elif name == "objectid" and isinstance(f, ds.StringStartsWith):
                self.objects.append(lambda key, start=f.value: key.startswith(start))
            elif name in kinds and name not in _OURS and isinstance(kinds[name], numeric) and type(f) in _COMPARE and isinstance(f.value, (int, float)) and math.isfinite(f.value):
                self.rows.append((name, type(f), f.value))
                # an integer column cuts values off before Spark compares them, so Spark compares again
                if not isinstance(kinds[name], DoubleType):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Files]:
        found = _listed(self.path, self.format.glob)
        if self.objects and self.id_in_name:
            named = re.compile(self.id_in_name)
            # a name without an id may be of any object
            keep = lambda p: not (m := named.search(os.path.basename(p))) or all(test(m[1]) for test in self.objects)
            found = [x for x in found if keep(x[0])]
        most = min(PARTITION, sum(size + OPENING for _, size in found) // LEAST)
        out, room = [Files([])], most
        for path, size in found:
            if out[-1].paths and room < size + OPENING:
                out.append(Files([]))
                room = most
            out[-1].paths.append(path)
            room -= size + OPENING
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._rows(path)

    def _rows(self, path: str) -> Iterator[tuple]:
        system, _ = _system(self.path)
        with system.open_input_stream(path, compression=None) as f:
            data = readers.unpacked(path, f.read())
        columns = [f.name for f in self.schema.fields if f.name not in _OURS]
        # compared as doubles both in files and in Spark; integer columns are left to Spark
        doubles = {f.name for f in self.schema.fields if isinstance(f.dataType, DoubleType)}
        tests = [(c, _COMPARE[kind], v) for c, kind, v in self.rows if c in doubles]
        if self.format.parser == "sqlite":
            key, rows = _sqlite(data, columns, [(c, op, v) for c, (op, _), v in tests])
        else:
            key, found = readers.PARSERS[self.format.parser](os.path.basename(path), data, **self.format.options)
            fits = lambda r: all((x := readers.number(r.get(c))) is not None and test(x, v) for c, (_, test), v in tests)
            rows = (tuple(r.get(c) for c in columns) for r in found if fits(r))
        if not all(test(key) for test in self.objects):
            return
        fixed = {"objectid": key, "file": path}
        places = [(f.name if f.name in _OURS else None, columns.index(f.name) if f.name in columns else -1, f.dataType) for f in self.schema.fields]
        for row in rows:
            yield tuple(fixed[ours] if ours else _cast(kind, row[at]) for ours, at, kind in places)


class LightCurveSource(ds.DataSource):
    """Options: path; layout, the name of a format of readers.FORMATS or its JSON; idInName, a pattern whose group is the id."""

    @classmethod
    def name(cls) -> str:
        return "lightcurves"

    def _format(self) -> readers.LightCurveFormat:
        layout = self.options.get("layout", "hat-sql")
        return readers.from_json(layout) if layout.lstrip().startswith("{") else readers.FORMATS[layout]

    def schema(self) -> str:
        t, m, e = self._format().columns[0]
        return f"objectid string, file string, `{t}` double, `{m}` double, `{e}` double"

    def reader(self, schema: StructType) -> LightCurveReader:
        return LightCurveReader(schema, self.options["path"], self._format(), self.options.get("idinname") or self.options.get("idInName"))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LightCurveSource)


def scan(spark: SparkSession, path: str, layout: str | readers.LightCurveFormat, columns: dict[str, str] | None = None, id_in_name: str | None = None) -> DataFrame:
    """The files under ``path`` with the id, the file and ``columns`` (name: type); by default time, magnitude and error."""
    register(spark)
    fmt = readers.FORMATS[layout] if isinstance(layout, str) else layout
    r = spark.read.format("lightcurves").option("layout", json.dumps(json.loads(readers.to_json(fmt))))
    if id_in_name:
        r = r.option("idInName", id_in_name)
    if columns is not None:
        r = r.schema("objectid string, file string" + "".join(f", `{c}` {k}" for c, k in columns.items()))
    return r.load(path)
