"""Object catalogs: building, filter and sort specifications, enrichment, colour-magnitude rows, documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simulate import uniform
from .series import KEY, finite

#: Words that a filter string may hold besides columns, numbers and quoted strings.
SQL_WORDS = {"and", "between", "in", "is", "isnull", "like", "not", "notnull", "null", "or", "=", "<", ">", "<=", ">=", "!=", "%", "(", ")", ","}

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[A-Za-z_][\w.]*|[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?|<=|>=|!=|[=<>%(),])")


def checked_filter(text: str, columns: list[str]) -> str | None:
    """The filter if it is made of allowed words, the columns, numbers and quoted strings; else None. Nothing is run."""
    at, out = 0, []
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        word = m[1]
        if re.match(r"[A-Za-z_]", word) and word.lower() not in SQL_WORDS and word not in columns:
            return None
        out.append(word)
        at = m.end()
    return " ".join(out) or None


def sql_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows that pass a filter string; a ValueError for one that is not allowed."""
    ok = checked_filter(text, df.columns)
    if ok is None:
        raise ValueError(f"not an allowed filter: {text!r}")
    return df.where(ok)


#: Operators of filter specifications ``column|operator|operand``.
OPERATORS = {
    "lt": lambda c, v: c < v, "gt": lambda c, v: c > v, "le": lambda c, v: c <= v, "ge": lambda c, v: c >= v, "eq": lambda c, v: c == v, "ne": lambda c, v: c != v,
    "ct": lambda c, v: c.contains(v), "isnull": lambda c, v: c.isNull(), "notnull": lambda c, v: c.isNotNull(),
    "cb": lambda c, v: (c > v[0]) & (c < v[1]), "ob": lambda c, v: (c < v[0]) | (c > v[1]),
}


def _operand(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def column_filter(spec: str) -> Column:
    """The predicate of ``column|operator|operand``; ranges (cb, ob) take ``low,high``. Operands are typed, never run."""
    name, op, *rest = spec.split("|")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator in {spec!r}")
    operand = [_operand(x) for x in rest[0].split(",")] if op in ("cb", "ob") else _operand(rest[0]) if rest else None
    return OPERATORS[op](F.col(name), operand)


def filter_catalog(catalog: DataFrame, specs: list[str]) -> DataFrame:
    """Rows that pass all specifications."""
    for s in specs:
        catalog = catalog.where(column_filter(s))
    return catalog


def sort_catalog(catalog: DataFrame, spec: str, tie: str = KEY) -> DataFrame:
    """``column|asc`` or ``column|desc``; missing values last, ties by ``tie``."""
    name, _, way = spec.partition("|")
    c = F.col(name)
    return catalog.orderBy(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last(), tie)


def sample_sort_limit(catalog: DataFrame, share_in: int, of: int, sort: str, limit: int, seed: int = 0) -> DataFrame:
    """A hash sample of ``share_in`` in ``of``, then sorted, then limited (in this order)."""
    return sort_catalog(catalog.where(uniform("sample", 0.0, 1.0, seed) * of < share_in), sort).limit(limit)


def build(lc: DataFrame, info: DataFrame, magcol: str = "m") -> DataFrame:
    """Catalog of objects with their counts of finite points; repeated ids get -2, -3 and so on."""
    n = lc.groupBy(KEY).agg(F.count_if(finite(magcol)).alias("ndet"), F.min("t").alias("mintime"), F.max("t").alias("maxtime"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("ra", "decl"))
    return info.withColumn("_r", rank).join(n, KEY, "left").withColumn("name", F.when(F.col("_r") > 1, F.concat(F.col(KEY).cast("string"), F.lit("-"), F.col("_r").cast("string"))).otherwise(F.col(KEY).cast("string"))).withColumn("ndet", F.coalesce("ndet", F.lit(0))).drop("_r")


def add_info(catalog: DataFrame, info: DataFrame, columns: list[str], order: list[str], key: str = KEY) -> DataFrame:
    """Left join of chosen columns; of several rows of an object the first by ``order`` counts."""
    first = info.groupBy(key).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_i"))
    return catalog.join(first, key, "left").select(*catalog.columns, *[F.col(f"_i.{c}").alias(c) for c in columns])


def get_path(df: DataFrame, path: str) -> Column:
    """A value by a dotted path; numbers index lists, and a miss is null."""
    at, *rest = path.split(".")
    out = F.col(at)
    for p in rest:
        out = F.try_element_at(out, F.lit(int(p) + 1)) if p.isdigit() else out[p]
    return out


def color_magnitude(catalog: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(objectid, color, x, y): colour and magnitude of each (mag1, mag2, y) where all are there."""
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("color"), (F.col(a) - F.col(b)).alias("x"), F.col(y).alias("y")) for a, b, y in pairs])
    return catalog.select(KEY, F.explode(rows).alias("c")).select(KEY, "c.*")


def assemble(info: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """A document for each object: its row, and for each part an array of the part's rows, sorted by the named columns.

    Arrays are bounded by what a part holds for one object.
    """
    out = info
    for name, (rows, order) in parts.items():
        cols = [*order, *[c for c in rows.columns if c not in (KEY, *order)]]
        out = out.join(rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name)), KEY, "left")
    return out


def update_documents(old: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Top-level fields of ``new`` replace those of ``old`` where they are not null; objects of either stay."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in dict.fromkeys(old.columns + new.columns) if c != key]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in old.columns and c in new.columns else F.col(f"n.{c}" if c in new.columns else f"o.{c}")
    return o.join(n, key, "full").select(key, *[pick(c).alias(c) for c in cols])
