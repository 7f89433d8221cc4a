"""URL filters: dated list entries become validity intervals; an as-of join judges every capture at its fetch time.

An entry names a host or a domain above it and is added or removed at a time. Per pattern the entries in order of time
become intervals from an "add" up to, but not including, the next "remove"; repeated adds or removes change nothing,
and of entries at the same time "remove" comes last. The last interval of a pattern may be open.

The as-of join is of distinct (host, time) of the captures, each with the host's name and the domains above it as
patterns. Closed intervals are cut along the calendar into slices of SLICE days, so it is an equality of pattern and slice
with a condition on the time: a pattern that is edited often, or a host that is captured often, is spread over its
slices. Of open intervals a pattern has one at most, so those meet by pattern alone. The longest active pattern decides,
and goes back to the captures by host and time. No list is gathered by host or pattern.

All of it is DataFrame operations. A capture without a host (null, empty or relative URL) or without a time matches
nothing. Rows that repeat are each judged, and are one to the join. Entries with a null pattern, time or action are left
out. Empty tables are allowed on either side. The captures' columns are returned as they are; a result whose name is taken
gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

#: Days of a slice of time.
SLICE = 32

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without a port, user or closing dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) from ``entries`` (pattern, at, action: add or remove); until is null while open."""
    e = entries.select(F.lower("pattern").alias("pattern"), "at", (F.col("action") == "add").alias("on")).where("pattern IS NOT NULL AND at IS NOT NULL AND on IS NOT NULL").distinct()
    # of entries at one time the removal decides
    e = e.groupBy("pattern", "at").agg(F.min("on").alias("on"))
    w = Window.partitionBy("pattern").orderBy("at")
    turns = e.withColumn("before", F.lag("on", 1, False).over(w)).where("on <> before")
    return turns.withColumn("until", F.lead("at").over(w)).where("on").select("pattern", F.col("at").alias("since"), "until")


def as_of(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """``keys`` (host, at, pattern) with the interval of ``spans`` (pattern, since, until) that holds at the time: (host, at,
    pattern, since). Others are left out; a pattern has one interval at a time."""
    part = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / SLICE)
    closed = spans.where("until IS NOT NULL").select("*", F.explode(F.sequence(part("since"), part("until"))).alias("slice"))
    within = keys.withColumn("slice", part("at")).join(closed, ["pattern", "slice"]).where("since <= at AND at < until")
    after = keys.join(spans.where("until IS NULL"), "pattern").where("since <= at")
    return within.select("host", "at", "pattern", "since").unionAll(after.select("host", "at", "pattern", "since"))


def matches(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` and, as the last four columns, host, blocked, pattern (the longest active one) and since, the start of
    its interval."""
    names = [fresh(c, captures.columns) for c in ("host", "blocked", "pattern", "since")]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(captures.columns)]
    c = captures.select(*own, host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{at}`").alias("at"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = c.select("host", "at").where("host IS NOT NULL AND at IS NOT NULL").distinct().select("host", "at", F.explode(above).alias("pattern"))
    hits = as_of(keys, intervals(entries)).groupBy("host", "at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("hit"))
    out = (F.col("host"), F.col("hit").isNotNull(), F.col("hit.pattern"), F.col("hit.since"))
    return c.join(hits, ["host", "at"], "left").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(captures.columns)], *[v.alias(n) for v, n in zip(out, names, strict=True)])


def derived_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): the table has no fetch times, so a time in 2024 follows from the id."""
    return pages.select("page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 366) AS int), cast(pmod(page_id, 24) AS int))").alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """(pattern, at, action): a dated list over the pages' own hosts and the domains one label above them.

    The first two digits of a name's MD5 say whether and when it is added (in two of three cases), removed 60 days
    later, and added again another 60 days later (in every other case).
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    above = hosts.where("size(split(host, '[.]')) > 3").select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host"))
    v = hosts.union(above).distinct().select("host", F.conv(F.substring(F.md5("host"), 1, 2), 16, 10).cast("int").alias("v"))
    dated = v.where("v % 3 <> 2").select("host", F.explode(F.expr("filter(array(struct(v AS d, 'add' AS action), struct(v + 60 AS d, 'remove' AS action), struct(CASE WHEN v % 2 = 0 THEN v + 120 END AS d, 'add' AS action)), x -> x.d IS NOT NULL)")).alias("e"))
    return dated.select(F.col("host").alias("pattern"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(e.d)").alias("at"), F.col("e.action").alias("action"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every page against the list as of its fetch."""
    pages = table(spark, sf_dir, "pages")
    return matches(derived_captures(pages), derived_entries(pages)).select("page_id", "url", "fetched_at", "host", "blocked", "pattern", "since")


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((((page_id * 37) % 366 + 366) % 366)::INT) + to_hours((((page_id % 24) + 24) % 24)::INT) AS fetched_at,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
names AS (
  SELECT host, ('0x' || substr(md5(host), 1, 2))::INT AS v FROM (
    SELECT host FROM hosts UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM hosts WHERE len(string_split(host, '.')) > 3)),
spans AS (
  SELECT host AS pattern, TIMESTAMP '2024-01-01' + to_days(v) AS since, TIMESTAMP '2024-01-01' + to_days(v + 60) AS until FROM names WHERE v % 3 <> 2
  UNION ALL
  SELECT host, TIMESTAMP '2024-01-01' + to_days(v + 120), NULL FROM names WHERE v % 3 <> 2 AND v % 2 = 0),
found AS (
  SELECT c.page_id, c.url, s.pattern, s.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC) AS r
  FROM captures c JOIN spans s ON (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)) AND s.since <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until))
SELECT c.page_id, c.url, c.fetched_at, c.host, f.pattern IS NOT NULL AS blocked, f.pattern, f.since
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND f.r = 1
"""
