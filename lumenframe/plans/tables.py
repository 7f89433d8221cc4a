"""The driver's tables in the terms of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the light curves below, for DuckDB.
EVENTS_SQL = "SELECT user_id AS objectid, epoch_us(ts)::DOUBLE / 86400000000.0 + 40587.5 AS t, value AS m, 0.001 * value AS e, event_id AS seq, event_type AS inst FROM events"
SUPPLIES_SQL = "SELECT l_suppkey AS objectid, epoch_us(l_shipdate)::DOUBLE / 86400000000.0 + 40587.5 AS t, l_extendedprice AS m, 0.001 * l_extendedprice AS e, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS inst FROM lineitem"
STARS_SQL = "SELECT c_custkey AS objectid, ((c_custkey * 137) % 360 + 0.25)::DOUBLE AS ra, ((c_custkey * 53) % 180 - 89.75)::DOUBLE AS decl, 10 + c_acctbal / 2500.0 AS jmag, 9.5 + c_acctbal / 2600.0 AS hmag, 9.25 + c_acctbal / 2700.0 AS kmag, c_nationkey AS nation FROM customer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rjd(ts: str) -> Column:
    return F.expr(f"cast(unix_micros(cast({ts} AS timestamp)) AS double) / 86400000000D + 40587.5D")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light curves of users: time, value, and the fallback error of a thousandth."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("objectid"), _rjd("ts").alias("t"), F.col("value").alias("m"), (F.lit(0.001) * F.col("value")).alias("e"), F.col("event_id").alias("seq"), F.col("event_type").alias("inst"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series with ties in time: shipped prices by supplier."""
    e = table(spark, sf_dir, "lineitem")
    return e.select(F.col("l_suppkey").alias("objectid"), _rjd("l_shipdate").alias("t"), F.col("l_extendedprice").alias("m"), (F.lit(0.001) * F.col("l_extendedprice")).alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("inst"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog: positions from keys, magnitudes from balances."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS objectid", "(c_custkey * 137) % 360 + 0.25D AS ra", "(c_custkey * 53) % 180 - 89.75D AS decl", "10 + c_acctbal / 2500D AS jmag", "9.5D + c_acctbal / 2600D AS hmag", "9.25D + c_acctbal / 2700D AS kmag", "c_nationkey AS nation")
