"""Bars, trades and side tables made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .bars import bars_of_ticks

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, ts, sec (seconds since 1970), price, size of each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        "ts",
        F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("sec"),
        F.col("value").alias("price"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("double").alias("size"),
        "event_id",
        "user_id",
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Bars of a fixed length: instrument, t (bar number), session (day number), sessmin (bar of the session), o h l c v n."""
    made = bars_of_ticks(ticks(spark, sf_dir), seconds)
    day = 86_400 // seconds
    return made.withColumns({"session": F.floor(F.col("t") / day), "sessmin": F.pmod(F.col("t"), F.lit(day)).cast("int")})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades made of order lines: account, day, setup, side, qty, pnl4 (exact, in 1e-4), r (pnl4 / 1e6), reason, seq columns."""
    pnl4 = F.round(F.col("l_extendedprice") * 100).cast("long") * (F.round(F.col("l_discount") * 100).cast("long") - 5)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("account"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        F.col("l_returnflag").alias("setup"),
        F.col("l_linestatus").alias("side"),
        F.round("l_quantity").cast("long").alias("qty"),
        pnl4.alias("pnl4"),
        (pnl4 / 1e6).alias("r"),
        F.when(F.col("l_linenumber") <= 2, "stop").when(F.col("l_linenumber") <= 4, "target").otherwise("time").alias("reason"),
        F.col("l_linenumber").cast("int").alias("conviction"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_partkey").alias("k2"),
        F.col("l_linenumber").alias("k3"),
        F.col("l_extendedprice").alias("k4"),
    )


#: The total order of an account's trades.
SEQUENCE = ["day", "k1", "k2", "k3", "k4"]

# The same inputs as DuckDB common table expressions.
TICKS_SQL = """ticks AS (SELECT event_type AS instrument, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, value AS price,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS size, event_id, user_id FROM events)"""


def bars_sql(seconds: int = 3600, name: str = "bars") -> str:
    day = 86_400 // seconds
    return f"""{name} AS (SELECT *, CAST(floor(t / {float(day)}) AS BIGINT) AS session, CAST(t % {day} AS INTEGER) AS sessmin FROM (
 SELECT instrument, CAST(floor(sec / {float(seconds)}) AS BIGINT) AS t, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c,
 sum(size) AS v, count(*) AS n FROM ticks GROUP BY 1, 2))"""


BARS_SQL = f"{TICKS_SQL}, {bars_sql()}"
TRADES_SQL = """trades AS (SELECT *, pnl4 / 1e6 AS r FROM (SELECT l_suppkey AS account, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, l_returnflag AS setup,
 l_linestatus AS side, CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) * (CAST(round(l_discount * 100) AS BIGINT) - 5) AS pnl4,
 CASE WHEN l_linenumber <= 2 THEN 'stop' WHEN l_linenumber <= 4 THEN 'target' ELSE 'time' END AS reason, CAST(l_linenumber AS INTEGER) AS conviction,
 l_orderkey AS k1, l_partkey AS k2, l_linenumber AS k3, l_extendedprice AS k4 FROM lineitem))"""
SEQUENCE_SQL = "day, k1, k2, k3, k4"
