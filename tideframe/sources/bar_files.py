"""Bar files: a strict and a tolerant reader, daily side files, writers and assets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bars import decode, encode
from .text import BAR_ALIASES, alias, columns_of, instant, number


def read_strict(spark: SparkSession, path: str, open_minute: int = 570, minutes: int = 390) -> DataFrame:
    """day, minute (from the session's open), o, h, l, c, v of a comma file with a header, in any order and case.

    Times are ISO or epoch seconds; slashed dates are refused. Bars outside the session go; of a repeated minute the last
    line stays.
    """
    raw = spark.read.option("header", True).csv(path)
    at = columns_of(raw.columns, BAR_ALIASES)
    missing = [k for k in ("time", "o", "h", "l", "c") if k not in at]
    if missing:
        raise ValueError(f"no column for {missing}")
    pick = lambda k: F.col(f"`{raw.columns[at[k]]}`")
    text = F.concat_ws(" ", pick("time"), pick("clock")) if "clock" in at else pick("time")
    if raw.where(text.contains("/")).limit(1).count():
        raise ValueError("dates with slashes are ambiguous")
    rows = raw.select(
        instant(text).alias("ts"), *[pick(k).try_cast("double").alias(k) for k in "ohlc"], (pick("v").try_cast("double") if "v" in at else F.lit(0.0)).alias("v"), F.monotonically_increasing_id().alias("_line")
    ).where("ts is not null")
    rows = rows.withColumns({"day": F.to_date("ts"), "minute": F.hour("ts") * 60 + F.minute("ts") - open_minute}).where((F.col("minute") >= 0) & (F.col("minute") < minutes))
    last = W.partitionBy("day", "minute").orderBy(F.desc("_line"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("day", "minute", "o", "h", "l", "c", "v")


def sniff(lines: list[str]) -> dict:
    """Separator, header positions, decimal comma and date order of the first lines of a file."""
    text = [x for x in lines if x.strip()]
    sep = max("\t;,", key=lambda s: (min((x.count(s) for x in text[1:5] or text), default=0) > 0, s != ",", min((x.count(s) for x in text[1:5] or text), default=0)))
    head = [h.strip().strip('"') for h in text[0].split(sep)] if text else []
    at = columns_of(head, BAR_ALIASES)
    header = len(at) >= 4 or any(re.search("[A-Za-z]{3}", h) for h in head)
    if not header:
        at = {k: i for i, k in enumerate(["time", "o", "h", "l", "c", "v"][: len(head)])}
    body = text[1:] if header else text
    votes = [m for x in body for m in [re.match(r"^\"?(\d{1,2})[./-](\d{1,2})[./-]\d{4}", x)] if m]
    month_first = sum(int(m[2]) > 12 for m in votes) > sum(int(m[1]) > 12 for m in votes)
    return {"sep": sep, "header": header, "first": text[0] if text else "", "at": at, "decimal_comma": sep != "," and any(re.search(r"\d,\d", x) for x in body), "month_first": month_first}


def read_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bars (t: minute number, o, h, l, c, v) of almost any bar file, and one row of warnings.

    The first lines tell separator and header; all lines vote on decimal comma and date order. Highs and lows are widened to
    hold open and close. Of a repeated minute the last line stays and is counted. Warnings also count lines that could not be
    read, and tell whether no majority of lines settles the order of day and month.
    """
    lines = spark.read.text(path)
    look = sniff([r["value"] for r in lines.limit(2000).collect()])
    at = look["at"]
    lines = lines.where(F.trim("value") != "")
    if look["header"]:
        lines = lines.where(F.col("value") != look["first"])
    cells = F.split("value", re.escape(look["sep"]))
    cell = lambda k: F.trim(F.regexp_replace(F.get(cells, F.lit(at[k])), '^"|"$', ""))
    text = F.concat_ws(" ", cell("time"), cell("clock")) if "clock" in at else cell("time")
    date = r"^(\d{1,2})[./-](\d{1,2})[./-]\d{4}"
    beyond = lambda k: F.count_if(F.regexp_extract(cell("time"), date, k).try_cast("int") > 12)
    votes = lines.agg(beyond(1).alias("day"), beyond(2).alias("month"), F.count_if(cell("time").rlike(date)).alias("dated"), F.count_if(F.col("value").rlike(r"\d,\d")).alias("commas")).first()
    look |= {"month_first": votes["month"] > votes["day"], "decimal_comma": look["sep"] != "," and votes["commas"] > 0}
    rows = lines.withColumn("_line", F.monotonically_increasing_id()).select(
        "_line", instant(text, look["month_first"]).alias("ts"), *[number(cell(k), look["decimal_comma"]).alias(k) for k in "ohlc"], (number(cell("v"), look["decimal_comma"]) if "v" in at else F.lit(None).cast("double")).alias("v")
    )
    read = F.expr("ts is not null and o is not null and h is not null and l is not null and c is not null")
    rows = rows.withColumns({"_read": read, "t": F.when(read, F.floor(F.unix_timestamp("ts") / 60))})
    good = rows.where("_read")
    last = W.partitionBy("t").orderBy(F.desc("_line"))
    kept = good.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    bars = kept.select("t", "o", F.greatest("h", "o", "l", "c").alias("h"), F.least("l", "o", "h", "c").alias("l"), "c", "v")
    warnings = rows.agg(
        F.count_if("_read").alias("lines"),
        (F.count_if("_read") - F.countDistinct("t")).alias("repeated"),
        F.count_if(F.col("_read") & ((F.col("h") < F.greatest("o", "c")) | (F.col("l") > F.least("o", "c")))).alias("mended"),
        F.lit(votes["dated"] > 0 and votes["day"] == votes["month"]).alias("ambiguous"),
        F.count_if(~F.col("_read")).alias("unread"),
    )
    return bars, warnings


def read_daily(spark: SparkSession, path: str, value: str = "gamma_net") -> DataFrame:
    """(day, value) of a daily side file."""
    raw = spark.read.option("header", True).csv(path)
    names = {alias(c): c for c in raw.columns}
    return raw.select(F.to_date(f"`{names['date']}`").alias("day"), F.col(f"`{names[alias(value)]}`").try_cast("double").alias(value)).where(f"day is not null and {value} is not null")


def write_bars(bars: DataFrame, path: str) -> None:
    bars.write.option("header", True).mode("overwrite").csv(path)


def write_assets(bars: DataFrame, path: str, scale: int = 100) -> None:
    """Encoded sessions, a folder a year (session numbers are days since 1970)."""
    encode(bars, scale).withColumn("year", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("session").cast("int")))).write.partitionBy("year").mode("overwrite").parquet(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Bars of encoded sessions; a session that two assets hold, or two scales, stop the read."""
    rows = spark.read.parquet(path).drop("year")
    bad = rows.groupBy("instrument", "session").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if bad or rows.select("scale").distinct().count() > 1:
        raise ValueError("assets overlap or differ in scale")
    return decode(rows)


def driftless_walk(spark: SparkSession, sessions: int, minutes: int, tick: float = 0.25, start: float = 10_000.0, seed: int = 1, steps: int = 20) -> DataFrame:
    """Bars of exact walks of single ticks, a session a row group: the null under which no rule earns more than its cost."""
    import numpy as np
    import pandas as pd

    def walk(batches):
        for pdf in batches:
            out = []
            for session in pdf["id"].tolist():
                rng = np.random.default_rng([seed, session])
                path = start + tick * np.concatenate([[0], np.cumsum(rng.integers(0, 2, minutes * steps) * 2 - 1)])
                cut = np.lib.stride_tricks.sliding_window_view(path, steps + 1)[::steps]
                out.append(pd.DataFrame({"instrument": "walk", "t": session * 1440 + np.arange(minutes), "session": session, "sessmin": np.arange(minutes, dtype="int32"), "o": cut[:, 0], "h": cut.max(axis=1), "l": cut.min(axis=1), "c": cut[:, -1], "v": 1.0, "n": steps, "low_first": cut.argmin(axis=1) < cut.argmax(axis=1)}))
            yield pd.concat(out) if out else pd.DataFrame()

    return spark.range(sessions).mapInPandas(walk, "instrument string, t long, session long, sessmin int, o double, h double, l double, c double, v double, n long, low_first boolean")
