"""Bars: building, resampling, session aggregates, quality, identity and the delta codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bars_of_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """instrument, t, o, h, l, c, v, n of ticks (instrument, ts, sec, price, size). One partial aggregation, one shuffle."""
    return ticks.groupBy("instrument", F.floor(F.col("sec") / seconds).alias("t")).agg(
        F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.sum("size").alias("v"), F.count(F.lit(1)).alias("n")
    )


def resample(bars: DataFrame, m: int, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Bars of m bars, aligned to the session's start: first open, extremes, last close, sum of positive volumes. more: columns
    that do not change inside a session, to be kept."""
    return bars.groupBy("instrument", "session", *more, F.floor(F.col("sessmin") / m).cast("int").alias("bucket")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)).alias("v"), F.count(F.lit(1)).alias("n")
    )


def sessions(bars: DataFrame, expected: int) -> DataFrame:
    """Open, high, low, close, bars of each session, and whether it is complete (80 % of the expected bars)."""
    return bars.groupBy("instrument", "session").agg(
        F.min_by("o", "t").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "t").alias("close"), F.count(F.lit(1)).alias("n_bars"), F.min("sessmin").alias("first_bar")
    ).withColumn("complete", F.col("n_bars") >= 0.8 * expected)


def session_key(ts, zone: str = "America/New_York", shift_hours: int = 6):
    """Trading day of a UTC timestamp: the local date of the exchange, from its evening opening on the next day's."""
    return F.to_date(F.from_utc_timestamp(ts, zone) + F.expr(f"INTERVAL {shift_hours} HOURS"))


def third_friday(year: Column, month: Column) -> Column:
    """The third Friday of a month, a date."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)) + 14)


# The months of quarterly contracts and their letters.
QUARTERS = ((3, "H"), (6, "M"), (9, "U"), (12, "Z"))


def front_contract(day: Column) -> Column:
    """(code, expiry, roll) of the quarterly contract whose third Friday has not passed on a day (that day still counts): the
    letter with the year's last digit, the third Friday, and the day eight days before it."""
    options = [F.struct(F.concat(F.lit(letter), (F.pmod(F.year(day) + ahead, F.lit(10))).cast("string")).alias("code"), third_friday(F.year(day) + ahead, F.lit(month)).alias("expiry")) for ahead in (0, 1) for month, letter in QUARTERS]
    found = F.get(F.filter(F.array(*options), lambda x: x["expiry"] >= day), F.lit(0))
    return F.struct(found["code"].alias("code"), found["expiry"].alias("expiry"), F.date_sub(found["expiry"], 8).alias("roll"))


def market_state(ts: Column) -> Column:
    """asia, europe, cash, after, pause or closed at a UTC timestamp, by the clocks of New York and London."""
    ny, london = F.from_utc_timestamp(ts, "America/New_York"), F.from_utc_timestamp(ts, "Europe/London")
    minute, day = F.hour(ny) * 60 + F.minute(ny), F.weekday(ny)  # Monday is 0
    weekend = (day == 5) | ((day == 6) & (minute < 18 * 60)) | ((day == 4) & (minute >= 17 * 60))
    opened, late = minute.between(570, 959), minute.between(960, 1019)
    return (
        F.when(weekend, "closed").when(minute.between(1020, 1079), "pause").when((day <= 4) & opened, "cash").when((day <= 4) & late, "after").when(minute >= 1080, "asia")
        .when(F.hour(london) >= 8, "europe").otherwise("asia")
    )


def quality(bars: DataFrame, expected: int) -> DataFrame:
    """Per session: bars, missing bars between first and last, flat bars, bars out of shape, no-volume bars, short or not."""
    order = W.partitionBy("instrument", "session").orderBy("t")
    hole = F.col("t") - F.lag("t").over(order) - 1
    return (
        bars.withColumn("hole", F.coalesce(hole, F.lit(0)))
        .groupBy("instrument", "session")
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.sum("hole").cast("long").alias("missing"),
            F.count_if(F.col("h") == F.col("l")).alias("flat"),
            F.count_if((F.col("h") < F.greatest("o", "c")) | (F.col("l") > F.least("o", "c"))).alias("invalid"),
            F.count_if(F.col("v") <= 0).alias("no_volume"),
        )
        .withColumn("short", F.col("n_bars") < 0.8 * expected)
    )


def roll_jumps(bars: DataFrame, expected: int, limit: float = 8.0) -> DataFrame:
    """Session openings that jump from the last close by more than `limit` robust deviations (median absolute, times 1.4826)."""
    days = sessions(bars, expected)
    jump = days.withColumn("jump", F.col("open") - F.lag("close").over(W.partitionBy("instrument").orderBy("session"))).where("jump is not null")
    middle = jump.groupBy("instrument").agg(F.percentile("jump", F.lit(0.5)).alias("middle"))
    away = jump.join(middle, "instrument").withColumn("away", F.abs(F.col("jump") - F.col("middle")))
    scale = away.groupBy("instrument").agg((1.4826 * F.percentile("away", F.lit(0.5))).alias("scale"))
    return away.join(scale, "instrument").select("instrument", "session", "jump", "scale", (F.col("away") > limit * F.col("scale")).alias("is_roll"))


def fingerprint(bars: DataFrame, scale: int = 100) -> DataFrame:
    """Identity of a bar set: first and last session, number of bars, sum of integer closes modulo 2 ** 32."""
    close = F.floor(F.col("c") * scale + 0.5).cast("long")
    return bars.groupBy("instrument").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count(F.lit(1)).alias("n_bars"), F.pmod(F.sum(close), F.lit(1 << 32)).cast("long").alias("checksum"))


def encode(bars: DataFrame, scale: int) -> DataFrame:
    """One row a session, prices as integers at `scale`: first bar and close, then deltas of bar number, close, open, high, low."""
    p = lambda c: F.floor(F.col(c) * scale + 0.5).cast("long")
    bar = F.struct(F.col("t"), p("c").alias("c"), p("o").alias("o"), p("h").alias("h"), p("l").alias("l"), F.col("v"))
    made = bars.groupBy("instrument", "session").agg(F.sort_array(F.collect_list(bar)).alias("b"))  # a session at most
    steps = lambda f: F.transform(F.slice("b", F.lit(2), F.size("b")), lambda x, i: x[f] - F.get("b", i)[f])
    return made.select(
        "instrument",
        "session",
        F.lit(scale).alias("scale"),
        F.get("b", F.lit(0))["t"].alias("t0"),
        F.get("b", F.lit(0))["c"].alias("c0"),
        steps("t").alias("dt"),
        steps("c").alias("dc"),
        F.transform("b", lambda x: x["o"] - x["c"]).alias("o"),
        F.transform("b", lambda x: x["h"] - x["c"]).alias("h"),
        F.transform("b", lambda x: x["l"] - x["c"]).alias("l"),
        F.transform("b", lambda x: x["v"]).alias("vol"),
    )


def decode(encoded: DataFrame) -> DataFrame:
    """Bars of encoded sessions; the inverse of encode for prices on the grid."""
    zipped = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), "dt").alias("dt"), F.concat(F.array(F.lit(0).cast("long")), "dc").alias("dc"), "o", "h", "l", "vol")
    rows = encoded.select("instrument", "session", "scale", "t0", "c0", F.posexplode(zipped).alias("i", "x"))
    upto = W.partitionBy("instrument", "session").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    close = F.col("c0") + F.sum(F.col("x.dc")).over(upto)
    back = lambda d: (F.col("close") + F.col("x")[d]) / F.col("scale")
    rows = rows.withColumns({"t": F.col("t0") + F.sum("x.dt").over(upto), "close": close})
    return rows.select("instrument", "session", "t", back("o").alias("o"), back("h").alias("h"), back("l").alias("l"), (F.col("close") / F.col("scale")).alias("c"), F.col("x")["vol"].alias("v"))


def union_assets(parts: list[DataFrame]) -> DataFrame:
    """All bars of several parts; a bar that two parts hold is taken from the later part."""
    from functools import reduce

    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, marked)
    last = W.partitionBy("instrument", "t").orderBy(F.desc("_part"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_part")


def segments(bars: DataFrame, expected: int) -> DataFrame:
    """bars with segment: how many rolls, jumps between sessions far beyond the usual, lie at or before their session."""
    jumps = roll_jumps(bars, expected).select("instrument", "session", "is_roll")
    days = bars.select("instrument", "session").distinct().join(jumps, ["instrument", "session"], "left")
    upto = W.partitionBy("instrument").orderBy("session").rowsBetween(W.unboundedPreceding, 0)  # a row a session
    days = days.select("instrument", "session", F.sum(F.coalesce("is_roll", F.lit(False)).cast("long")).over(upto).alias("segment"))
    return bars.join(days, ["instrument", "session"])
