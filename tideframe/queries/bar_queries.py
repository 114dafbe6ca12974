"""Bars, operands and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import inputs as I
from ..operators import joins as J
from ..plans.compiler import Compiler
from ..registry import register
from .common import r6, r6_all, r6_sql

BARS = I.BARS_SQL
ANCHOR = (8, 20)
S = "WINDOW w AS (PARTITION BY instrument ORDER BY t)"
TICK = 0.01


def frame(spark: SparkSession, sf_dir: str, **more) -> Compiler:
    return Compiler(I.bars(spark, sf_dir), anchor=ANCHOR, expected=24, **more)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named levels of each session: quartiles of all its prices, of every instrument, as of the session before."""
    ticks = I.ticks(spark, sf_dir).withColumn("session", F.floor(F.col("sec") / 86_400) + 1)
    made = ticks.groupBy("session").agg(F.min("price").alias("S2"), F.percentile("price", F.lit(0.25)).alias("S1"), F.percentile("price", F.lit(0.75)).alias("R1"), F.max("price").alias("R2"))
    return made.unpivot("session", ["S2", "S1", "R1", "R2"], "name", "price")


LEVELS = """lv AS (SELECT CAST(floor(sec / 86400.0) AS BIGINT) + 1 AS session, min(price) AS S2, quantile_cont(price, 0.25) AS S1, quantile_cont(price, 0.75) AS R1, max(price) AS R2 FROM ticks GROUP BY 1),
levels AS (SELECT session, 'S2' AS name, S2 AS price FROM lv UNION ALL SELECT session, 'S1', S1 FROM lv UNION ALL SELECT session, 'R1', R1 FROM lv UNION ALL SELECT session, 'R2', R2 FROM lv)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news item in the hour of every event, its impact by its price: 3 from 99, 2 from 95, else 1."""
    price = F.col("price")
    return I.ticks(spark, sf_dir).select(F.floor(F.col("sec") / 3600).alias("t"), F.when(price >= 99, 3).when(price >= 95, 2).otherwise(1).alias("impact"))


NEWS = "news AS (SELECT CAST(floor(sec / 3600.0) AS BIGINT) AS t, CASE WHEN price >= 99 THEN 3 WHEN price >= 95 THEN 2 ELSE 1 END AS impact FROM ticks)"


def all_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news item in the hour of every event, impact 1 to 3."""
    return I.ticks(spark, sf_dir).select(F.floor(F.col("sec") / 3600).alias("t"), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int").alias("impact")).distinct()


ALL_NEWS = "news AS (SELECT DISTINCT CAST(floor(sec / 3600.0) AS BIGINT) AS t, CAST(event_id % 3 + 1 AS INTEGER) AS impact FROM ticks)"
#: The frame with anchored and edge marks in SQL.
FRAME = f"""{BARS}, fr AS (SELECT *, sessmin BETWEEN {ANCHOR[0]} AND {ANCHOR[1]} AS anchored FROM bars),
fx AS (SELECT *, (anchored AND row_number() OVER (PARTITION BY instrument, session, anchored ORDER BY t) = 1) OR lag(t) OVER w IS NULL AS edge, lag(c) OVER w AS c1 FROM fr {S})"""
KEY = ["instrument", "t"]


@register("bars_hourly", f"WITH {BARS} SELECT instrument, t, session, sessmin, o, h, l, c, v, n FROM bars")
def bars_hourly(spark, sf_dir):
    return I.bars(spark, sf_dir).select("instrument", "t", "session", "sessmin", "o", "h", "l", "c", "v", "n")


@register(
    "bars_resample_tf",
    f"""WITH {BARS} SELECT instrument, session, CAST(floor(sessmin / 4.0) AS INTEGER) AS bucket, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c,
sum(CASE WHEN v > 0 THEN v ELSE 0.0 END) AS v, count(*) AS n FROM bars GROUP BY 1, 2, 3""",
)
def bars_resample_tf(spark, sf_dir):
    return B.resample(I.bars(spark, sf_dir), 4)


SESSIONS = """days AS (SELECT instrument, session, arg_min(o, t) AS open, max(h) AS high, min(l) AS low, arg_max(c, t) AS close, count(*) AS n_bars, min(sessmin) AS first_bar, count(*) >= 0.8 * 24 AS complete FROM bars GROUP BY 1, 2)"""


@register("session_ohlc", f"WITH {BARS}, {SESSIONS} SELECT * FROM days")
def session_ohlc(spark, sf_dir):
    return B.sessions(I.bars(spark, sf_dir), 24)


@register("session_key_globex", "SELECT CAST(k AS VARCHAR) AS session_key, count(*) AS n FROM (SELECT CAST(ts - INTERVAL 5 HOUR + INTERVAL 6 HOUR AS DATE) AS k FROM events WHERE month(ts) IN (1, 2, 12) OR (month(ts) = 3 AND day(ts) <= 7) OR (month(ts) = 11 AND day(ts) >= 9)) GROUP BY 1")
def session_key_globex(spark, sf_dir):
    """Trading days of the winter months, when the exchange is five hours behind UTC (the twin knows no time zones)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("month(ts) IN (1, 2, 12) OR (month(ts) = 3 AND day(ts) <= 7) OR (month(ts) = 11 AND day(ts) >= 9)")
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return ev.groupBy(B.session_key(utc).cast("string").alias("session_key")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "quality_report",
    f"""WITH {BARS} SELECT instrument, session, count(*) AS n_bars, CAST(sum(coalesce(gap, 0)) AS BIGINT) AS missing, count(*) FILTER (h = l) AS flat,
count(*) FILTER (h < greatest(o, c) OR l > least(o, c)) AS invalid, count(*) FILTER (v <= 0) AS no_volume, count(*) < 0.8 * 24 AS short
FROM (SELECT *, t - lag(t) OVER (PARTITION BY instrument, session ORDER BY t) - 1 AS gap FROM bars) GROUP BY 1, 2""",
)
def quality_report(spark, sf_dir):
    return B.quality(I.bars(spark, sf_dir), 24)


@register(
    "roll_jumps",
    f"""WITH {BARS}, {SESSIONS}, j AS (SELECT * FROM (SELECT instrument, session, open - lag(close) OVER (PARTITION BY instrument ORDER BY session) AS jump FROM days) WHERE jump IS NOT NULL),
m AS (SELECT instrument, quantile_cont(jump, 0.5) AS middle FROM j GROUP BY 1), a AS (SELECT j.*, abs(jump - middle) AS away FROM j JOIN m USING (instrument)),
s AS (SELECT instrument, 1.4826 * quantile_cont(away, 0.5) AS scale FROM a GROUP BY 1)
SELECT instrument, session, {r6_sql('jump', 'jump')}, {r6_sql('scale', 'scale')}, away > 8 * scale AS is_roll FROM a JOIN s USING (instrument)""",
)
def roll_jumps(spark, sf_dir):
    return r6_all(B.roll_jumps(I.bars(spark, sf_dir), 24), "jump", "scale")


@register("fingerprint", f"WITH {BARS} SELECT instrument, min(session) AS first_session, max(session) AS last_session, count(*) AS n_bars, CAST(sum(CAST(floor(c * 100 + 0.5) AS BIGINT)) % 4294967296 AS BIGINT) AS checksum FROM bars GROUP BY 1")
def fingerprint(spark, sf_dir):
    return B.fingerprint(I.bars(spark, sf_dir))


@register(
    "codec_round_trip",
    f"WITH {BARS} SELECT instrument, session, t, floor(o * 10000 + 0.5) / 10000 AS o, floor(h * 10000 + 0.5) / 10000 AS h, floor(l * 10000 + 0.5) / 10000 AS l, floor(c * 10000 + 0.5) / 10000 AS c, v FROM bars",
)
def codec_round_trip(spark, sf_dir):
    return B.decode(B.encode(I.bars(spark, sf_dir), 10_000))


@register(
    "union_dedupe",
    f"""WITH {BARS} SELECT instrument, t, CASE WHEN sessmin >= 12 THEN c + 1 ELSE c END AS c FROM bars""",
)
def union_dedupe(spark, sf_dir):
    bars = I.bars(spark, sf_dir).select("instrument", "t", "sessmin", "c")
    return B.union_assets([bars, bars.where("sessmin >= 12").withColumn("c", F.col("c") + 1)]).select("instrument", "t", "c")


@register(
    "flag_audit",
    f"""WITH {BARS}, {SESSIONS} SELECT instrument, count(*) AS sessions, count(*) FILTER (NOT complete) AS short_sessions, count(*) FILTER (first_bar > 0) AS late_sessions, max(gap) AS max_gap,
{r6_sql('avg(CASE WHEN complete THEN 1.0 ELSE 0.0 END)', 'usable')} FROM (SELECT *, session - lag(session) OVER (PARTITION BY instrument ORDER BY session) AS gap FROM days) GROUP BY 1""",
)
def flag_audit(spark, sf_dir):
    days = B.sessions(I.bars(spark, sf_dir), 24).withColumn("gap", F.col("session") - F.lag("session").over(W.partitionBy("instrument").orderBy("session")))
    return days.groupBy("instrument").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(~F.col("complete")).alias("short_sessions"), F.count_if(F.col("first_bar") > 0).alias("late_sessions"), F.max("gap").alias("max_gap"), r6(F.avg(F.col("complete").cast("double")), "usable"))


# operands


def operand(name: str, spec, sql: str, **more):
    """Register a query of one compiled operand against SQL that selects instrument, t, value."""

    @register(name, f"SELECT instrument, t, {r6_sql('value', 'value')} FROM ({sql})")
    def query(spark, sf_dir, spec=spec):
        compiler = frame(spark, sf_dir, **{k: f(spark, sf_dir) for k, f in more.items()})
        value = compiler.operand(spec)
        return compiler.frame.select("instrument", "t", r6(value, "value"))

    return query


operand("field_hlc3", "hlc3", f"WITH {FRAME} SELECT instrument, t, (h + l + c) / 3 AS value FROM fx")
operand("operand_lag", {"ind": "close", "lag": 3}, f"WITH {FRAME} SELECT instrument, t, lag(c, 3) OVER w AS value FROM fx {S}")
operand("operand_arith", {"op": "/", "a": "body", "b": "range"}, f"WITH {FRAME} SELECT instrument, t, (c - o) / nullif(h - l, 0) AS value FROM fx")
operand("sma", {"ind": "sma", "n": 12}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN count(c) OVER x = 12 THEN avg(c) OVER x END AS value FROM fx WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
operand("rolling_sd", {"ind": "sd", "n": 12}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN count(c) OVER x = 12 THEN stddev_pop(c) OVER x END AS value FROM fx WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
operand("highest_high", {"ind": "hh", "n": 10}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN count(h) OVER x = 10 THEN max(h) OVER x END AS value FROM fx WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
operand("lowest_low", {"ind": "ll", "n": 10}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN count(l) OVER x = 10 THEN min(l) OVER x END AS value FROM fx WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
operand("rvol", {"ind": "rvol", "n": 5}, f"WITH {FRAME}, so AS (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY session) AS place FROM fx) SELECT instrument, t, CASE WHEN sum(v) OVER x > 0 THEN v / avg(v) OVER x END AS value FROM so WINDOW x AS (PARTITION BY instrument, sessmin ORDER BY place RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)")
operand("session_running_high", {"ind": "sess", "field": "high"}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN anchored THEN max(h) OVER (PARTITION BY instrument, session, anchored ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS value FROM fx")
operand(
    "opening_range_mid",
    {"ind": "or", "field": "mid", "from": 8, "to": 11},
    f"WITH {FRAME} SELECT instrument, t, CASE WHEN sessmin >= 11 THEN (max(CASE WHEN sessmin >= 8 AND sessmin < 11 THEN h END) OVER d + min(CASE WHEN sessmin >= 8 AND sessmin < 11 THEN l END) OVER d) / 2 END AS value FROM fx WINDOW d AS (PARTITION BY instrument, session)",
)
operand("price_at_time", {"ind": "at", "bar": 12, "field": "open"}, f"WITH {FRAME} SELECT instrument, t, CASE WHEN sessmin >= 12 THEN max(CASE WHEN sessmin = 12 THEN o END) OVER (PARTITION BY instrument, session) END AS value FROM fx")
operand("weekday", "dow", f"WITH {FRAME} SELECT instrument, t, CAST((session + 3) % 7 + 1 AS DOUBLE) AS value FROM fx")
operand(
    "prev_session",
    {"ind": "prev", "field": "close", "n": 2},
    f"""WITH {FRAME}, {SESSIONS}, rk AS (SELECT *, coalesce(sum(CAST(complete AS INTEGER)) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM days)
SELECT fx.instrument, fx.t, k.close AS value FROM fx JOIN rk ON fx.instrument = rk.instrument AND fx.session = rk.session LEFT JOIN (SELECT instrument, before + 1 AS own, close FROM rk WHERE complete) k ON k.instrument = fx.instrument AND k.own = rk.before - 1""",
)
def wide_as_of(wide: str) -> str:
    """SQL of what each bar reads of a table `wide` (instrument, session, b, g) of four-bar buckets: its own bucket's g with
    the bucket's last minute, before that the g of the last bucket that has bars."""
    return f"""{wide}, wj AS (SELECT fx.instrument, fx.session, fx.t, fx.sessmin, CAST(floor(fx.sessmin / 4.0) AS INTEGER) AS b, wide.g FROM fx LEFT JOIN wide ON wide.instrument = fx.instrument AND wide.session = fx.session AND wide.b = CAST(floor(fx.sessmin / 4.0) AS INTEGER)),
wl AS (SELECT *, lag(g) OVER (PARTITION BY instrument ORDER BY t) AS before FROM wj)
SELECT instrument, t, CASE WHEN sessmin % 4 = 3 THEN g ELSE first_value(before) OVER (PARTITION BY instrument, session, b ORDER BY t) END AS value FROM wl"""


WIDE_BARS = "wb AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session, b) AS i FROM (SELECT instrument, session, CAST(floor(sessmin / 4.0) AS INTEGER) AS b, arg_max(c, t) AS c, max(h) AS h FROM bars GROUP BY 1, 2, 3))"
operand("tf_asof", {"ind": "tf", "m": 4, "of": "close"}, f"WITH {FRAME}, {WIDE_BARS}, {wide_as_of('wide AS (SELECT instrument, session, b, c AS g FROM wb)')}")
operand(
    "tf_ema",
    {"ind": "tf", "m": 4, "of": {"ind": "ema", "n": 5}},
    f"""WITH RECURSIVE {FRAME}, {WIDE_BARS}, e(instrument, i, value) AS (SELECT instrument, CAST(5 AS BIGINT), avg(c) FROM wb WHERE i <= 5 GROUP BY 1 HAVING count(*) = 5
UNION ALL SELECT wb.instrument, wb.i, (1 - 2.0 / 6) * e.value + 2.0 / 6 * wb.c FROM e JOIN wb ON wb.instrument = e.instrument AND wb.i = e.i + 1),
{wide_as_of('wide AS (SELECT wb.instrument, session, b, e.value AS g FROM wb LEFT JOIN e ON e.instrument = wb.instrument AND e.i = wb.i)')}""",
)
operand(
    "tf_rsi",
    {"ind": "tf", "m": 4, "of": {"ind": "rsi", "n": 6}},
    f"""WITH RECURSIVE {FRAME}, {WIDE_BARS}, ws AS (SELECT *, c - lag(c) OVER (PARTITION BY instrument ORDER BY i) AS d FROM wb), e(instrument, i, u, d) AS (SELECT instrument, CAST(7 AS BIGINT), avg(greatest(d, 0)), avg(greatest(-d, 0)) FROM ws WHERE i BETWEEN 2 AND 7 GROUP BY 1 HAVING count(*) = 6
UNION ALL SELECT ws.instrument, ws.i, (e.u * 5 + greatest(ws.d, 0)) / 6, (e.d * 5 + greatest(-ws.d, 0)) / 6 FROM e JOIN ws ON ws.instrument = e.instrument AND ws.i = e.i + 1),
{wide_as_of('wide AS (SELECT ws.instrument, session, b, CASE WHEN e.u = 0 AND e.d = 0 THEN 50.0 WHEN e.d = 0 THEN 100.0 ELSE 100 - 100 / (1 + e.u / e.d) END AS g FROM ws LEFT JOIN e ON e.instrument = ws.instrument AND e.i = ws.i)')}""",
)
operand(
    "tf_highest_lagged",
    {"ind": "tf", "m": 4, "of": {"ind": "hh", "n": 3, "lag": 1}},
    f"WITH {FRAME}, {WIDE_BARS}, {wide_as_of('wide AS (SELECT instrument, session, b, lag(CASE WHEN i > 3 THEN m END) OVER (PARTITION BY instrument ORDER BY i) AS g FROM (SELECT *, max(h) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM wb))')}",
)
operand("level_join", {"ind": "level", "name": "R1"}, f"WITH {FRAME}, {LEVELS} SELECT fx.instrument, fx.t, levels.price AS value FROM fx LEFT JOIN levels ON levels.session = fx.session AND levels.name = 'R1'", levels=levels)


def scaled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """levels with every other session's on the scale of an index whose base is known on two days of three, and adjusted."""
    s = F.col("session")
    return levels(spark, sf_dir).withColumns({"scale": F.when(s % 2 == 0, "index").otherwise("contract"), "base": F.when(s % 3 != 0, (s % 5).cast("double")), "adj": F.when(s % 4 == 0, 0.25)})


operand(
    "level_scaled",
    {"ind": "level", "name": "S1"},
    f"WITH {FRAME}, {LEVELS} SELECT fx.instrument, fx.t, levels.price + CASE WHEN fx.session % 2 = 0 THEN CASE WHEN fx.session % 3 <> 0 THEN fx.session % 5 END ELSE 0 END + CASE WHEN fx.session % 4 = 0 THEN 0.25 ELSE 0 END AS value FROM fx LEFT JOIN levels ON levels.session = fx.session AND levels.name = 'S1'",
    levels=scaled_levels,
)
operand(
    "nearest_level",
    {"ind": "nearest", "side": "above"},
    f"WITH {FRAME}, {LEVELS} SELECT fx.instrument, fx.t, min(CASE WHEN levels.price > fx.c THEN levels.price END) AS value FROM fx LEFT JOIN levels ON levels.session = fx.session GROUP BY 1, 2",
    levels=levels,
)
VWAP = f"""{FRAME}, vw AS (SELECT *, (h + l + c) / 3 AS p, first_value((h + l + c) / 3) OVER u AS p0 FROM fx WINDOW u AS (PARTITION BY instrument, session, anchored ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
vm AS (SELECT *, CASE WHEN sum(v) OVER u > 0 THEN sum(v * (p - p0)) OVER u / nullif(sum(v) OVER u, 0) ELSE avg(p - p0) OVER u END AS m, CASE WHEN sum(v) OVER u > 0 THEN sum(v * (p - p0) * (p - p0)) OVER u / nullif(sum(v) OVER u, 0) ELSE avg((p - p0) * (p - p0)) OVER u END AS m2
 FROM vw WINDOW u AS (PARTITION BY instrument, session, anchored ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
vb AS (SELECT *, CASE WHEN m2 - m * m <= 1e-12 THEN 0.0 ELSE sqrt(greatest(m2 - m * m, 0)) END AS sg FROM vm)"""
operand("vwap_anchored", {"ind": "vwap", "k": 0}, f"WITH {VWAP} SELECT instrument, t, CASE WHEN anchored THEN p0 + m END AS value FROM vb")
operand("vwap_band", {"ind": "vwap", "k": -1.5}, f"WITH {VWAP} SELECT instrument, t, CASE WHEN anchored AND sg >= {TICK} THEN p0 + m - 1.5 * sg END AS value FROM vb")
operand("dist_sigma", {"ind": "dist", "a": "close", "b": {"ind": "vwap", "k": 0}, "unit": "sigma"}, f"WITH {VWAP} SELECT instrument, t, CASE WHEN anchored AND sg >= {TICK} THEN (c - (p0 + m)) / ((p0 + m + sg) - (p0 + m)) END AS value FROM vb")
RECURSIVE = f"WITH RECURSIVE {FRAME}, nb AS (SELECT *, row_number() OVER w AS i, CASE WHEN c1 IS NULL THEN h - l ELSE greatest(h - l, abs(h - c1), abs(l - c1)) END AS tr FROM fx {S})"
operand(
    "ema",
    {"ind": "ema", "n": 10},
    f"""{RECURSIVE}, e(instrument, i, value) AS (SELECT instrument, CAST(10 AS BIGINT), avg(c) FROM nb WHERE i <= 10 GROUP BY 1 HAVING count(*) = 10
UNION ALL SELECT nb.instrument, nb.i, (1 - 2.0 / 11) * e.value + 2.0 / 11 * nb.c FROM e JOIN nb ON nb.instrument = e.instrument AND nb.i = e.i + 1) SELECT nb.instrument, nb.t, e.value FROM nb LEFT JOIN e ON e.instrument = nb.instrument AND e.i = nb.i""",
)
operand(
    "atr_wilder",
    {"ind": "atr", "n": 14},
    f"""{RECURSIVE}, e(instrument, i, value) AS (SELECT instrument, CAST(14 AS BIGINT), avg(tr) FROM nb WHERE i <= 14 GROUP BY 1 HAVING count(*) = 14
UNION ALL SELECT nb.instrument, nb.i, (e.value * 13 + nb.tr) / 14 FROM e JOIN nb ON nb.instrument = e.instrument AND nb.i = e.i + 1) SELECT nb.instrument, nb.t, e.value FROM nb LEFT JOIN e ON e.instrument = nb.instrument AND e.i = nb.i""",
)
operand(
    "rsi_wilder",
    {"ind": "rsi", "n": 14},
    f"""{RECURSIVE}, e(instrument, i, u, d) AS (SELECT instrument, CAST(15 AS BIGINT), avg(greatest(c - c1, 0)), avg(greatest(c1 - c, 0)) FROM nb WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
UNION ALL SELECT nb.instrument, nb.i, (e.u * 13 + greatest(nb.c - nb.c1, 0)) / 14, (e.d * 13 + greatest(nb.c1 - nb.c, 0)) / 14 FROM e JOIN nb ON nb.instrument = e.instrument AND nb.i = e.i + 1)
SELECT nb.instrument, nb.t, CASE WHEN u = 0 AND d = 0 THEN 50.0 WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END AS value FROM nb LEFT JOIN e ON e.instrument = nb.instrument AND e.i = nb.i""",
)


# series that stop at rolls


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose prices go up by 1,000 on the twentieth day of the table, as an unadjusted roll would, with their segments."""
    bars = I.bars(spark, sf_dir)
    day = bars.agg((F.min("session") + 20).alias("_day"))
    jump = F.when(F.col("session") >= F.col("_day"), 1000.0).otherwise(0.0)
    bars = bars.crossJoin(F.broadcast(day)).withColumns({x: F.col(x) + jump for x in "ohlc"}).drop("_day")
    return B.segments(bars, 24)


ROLLED = f"""{BARS}, rb AS (SELECT instrument, t, session, sessmin, o + j AS o, h + j AS h, l + j AS l, c + j AS c, v, n FROM (SELECT *, CASE WHEN session >= (SELECT min(session) + 20 FROM bars) THEN 1000.0 ELSE 0.0 END AS j FROM bars)),
rd AS (SELECT instrument, session, arg_min(o, t) AS open, arg_max(c, t) AS close FROM rb GROUP BY 1, 2), rj AS (SELECT *, open - lag(close) OVER (PARTITION BY instrument ORDER BY session) AS jump FROM rd),
rm AS (SELECT instrument, quantile_cont(jump, 0.5) AS middle FROM rj WHERE jump IS NOT NULL GROUP BY 1), ra AS (SELECT rj.*, abs(jump - middle) AS away FROM rj LEFT JOIN rm USING (instrument)), rs AS (SELECT instrument, 1.4826 * quantile_cont(away, 0.5) AS scale FROM ra WHERE jump IS NOT NULL GROUP BY 1),
sg AS (SELECT instrument, session, CAST(coalesce(sum(CAST(coalesce(away > 8 * scale, false) AS BIGINT)) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS segment FROM ra LEFT JOIN rs USING (instrument)), sb AS (SELECT rb.*, segment FROM rb JOIN sg USING (instrument, session))"""


def segmented(name: str, spec, sql: str):
    """Register a query of one operand over bars with a roll."""

    @register(name, f"WITH RECURSIVE {ROLLED}{sql}")
    def query(spark, sf_dir, spec=spec):
        compiler = Compiler(rolled(spark, sf_dir), anchor=ANCHOR, expected=24)
        value = compiler.operand(spec)
        return compiler.frame.select("instrument", "t", "segment", r6(value, "value"))


X12S = "WINDOW x AS (PARTITION BY instrument, segment ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
segmented("segment_sma", {"ind": "sma", "n": 12}, f" SELECT instrument, t, segment, {r6_sql('CASE WHEN count(c) OVER x = 12 THEN avg(c) OVER x END', 'value')} FROM sb {X12S}")
segmented("segment_lag", {"ind": "close", "lag": 3}, f" SELECT instrument, t, segment, {r6_sql('lag(c, 3) OVER (PARTITION BY instrument, segment ORDER BY t)', 'value')} FROM sb")
segmented(
    "segment_ema",
    {"ind": "ema", "n": 10},
    f""", nb AS (SELECT *, row_number() OVER (PARTITION BY instrument, segment ORDER BY t) AS i FROM sb), e(instrument, segment, i, value) AS (SELECT instrument, segment, CAST(10 AS BIGINT), avg(c) FROM nb WHERE i <= 10 GROUP BY 1, 2 HAVING count(*) = 10
UNION ALL SELECT nb.instrument, nb.segment, nb.i, (1 - 2.0 / 11) * e.value + 2.0 / 11 * nb.c FROM e JOIN nb ON nb.instrument = e.instrument AND nb.segment = e.segment AND nb.i = e.i + 1) SELECT nb.instrument, nb.t, nb.segment, {r6_sql('e.value', 'value')} FROM nb LEFT JOIN e ON e.instrument = nb.instrument AND e.segment = nb.segment AND e.i = nb.i""",
)
segmented(
    "segment_atr",
    {"ind": "atr", "n": 14},
    f""", nb AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(c) OVER w IS NULL THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr FROM sb WINDOW w AS (PARTITION BY instrument, segment ORDER BY t)), e(instrument, segment, i, value) AS (SELECT instrument, segment, CAST(14 AS BIGINT), avg(tr) FROM nb WHERE i <= 14 GROUP BY 1, 2 HAVING count(*) = 14
UNION ALL SELECT nb.instrument, nb.segment, nb.i, (e.value * 13 + nb.tr) / 14 FROM e JOIN nb ON nb.instrument = e.instrument AND nb.segment = e.segment AND nb.i = e.i + 1) SELECT nb.instrument, nb.t, nb.segment, {r6_sql('e.value', 'value')} FROM nb LEFT JOIN e ON e.instrument = nb.instrument AND e.segment = nb.segment AND e.i = nb.i""",
)


# conditions


def condition(name: str, spec, sql: str, **more):
    """Register a query of one compiled condition: its three-valued truth on each bar."""

    @register(name, sql)
    def query(spark, sf_dir, spec=spec):
        compiler = frame(spark, sf_dir, **{k: f(spark, sf_dir) for k, f in more.items()})
        value = compiler.condition(spec)
        return compiler.frame.select("instrument", "t", value.alias("holds"))

    return query


SMA12 = "CASE WHEN count(c) OVER x = 12 THEN avg(c) OVER x END"
X12 = "WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
AVG = {"ind": "sma", "n": 12}
CROSSED = f"{FRAME}, s AS (SELECT *, {SMA12} AS m FROM fx {X12}), s1 AS (SELECT *, lag(m) OVER w AS m1 FROM s {S})"
condition("cond_cmp", {"cmp": ">", "a": "close", "b": AVG}, f"WITH {FRAME} SELECT instrument, t, c > {SMA12} AS holds FROM fx {X12}")
condition("cond_cross", {"cross": "up", "a": "close", "b": AVG}, f"WITH {CROSSED} SELECT instrument, t, CASE WHEN edge THEN false WHEN c1 IS NOT NULL AND m IS NOT NULL AND m1 IS NOT NULL THEN c1 <= m1 AND c > m END AS holds FROM s1")
condition("cond_touch", {"touch": "above", "level": AVG}, f"WITH {CROSSED} SELECT instrument, t, CASE WHEN edge THEN false WHEN m IS NOT NULL AND m1 IS NOT NULL AND c1 IS NOT NULL THEN l <= m AND c1 > m1 END AS holds FROM s1")
condition("cond_reject", {"reject": "above", "level": AVG}, f"WITH {CROSSED} SELECT instrument, t, CASE WHEN edge THEN false WHEN m IS NOT NULL AND m1 IS NOT NULL AND c1 IS NOT NULL THEN l <= m AND c1 > m1 AND c > m END AS holds FROM s1")
condition("cond_break", {"break": "down", "level": AVG}, f"WITH {CROSSED} SELECT instrument, t, CASE WHEN edge THEN false WHEN m IS NOT NULL AND m1 IS NOT NULL AND c1 IS NOT NULL THEN c < m AND c1 >= m1 END AS holds FROM s1")
condition("cond_bar", {"bar": "up"}, f"WITH {FRAME} SELECT instrument, t, c > o AS holds FROM fx")
condition("cond_time_wraps", {"time": [20, 6]}, f"WITH {FRAME} SELECT instrument, t, sessmin >= 20 OR sessmin < 6 AS holds FROM fx")
UP = {"cmp": ">", "a": "close", "b": AVG}
condition(
    "kleene_all_any_not",
    {"any": [{"all": [UP, {"bar": "up"}]}, {"not": {"any": [UP, {"bar": "down"}]}}]},
    f"WITH {CROSSED} SELECT instrument, t, (c > m AND c > o) OR NOT (c > m OR c < o) AS holds FROM s1",
)
FORN = f"{CROSSED}, q AS (SELECT *, CAST(c > m AS INTEGER) AS k FROM s1)"
X3 = "WINDOW x AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
condition("cond_for", {"for": 3, "cond": UP}, f"WITH {FORN} SELECT instrument, t, CASE WHEN coalesce(min(k) OVER x, 1) = 0 THEN false WHEN count(k) OVER x = 3 THEN true END AS holds FROM q {X3}")
condition("cond_within", {"within": 3, "cond": UP}, f"WITH {FORN} SELECT instrument, t, CASE WHEN coalesce(max(k) OVER x, 0) = 1 THEN true WHEN count(k) OVER x = 3 THEN false END AS holds FROM q {X3}")
condition(
    "cond_news_anti",
    {"news": 2, "before": 1, "after": 1},
    f"WITH {FRAME}, {NEWS} SELECT instrument, t, NOT EXISTS (SELECT 1 FROM news WHERE impact >= 2 AND news.t >= fx.t + 1 - 1 AND news.t <= fx.t + 1 + 1) AS holds FROM fx",
    news=news,
)
condition(
    "cond_news_anti_all",
    {"news": 2, "before": 1, "after": 1},
    f"WITH {FRAME}, {ALL_NEWS} SELECT instrument, t, NOT EXISTS (SELECT 1 FROM news WHERE impact >= 2 AND news.t >= fx.t + 1 - 1 AND news.t <= fx.t + 1 + 1) AS holds FROM fx",
    news=all_news,
)


@register("domain_filter", f"WITH {FRAME} SELECT instrument, t, anchored AND sessmin - 8 >= 2 AND sessmin + 1 >= 10 AND sessmin < 18 AND (session + 3) % 7 + 1 IN (1, 2, 3, 4) AS tradable, CASE WHEN lead(t) OVER w IS NULL OR lead(session) OVER w <> session THEN 1 WHEN lead(t) OVER w <> t + 1 THEN 2 ELSE 0 END AS status FROM fx {S}")
def domain_filter(spark, sf_dir):
    compiler = frame(spark, sf_dir)
    return compiler.frame.select("instrument", "t", compiler.domain(2, 10, 18, (1, 2, 3, 4)).alias("tradable"), compiler.executable().alias("status"))


@register(
    "signals",
    f"WITH {VWAP}, s AS (SELECT instrument, t, session, anchored, edge, l, c, o, c1, CASE WHEN anchored AND sg >= {TICK} THEN p0 + m - 1.0 * sg END AS b FROM vb), s1 AS (SELECT *, lag(b) OVER w AS b1 FROM s {S}) SELECT instrument, count(*) FILTER (anchored AND NOT edge AND l <= b AND c1 > b1 AND c > b) AS signals, count(*) AS bars FROM s1 GROUP BY 1",
)
def signals(spark, sf_dir):
    """Bars that dip to the band one deviation below the anchored mean price and close above it."""
    compiler = frame(spark, sf_dir)
    fired = compiler.signal({"setup": [], "trigger": {"reject": "above", "level": {"ind": "vwap", "k": -1}}})
    return compiler.frame.groupBy("instrument").agg(F.count_if(fired).alias("signals"), F.count(F.lit(1)).alias("bars"))


# joins


@register(
    "index_basis",
    f"""WITH {BARS}, fb AS (SELECT instrument, t, c AS price FROM bars WHERE instrument <> 'view'), ix AS (SELECT t, c AS index FROM bars WHERE instrument = 'view'),
j AS (SELECT fb.*, ix.t AS s, CASE WHEN fb.t - ix.t <= 2 THEN ix.index END AS index FROM fb ASOF LEFT JOIN ix ON fb.t >= ix.t),
k AS (SELECT *, price - index AS raw, count(price - index) OVER (PARTITION BY instrument ORDER BY t) AS kept FROM j),
m AS (SELECT instrument, kept, quantile_cont(raw, 0.5) OVER (PARTITION BY instrument ORDER BY kept ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS basis FROM k WHERE raw IS NOT NULL)
SELECT k.instrument, k.t, {r6_sql('raw', 'raw')}, k.kept, {r6_sql('basis', 'basis')} FROM k LEFT JOIN m ON m.instrument = k.instrument AND m.kept = k.kept""",
)
def index_basis(spark, sf_dir):
    """Each instrument's median distance from one of them, over the last thirty bars that had its price of two bars ago at most."""
    bars = I.bars(spark, sf_dir)
    found = J.aligned_basis(bars.where("instrument <> 'view'"), bars.where("instrument = 'view'"), ["instrument"], "t", "c", 2, 30)
    return found.select("instrument", "t", r6(F.col("raw"), "raw"), "kept", r6(F.col("basis"), "basis"))


@register(
    "asof_tolerance",
    """WITH l AS (SELECT event_type AS k, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec, max(value) AS x FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT l.k, l.event_id, l.sec, CASE WHEN l.sec - r.sec <= 1800 THEN r.x END AS x FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.sec >= r.sec""",
)
def asof_tolerance(spark, sf_dir):
    ticks = I.ticks(spark, sf_dir).select(F.col("instrument").alias("k"), "event_id", "sec", "price")
    right = ticks.where("event_id % 2 = 1").groupBy("k", "sec").agg(F.max("price").alias("x"))
    return J.as_of(ticks.where("event_id % 2 = 0").select("k", "event_id", "sec"), right, ["k"], "sec", ["x"], tolerance=1800)


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, instrument, status, lo (day number), len (days) of each order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("instrument"), F.col("o_orderstatus").alias("status"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("lo"), (F.col("o_custkey") % 20).alias("len"))


@register(
    "trial_overlap",
    """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS instrument, o_orderstatus AS status, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo, o_custkey % 20 AS len FROM orders),
p AS (SELECT id, instrument, lo, lo + len AS hi FROM o WHERE status = 'P'), q AS (SELECT id AS other, instrument, lo AS lo2, lo + len AS hi2 FROM o WHERE status = 'F') SELECT p.id, q.other FROM p JOIN q ON p.instrument = q.instrument AND p.lo <= q.hi2 AND q.lo2 <= p.hi""",
)
def trial_overlap(spark, sf_dir):
    """Every trial still pending with the finished ones of its instrument whose days meet its own."""
    o = order_spans(spark, sf_dir)
    p = o.where("status = 'P'").select("id", "instrument", "lo", (F.col("lo") + F.col("len")).alias("hi"))
    q = o.where("status = 'F'").select(F.col("id").alias("other"), "instrument", F.col("lo").alias("lo2"), (F.col("lo") + F.col("len")).alias("hi2"))
    return J.overlapping(p, q, ["instrument"], "lo", "hi", "lo2", "hi2", 32).select("id", "other")


@register(
    "trial_overlap_counts",
    """WITH o AS (SELECT row_number() OVER () AS n, o_orderkey AS id, o_orderpriority AS instrument, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo, o_custkey % 20 AS len FROM orders)
SELECT p.id, p.instrument, p.lo, p.lo + p.len AS hi, count(q.id) AS overlapping FROM o p LEFT JOIN o q ON p.n <> q.n AND p.instrument = q.instrument AND p.lo <= q.lo + q.len AND q.lo <= p.lo + p.len GROUP BY p.n, p.id, p.instrument, p.lo, p.len""",
)
def trial_overlap_counts(spark, sf_dir):
    """Every order with the number of other orders of its instrument whose days meet its own."""
    o = order_spans(spark, sf_dir).select("id", "instrument", "lo", (F.col("lo") + F.col("len")).alias("hi"))
    return J.overlap_counts(o, ["instrument"], "lo", "hi", "overlapping")


@register("consensus_window", "SELECT event_type AS instrument, event_id, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE -1 END) OVER w AS BIGINT) AS imbalance, count(*) OVER w AS calls FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")
def consensus_window(spark, sf_dir):
    w = W.partitionBy("instrument").orderBy("sec").rangeBetween(-7200, 0)
    side = F.when(F.col("price") >= 50, 1).otherwise(-1)
    return I.ticks(spark, sf_dir).select("instrument", "event_id", F.sum(side).over(w).cast("long").alias("imbalance"), F.count(F.lit(1)).over(w).alias("calls"))
