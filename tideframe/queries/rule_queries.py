"""Filters on daily bars, profile nodes, bands and regimes; joins and orders of side tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import inputs as I
from ..operators import joins as J
from ..operators import measures as M
from ..operators import rules as R
from ..registry import register
from .bar_queries import SESSIONS
from .common import r6, r6_all, r6_sql
from .trade_queries import T

BARS, TICKS = I.BARS_SQL, I.TICKS_SQL


def days(spark, sf_dir):
    return B.sessions(I.bars(spark, sf_dir), 24)


RULES = """dr AS (SELECT *, CASE WHEN close > lag(greatest(open, close)) OVER w THEN 1 WHEN close < lag(least(open, close)) OVER w THEN -1 ELSE 0 END AS continuation,
CASE WHEN greatest(open, close) - least(open, close) <= 0 THEN 0 WHEN high - greatest(open, close) >= 1.0 * (greatest(open, close) - least(open, close)) THEN -1 WHEN least(open, close) - low >= 1.0 * (greatest(open, close) - least(open, close)) THEN 1 ELSE 0 END AS rejection
FROM days WINDOW w AS (PARTITION BY instrument ORDER BY session))"""


@register("daily_rules", f"WITH {BARS}, {SESSIONS}, {RULES} SELECT instrument, session, continuation, rejection FROM dr")
def daily_rules(spark, sf_dir):
    return R.daily_rules(days(spark, sf_dir), ["instrument"], "session").select("instrument", "session", "continuation", "rejection")


NODES = f"""{BARS}, {SESSIONS}, pr AS (SELECT instrument, floor(price / 5.0) * 5.0 AS price, sum(size) AS volume FROM ticks GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY volume, price) AS k, count(*) OVER (PARTITION BY instrument) AS n FROM pr),
th AS (SELECT instrument, max(CASE WHEN k = floor(0.25 * (n - 1)) + 1 THEN volume END) AS lo, max(CASE WHEN k = floor(0.75 * (n - 1)) + 1 THEN volume END) AS hi FROM rk GROUP BY 1),
nd AS (SELECT rk.instrument, list(price) FILTER (volume <= lo) AS lows, list(price) FILTER (volume >= hi) AS highs, first(price ORDER BY volume DESC, price) AS poc FROM rk JOIN th USING (instrument) GROUP BY 1)"""


@register(
    "low_node_entries",
    f"""WITH {NODES} SELECT days.instrument, session, CASE WHEN session % 2 = 0 THEN 1 ELSE -1 END AS side, len(list_filter(lows, lambda x: abs(close - x) <= 2.0)) > 0 AND CASE WHEN session % 2 = 0 THEN close < poc AND len(list_filter(highs, lambda x: x < close)) > 0 ELSE close > poc AND len(list_filter(highs, lambda x: x > close)) > 0 END AS valid FROM days JOIN nd USING (instrument)""",
)
def low_node_entries(spark, sf_dir):
    """Whether each session's close may be entered, long on even sessions, against the volume profile of its instrument."""
    profile = I.ticks(spark, sf_dir).groupBy("instrument", (F.floor(F.col("price") / 5) * 5.0).alias("price")).agg(F.sum("size").alias("volume"))
    side = F.when(F.col("session") % 2 == 0, 1).otherwise(-1)
    rows = days(spark, sf_dir).join(R.node_levels(profile, ["instrument"], "price", "volume"), "instrument").withColumn("side", side)
    return rows.select("instrument", "session", "side", R.low_node_entry(F.col("close"), F.col("side"), 2.0).alias("valid"))


SESSION_VWAP = f"""{BARS}, sx AS (SELECT *, (h + l + c) / 3 AS p, first_value((h + l + c) / 3) OVER u AS p0, CASE WHEN (SELECT max(v) FROM bars) > 0 THEN greatest(v, 0.0) ELSE 1.0 END AS w FROM bars WINDOW u AS (PARTITION BY instrument, session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sm AS (SELECT *, sum(w) OVER u AS sw, sum(w * (p - p0)) OVER u AS s1, sum(w * (p - p0) * (p - p0)) OVER u AS s2 FROM sx WINDOW u AS (PARTITION BY instrument, session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sv AS (SELECT *, CASE WHEN sw > 0 THEN p0 + s1 / sw END AS vwap, CASE WHEN sw > 0 THEN CASE WHEN s2 / sw - (s1 / sw) * (s1 / sw) > 1e-12 THEN sqrt(s2 / sw - (s1 / sw) * (s1 / sw)) ELSE 0.0 END END AS sd FROM sm)"""


@register("session_vwap", f"WITH {SESSION_VWAP} SELECT instrument, t, {r6_sql('vwap', 'vwap', 9)}, {r6_sql('sd', 'sd', 9)} FROM sv")
def session_vwap(spark, sf_dir):
    return r6_all(M.session_vwap(I.bars(spark, sf_dir)).select("instrument", "t", "vwap", "sd"), "vwap", "sd", digits=9)


@register("day_vwap", f"WITH {BARS} SELECT instrument, session, {r6_sql('coalesce(CASE WHEN sum(v) > 0 THEN sum((o + h + l + c) / 4 * v) / sum(v) END, avg(c))', 'vwap', 9)} FROM bars GROUP BY 1, 2")
def day_vwap(spark, sf_dir):
    return r6_all(M.day_vwap(I.bars(spark, sf_dir)), "vwap", digits=9)


@register(
    "band_reversion",
    f"""WITH {SESSION_VWAP}, z AS (SELECT instrument, t, CASE WHEN sd > 0 THEN (c - vwap) / sd END AS z FROM sv), b AS (SELECT *, CASE WHEN abs(z) >= 3.0 THEN 3.0 WHEN abs(z) >= 2.5 THEN 2.5 WHEN abs(z) >= 2.0 THEN 2.0 WHEN abs(z) >= 1.5 THEN 1.5 END AS band FROM z)
SELECT instrument, t, CAST(band AS DOUBLE) AS band, CASE WHEN band <= 2.5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END END AS side FROM b""",
)
def band_reversion(spark, sf_dir):
    side, band = R.band_reversion(F.col("c"), F.col("vwap"), F.col("sd"))
    return M.session_vwap(I.bars(spark, sf_dir)).select("instrument", "t", band.alias("band"), side.alias("side"))


@register("persistence", f"WITH {BARS} SELECT instrument, t, {r6_sql('CASE WHEN p <= 0 THEN 0.0 WHEN p IS NOT NULL THEN v / p END', 'ratio')} FROM (SELECT *, lag(v) OVER (PARTITION BY instrument, session ORDER BY t) AS p FROM bars)")
def persistence(spark, sf_dir):
    before = F.lag("v").over(W.partitionBy("instrument", "session").orderBy("t"))
    return I.bars(spark, sf_dir).select("instrument", "t", r6(R.persistence(F.col("v"), before), "ratio"))


GAMMA = "gm AS (SELECT CAST(floor(sec / 86400.0) AS BIGINT) AS session, sum(CASE WHEN price > 50 THEN size ELSE -size END) AS gamma, avg(price) AS flip FROM ticks GROUP BY 1)"


def gamma(spark, sf_dir):
    """(session, gamma, flip) of all ticks: size above a price of 50 less size below it, and the mean price."""
    x = I.ticks(spark, sf_dir)
    return x.groupBy(F.floor(F.col("sec") / 86_400).alias("session")).agg(F.sum(F.when(F.col("price") > 50, F.col("size")).otherwise(-F.col("size"))).alias("gamma"), F.avg("price").alias("flip"))


REGIME = "CASE WHEN abs(CASE WHEN close > 0 THEN 100 * (close - flip) / close END) <= 5.0 THEN 'transition' WHEN gamma > 0 THEN 'reversion' WHEN gamma < 0 THEN 'momentum' ELSE 'transition' END"


@register("gamma_regime", f"WITH {BARS}, {SESSIONS}, {GAMMA} SELECT instrument, days.session, {REGIME} AS regime FROM days JOIN gm USING (session)")
def gamma_regime(spark, sf_dir):
    rows = days(spark, sf_dir).join(gamma(spark, sf_dir), "session")
    return rows.select("instrument", "session", R.gamma_regime(F.col("gamma"), F.col("close"), F.col("flip"), 5.0).alias("regime"))


@register("negative_gamma_sessions", f"WITH {BARS}, {SESSIONS}, {GAMMA} SELECT instrument, gamma < 0 AS negative, count(*) AS sessions, {r6_sql('avg(close - open)', 'mean_move')}, {r6_sql('avg(abs(close - open))', 'mean_size')} FROM days JOIN gm USING (session) GROUP BY 1, 2")
def negative_gamma_sessions(spark, sf_dir):
    """Moves of sessions joined with the gamma of their day, split by its sign."""
    rows = days(spark, sf_dir).join(gamma(spark, sf_dir), "session")
    move = F.col("close") - F.col("open")
    return rows.groupBy("instrument", (F.col("gamma") < 0).alias("negative")).agg(F.count(F.lit(1)).alias("sessions"), r6(F.avg(move), "mean_move"), r6(F.avg(F.abs(move)), "mean_size"))


@register(
    "confluence",
    f"""WITH {BARS}, {SESSIONS}, {RULES}, {GAMMA}, x AS (SELECT dr.instrument, dr.session, CAST(continuation = 1 AS INTEGER) + CAST(rejection = 1 AS INTEGER) + CAST(coalesce(gamma < 0, false) AS INTEGER) + CAST(high - low > 50 AS INTEGER) AS k FROM dr LEFT JOIN gm USING (session)) SELECT instrument, session, k / 4.0::DOUBLE AS score, k / 4.0 >= 0.5 AS passed FROM x""",
)
def confluence(spark, sf_dir):
    rows = R.daily_rules(days(spark, sf_dir), ["instrument"], "session").join(gamma(spark, sf_dir), "session", "left")
    score, passed = R.confluence([F.col("continuation") == 1, F.col("rejection") == 1, F.col("gamma") < 0, F.col("high") - F.col("low") > 50], 0.5)
    return rows.select("instrument", "session", score.alias("score"), passed.alias("passed"))


@register(
    "pivot_kinds",
    f"""WITH {BARS}, {SESSIONS}, s AS (SELECT instrument, session, true AS is_high, high AS price FROM days UNION ALL SELECT instrument, session, false, low FROM days), b AS (SELECT *, lag(price) OVER (PARTITION BY instrument, is_high ORDER BY session) AS p FROM s)
SELECT instrument, session, is_high, CASE WHEN p IS NULL THEN NULL WHEN is_high THEN CASE WHEN price > p THEN 'HH' ELSE 'LH' END WHEN price > p THEN 'HL' ELSE 'LL' END AS kind FROM b""",
)
def pivot_kinds(spark, sf_dir):
    """Every session's high and low against those of the session before."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("is_high"), F.col("high").alias("price")), F.struct(F.lit(False).alias("is_high"), F.col("low").alias("price"))))
    swings = days(spark, sf_dir).select("instrument", "session", both.alias("x")).select("instrument", "session", "x.is_high", "x.price")
    return R.pivot_kinds(swings, ["instrument"], "session").select("instrument", "session", "is_high", "kind")


@register(
    "window_rank",
    f"""WITH {BARS}, p AS (SELECT instrument, t, c, count(c) OVER w AS n, min(c) OVER w AS lo, max(c) OVER w AS hi, list(c) OVER w AS xs FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT instrument, t, {r6_sql('CASE WHEN n = 10 THEN CASE WHEN hi <= lo THEN 0.5 ELSE (c - lo) / (hi - lo) END END', 'rank')}, CASE WHEN n = 10 THEN len(list_filter(xs, lambda x: x < c)) / 10.0::DOUBLE END AS percentile FROM p""",
)
def window_rank(spark, sf_dir):
    return r6_all(R.window_rank(I.bars(spark, sf_dir), ["instrument"], "t", "c", 10).select("instrument", "t", "rank", "percentile"), "rank")


@register("half_width", f"SELECT p_partkey AS id, {r6_sql('CASE WHEN p_size % 5 > 0 THEN p_retailprice * (exp(sqrt(2 * ln(2.0)) * (p_size / 100.0::DOUBLE) * sqrt((p_size % 5) / 365.0::DOUBLE)) - 1) END', 'half_width')} FROM part")
def half_width(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), r6(R.half_width(F.col("p_retailprice").cast("double"), F.col("p_size") / 100.0, (F.col("p_size") % 5).cast("double")), "half_width"))


@register(
    "pivot_zones",
    f"""WITH {BARS}, z AS (SELECT instrument, t, h, l, v, count(*) OVER w AS n, max(h) OVER w AS hh, min(l) OVER w AS ll, avg(v) OVER m AS mv FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), m AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT instrument, t, CASE WHEN h = hh THEN 'high' ELSE 'low' END AS kind, CASE WHEN h = hh THEN h ELSE l END AS price FROM z WHERE n = 7 AND v >= 1.0 * mv AND (h = hh OR l = ll)""",
)
def pivot_zones(spark, sf_dir):
    """Bars that are extremes of the three bars on both sides, on at least the mean volume of the last twenty."""
    order = W.partitionBy("instrument").orderBy("t")
    near, past = order.rowsBetween(-3, 3), order.rowsBetween(-19, 0)
    rows = I.bars(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(near), "hh": F.max("h").over(near), "ll": F.min("l").over(near), "mv": F.avg("v").over(past)})
    high = F.col("h") == F.col("hh")
    return rows.where((F.col("n") == 7) & (F.col("v") >= F.col("mv")) & (high | (F.col("l") == F.col("ll")))).select("instrument", "t", F.when(high, "high").otherwise("low").alias("kind"), F.when(high, F.col("h")).otherwise(F.col("l")).alias("price"))


@register("rolling_dispersion", f"WITH {BARS}, {SESSIONS} SELECT instrument, session, {r6_sql('CASE WHEN count(close - open) OVER w = 5 THEN stddev_samp(close - open) OVER w END', 'dispersion')} FROM days WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def rolling_dispersion(spark, sf_dir):
    return r6_all(M.rolling_dispersion(days(spark, sf_dir), 5).select("instrument", "session", "dispersion"), "dispersion")


@register(
    "median_step_deviation",
    f"""WITH {BARS}, s AS (SELECT instrument, session, CASE WHEN t - lag(t) OVER w = 1 AND lag(sessmin) OVER w >= 4 AND sessmin < 22 THEN c - lag(c) OVER w END AS step FROM bars WINDOW w AS (PARTITION BY instrument, session ORDER BY t)),
d AS (SELECT instrument, session, stddev_samp(step) AS sd FROM s GROUP BY 1, 2 HAVING count(step) >= 2) SELECT instrument, {r6_sql('quantile_cont(sd, 0.5)', 'sigma')}, count(*) AS sessions FROM d GROUP BY 1""",
)
def median_step_deviation(spark, sf_dir):
    return r6_all(M.median_step_deviation(I.bars(spark, sf_dir), 4, 22), "sigma")


@register("trigger_rate", f"WITH {BARS}, e AS (SELECT instrument, count(DISTINCT session) AS sessions, count(DISTINCT session) FILTER (h - l > 90) AS traded FROM bars GROUP BY 1) SELECT instrument, traded, sessions, traded / CAST(sessions AS DOUBLE) AS rate FROM e")
def trigger_rate(spark, sf_dir):
    bars = I.bars(spark, sf_dir)
    return M.trigger_rate(bars.where("h - l > 90"), bars)


SCALE = f"""{I.TICKS_SQL}, {I.bars_sql(600)}, b AS (SELECT *, count(*) FILTER (v > 0) OVER u AS used, min(l) FILTER (v > 0) OVER u AS lo, max(h) FILTER (v > 0) OVER u AS hi, sum(v) FILTER (v > 0) OVER u AS total, max(t) FILTER (v > 0) OVER u AS lt FROM bars WINDOW u AS (PARTITION BY instrument, session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT b.*, k.c AS lc FROM b LEFT JOIN bars k ON k.instrument = b.instrument AND k.t = b.lt),
g AS (SELECT q.instrument, q.session, q.t, max(q.total) AS total, sum(j.v) AS mine FROM q JOIN bars j ON j.instrument = q.instrument AND j.session = q.session AND j.t <= q.t AND j.v > 0 WHERE q.used >= 10 AND q.hi > q.lo
 AND least(9, greatest(0, CAST(trunc((j.c - q.lo) / ((q.hi - q.lo) / 10)) AS BIGINT))) = least(9, greatest(0, CAST(trunc((q.lc - q.lo) / ((q.hi - q.lo) / 10)) AS BIGINT))) GROUP BY 1, 2, 3)"""


@register("local_scale", f"WITH {SCALE} SELECT bars.instrument, bars.session, bars.t, {r6_sql('CASE WHEN mine IS NULL THEN 1.0 ELSE least(1.8, greatest(0.6, sqrt(1 / 10.0::DOUBLE / (mine / total)))) END', 'scale')} FROM bars LEFT JOIN g ON g.instrument = bars.instrument AND g.t = bars.t")
def local_scale(spark, sf_dir):
    """Scale of a stop at each bar of ten minutes, by ten price bins of the session's volume so far."""
    return r6_all(M.local_scale(I.bars(spark, sf_dir, 600), 10), "scale")


@register("excursions", f"WITH {BARS}, {SESSIONS}, x AS (SELECT instrument, close - open AS points, low - open AS mae, high - open AS mfe FROM days) SELECT instrument, count(*) AS n, {r6_sql('avg(mae)', 'mae')}, {r6_sql('avg(mfe)', 'mfe')}, {r6_sql('sum(points) / nullif(sum(mfe), 0)', 'kept')}, {r6_sql('quantile_cont(mae, 0.1)', 'mae10')} FROM x GROUP BY 1")
def excursions(spark, sf_dir):
    """Every session as a trade from its open to its close."""
    x = days(spark, sf_dir).select("instrument", (F.col("close") - F.col("open")).alias("points"), (F.col("low") - F.col("open")).alias("mae"), (F.col("high") - F.col("open")).alias("mfe"))
    return r6_all(M.excursions(x, ["instrument"]), "mae", "mfe", "kept", "mae10")


@register("result_flows", f"WITH {T} SELECT setup AS source, reason AS target, count(*) AS n, CAST(sum(pnl4) AS BIGINT) AS total FROM trades GROUP BY 1, 2")
def result_flows(spark, sf_dir):
    return M.flows(I.trades(spark, sf_dir), "setup", "reason", "pnl4")


@register(
    "downsample",
    f"""WITH {BARS}, r AS (SELECT instrument, t, c, row_number() OVER (PARTITION BY instrument ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM bars), k AS (SELECT *, i * 20 // n AS run FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY instrument, run ORDER BY i) AS a, row_number() OVER (PARTITION BY instrument, run ORDER BY i DESC) AS b, row_number() OVER (PARTITION BY instrument, run ORDER BY c, i) AS lo, row_number() OVER (PARTITION BY instrument, run ORDER BY c DESC, i) AS hi FROM k)
SELECT instrument, CAST(run AS BIGINT) AS run, t, c FROM p WHERE a = 1 OR b = 1 OR lo = 1 OR hi = 1""",
)
def downsample(spark, sf_dir):
    return M.downsample(I.bars(spark, sf_dir), ["instrument"], "t", "c", 20)


# joins, sets and orders of side tables


@register("journal_followup", f"WITH {T}, s AS (SELECT setup, CAST(floor(avg(day)) AS BIGINT) AS sealed FROM trades WHERE conviction = 1 GROUP BY 1) SELECT setup, side, count(*) AS n, CAST(sum(pnl4) AS BIGINT) AS net4 FROM trades SEMI JOIN s ON trades.setup = s.setup AND trades.day > s.sealed GROUP BY 1, 2")
def journal_followup(spark, sf_dir):
    """Trades of each setup made after the day its plan was sealed."""
    x = I.trades(spark, sf_dir)
    sealed = x.where("conviction = 1").groupBy("setup").agg(F.floor(F.avg("day")).alias("sealed"))
    return J.after_seal(x, sealed, ["setup"], "day", "sealed").groupBy("setup", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl4").alias("net4"))


@register(
    "calendar_groups",
    f"WITH {TICKS}, d AS (SELECT instrument, CAST(floor(sec / 86400.0) AS BIGINT) AS day, count(*) AS n, min(sec) AS first_sec FROM ticks GROUP BY 1, 2) SELECT instrument, day, n, lead(first_sec) OVER (PARTITION BY instrument ORDER BY day) - first_sec AS to_next FROM d",
)
def calendar_groups(spark, sf_dir):
    """Events by day, and the seconds from a day's first event to that of the next day with events."""
    d = I.ticks(spark, sf_dir).groupBy("instrument", F.floor(F.col("sec") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"))
    return d.select("instrument", "day", "n", (F.lead("first_sec").over(W.partitionBy("instrument").orderBy("day")) - F.col("first_sec")).alias("to_next"))


@register(
    "paired_sessions",
    f"""WITH {BARS}, {SESSIONS}, a AS (SELECT * FROM days WHERE instrument = 'view' AND n_bars > 1), b AS (SELECT * FROM days WHERE instrument = 'click' AND n_bars > 1)
SELECT coalesce(a.session, b.session) AS session, CASE WHEN b.session IS NULL THEN 'left only' WHEN a.session IS NULL THEN 'right only' ELSE 'paired' END AS state, {r6_sql('(a.close - a.open) - (b.close - b.open)', 'difference')} FROM a FULL JOIN b ON a.session = b.session""",
)
def paired_sessions(spark, sf_dir):
    """Moves of two series paired by session, with what is on one side only."""
    d = days(spark, sf_dir).where("n_bars > 1").select("instrument", "session", (F.col("close") - F.col("open")).alias("move"))
    made = J.paired(d.where("instrument = 'view'").select("session", "move"), d.where("instrument = 'click'").select("session", "move"), ["session"], "move")
    return r6_all(made, "difference")


@register("group_order", f"WITH {T}, g AS (SELECT CASE WHEN conviction = 7 THEN '—' ELSE CAST(conviction AS VARCHAR) END AS value, count(*) AS n FROM trades GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY value = '—', n DESC, value) AS place FROM g")
def group_order(spark, sf_dir):
    """Groups by size, the unnamed one last (a row a group: few)."""
    g = I.trades(spark, sf_dir).groupBy(F.when(F.col("conviction") == 7, "—").otherwise(F.col("conviction").cast("string")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("value", "n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("value") == "—", F.desc("n"), "value")).cast("long").alias("place"))


@register("event_order", f"WITH {TICKS} SELECT event_id, CAST(floor(sec / 86400.0) AS BIGINT) AS day, row_number() OVER (PARTITION BY CAST(floor(sec / 86400.0) AS BIGINT) ORDER BY sec, price DESC, event_id) AS place FROM ticks")
def event_order(spark, sf_dir):
    """Place of each event in its day: by time, the greater first, then by id."""
    x = I.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("sec") / 86_400))
    return x.select("event_id", "day", F.row_number().over(W.partitionBy("day").orderBy("sec", F.desc("price"), "event_id")).cast("long").alias("place"))


@register("shared_nodes", "SELECT l_partkey AS node FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def shared_nodes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_partkey").alias("node")).intersect(li.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("node")))


@register("candidate_registry", "SELECT p_type AS family, count(*) AS candidates, min(p_partkey) AS first FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size <= 25 GROUP BY 1")
def candidate_registry(spark, sf_dir):
    """Candidates within a mandate and a cost, by family: one published several times stays one piece."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    mandate = p.agg(F.min("p_brand").alias("p_brand"))  # one row
    return p.where("p_size <= 25").join(F.broadcast(mandate), "p_brand", "left_semi").groupBy(F.col("p_type").alias("family")).agg(F.count(F.lit(1)).alias("candidates"), F.min("p_partkey").alias("first"))


# seeded draws that SQL can repeat


def draw_sql(seed: str) -> str:
    return f"(({seed}) * 48271 % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647 / 2147483647.0::DOUBLE)"


SIGN = "(k1 * 31 + k3 * 17 + draw * 1000003) % 2147483646 + 1"


@register(
    "sign_permutation",
    f"""WITH {T}, x AS (SELECT setup, draw, pnl4, CASE WHEN draw = 0 OR {draw_sql(SIGN)} < 0.5 THEN pnl4 ELSE -pnl4 END AS y FROM trades, range(0, 21) t(draw)), s AS (SELECT setup, draw, sum(y) AS total FROM x GROUP BY 1, 2)
SELECT a.setup, CAST(max(a.total) AS BIGINT) AS total, (1 + count(*) FILTER (b.total >= a.total)) / 21.0::DOUBLE AS p FROM s a JOIN s b ON a.setup = b.setup AND a.draw = 0 AND b.draw > 0 GROUP BY 1""",
)
def sign_permutation(spark, sf_dir):
    """Each setup's total against twenty draws of random signs."""
    from ..operators import resampling

    return resampling.sign_permutation(I.trades(spark, sf_dir), ["setup"], "pnl4", F.col("k1") * 31 + F.col("k3") * 17, 20)


@register(
    "purged_folds",
    f"""WITH {T}, d AS (SELECT day, sum(pnl4) / 1e4 AS x FROM trades GROUP BY 1), b AS (SELECT *, (row_number() OVER (ORDER BY day) - 1) * 5 // count(*) OVER () AS fold FROM d), e AS (SELECT fold, min(day) AS lo, max(day) AS hi FROM b GROUP BY 1)
SELECT CAST(e.fold AS INTEGER) AS fold, count(*) FILTER (b.fold = e.fold) AS test_days, count(*) FILTER (b.day < lo - 7 OR b.day > hi + 14) AS train_days, {r6_sql('avg(x) FILTER (b.fold = e.fold)', 'test_mean', 3)}, {r6_sql('avg(x) FILTER (b.day < lo - 7 OR b.day > hi + 14)', 'train_mean', 3)} FROM e, b GROUP BY 1""",
)
def purged_folds(spark, sf_dir):
    """Five folds of days in order; training leaves out a week before a fold and two weeks after it."""
    from ..operators import search

    d = I.trades(spark, sf_dir).groupBy("day").agg((F.sum("pnl4") / 1e4).alias("x"))
    return r6_all(search.purged_folds(d, "day", "x", 5, 7, 14), "test_mean", "train_mean", digits=3)


@register("noise_trades")
def noise_trades(spark, sf_dir):
    """Trades of the noise-band rule, calibrated on the five sessions before each; a path, held by tests to a plain walk."""
    bars = I.bars(spark, sf_dir)
    sigma = M.rolling_dispersion(B.sessions(bars, 24), 5).select("instrument", "session", (F.col("dispersion") / F.sqrt(F.lit(24.0))).alias("sigma"))
    return r6_all(M.noise_trades(bars, sigma, 4, 22), "entry", "stop", "exit")


@register("band_trades")
def band_trades(spark, sf_dir):
    """Trades from the band of the session's mean back to it; a path, held by tests to a plain walk."""
    return r6_all(M.band_trades(M.session_vwap(I.bars(spark, sf_dir)), 1.5, 3.0, lo=4, hi=22, warm=2), "entry", "stop", "exit", "points")
