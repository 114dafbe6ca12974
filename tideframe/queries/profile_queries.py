"""Profiles by price, footprints and option exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import closed_forms as cf
from ..functions import normal
from ..operators import inputs as I
from ..operators import profiles as P
from ..registry import register
from .common import r6, r6_all, r6_sql

TK = f"{I.TICKS_SQL}, tk AS (SELECT *, CAST(floor(sec / 86400.0) AS BIGINT) AS session FROM ticks)"
VP = f"{TK}, vp AS (SELECT instrument, session, CAST(floor(price / 10.0) AS BIGINT) AS bin, sum(size) AS volume FROM tk GROUP BY 1, 2, 3)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = I.ticks(spark, sf_dir).withColumn("session", F.floor(F.col("sec") / 86_400))
    return P.volume_by_price(ticks, ["instrument", "session"], "price", "size", 10.0)


@register("volume_profile", f"WITH {VP} SELECT * FROM vp")
def volume_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@register("volume_poc", f"WITH {VP} SELECT instrument, session, min(bin) FILTER (volume = m) AS poc, sum(volume) AS total, count(*) AS bins FROM (SELECT *, max(volume) OVER (PARTITION BY instrument, session) AS m FROM vp) GROUP BY 1, 2")
def volume_poc(spark, sf_dir):
    return P.point_of_control(profile(spark, sf_dir), ["instrument", "session"])


@register("profile_composite", f"WITH {VP} SELECT instrument, bin, sum(volume) AS volume, count(*) AS sessions FROM vp GROUP BY 1, 2")
def profile_composite(spark, sf_dir):
    return profile(spark, sf_dir).groupBy("instrument", "bin").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("sessions"))


@register("profile_nodes", f"""WITH {VP}, n AS (SELECT *, lag(volume) OVER w AS b, lead(volume) OVER w AS a FROM vp WINDOW w AS (PARTITION BY instrument, session ORDER BY bin)), k AS (SELECT instrument, session, bin, volume, CASE WHEN volume > b AND volume >= a THEN 'high' WHEN volume < b AND volume <= a THEN 'low' END AS node FROM n) SELECT * FROM k WHERE node IS NOT NULL""")
def profile_nodes(spark, sf_dir):
    return P.nodes(profile(spark, sf_dir), ["instrument", "session"])


FINE = 2.0
VF = f"{TK}, vp AS (SELECT instrument, session, CAST(floor(price / {FINE}) AS BIGINT) AS bin, sum(size) AS volume FROM tk GROUP BY 1, 2, 3), en AS (SELECT instrument, session, min(bin) AS low, max(bin) AS high, max(volume) AS most, sum(volume) / (max(bin) - min(bin) + 1) AS mean FROM vp GROUP BY 1, 2)"
#: Every bin between a profile's ends.
DENSE = f"{VF}, gr AS (SELECT *, unnest(range(low, high + 1)) AS bin FROM en), pr AS (SELECT gr.*, coalesce(volume, 0.0) AS volume FROM gr LEFT JOIN vp USING (instrument, session, bin))"


def fine_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = I.ticks(spark, sf_dir).withColumn("session", F.floor(F.col("sec") / 86_400))
    return P.volume_by_price(ticks, ["instrument", "session"], "price", "size", FINE)


def _prominent_sql(node: str, sign: str) -> str:
    """Peaks of sign * volume: the nearest greater bins by a join with the profile, then the saddles up to them."""
    return f"""ca AS (SELECT * FROM (SELECT *, {sign}volume AS x, {sign}lag(volume) OVER w AS b, {sign}lead(volume) OVER w AS a FROM pr WINDOW w AS (PARTITION BY instrument, session ORDER BY bin)) WHERE x >= b AND x >= a AND (x > b OR x > a)),
ne AS (SELECT c.instrument, c.session, c.bin, any_value(c.x) AS x, any_value(c.most) AS most, any_value(c.mean) AS mean, coalesce(max(p.bin) FILTER (p.bin < c.bin AND {sign}p.volume > c.x), any_value(c.low) - 1) AS l, coalesce(min(p.bin) FILTER (p.bin > c.bin AND {sign}p.volume > c.x), any_value(c.high) + 1) AS r FROM ca c JOIN pr p USING (instrument, session) GROUP BY 1, 2, 3),
sa AS (SELECT n.instrument, n.session, n.bin, any_value(n.x) AS x, any_value(most) AS most, any_value(mean) AS mean, min({sign}p.volume) FILTER (p.bin > l AND p.bin <= n.bin) AS sl, min({sign}p.volume) FILTER (p.bin < r AND p.bin >= n.bin) AS sr FROM ne n JOIN (SELECT instrument, session, bin, volume FROM pr) p USING (instrument, session) GROUP BY 1, 2, 3)
SELECT instrument, session, bin, '{node}' AS node, {sign}x AS volume, x - greatest(sl, sr) AS prominence, mean FROM sa WHERE x - greatest(sl, sr) >= 0.05 * most"""


@register(
    "profile_prominence",
    f"WITH {DENSE}, hi AS (WITH {_prominent_sql('high', '')}), lo AS (WITH {_prominent_sql('low', '-')}) SELECT instrument, session, bin, node, volume, {r6_sql('prominence', 'prominence')}, {r6_sql('CASE WHEN volume > 0 THEN least(sqrt(mean / volume), 4.0) ELSE 4.0 END', 'sigma')} FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)",
)
def profile_prominence(spark, sf_dir):
    """Nodes of each session's profile by prominence, with the local deviation there."""
    profile, keys = fine_profile(spark, sf_dir), ["instrument", "session"]
    nodes = P.prominent_nodes(profile, keys).join(P.profile_means(profile, keys), keys)
    return nodes.select(*keys, "bin", "node", "volume", r6(F.col("prominence"), "prominence"), r6(P.local_sigma(F.col("volume"), F.col("mean_volume")), "sigma"))


@register(
    "profile_traversal",
    f"""WITH {DENSE}, pc AS (SELECT instrument, session, min(bin) FILTER (volume = m) AS poc FROM (SELECT *, max(volume) OVER (PARTITION BY instrument, session) AS m FROM vp) GROUP BY 1, 2),
sp AS (SELECT instrument, session, low AS start, poc AS stop FROM en JOIN pc USING (instrument, session) UNION ALL SELECT instrument, session, high, poc FROM en JOIN pc USING (instrument, session))
SELECT instrument, session, start, stop, {r6_sql(f'sum(power({FINE} / 0.5 / CASE WHEN volume > 0 THEN least(sqrt(mean / volume), 4.0) ELSE 4.0 END, 2))', 'minutes')} FROM (SELECT DISTINCT * FROM sp) sp JOIN pr USING (instrument, session) WHERE bin BETWEEN least(start, stop) AND greatest(start, stop) GROUP BY 1, 2, 3, 4""",
)
def profile_traversal(spark, sf_dir):
    """Mean times from either end of a session's profile to its point of control."""
    profile, keys = fine_profile(spark, sf_dir), ["instrument", "session"]
    ends = P.profile_means(profile, keys).join(P.point_of_control(profile, keys), keys)
    spans = ends.select(*keys, F.explode(F.array("low", "high")).alias("start"), F.col("poc").alias("stop")).distinct()
    return r6_all(P.traversal_times(profile, spans, keys, FINE, 0.5), "minutes")


@register("value_area")
def value_area(spark, sf_dir):
    """Value areas; the growth from the point of control is a path, so tests hold it against a plain loop."""
    return P.value_area(profile(spark, sf_dir), ["instrument", "session"])


MP = f"{I.BARS_SQL}, mp AS (SELECT instrument, session, level, count(DISTINCT sessmin) AS periods FROM (SELECT *, unnest(range(CAST(floor(l / 10.0) AS BIGINT), CAST(floor(h / 10.0) AS BIGINT) + 1)) AS level FROM bars) GROUP BY 1, 2, 3)"


@register("tpo_profile", f"WITH {MP} SELECT * FROM mp")
def tpo_profile(spark, sf_dir):
    return P.market_profile(I.bars(spark, sf_dir), ["instrument", "session"], "sessmin", 10.0)


@register(
    "tpo_summary",
    f"""WITH {MP}, e AS (SELECT instrument, session, min(level) AS low, max(level) AS high, max(periods) AS most, count(*) FILTER (periods = 1) AS single_prints FROM mp GROUP BY 1, 2),
p AS (SELECT instrument, session, level, row_number() OVER (PARTITION BY instrument, session ORDER BY abs(2 * level - low - high), level) AS k FROM mp JOIN e USING (instrument, session) WHERE periods = most),
f AS (SELECT *, min(sessmin) OVER (PARTITION BY instrument, session) AS f FROM bars), b AS (SELECT instrument, session, CAST(floor(min(l) / 10.0) AS BIGINT) AS balance_low, CAST(floor(max(h) / 10.0) AS BIGINT) AS balance_high FROM f WHERE sessmin <= f + 1 GROUP BY 1, 2)
SELECT instrument, session, low, high, single_prints, level AS poc, balance_low, balance_high, low < balance_low OR high > balance_high AS extended FROM e JOIN p USING (instrument, session) JOIN b USING (instrument, session) WHERE k = 1""",
)
def tpo_summary(spark, sf_dir):
    return P.market_profile_summary(I.bars(spark, sf_dir), ["instrument", "session"], "sessmin", 10.0)


FP = f"""{I.TICKS_SQL}, fp AS (SELECT instrument, CAST(floor(sec / 14400.0) AS BIGINT) AS bar, CAST(floor(price / 10.0) AS BIGINT) AS level, sum(CASE WHEN event_id % 2 = 0 THEN size ELSE 0.0 END) AS bid, sum(CASE WHEN event_id % 2 = 1 THEN size ELSE 0.0 END) AS ask FROM ticks GROUP BY 1, 2, 3)"""


@register(
    "footprint_imbalance",
    f"""WITH {FP}, n AS (SELECT *, lag(bid) OVER w AS bb, lead(ask) OVER w AS aa FROM fp WINDOW w AS (PARTITION BY instrument, bar ORDER BY level)), m AS (SELECT *, max(bid + ask) OVER (PARTITION BY instrument, bar) AS mx FROM n)
SELECT instrument, bar, sum(bid + ask) AS volume, sum(ask - bid) AS delta, min(level) FILTER (bid + ask = mx) AS poc, count(*) FILTER (ask >= 10 AND ask >= 3 * bb) AS buy_imbalances, count(*) FILTER (bid >= 10 AND bid >= 3 * aa) AS sell_imbalances FROM m GROUP BY 1, 2""",
)
def footprint_imbalance(spark, sf_dir):
    ticks = I.ticks(spark, sf_dir)
    part = lambda k: F.sum(F.when(F.col("event_id") % 2 == k, F.col("size")).otherwise(0.0))
    cells = ticks.groupBy("instrument", F.floor(F.col("sec") / 14_400).alias("bar"), F.floor(F.col("price") / 10.0).alias("level")).agg(part(0).alias("bid"), part(1).alias("ask"))
    return P.footprint(cells, ["instrument", "bar"])


@register("tpo_poor_ends", f"WITH {MP} SELECT instrument, session, arg_max(periods, level) >= 2 AS poor_high, arg_min(periods, level) >= 2 AS poor_low FROM mp GROUP BY 1, 2")
def tpo_poor_ends(spark, sf_dir):
    return P.poor_ends(P.market_profile(I.bars(spark, sf_dir), ["instrument", "session"], "sessmin", 10.0), ["instrument", "session"])


@register(
    "absorption",
    f"""WITH {FP}, s AS (SELECT instrument, bar, sum(bid + ask) AS volume, sum(ask - bid) AS delta FROM fp GROUP BY 1, 2), b AS (SELECT instrument, CAST(floor(sec / 14400.0) AS BIGINT) AS bar, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c FROM ticks GROUP BY 1, 2),
e AS (SELECT *, volume / (h - l + 1) AS effort FROM b JOIN s USING (instrument, bar)) SELECT instrument, bar, volume, delta, {r6_sql('(effort - avg(effort) OVER p) / nullif(stddev_samp(effort) OVER p, 0)', 'z')}, CASE WHEN c <> o THEN sign(delta) = -sign(c - o) ELSE false END AS absorbed FROM e WINDOW p AS (PARTITION BY instrument ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def absorption(spark, sf_dir):
    """Effort and result of bars of four hours, by the ladder of their ticks."""
    ticks = I.ticks(spark, sf_dir)
    part = lambda k: F.sum(F.when(F.col("event_id") % 2 == k, F.col("size")).otherwise(0.0))
    cells = ticks.groupBy("instrument", F.floor(F.col("sec") / 14_400).alias("bar"), F.floor(F.col("price") / 10.0).alias("level")).agg(part(0).alias("bid"), part(1).alias("ask"))
    bars = I.bars(spark, sf_dir, 14_400).select("instrument", F.col("t").alias("bar"), "o", "h", "l", "c")
    return r6_all(P.absorption(cells, bars, ["instrument", "bar"], ["instrument"], "bar"), "z")


def _chance_sql(low: str) -> str:
    """The null chance of an imbalance in clumps of five, as a double sum over binomials."""
    n, m = "CAST(round_even(v / 5, 0) AS BIGINT)", f"CAST(round_even({low} / 5, 0) AS BIGINT)"
    binomial = lambda n, k: f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) - {n} * ln(2))"
    inner = f"list_sum(list_transform(range(0, CAST(least({m}, floor(a / 3.0)) AS BIGINT) + 1), lambda b: {binomial(m, 'b')}))"
    return f"CASE WHEN {low} IS NULL THEN 0.0 ELSE coalesce(list_sum(list_transform(list_filter(range(0, {n} + 1), lambda a: a * 5 >= 10 AND a >= 3), lambda a: {binomial(n, 'a')} * {inner})), 0.0) END"


@register(
    "footprint_null",
    f"""WITH {FP}, b AS (SELECT instrument, CAST(floor(sec / 14400.0) AS BIGINT) AS bar, arg_min(price, ts) AS o, arg_max(price, ts) AS c FROM ticks GROUP BY 1, 2),
n AS (SELECT *, bid + ask AS v, lag(bid) OVER w AS bb, lead(ask) OVER w AS aa, lag(bid + ask) OVER w AS vb, lead(bid + ask) OVER w AS va FROM fp WINDOW w AS (PARTITION BY instrument, bar ORDER BY level)),
e AS (SELECT *, {_chance_sql('vb')} AS p, {_chance_sql('va')} AS q FROM n),
g AS (SELECT instrument, bar, count(*) FILTER (ask >= 10 AND ask >= 3 * greatest(bb, 1)) + count(*) FILTER (bid >= 10 AND bid >= 3 * greatest(aa, 1)) AS imbalances, sum(p + q) AS expected, arg_max(v, level) / nullif(quantile_cont(v, 0.5), 0) AS eh, arg_min(v, level) / nullif(quantile_cont(v, 0.5), 0) AS el, sum(v) AS s FROM e GROUP BY 1, 2),
z AS (SELECT *, (c - o) / (2.0 * sqrt(greatest(s, 1))) AS z FROM g JOIN b USING (instrument, bar))
SELECT instrument, bar, imbalances, {r6_sql('expected + 1e-9', 'expected')}, {r6_sql('eh', 'exhaustion_high')}, {r6_sql('el', 'exhaustion_low')}, {r6_sql('z', 'impact_z')}, {r6_sql('2 * ' + normal.cdf_sql('abs(z)') + ' - 1', 'absorption_p')} FROM z""",
)
def footprint_null(spark, sf_dir):
    """Imbalances of four-hour ladders against chance, exhausted ends and absorbed moves."""
    ticks = I.ticks(spark, sf_dir)
    part = lambda k: F.sum(F.when(F.col("event_id") % 2 == k, F.col("size")).otherwise(0.0))
    cells = ticks.groupBy("instrument", F.floor(F.col("sec") / 14_400).alias("bar"), F.floor(F.col("price") / 10.0).alias("level")).agg(part(0).alias("bid"), part(1).alias("ask"))
    bars = I.bars(spark, sf_dir, 14_400).select("instrument", F.col("t").alias("bar"), "o", "c")
    found = P.footprint_null(cells, bars, ["instrument", "bar"], clump=5.0, impact=2.0)
    # sums of even coins' chances often end in a five, so they are rounded a little above it
    return r6_all(found.withColumn("expected", F.col("expected") + 1e-9), "expected", "exhaustion_high", "exhaustion_low", "impact_z", "absorption_p")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option chain made of parts: a chain a brand, spot 1500, strikes by price, volatility and interest by size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_brand").alias("root"), F.lit(1500.0).alias("spot"), (F.floor(F.col("p_retailprice") / 50) * 50.0 + 50).alias("strike"), (0.1 + F.col("p_size") / 100).alias("iv"), F.lit(0.25).alias("time"),
        F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("kind"), F.col("p_size").cast("double").alias("open_interest"),
    )


CHAIN = """ch AS (SELECT p_brand AS root, 1500.0::DOUBLE AS spot, floor(p_retailprice / 50) * 50.0 + 50 AS strike, 0.1::DOUBLE + p_size / 100.0::DOUBLE AS iv, 0.25::DOUBLE AS time, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CAST(p_size AS DOUBLE) AS open_interest FROM part),
gm AS (SELECT *, (ln(spot / strike) + iv * iv * time / 2) / (iv * sqrt(time)) AS d1 FROM ch), gx AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * iv * sqrt(time)) AS gamma FROM gm),
ge AS (SELECT root, strike, sum(CASE WHEN kind = 'call' THEN 1 ELSE -1 END * gamma * open_interest * 100.0 * spot * spot * 0.01) AS gex FROM gx GROUP BY 1, 2)"""


@register("gex_by_strike", f"WITH {CHAIN} SELECT root, strike, {r6_sql('gex', 'gex', 4)} FROM ge")
def gex_by_strike(spark, sf_dir):
    return r6_all(P.gamma_exposure(chain(spark, sf_dir), ["root"]), "gex", digits=4)


@register("gex_walls", f"WITH {CHAIN}, s AS (SELECT *, CASE WHEN gex > 0 THEN 'call' WHEN gex < 0 THEN 'put' END AS side FROM ge), k AS (SELECT root, strike, {r6_sql('gex', 'gex', 4)}, side, CAST(row_number() OVER (PARTITION BY root, side ORDER BY abs(gex) DESC, strike) AS INTEGER) AS rank FROM s WHERE side IS NOT NULL) SELECT * FROM k WHERE rank <= 3")
def gex_walls(spark, sf_dir):
    return r6_all(P.walls(P.gamma_exposure(chain(spark, sf_dir), ["root"]), ["root"], 3), "gex", digits=4)


@register("zero_gamma")
def zero_gamma(spark, sf_dir):
    """Spot of no net exposure, on a grid; tests hold it against the sign of the sums."""
    return r6_all(P.zero_gamma(chain(spark, sf_dir), ["root"]), "zero_gamma", digits=4)


@register("option_greeks", f"WITH {CHAIN}, g AS (SELECT *, spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(time) AS vega, d1 - iv * sqrt(time) AS d2 FROM gx) SELECT root, strike, kind, iv, {r6_sql('gamma', 'gamma', 9)}, {r6_sql('vega', 'vega')}, {r6_sql('-iv * iv * spot * spot * gamma / 2', 'theta')}, {r6_sql('-exp(-d1 * d1 / 2) / sqrt(2 * pi()) * d2 / iv', 'vanna')}, {r6_sql('vega * d1 * d2 / iv', 'volga')}, {r6_sql('exp(-d1 * d1 / 2) / sqrt(2 * pi()) * d2 / (2 * time)', 'charm')}, {r6_sql('-gamma / spot * (1 + d1 / (iv * sqrt(time)))', 'speed', 9)}, {r6_sql('gamma * (d1 * d2 - 1) / iv', 'zomma', 9)}, open_interest FROM g")
def option_greeks(spark, sf_dir):
    c, a = chain(spark, sf_dir), ("spot", "strike", "iv", "time")
    cols = [F.col(x) for x in a]
    return c.select("root", "strike", "kind", "iv", r6(cf.gamma(*cols), "gamma", 9), r6(cf.vega(*cols), "vega"), r6(cf.theta(*cols), "theta"), r6(cf.vanna(*cols), "vanna"), r6(cf.volga(*cols), "volga"), r6(cf.charm(*cols), "charm"), r6(cf.speed(*cols), "speed", 9), r6(cf.zomma(*cols), "zomma", 9), "open_interest")


N2 = normal.cdf_sql("(d1 - iv * sqrt(time))")


@register("option_greeks_more", f"WITH {CHAIN}, g AS (SELECT *, spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(time) AS vega, d1 - iv * sqrt(time) AS d2 FROM gx) SELECT root, strike, kind, iv, {r6_sql('gamma / (2 * time) * (1 - d1 * d2)', 'color', 9)}, {r6_sql('-vega / (iv * iv) * (d1 * d2 * (1 - d1 * d2) + d1 * d1 + d2 * d2)', 'ultima', 4)}, {r6_sql('-vega * (1 + d1 * d2) / (2 * time)', 'veta', 5)}, {r6_sql(f'strike * time * (CASE WHEN kind = ' + repr('call') + f' THEN {N2} ELSE {N2} - 1 END)', 'rho', 5)}, open_interest FROM g")
def option_greeks_more(spark, sf_dir):
    c = chain(spark, sf_dir)
    cols = [F.col(x) for x in ("spot", "strike", "iv", "time")]
    call = F.col("kind") == "call"
    return c.select("root", "strike", "kind", "iv", r6(cf.color(*cols), "color", 9), r6(cf.ultima(*cols), "ultima", 4), r6(cf.veta(*cols), "veta", 5), r6(cf.rho(*cols, call), "rho", 5), "open_interest")
