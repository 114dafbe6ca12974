"""Reports of track records, option levels by halving, and the exchange's calendar."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import bars as B
from ..operators import inputs as I
from ..operators import joins as J
from ..operators import measures as M
from ..operators import profiles as P
from ..operators import reports as R
from ..operators import series as S
from ..operators import stats
from ..operators.quantiles import exact_quantiles, few_keys
from ..registry import register
from .common import r6, r6_all, r6_sql
from .profile_queries import CHAIN, chain
from .trade_queries import LEVELS, SEQ, SEQ_SQL, T, curve, risk

Z95, Z80 = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.8)
NEEDED = ((Z95 + Z80) / 0.1) ** 2


@register(
    "validation_report",
    f"""WITH {T}, k AS (SELECT *, row_number() OVER (PARTITION BY setup, side ORDER BY {SEQ_SQL}) AS i, count(*) OVER (PARTITION BY setup, side) AS n FROM trades), f AS (SELECT setup, side, CAST(floor((i - 1) * 5 / n) AS BIGINT) AS fold, avg(r) AS m FROM k GROUP BY 1, 2, 3), p AS (SELECT setup, side, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS p FROM f GROUP BY 1, 2),
d AS (SELECT setup, side, i, r - avg(r) OVER (PARTITION BY setup, side) AS d FROM k), c AS (SELECT setup, side, sum(d * b) / nullif(sum(d * d), 0) AS rho FROM (SELECT *, lag(d) OVER (PARTITION BY setup, side ORDER BY i) AS b FROM d) GROUP BY 1, 2),
s AS (SELECT setup, side, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, sum(r) AS t, sum(r * r) AS q FROM trades GROUP BY 1, 2), a AS (SELECT s.*, p, least(greatest(coalesce(rho, 0), 0), 0.99) AS rho FROM s JOIN p USING (setup, side) JOIN c USING (setup, side)),
v AS (SELECT *, coalesce(m / nullif(sd, 0), 0) AS sr, CASE WHEN n >= 30 THEN m - {NormalDist().inv_cdf(0.975)!r} * sd / sqrt(n) * sqrt((1 + rho) / (1 - rho)) END AS lo, CASE WHEN n >= 30 THEN 1 - {normal.cdf_sql('coalesce(t / nullif(sqrt(q), 0), 0.0)')} ELSE 1.0 END AS ch, CASE WHEN n >= 100 THEN p ELSE 0.0 END AS fp FROM a),
e AS (SELECT setup, side, 'sample' AS "check", CAST(n AS DOUBLE) AS value, {NEEDED!r} AS threshold, n >= {NEEDED!r} AS passed FROM v UNION ALL SELECT setup, side, 'selection', sr, sqrt(2 * ln(7) / n), sr > sqrt(2 * ln(7) / n) FROM v UNION ALL SELECT setup, side, 'interval', lo, 0.0, coalesce(lo > 0, false) FROM v
UNION ALL SELECT setup, side, 'signs', ch, 0.05, ch < 0.05 FROM v UNION ALL SELECT setup, side, 'folds', fp, 0.6, fp >= 0.6 FROM v UNION ALL SELECT setup, side, 'margin', m, 0.0, m > 0 FROM v)
SELECT setup, side, "check", {r6_sql('value', 'value')}, {r6_sql('threshold', 'threshold')}, passed, bool_and(passed) OVER (PARTITION BY setup, side) AS accepted FROM e""",
)
def validation_report(spark, sf_dir):
    """All checks of each setup and side as one report, with seven trials behind them."""
    return r6_all(R.validation(I.trades(spark, sf_dir), ["setup", "side"], SEQ, "r", trials=7), "value", "threshold")


@register(
    "effective_trials",
    f"""WITH {T}, d AS (SELECT conviction, day, sum(r) AS x FROM trades GROUP BY 1, 2), n AS (SELECT count(DISTINCT day) AS n FROM trades), l AS (SELECT conviction, sum(x) / any_value(n) AS m, sqrt(sum(x * x) / any_value(n) - pow(sum(x) / any_value(n), 2)) AS s FROM d, n GROUP BY 1),
g AS (SELECT l.conviction, days.day, (coalesce(x, 0) - m) / s AS z FROM l CROSS JOIN (SELECT DISTINCT day FROM trades) days LEFT JOIN d ON d.conviction = l.conviction AND d.day = days.day), t AS (SELECT day, sum(z) AS z, count(*) AS k FROM g GROUP BY 1),
r AS (SELECT any_value(k) AS trials, greatest(0.0, (avg(z * z) - any_value(k)) / (any_value(k) * (any_value(k) - 1))) AS rho FROM t) SELECT trials, {r6_sql('rho', 'mean_correlation')}, {r6_sql('trials / (1 + (trials - 1) * rho)', 'effective')} FROM r""",
)
def effective_trials(spark, sf_dir):
    """What the seven levels of conviction amount to as independent trials, by their daily results."""
    return r6_all(R.effective_trials(I.trades(spark, sf_dir), "conviction", "day", "r"), "mean_correlation", "effective")


def _haircut_sql(factor: str) -> str:
    p = f"least(1.0, greatest(1 - {normal.cdf_sql('(sr * sqrt(n))')}, 1e-15) * {factor})"
    return f"CASE WHEN sr <= 0 OR n < 2 OR {p} >= 0.5 THEN 1.0 ELSE greatest(0.0, 1 - {normal.quantile_sql(f'(1 - {p})')} / sqrt(n) / sr) END"


@register("sharpe_haircut", f"WITH {T}, s AS (SELECT setup, side, conviction, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sr FROM trades GROUP BY 1, 2, 3) SELECT setup, side, conviction, n, {r6_sql('sr', 'sharpe')}, {r6_sql(_haircut_sql('5'), 'plain')}, {r6_sql(_haircut_sql('(5 * (1 + 1 / 2.0 + 1 / 3.0 + 1 / 4.0 + 1 / 5.0))'), 'dependent')} FROM s")
def sharpe_haircut(spark, sf_dir):
    """The part of each cell's Sharpe ratio that five tests take away, for independent tests and for any."""
    made = I.trades(spark, sf_dir).groupBy("setup", "side", "conviction").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"))
    return made.select("setup", "side", "conviction", "n", r6(F.col("sharpe"), "sharpe"), *[r6(R.haircut(F.col("sharpe"), F.col("n"), 5, m), m) for m in ("plain", "dependent")])


@register("grid_stability", f"WITH {T}, c AS (SELECT setup, side, conviction, avg(r) AS x FROM trades GROUP BY 1, 2, 3) SELECT setup, count(*) AS cells, {r6_sql('avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)', 'above')}, {r6_sql('quantile_cont(x, 0.5)', 'middle')}, {r6_sql('min(x)', 'least')}, {r6_sql('max(x)', 'most')} FROM c GROUP BY 1")
def grid_stability(spark, sf_dir):
    """Each setup's grid of sides and convictions: how much of it lies above nought."""
    cells = I.trades(spark, sf_dir).groupBy("setup", "side", "conviction").agg(F.avg("r").alias("x"))
    return r6_all(R.stability(cells, ["setup"], "x"), "above", "middle", "least", "most")


CUT = 10400
UP, DOWN = "ln(0.8 / 0.05)", "ln(0.2 / 0.95)"


@register(
    "follow_up_plan",
    f"""WITH {T}, k AS (SELECT account, count(*) FILTER (day <= {CUT}) AS n, count(DISTINCT CASE WHEN day <= {CUT} THEN day END) AS d, count(DISTINCT CASE WHEN day > {CUT} THEN day END) AS e, avg(CASE WHEN day <= {CUT} THEN r END) AS m, stddev_samp(CASE WHEN day <= {CUT} THEN r END) AS s,
count(*) FILTER (day <= {CUT} AND r > 0) / CAST(nullif(count(*) FILTER (day <= {CUT} AND r <> 0), 0) AS DOUBLE) AS pw, avg(CASE WHEN day <= {CUT} AND r > 0 THEN r END) AS aw, avg(CASE WHEN day <= {CUT} AND r < 0 THEN -r END) AS al FROM trades GROUP BY 1),
q AS (SELECT *, al / (aw + al) AS pe FROM k), g AS (SELECT *, coalesce(pe BETWEEN 1e-12 AND 1 - 1e-12 AND pw BETWEEN 1e-12 AND 1 - 1e-12 AND pw > pe, false) AS ok FROM q),
l AS (SELECT account, row_number() OVER w AS i, sum(CASE WHEN r > 0 THEN ln(pw / pe) ELSE ln((1 - pw) / (1 - pe)) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM trades JOIN g USING (account) WHERE ok AND day > {CUT} AND r <> 0 WINDOW w AS (PARTITION BY account ORDER BY {SEQ_SQL})),
h AS (SELECT account, min(i) AS ended, arg_min(CASE WHEN path >= {UP} THEN 'better' ELSE 'null' END, i) AS how FROM l WHERE path >= {UP} OR path <= {DOWN} GROUP BY 1),
o AS (SELECT *, n / CAST(nullif(d, 0) AS DOUBLE) AS rate, CASE WHEN (m + 0.02) / nullif(s, 0) > 0 THEN pow({Z95 + Z80!r} / ((m + 0.02) / s), 2) END AS req FROM g LEFT JOIN h USING (account))
SELECT account, {r6_sql('rate', 'rate')}, {r6_sql('rate * e', 'expected')}, {r6_sql('req', 'required', 3)}, coalesce(rate * e >= req, false) AS enough, {r6_sql('pe', 'p_even')}, {r6_sql('pw', 'p_win')}, CASE WHEN NOT ok THEN 'none' ELSE coalesce(how, 'going on') END AS decision, CAST(ended AS INTEGER) AS "at" FROM o""",
)
def follow_up_plan(spark, sf_dir):
    """What each account's days up to a cut ask of those after it, and how Wald's test of these ended."""
    made = R.follow_up_plan(I.trades(spark, sf_dir), ["account"], SEQ, "r", "day", F.lit(CUT), 0.02)
    return r6_all(made, "rate", "expected", "p_even", "p_win").withColumn("required", F.round("required", 3))


@register("cost_floors", "SELECT l_orderkey, l_linenumber, greatest(l_tax * 10, 0.5) AS commission, greatest(l_discount * 20, 1.0) AS slip, l_tax * 10 < 0.5 OR l_discount * 20 < 1.0 AS raised FROM lineitem")
def cost_floors(spark, sf_dir):
    """Commission and slip of each order line, no less than their floors."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paid, slid, raised = R.costs_with_floors(F.col("l_tax") * 10, F.col("l_discount") * 20, 0.5)
    return li.select("l_orderkey", "l_linenumber", paid.alias("commission"), slid.alias("slip"), raised.alias("raised"))


@register(
    "quantile_normal",
    f"WITH {T}, m AS (SELECT setup, avg(r) AS m, stddev_samp(r) AS s FROM trades GROUP BY 1), q AS (SELECT setup, unnest({LEVELS}) AS level, unnest(quantile_cont(CAST(pnl4 AS DOUBLE), {LEVELS})) AS x FROM trades GROUP BY 1) SELECT setup, CAST(level AS DOUBLE) AS level, round(x, 2) / 1e6 AS value, {r6_sql('m + s * ' + normal.quantile_sql('level'), 'normal')} FROM q JOIN m USING (setup)",
)
def quantile_normal(spark, sf_dir):
    """Exact quantiles of each setup's results beside a normal law's."""
    rows = I.trades(spark, sf_dir)
    laws = rows.groupBy("setup").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    found = exact_quantiles(rows, ["setup"], "pnl4", LEVELS, few=few_keys(rows, ["setup"])).select("setup", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in LEVELS]).alias("level"), F.col("quantiles").alias("value"))).alias("x"))
    return found.join(laws, "setup").select("setup", F.col("x.level").alias("level"), (F.round("x.value", 2) / 1e6).alias("value"), r6(F.col("m") + F.col("s") * normal.quantile(F.col("x.level")), "normal"))


@register("pin_strength", f"""WITH {CHAIN}, a AS (SELECT root, strike, sum(exp(-pow(iv * sqrt(time) / 2, 2) / 2) / sqrt(2 * pi()) / (strike * iv * sqrt(time)) * open_interest * 100.0 * strike * strike * 0.01) AS g FROM ch GROUP BY 1, 2) SELECT root, strike, {r6_sql('g / sum(g) OVER (PARTITION BY root)', 'pin')} FROM a""")
def pin_strength(spark, sf_dir):
    """The share of each chain's gamma that every strike would hold with the spot there."""
    return r6_all(P.pin_strength(chain(spark, sf_dir), ["root"]), "pin")


@register("zero_gamma_exact")
def zero_gamma_exact(spark, sf_dir):
    """Spots of no net exposure by halving; tests hold them against the sums' signs on either side."""
    return r6_all(P.zero_gamma_exact(chain(spark, sf_dir), ["root"]), "zero_gamma")


@register(
    "front_contracts",
    """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), m AS (SELECT day, y, unnest([3, 6, 9, 12]) AS mo, unnest(['H', 'M', 'U', 'Z']) AS letter FROM d, (SELECT unnest([0, 1]) AS k) ks, LATERAL (SELECT year(day) + k AS y) ys),
e AS (SELECT *, make_date(y, mo, 1) + CAST((4 - (isodow(make_date(y, mo, 1)) - 1) + 7) % 7 + 14 AS INTEGER) AS expiry FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY expiry) AS i FROM e WHERE expiry >= day)
SELECT CAST(day AS VARCHAR) AS day, letter || (y % 10) AS code, CAST(CAST(expiry AS DATE) AS VARCHAR) AS expiry, CAST(CAST(expiry AS DATE) - 8 AS VARCHAR) AS roll FROM f WHERE i = 1""",
)
def front_contracts(spark, sf_dir):
    """The quarterly contract, its expiry and roll on every shipping day."""
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).distinct()
    found = days.withColumn("x", B.front_contract(F.col("day")))
    return found.select(F.col("day").cast("string").alias("day"), "x.code", F.col("x.expiry").cast("string").alias("expiry"), F.col("x.roll").cast("string").alias("roll"))


@register(
    "market_states",
    """WITH n AS (SELECT ts - INTERVAL 5 HOUR AS ny, ts AS ldn FROM events WHERE month(ts) IN (1, 2, 12)), m AS (SELECT hour(ny) * 60 + minute(ny) AS mn, isodow(ny) AS d, hour(ldn) AS lh FROM n)
SELECT CASE WHEN d = 6 OR (d = 7 AND mn < 1080) OR (d = 5 AND mn >= 1020) THEN 'closed' WHEN mn BETWEEN 1020 AND 1079 THEN 'pause' WHEN d <= 5 AND mn BETWEEN 570 AND 959 THEN 'cash' WHEN d <= 5 AND mn BETWEEN 960 AND 1019 THEN 'after' WHEN mn >= 1080 THEN 'asia' WHEN lh >= 8 THEN 'europe' ELSE 'asia' END AS state, count(*) AS n FROM m GROUP BY 1""",
)
def market_states(spark, sf_dir):
    """Events by the state of the exchanges, in the months when no clock is changed (the twin knows no time zones)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("month(ts) IN (1, 2, 12)")
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return ev.groupBy(B.market_state(utc).alias("state")).agg(F.count(F.lit(1)).alias("n"))


RUNS = f"nz AS (SELECT *, pnl4 > 0 AS up, row_number() OVER (PARTITION BY setup ORDER BY {SEQ_SQL}) AS i FROM trades WHERE pnl4 <> 0), nw AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY setup ORDER BY i) <> up, true) AS nw FROM nz), ag AS (SELECT setup, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b, count(*) FILTER (nw) AS runs FROM nw GROUP BY 1), mm AS (SELECT *, 1 + 2.0 * a * b / (a + b) AS m FROM ag)"


def _sheet_sql() -> str:
    from ..registry import oracle_sql

    found = oracle_sql()
    run = f"SELECT setup, runs, {r6_sql('m', 'runs_expected')}, {r6_sql('CASE WHEN (m - 1) * (m - 2) / nullif(a + b - 1, 0) > 0 THEN (runs - m) / sqrt((m - 1) * (m - 2) / (a + b - 1)) END', 'runs_z')} FROM (WITH {T}, {RUNS} SELECT * FROM mm)"
    basic = f"SELECT setup, {r6_sql('m', 'mean')}, {r6_sql('s', 'sd')}, {r6_sql('m / s', 'sharpe')}, {r6_sql('m / s * sqrt(n)', 't')}, {r6_sql('w / CAST(nz AS DOUBLE)', 'win_rate')}, {r6_sql('won / lost', 'profit_factor')} FROM (WITH {T} SELECT setup, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, count(*) FILTER (r > 0) AS w, count(*) FILTER (r <> 0) AS nz, sum(greatest(r, 0.0)) AS won, sum(greatest(-r, 0.0)) AS lost FROM trades GROUP BY 1)"
    return f"SELECT * FROM ({basic}) JOIN ({run}) USING (setup) JOIN ({found['risk_sheet']}) USING (setup) JOIN (SELECT * EXCLUDE (n) FROM ({found['curve_sheet']})) USING (setup)"


@register("metrics_sheet", _sheet_sql())
def metrics_sheet(spark, sf_dir):
    """One sheet of a setup's figures: mean and spread, ratios, wins, risk, curve and runs."""
    # trades without a setup meet no other sheet's row
    rows = I.trades(spark, sf_dir).where("setup IS NOT NULL")
    n, r = F.count(F.lit(1)), F.col("r")
    sharpe = F.avg(r) / F.stddev_samp(r)
    basic = rows.groupBy("setup").agg(
        r6(F.avg(r), "mean"), r6(F.stddev_samp(r), "sd"), r6(sharpe, "sharpe"), r6(sharpe * F.sqrt(n), "t"), r6(F.count_if(r > 0) / F.count_if(r != 0), "win_rate"), r6(F.sum(F.greatest(r, F.lit(0.0))) / F.sum(F.greatest(-r, F.lit(0.0))), "profit_factor")
    )
    run = stats.runs_test(rows, ["setup"], SEQ, "pnl4").select("setup", "runs", r6(F.col("expected"), "runs_expected"), r6(F.col("z"), "runs_z"))
    return basic.join(run, "setup").join(risk(rows), "setup").join(curve(rows).drop("n"), "setup")


@register("tpo_value_area")
def tpo_value_area(spark, sf_dir):
    """Value areas of market profiles by pairs of levels; a path, so tests hold it against a plain loop."""
    return P.paired_value_area(P.market_profile(I.bars(spark, sf_dir), ["instrument", "session"], "sessmin", 10.0), ["instrument", "session"])


@register(
    "split_gamma_sign",
    f"""WITH {T}, g AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT) - 25000000) AS gamma FROM orders GROUP BY 1),
s AS (SELECT CASE WHEN gamma < 0 THEN 'negative' WHEN gamma > 0 THEN 'positive' ELSE 'none' END AS gamma, r FROM trades LEFT JOIN g USING (day)), a AS (SELECT gamma, count(*) AS n, avg(r) AS m, coalesce(stddev_samp(r), 0) AS sd FROM s GROUP BY 1)
SELECT gamma, n, {r6_sql('m', 'mean')}, {r6_sql('sd', 'sd')}, {r6_sql('coalesce(m / nullif(sd, 0), 0)', 'sharpe')}, {r6_sql('coalesce(m / nullif(sd, 0), 0) * sqrt(n)', 't')} FROM a""",
)
def split_gamma_sign(spark, sf_dir):
    """Trades by the sign of their day's gamma (here: of what the day's orders stand above 250,000 each)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    gamma = orders.groupBy(day.alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long") - 25_000_000).alias("g"))
    sign = F.when(F.col("g") < 0, "negative").when(F.col("g") > 0, "positive").otherwise("none")
    rows = I.trades(spark, sf_dir).join(gamma, "day", "left").withColumn("gamma", sign)
    return r6_all(R.split(rows, ["gamma"], "r"), "mean", "sd", "sharpe", "t")


WINDOWS = [(0, 600), (600, 1800), (1800, 7200)]


@register(
    "event_response",
    f"""WITH {I.TICKS_SQL}, e AS (SELECT instrument, sec, count(*) AS n, max(sec) OVER (PARTITION BY instrument) AS last FROM ticks GROUP BY 1, 2), w AS (SELECT unnest([{', '.join(str(a) for a, _ in WINDOWS)}]) AS lo, unnest([{', '.join(str(b) for _, b in WINDOWS)}]) AS hi),
p AS (SELECT e.instrument, e.sec, e.n, lo, hi FROM e, w WHERE e.sec + hi <= e.last), c AS (SELECT p.instrument, p.sec, p.n, p.lo, p.hi, coalesce(sum(f.n), 0) AS m FROM p LEFT JOIN e f ON f.instrument = p.instrument AND f.sec > p.sec + lo AND f.sec <= p.sec + hi GROUP BY ALL)
SELECT instrument, lo, hi, CAST(sum(n) AS BIGINT) AS windows, {r6_sql('sum(n * m) / CAST(sum(n) * (hi - lo) AS DOUBLE)', 'rate', 9)} FROM c GROUP BY 1, 2, 3""",
)
def event_response(spark, sf_dir):
    """How often events follow events, in three windows after each."""
    return r6_all(R.response(I.ticks(spark, sf_dir), ["instrument"], "sec", WINDOWS), "rate", digits=9)


@register(
    "exponent_corrected",
    f"""WITH {I.BARS_SQL}, j AS (SELECT *, t - lag(t) OVER w = 1 AS joined, ln(c / lag(c) OVER w) AS x FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t)), s AS (SELECT instrument, t, CASE WHEN joined THEN x END AS ret, sum(CASE WHEN coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY t) AS seg FROM j),
r AS (SELECT instrument, t, ret, seg, avg(ret) OVER (PARTITION BY instrument) AS m, count(*) OVER (PARTITION BY instrument) AS n FROM s WHERE ret IS NOT NULL),
v AS (SELECT instrument, t, seg, ret, m, n, q, CASE WHEN count(*) OVER w2 = 2 THEN sum(ret) OVER w2 END AS s2, CASE WHEN count(*) OVER w4 = 4 THEN sum(ret) OVER w4 END AS s4, CASE WHEN count(*) OVER w8 = 8 THEN sum(ret) OVER w8 END AS s8 FROM r, (SELECT unnest([2, 4, 8]) AS q) qs
 WINDOW w2 AS (PARTITION BY instrument, seg, q ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), w4 AS (PARTITION BY instrument, seg, q ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY instrument, seg, q ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
k AS (SELECT instrument, q, avg(pow(CASE q WHEN 2 THEN s2 WHEN 4 THEN s4 ELSE s8 END - q * m, 2)) / (q * avg(pow(ret - m, 2))) AS vr, any_value(n) AS n FROM v GROUP BY 1, 2),
l AS (SELECT instrument, ln(q) AS x, ln(q * vr / ((1 - q / CAST(n AS DOUBLE)) / (1 - 1 / CAST(n AS DOUBLE)))) AS y FROM k UNION ALL SELECT DISTINCT instrument, 0.0, 0.0 FROM k)
SELECT instrument, {r6_sql('regr_slope(y, x) / 2', 'exponent')}, {r6_sql('regr_r2(y, x)', 'fit')}, count(y) AS points FROM l GROUP BY 1""",
)
def exponent_corrected(spark, sf_dir):
    """Scaling exponents of hourly bars with each variance ratio over what as many independent returns give it."""
    returns = S.log_returns(I.bars(spark, sf_dir), ["instrument"], "t", segments=False)
    ratios = None
    for q in (2, 4, 8):
        one = S.variance_ratio(returns, ["instrument"], q)
        ratios = one if ratios is None else ratios.unionByName(one)
    sizes = returns.groupBy("instrument").agg(F.count(F.lit(1)).alias("all"))
    nulls = ratios.join(sizes, "instrument").select("instrument", "q", R.ratio_null(F.col("all"), F.col("q")).alias("vr"))
    return r6_all(R.corrected_exponent(ratios, nulls, ["instrument"]), "exponent", "fit")


@register("cusum_false_alarms", f"WITH {T}, s AS (SELECT account, stddev_samp(r) AS sd FROM trades GROUP BY 1), x AS (SELECT account, sd, 0.25 / sd AS d, 4.0 * sd / sd + 1.166 AS b FROM s WHERE sd > 0) SELECT account, {r6_sql('(exp(2 * d * b) - 2 * d * b - 1) / (2 * d * d)', 'records', 3)} FROM x")
def cusum_false_alarms(spark, sf_dir):
    """Records between false alarms of each account's cumulative sum with a slack of 0.25 and a limit of four deviations."""
    made = I.trades(spark, sf_dir).groupBy("account").agg(F.stddev_samp("r").alias("sd")).where("sd > 0")
    return made.select("account", r6(stats.false_alarm_run(F.lit(0.25), 4 * F.col("sd"), F.col("sd")), "records", 3))


def _period_sql(period: str) -> str:
    p = f"CAST(date_trunc('{period}', DATE '1970-01-01' + CAST(session AS INTEGER)) AS DATE)"
    return f"SELECT instrument, t, {r6_sql('sum((h + l + c) / 3 * v) OVER w / nullif(sum(v) OVER w, 0)', 'vwap')}, '{period}' AS period FROM bars WINDOW w AS (PARTITION BY instrument, {p} ORDER BY t)"


@register("period_vwap", f"WITH {I.BARS_SQL} {_period_sql('week')} UNION ALL {_period_sql('month')}")
def period_vwap(spark, sf_dir):
    """Running mean prices since the week and since the month began."""
    bars, out = I.bars(spark, sf_dir), None
    for period in ("week", "month"):
        made = M.period_vwap(bars, period).select("instrument", "t", r6(F.col("vwap"), "vwap"), F.lit(period).alias("period"))
        out = made if out is None else out.unionByName(made)
    return out


@register(
    "session_entropy",
    f"""WITH {I.BARS_SQL}, p AS (SELECT instrument, session, lag(c, 2) OVER w AS a, lag(c) OVER w AS b, c FROM bars WINDOW w AS (PARTITION BY instrument, session ORDER BY t)), o AS (SELECT instrument, session, CAST(a <= b AS VARCHAR) || CAST(b <= c AS VARCHAR) || CAST(a <= c AS VARCHAR) AS k, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY instrument, session) AS DOUBLE) AS p FROM o) SELECT instrument, session, CAST(sum(n) AS BIGINT) AS windows, count(*) AS patterns, {r6_sql('-sum(p * log2(p)) / log2(6)', 'entropy')} FROM q GROUP BY 1, 2""",
)
def session_entropy(spark, sf_dir):
    """Entropy of the order of three closes in each session."""
    return r6_all(S.permutation_entropy(I.bars(spark, sf_dir), ["instrument", "session"], "t", "c"), "entropy")


@register(
    "trials_out_of_sample",
    """WITH a AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT o_custkey % 50 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo FROM orders WHERE o_orderstatus = 'F')
SELECT id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND a.lo <= b.lo + 1 AND b.lo <= a.lo + 2)""",
)
def trials_out_of_sample(spark, sf_dir):
    """Pending orders whose three days meet two days of some finished order of their group."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), day.alias("lo"), "o_orderstatus")
    pending = rows.where("o_orderstatus = 'P'").select("id", "k", "lo", (F.col("lo") + 2).alias("hi"))
    done = rows.where("o_orderstatus = 'F'").select("k", F.col("lo").alias("from"), (F.col("lo") + 1).alias("to"))
    return J.overlapping(pending, done, ["k"], "lo", "hi", "from", "to", 7, "left_semi").select("id")
