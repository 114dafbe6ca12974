"""Trade statistics, equity, risk, the journal and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import inputs as I
from ..operators import joins as J
from ..operators import stats as S
from ..operators.quantiles import exact_quantiles, few_keys
from ..registry import register
from .common import r6, r6_all, r6_sql

T = I.TRADES_SQL
SEQ, SEQ_SQL = I.SEQUENCE, I.SEQUENCE_SQL
UPTO = f"(PARTITION BY account ORDER BY {SEQ_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
STATS = ["mean_r", "sd_r", "skew", "excess", "net", "avg_win", "avg_loss", "win_rate", "sharpe", "profit_factor", "break_even"]


def stats_sql(keys: str) -> str:
    """Run statistics by keys; skew and kurtosis by population moments."""
    m = f"SELECT {keys}, avg(r) AS mu FROM trades GROUP BY {keys}"
    return f"""WITH {T}, mu AS ({m}), s AS (SELECT {keys}, count(*) AS n, count(*) FILTER (r <> 0) AS nz, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, avg(r) AS mean_r, stddev_samp(r) AS sd_r,
 avg(pow(r - mu, 3)) / pow(stddev_pop(r), 3) AS skew, avg(pow(r - mu, 4)) / pow(stddev_pop(r), 4) - 3 AS excess, sum(r) AS net, avg(CASE WHEN r > 0 THEN r END) AS avg_win, avg(CASE WHEN r < 0 THEN -r END) AS avg_loss,
 sum(CASE WHEN r > 0 THEN r END) AS won, sum(CASE WHEN r < 0 THEN -r END) AS lost FROM trades JOIN mu USING ({keys}) GROUP BY {keys})
 SELECT {keys}, n, nz, wins, losses, {r6_sql('mean_r', 'mean_r')}, {r6_sql('sd_r', 'sd_r')}, {r6_sql('skew', 'skew')}, {r6_sql('excess', 'excess')}, {r6_sql('net', 'net', 4)}, {r6_sql('avg_win', 'avg_win')}, {r6_sql('avg_loss', 'avg_loss')},
 {r6_sql('wins / CAST(nullif(nz, 0) AS DOUBLE)', 'win_rate')}, {r6_sql('mean_r / nullif(sd_r, 0)', 'sharpe')}, {r6_sql('won / nullif(lost, 0)', 'profit_factor')}, {r6_sql('avg_loss / nullif(avg_win + avg_loss, 0)', 'break_even')} FROM s"""


@register("trades_stats", stats_sql("setup, side"))
def trades_stats(spark, sf_dir):
    made = S.run_statistics(I.trades(spark, sf_dir), ["setup", "side"])
    return r6_all(made, *[s for s in STATS if s != "net"]).withColumn("net", F.round("net", 4))


@register("stats_by_reason", f"WITH {T} SELECT reason, count(*) AS n, {r6_sql('sum(r)', 'sum_r', 4)}, {r6_sql('avg(r)', 'mean_r')}, CAST(sum(pnl4) AS BIGINT) AS net4 FROM trades GROUP BY 1")
def stats_by_reason(spark, sf_dir):
    return I.trades(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("r"), "sum_r", 4), r6(F.avg("r"), "mean_r"), F.sum("pnl4").alias("net4"))


EQ = f"""eq AS (SELECT *, CAST(sum(pnl4) OVER {UPTO} AS BIGINT) AS equity FROM trades), dd AS (SELECT *, greatest(0, max(equity) OVER {UPTO}) AS peak FROM eq), ddi AS (SELECT *, peak - equity AS drawdown, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i FROM dd)"""


@register("equity_drawdown", f"WITH {T}, {EQ} SELECT account, {SEQ_SQL}, equity, peak, drawdown FROM ddi")
def equity_drawdown(spark, sf_dir):
    return S.equity(I.trades(spark, sf_dir), ["account"], SEQ, "pnl4").select("account", *SEQ, "equity", "peak", "drawdown")


@register(
    "drawdown_episodes",
    f"""WITH {T}, {EQ}, st AS (SELECT *, drawdown > 0 AS under, max(i) OVER (PARTITION BY account) AS last, CAST(drawdown > 0 AND NOT coalesce(lag(drawdown > 0) OVER (PARTITION BY account ORDER BY i), false) AS INTEGER) AS s FROM ddi),
ep AS (SELECT *, CAST(sum(s) OVER (PARTITION BY account ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode FROM st)
SELECT account, episode, min(i) AS start, max(i) AS "end", max(drawdown) AS depth, min(i) FILTER (drawdown = dmax) AS trough, max(i) - min(i) + 1 AS length, max(i) < max(last) AS recovered
FROM (SELECT *, max(drawdown) OVER (PARTITION BY account, episode) AS dmax FROM ep WHERE under) GROUP BY 1, 2""",
)
def drawdown_episodes(spark, sf_dir):
    made = S.drawdown_episodes(I.trades(spark, sf_dir), ["account"], SEQ, "pnl4")
    return made.withColumns({c: F.col(c).cast("long") for c in ("episode", "start", "end", "trough", "length")})


RUNS = f"""sg AS (SELECT *, CAST(sign(pnl4) AS INTEGER) AS sgn, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i FROM trades),
ch AS (SELECT *, CAST(sgn <> coalesce(lag(sgn) OVER (PARTITION BY account ORDER BY i), 9) AS INTEGER) AS ch FROM sg), rn AS (SELECT *, sum(ch) OVER (PARTITION BY account ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ch),
rs AS (SELECT account, run, sgn, count(*) AS size FROM rn GROUP BY 1, 2, 3)"""


@register("streaks", f"WITH {T}, {RUNS} SELECT account, coalesce(max(CASE WHEN sgn = 1 THEN size END), 0) AS longest_wins, coalesce(max(CASE WHEN sgn = -1 THEN size END), 0) AS longest_losses FROM rs GROUP BY 1")
def streaks(spark, sf_dir):
    return S.streaks(I.trades(spark, sf_dir), ["account"], SEQ, "pnl4")


@register(
    "runs_test",
    f"""WITH {T}, nz AS (SELECT *, pnl4 > 0 AS up, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i FROM trades WHERE pnl4 <> 0), nw AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY account ORDER BY i) <> up, true) AS nw FROM nz),
ag AS (SELECT account, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b, count(*) FILTER (nw) AS runs FROM nw GROUP BY 1), mm AS (SELECT *, 1 + 2.0 * a * b / (a + b) AS m FROM ag)
SELECT account, a, b, runs, {r6_sql('m', 'expected')}, {r6_sql('CASE WHEN (m - 1) * (m - 2) / nullif(a + b - 1, 0) > 0 THEN (runs - m) / sqrt((m - 1) * (m - 2) / (a + b - 1)) END', 'z')} FROM mm""",
)
def runs_test(spark, sf_dir):
    return r6_all(S.runs_test(I.trades(spark, sf_dir), ["account"], SEQ, "pnl4"), "expected", "z")


@register(
    "autocorr1",
    f"""WITH {T}, d AS (SELECT *, r - avg(r) OVER (PARTITION BY account) AS d FROM trades), b AS (SELECT *, lag(d) OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS p FROM d) SELECT account, {r6_sql('sum(d * p) / nullif(sum(d * d), 0)', 'rho')} FROM b GROUP BY 1""",
)
def autocorr1(spark, sf_dir):
    return r6_all(S.lag_correlation(I.trades(spark, sf_dir), ["account"], SEQ, "r"), "rho")


Z = -1.6448536269514722
RISK = ["downside", "sortino", "omega", "payoff", "kelly", "sqn", "tail_ratio", "var95", "var99", "var95_normal", "var95_fisher", "shortfall95"]


@register(
    "risk_sheet",
    f"""WITH {T}, mu AS (SELECT setup, avg(r) AS mu, stddev_pop(r) AS sp FROM trades GROUP BY 1), lv AS (SELECT setup, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(pow((r - mu) / sp, 3)) AS skew, avg(pow((r - mu) / sp, 4)) - 3 AS excess,
 sqrt(avg(pow(least(r, 0.0), 2))) AS downside, sum(greatest(r, 0.0)) AS above, sum(greatest(-r, 0.0)) AS below, avg(CASE WHEN r > 0 THEN r END) AS aw, avg(CASE WHEN r < 0 THEN -r END) AS al, count(*) FILTER (r > 0) / CAST(count(*) FILTER (r <> 0) AS DOUBLE) AS wr,
 quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95, quantile_cont(r, 0.01) AS q01 FROM trades JOIN mu USING (setup) GROUP BY 1),
tl AS (SELECT setup, -avg(r) AS sf FROM trades JOIN lv USING (setup) WHERE r <= q05 GROUP BY 1)
SELECT setup, n, {r6_sql('downside', 'downside')}, {r6_sql('mean / downside', 'sortino')}, {r6_sql('above / below', 'omega')}, {r6_sql('aw / al', 'payoff')}, {r6_sql('wr - (1 - wr) / (aw / al)', 'kelly')}, {r6_sql('mean / sd * sqrt(least(n, 100))', 'sqn')},
 {r6_sql('abs(q95 / q05)', 'tail_ratio')}, {r6_sql('-q05', 'var95')}, {r6_sql('-q01', 'var99')}, {r6_sql(f'-(mean + ({Z}) * sd)', 'var95_normal')},
 {r6_sql(f'-(mean + (({Z}) + (({Z}) * ({Z}) - 1) * skew / 6 + (pow({Z}, 3) - 3 * ({Z})) * excess / 24 - (2 * pow({Z}, 3) - 5 * ({Z})) * skew * skew / 36) * sd)', 'var95_fisher')}, {r6_sql('sf', 'shortfall95')} FROM lv JOIN tl USING (setup)""",
)
def risk_sheet(spark, sf_dir):
    return risk(I.trades(spark, sf_dir))


def risk(trades):
    return r6_all(S.risk_sheet(trades, ["setup"]), *RISK)


LEVELS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@register("quantile_table", f"WITH {T}, q AS (SELECT setup, unnest({LEVELS}) AS level, unnest(quantile_cont(CAST(pnl4 AS DOUBLE), {LEVELS})) AS x FROM trades GROUP BY 1) SELECT setup, CAST(level AS DOUBLE) AS level, round(x, 2) / 1e6 AS value FROM q")
def quantile_table(spark, sf_dir):
    """Quantiles of exact results in 1e-4: at levels of hundredths they have two digits, so they are rounded once, exactly."""
    levels = F.array(*[F.lit(q) for q in LEVELS])
    rows = I.trades(spark, sf_dir)
    made = exact_quantiles(rows, ["setup"], "pnl4", LEVELS, "q", few=few_keys(rows, ["setup"]))
    return made.select("setup", F.explode(F.arrays_zip(levels.alias("level"), F.col("q").alias("value"))).alias("x")).select("setup", F.col("x.level").alias("level"), (F.round("x.value", 2) / 1e6).alias("value"))


@register("hour_weekday_pivot", "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"CAST(count(*) FILTER (isodow(ts) = {d}) AS BIGINT) AS d{d}" for d in range(1, 8)) + " FROM events GROUP BY 1")
def hour_weekday_pivot(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.hour("ts").alias("hour"), F.concat(F.lit("d"), F.weekday("ts") + 1).alias("day"))
    return ev.groupBy("hour").pivot("day", [f"d{d}" for d in range(1, 8)]).count().fillna(0)


@register(
    "journal_grouping_sets",
    f"""WITH {T}, g AS (SELECT CASE WHEN grouping(setup) = 0 THEN 'setup' WHEN grouping(side) = 0 THEN 'side' WHEN grouping(reason) = 0 THEN 'reason' ELSE 'conviction' END AS dimension, coalesce(setup, side, reason, CAST(conviction AS VARCHAR)) AS value,
 count(*) AS n, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, avg(r) AS e, stddev_samp(r) AS s, sum(r) AS t FROM trades GROUP BY GROUPING SETS ((setup), (side), (reason), (conviction)))
SELECT dimension, value, n, wins, losses, {r6_sql('wins / CAST(nullif(wins + losses, 0) AS DOUBLE)', 'win_rate')}, {r6_sql('e', 'exp_r')}, {r6_sql('s', 'sd_r')}, {r6_sql('1.96 * s / sqrt(n)', 'ci_r')}, {r6_sql('t', 'total', 4)} FROM g""",
)
def journal_grouping_sets(spark, sf_dir):
    made = S.journal(I.trades(spark, sf_dir), ["setup", "side", "reason", "conviction"])
    return r6_all(made, "win_rate", "exp_r", "sd_r", "ci_r").withColumn("total", F.round("total", 4))


@register("contingency", "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY 1")
def contingency(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("toxic_0"), F.count_if(F.col("toxic") == 1).alias("toxic_1"))


@register(
    "calibration",
    f"""WITH {T}, g AS (SELECT setup, conviction >= 5 AS high, count(*) AS n, avg(r) AS e, 1.96 * stddev_samp(r) / sqrt(count(*)) AS ci FROM trades WHERE conviction >= 5 OR conviction <= 2 GROUP BY 1, 2)
SELECT h.setup, {r6_sql('h.e', 'high_r')}, {r6_sql('l.e', 'low_r')}, CASE WHEN h.e - h.ci > l.e + l.ci THEN 'calibrated' WHEN h.e + h.ci < l.e - l.ci THEN 'inverted' ELSE 'undecided' END AS verdict FROM g h JOIN g l ON h.setup = l.setup AND h.high AND NOT l.high""",
)
def calibration(spark, sf_dir):
    x = I.trades(spark, sf_dir)
    high, low = F.col("conviction") >= 5, F.col("conviction") <= 2
    ci = lambda c: 1.96 * F.stddev_samp(F.when(c, F.col("r"))) / F.sqrt(F.count_if(c))
    made = x.groupBy("setup").agg(F.avg(F.when(high, F.col("r"))).alias("h"), F.avg(F.when(low, F.col("r"))).alias("l"), ci(high).alias("hc"), ci(low).alias("lc"))
    verdict = F.when(F.col("h") - F.col("hc") > F.col("l") + F.col("lc"), "calibrated").when(F.col("h") + F.col("hc") < F.col("l") - F.col("lc"), "inverted").otherwise("undecided")
    return made.where("h is not null and l is not null").select("setup", r6(F.col("h"), "high_r"), r6(F.col("l"), "low_r"), verdict.alias("verdict"))


@register("daily_pnl", f"WITH {T}, d AS (SELECT account, day, CAST(sum(pnl4) AS BIGINT) AS pnl4, count(*) AS n FROM trades GROUP BY 1, 2) SELECT account, day, pnl4, n, CAST(sum(pnl4) OVER (PARTITION BY account ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS equity FROM d")
def daily_pnl(spark, sf_dir):
    d = I.trades(spark, sf_dir).groupBy("account", "day").agg(F.sum("pnl4").alias("pnl4"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("equity", F.sum("pnl4").over(W.partitionBy("account").orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


@register("rolling_sharpe", f"WITH {T} SELECT account, {SEQ_SQL}, {r6_sql('CASE WHEN count(r) OVER w = 30 THEN avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) END', 'rolling')} FROM trades WINDOW w AS (PARTITION BY account ORDER BY {SEQ_SQL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark, sf_dir):
    return r6_all(S.rolling_ratio(I.trades(spark, sf_dir), ["account"], SEQ, "r", 30).select("account", *SEQ, "rolling"), "rolling")


@register(
    "cusum",
    f"""WITH {T}, c AS (SELECT *, sum(r - 0.0 - 0.5) OVER {UPTO} AS s FROM trades) SELECT account, {SEQ_SQL}, {r6_sql(f'CAST(s AS DOUBLE) - least(0.0, min(s) OVER {UPTO})', 'cusum')} FROM c""",
)
def cusum(spark, sf_dir):
    return r6_all(S.cusum(I.trades(spark, sf_dir), ["account"], SEQ, "r", 0.0, 0.5).select("account", *SEQ, "cusum"), "cusum")


@register(
    "sprt",
    f"""WITH {T}, l AS (SELECT account, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i, sum(CASE WHEN pnl4 > 0 THEN ln(0.55 / 0.45) ELSE ln(0.45 / 0.55) END) OVER {UPTO} AS llr FROM trades),
h AS (SELECT *, CASE WHEN llr >= ln(0.9 / 0.05) OR llr <= ln(0.1 / 0.95) THEN i END AS hit, CASE WHEN llr >= ln(0.9 / 0.05) THEN 'better' ELSE 'null' END AS d FROM l) SELECT account, count(*) AS n, min(hit) AS stopped_at, arg_min(d, hit) AS decision FROM h GROUP BY 1""",
)
def sprt(spark, sf_dir):
    made = S.sequential_test(I.trades(spark, sf_dir).withColumn("won", F.col("pnl4") > 0), ["account"], SEQ, "won", 0.45, 0.55)
    return made.withColumn("stopped_at", F.col("stopped_at").cast("long"))


@register(
    "cluster_statistic",
    f"""WITH {T}, d AS (SELECT day, sum(r / qty) AS a, CAST(sum(1.0 * conviction / qty) AS DOUBLE) AS b FROM trades GROUP BY 1), m AS (SELECT sum(a) / sum(b) AS mu FROM d), v AS (SELECT max(mu) AS mu, count(*) AS clusters, sum(b) AS b, sum(pow(a - mu * b, 2)) AS v FROM d, m)
SELECT {r6_sql('mu', 'mu')}, clusters, {r6_sql('b * b / v', 'information')}, {r6_sql('mu * b / sqrt(v)', 'z')} FROM v""",
)
def cluster_statistic(spark, sf_dir):
    x = I.trades(spark, sf_dir).withColumns({"w": 1.0 / F.col("qty"), "tau": F.col("conviction").cast("double")})
    return r6_all(S.cluster_statistic(x, "day", "r", "tau", "w"), "mu", "information", "z")


@register(
    "split_half_hour",
    f"WITH {I.TICKS_SQL} SELECT CAST(floor(sec % 86400 / 1800.0) AS BIGINT) AS half_hour, count(*) AS n, {r6_sql('avg(price)', 'mean')}, {r6_sql('stddev_samp(price)', 'sd')}, {r6_sql('avg(price) / stddev_samp(price)', 'sharpe')} FROM ticks GROUP BY 1",
)
def split_half_hour(spark, sf_dir):
    x = I.ticks(spark, sf_dir)
    return x.groupBy(F.floor(F.col("sec") % 86_400 / 1800).alias("half_hour")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price"), "mean"), r6(F.stddev_samp("price"), "sd"), r6(F.try_divide(F.avg("price"), F.stddev_samp("price")), "sharpe"))


@register("concentration", f"WITH {T}, g AS (SELECT setup, side, CAST(sum(pnl4) AS BIGINT) AS net4 FROM trades GROUP BY 1, 2) SELECT setup, side, net4, {r6_sql('abs(net4) / CAST(sum(abs(net4)) OVER () AS DOUBLE)', 'share')} FROM g")
def concentration(spark, sf_dir):
    g = I.trades(spark, sf_dir).groupBy("setup", "side").agg(F.sum("pnl4").alias("net4"))  # a few groups
    return g.withColumn("share", F.round(F.abs("net4") / F.sum(F.abs("net4")).over(W.partitionBy(F.lit(1))), 6))


FILLS = """fills AS (SELECT l_suppkey AS book, CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'S' END AS side, CAST(round(l_quantity) AS BIGINT) AS qty, l_extendedprice AS price, l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem),
un AS (SELECT *, CAST(sum(qty) OVER (PARTITION BY book, side ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS q1 FROM fills)"""


@register(
    "fifo_match",
    f"""WITH {FILLS}, bl AS (SELECT book, side, price, q1 - qty AS q0, q1, unnest(range(CAST(floor((q1 - qty) / 64.0) AS BIGINT), CAST(floor((q1 - 1) / 64.0) AS BIGINT) + 1)) AS block FROM un)
SELECT b.book, b.q0 AS b0, s.q0 AS s0, b.price AS b_price, s.price AS s_price, CAST(sum(least(b.q1, s.q1, (b.block + 1) * 64) - greatest(b.q0, s.q0, b.block * 64)) AS BIGINT) AS matched
FROM bl b JOIN bl s ON b.book = s.book AND b.block = s.block AND b.side = 'B' AND s.side = 'S' AND b.q0 < s.q1 AND s.q0 < b.q1 AND greatest(b.q0, s.q0, b.block * 64) < least(b.q1, s.q1, (b.block + 1) * 64) GROUP BY 1, 2, 3, 4, 5""",
)
def fifo_match(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fills = li.select(F.col("l_suppkey").alias("book"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"), F.round("l_quantity").cast("long").alias("qty"), F.col("l_extendedprice").alias("price"), "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")
    return J.fifo(fills, ["book"], ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "price"], "side", "qty", "price")


@register("fifo_flips")
def fifo_flips(spark, sf_dir):
    """Round trips of books that may go short; the open side changes along the path, so tests hold it to a plain loop."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fills = li.select(F.col("l_suppkey").alias("book"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"), F.round("l_quantity").cast("long").alias("qty"), F.col("l_extendedprice").cast("double").alias("price"), "l_orderkey", "l_partkey", "l_linenumber")
    return J.fifo_flips(fills, "book", ["l_orderkey", "l_partkey", "l_linenumber", "price"], "side", "qty", "price")


@register("except_hashes", "SELECT DISTINCT l_partkey % 997 AS h FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey % 997 FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 AND l_quantity < 3")
def except_hashes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("h", F.col("l_partkey") % 997)
    return J.new_rows(li.where("l_returnflag = 'R'").select("h"), li.where("l_returnflag = 'A' and l_linenumber = 1 and l_quantity < 3").select("h"), ["h"])


@register("trial_count", "SELECT instrument, count(DISTINCT h) AS trials, CASE WHEN count(DISTINCT h) >= 10 THEN " + r6_sql("stddev_samp(sr)", "x").removesuffix(" AS x") + " END AS sd_trials FROM (SELECT instrument, h, arg_min(sr, id) AS sr FROM (SELECT o_orderpriority AS instrument, o_custkey % 313 AS h, o_totalprice / 1e5 AS sr, o_orderkey AS id FROM orders) GROUP BY 1, 2) GROUP BY 1")
def trial_count(spark, sf_dir):
    """Distinct settings tried for each instrument (the first record of each counts) and the spread of their ratios."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("instrument"), (F.col("o_custkey") % 313).alias("h"), (F.col("o_totalprice") / 1e5).alias("sr"), F.col("o_orderkey").alias("id"))
    first = o.groupBy("instrument", "h").agg(F.min_by("sr", "id").alias("sr"))
    return first.groupBy("instrument").agg(F.count(F.lit(1)).alias("trials"), F.when(F.count(F.lit(1)) >= 10, F.round(F.stddev_samp("sr"), 6)).alias("sd_trials"))


@register("document_store", "SELECT user_id, arg_max(event_type, ts) AS kind, CAST(floor(epoch(max(ts))) AS BIGINT) AS updated FROM events GROUP BY 1 HAVING arg_max(value, ts) >= 5")
def document_store(spark, sf_dir):
    """Last version of each document, by time of writing; those whose last version is a deletion are gone."""
    ev = I.ticks(spark, sf_dir)
    last = ev.groupBy("user_id").agg(F.max_by(F.struct(F.col("instrument").alias("kind"), "price", F.col("sec").alias("updated")), "ts").alias("d"))
    return last.where("d.price >= 5").select("user_id", "d.kind", "d.updated")


@register(
    "share_bounds",
    f"""WITH {T}, g AS (SELECT setup, side, CAST(count(*) FILTER (r > 0) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM trades GROUP BY 1, 2), x AS (SELECT setup, side, k, n, k / n + 1.96 * 1.96 / (2 * n) AS m, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) AS h, 1 + 1.96 * 1.96 / n AS s FROM g)
SELECT setup, side, {r6_sql('(m - h) / s', 'low')}, {r6_sql('(m + h) / s', 'high')}, {r6_sql('ln(n * (k / n)) / ln(1 / (1 - k / n))', 'longest_run')} FROM x WHERE k > 0 AND k < n""",
)
def share_bounds(spark, sf_dir):
    """Bounds of each win rate, and the longest run of losses that chance gives."""
    from ..functions import closed_forms as cf

    g = I.trades(spark, sf_dir).groupBy("setup", "side").agg(F.count_if(F.col("r") > 0).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n")).where("k > 0 and k < n")
    low, high = cf.wilson(F.col("k"), F.col("n"))
    return g.select("setup", "side", r6(low, "low"), r6(high, "high"), r6(cf.run_null(F.col("n"), 1 - F.col("k") / F.col("n")), "longest_run"))


@register(
    "cusum_alarm",
    f"""WITH {T}, c AS (SELECT *, sum(r - 0.0 - 0.5) OVER {UPTO} AS s FROM trades), d AS (SELECT account, CAST(s AS DOUBLE) - least(0.0, min(s) OVER {UPTO}) AS cusum, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i FROM c)
SELECT account, count(*) AS n, min(i) FILTER (cusum >= 40.0) AS alarm FROM d GROUP BY 1""",
)
def cusum_alarm(spark, sf_dir):
    """Number of the first record at which the cumulative sum reaches 40; none if it never does."""
    made = S.cusum(I.trades(spark, sf_dir), ["account"], SEQ, "r", 0.0, 0.5).withColumn("i", F.row_number().over(W.partitionBy("account").orderBy(*SEQ)))
    return made.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("cusum") >= 40.0, F.col("i"))).cast("long").alias("alarm"))


@register("rolling_sortino", f"WITH {T} SELECT account, {SEQ_SQL}, {r6_sql('CASE WHEN count(r) OVER w = 30 THEN avg(r) OVER w / nullif(sqrt(avg(pow(least(r, 0.0), 2)) OVER w), 0) END', 'rolling')} FROM trades WINDOW w AS (PARTITION BY account ORDER BY {SEQ_SQL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_sortino(spark, sf_dir):
    return r6_all(S.rolling_sortino(I.trades(spark, sf_dir), ["account"], SEQ, "r", 30).select("account", *SEQ, "rolling"), "rolling")


CURVE = f"""{T}, e AS (SELECT setup, pnl4, row_number() OVER w AS i, sum(pnl4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e6 AS equity, day FROM trades WINDOW w AS (PARTITION BY setup ORDER BY {SEQ_SQL})),
p AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY setup ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM e)"""


@register(
    "curve_sheet",
    f"""WITH {CURVE}, a AS (SELECT setup, count(*) AS n, arg_max(equity, i) AS total, max(peak - equity) AS mdd, sqrt(avg(pow(peak - equity, 2))) AS ulcer, avg(peak - equity) AS pain, max(day) - min(day) + 1 AS days, regr_r2(equity, i) AS r2, sum(greatest(pnl4 / 1e6, 0.0)) AS gain, sum(greatest(-pnl4 / 1e6, 0.0)) AS loss FROM p GROUP BY 1)
SELECT setup, n, {r6_sql('mdd', 'max_drawdown', 4)}, {r6_sql('ulcer', 'ulcer', 4)}, {r6_sql('total / nullif(mdd, 0)', 'recovery')}, {r6_sql('total / days * 365.25', 'yearly', 3)}, {r6_sql('total / days * 365.25 / nullif(mdd, 0)', 'calmar')}, {r6_sql('total / nullif(ulcer, 0)', 'martin')}, {r6_sql('total / nullif(pain, 0)', 'pain_ratio')}, {r6_sql('r2', 'straightness')}, {r6_sql('(gain - loss) / nullif(loss, 0)', 'gain_to_pain')} FROM a""",
)
def curve_sheet(spark, sf_dir):
    """Figures of each setup's equity curve: drawdown, ulcer index, recovery, yearly result, Calmar, Martin and pain ratios."""
    return curve(I.trades(spark, sf_dir))


def curve(trades):
    made = S.curve_sheet(trades, ["setup"], SEQ, "pnl4", "day")
    return r6_all(made, "recovery", "calmar", "martin", "pain_ratio", "straightness", "gain_to_pain").withColumns({"max_drawdown": F.round("max_drawdown", 4), "ulcer": F.round("ulcer", 4), "yearly": F.round("yearly", 3)})
