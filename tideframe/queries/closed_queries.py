"""Closed forms over a grid of arguments made of the order lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import closed_forms as cf
from ..functions import horizon as hz
from ..functions import normal
from ..registry import register
from .common import r6, r6_sql

GRID = "g AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS k, (l_quantity * 7 + l_linenumber) % 97 / 97.0::DOUBLE + 0.001::DOUBLE AS p FROM lineitem)"
KEYS = ["q", "k"]


def grid(spark, sf_dir):
    """Distinct quantity q (1 to 50), line number k (1 to 7) and a share p of them."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("k"))
    return li.distinct().withColumn("p", (F.col("q") * 7 + F.col("k")) % 97 / 97.0 + 0.001)


def forms(name: str, columns: dict) -> None:
    """Register one query of several closed forms: name -> (column of q, k, p; SQL of them)."""
    sql = ", ".join(r6_sql(s, n) for n, (_, s) in columns.items())

    @register(name, f"WITH {GRID} SELECT q, k, {sql} FROM g")
    def query(spark, sf_dir):
        q, k, p = F.col("q"), F.col("k"), F.col("p")
        return grid(spark, sf_dir).select("q", "k", *[r6(f(q, k, p), n) for n, (f, _) in columns.items()])


PHI = normal.cdf_sql
PPF = normal.quantile_sql
BAND = math.sqrt(2 / math.pi)
forms(
    "closed_barriers",
    {
        "hit": (lambda q, k, p: cf.hit_probability(q, k), "k / (k + q)"),
        "touch": (lambda q, k, p: cf.touch_probability(k, F.lit(0.5), q), f"2 * {PHI('(-(k / (0.5 * sqrt(q))))')}"),
        "close_beyond": (lambda q, k, p: cf.close_probability(k, F.lit(0.5), q), PHI("(-(k / (0.5 * sqrt(q))))")),
        "band": (lambda q, k, p: cf.noise_band(k, q), f"k * sqrt(q) * {BAND!r}"),
        "sigma_one": (lambda q, k, p: cf.one_minute_sigma(k, q), "k / sqrt(q)"),
        "required_drift": (lambda q, k, p: cf.required_drift(k, q), "k / q"),
        "information_ratio": (lambda q, k, p: cf.information_ratio(k, p, q), "k / (p * sqrt(q))"),
        "wick": (lambda q, k, p: cf.wick_probability(k), "1 / (2 * k + 1)"),
        "new_high": (lambda q, k, p: cf.new_high_probability(q, k), "k / (q + k)"),
        "retrace": (lambda q, k, p: cf.retracement_probability(q, k), "k / (q + k)"),
        "jump": (lambda q, k, p: cf.jump_probability(p, k), "1 - exp(-p * k)"),
        "half_life": (lambda q, k, p: cf.half_life(p), "ln(2.0) / p"),
    },
)
forms(
    "closed_trades",
    {
        "expectancy": (lambda q, k, p: cf.expectancy(p, k, F.lit(1.0), q), "p * k - (1 - p) - 1.0 / q"),
        "break_even": (lambda q, k, p: cf.break_even(F.lit(1.0), q, k), "(1 + 1.0 / q) / (1 + k)"),
        "martingale": (lambda q, k, p: cf.martingale_hit(k), "1 / (k + 1)"),
        "all_fail": (lambda q, k, p: cf.all_fail(p, k), "CASE WHEN p >= 1 AND k % 2 <> 0 THEN -pow(p - 1, k) WHEN p >= 1 THEN pow(p - 1, k) ELSE pow(1 - p, k) END"),
        "kelly": (lambda q, k, p: cf.kelly(p, k), "p - (1 - p) / k"),
        "drawdown_null": (lambda q, k, p: cf.drawdown_null(p, q), f"{math.sqrt(math.pi / 2)!r} * p * sqrt(q)"),
        "block_length": (lambda q, k, p: cf.block_length(p / 2), "greatest(1.0, -1.0 / ln(abs(p / 2)))"),
        "hurst_of_ratio": (lambda q, k, p: cf.hurst_of_ratio(p, q + 1), "0.5 + ln(p) / (2 * ln(q + 1))"),
        "akaike": (lambda q, k, p: cf.akaike(k, q), "2 * k - 2 * q"),
        "bayes_criterion": (lambda q, k, p: cf.bayes_criterion(k, q, p), "k * ln(q) - 2 * p"),
        "noise_high": (lambda q, k, p: cf.noise_edges(p)[1], "pow(1 + sqrt(p), 2)"),
        "entropy": (lambda q, k, p: cf.bernoulli_entropy(p / 2), "-(p / 2) * log2(p / 2) - (1 - p / 2) * log2(1 - p / 2)"),
        "divergence": (lambda q, k, p: cf.divergence(p / 2, F.lit(0.3)), "(p / 2) * log2(p / 2 / 0.3) + (1 - p / 2) * log2((1 - p / 2) / 0.7)"),
    },
)
VAR = "(1 - 0.1 * (k / 10) + (0.5 + 2) / 4 * (k / 10) * (k / 10))"
PSR = f"CASE WHEN {VAR} > 0 THEN {PHI(f'((k / 10 - 0.1) * sqrt(q * 10 - 1) / sqrt({VAR}))')} ELSE CAST(k / 10 > 0.1 AS DOUBLE) END"
BEST = f"(CASE WHEN q < 2 THEN 0.0 ELSE 1 / sqrt(q * 10) * ((1 - {cf.EULER}) * {PPF('(1 - 1 / q)')} + {cf.EULER} * {PPF(f'(1 - 1 / (q * {math.e!r}))')}) END)"
DSR = f"CASE WHEN {VAR} > 0 THEN {PHI(f'((k / 10 - {BEST}) * sqrt(q * 10 - 1) / sqrt({VAR}))')} ELSE CAST(k / 10 > {BEST} AS DOUBLE) END"
forms(
    "psr_dsr",
    {
        "psr": (lambda q, k, p: cf.probabilistic_sharpe(k / 10, F.lit(0.1), q * 10, F.lit(0.1), F.lit(0.5)), PSR),
        "best_sharpe": (lambda q, k, p: cf.expected_best_sharpe(q, 1 / F.sqrt(q * 10)), BEST),
        "dsr": (lambda q, k, p: cf.deflated_sharpe(k / 10, q * 10, F.lit(0.1), F.lit(0.5), q), DSR),
        "min_track": (lambda q, k, p: cf.minimum_track(k / 10, F.lit(0.1), F.lit(0.1), F.lit(0.5)), f"CASE WHEN k / 10 > 0.1 THEN 1 + {VAR} * pow(1.6448536269514722 / (k / 10 - 0.1), 2) END"),
        "alpha_spent": (lambda q, k, p: cf.alpha_spent(F.lit(0.05), k / 7), f"least(0.05, 2 * (1 - {PHI(f'({PPF(str(1 - 0.05 / 2))} / sqrt(k / 7))')}))"),
        "auc": (lambda q, k, p: cf.auc(p), PHI(f"(p / {math.sqrt(2)!r})")),
        "bayes_error": (lambda q, k, p: cf.bayes_error(p), PHI("(-p / 2)")),
        "fisher": (lambda q, k, p: cf.cornish_fisher(F.lit(-1.645), p, k), "-1.645 + (1.645 * 1.645 - 1) * p / 6 + (-1.645 * 1.645 * 1.645 + 3 * 1.645) * k / 24 - (-2 * 1.645 * 1.645 * 1.645 + 5 * 1.645) * p * p / 36"),
    },
)


@register("implied_volatility")
def implied_volatility(spark, sf_dir):
    """Volatility back from a price, by bisection in one expression; tests hold it against the volatility it came from."""
    k, p, q = F.col("k"), F.col("p"), F.col("q")
    strike, time, sigma = 80 + q, k / 7, 0.1 + p / 2
    value = cf.price(F.lit(100.0), strike, sigma, time, F.lit(True))
    return grid(spark, sf_dir).select("q", "k", r6(sigma, "sigma"), r6(cf.implied_volatility(value, F.lit(100.0), strike, time, F.lit(True)), "implied", 4))


@register(
    "multiple_tests",
    """WITH t AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 25 + 1) / 500.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS n FROM t)
SELECT id, p, rank, p <= 0.05 / n AS bonferroni, max(CAST(p > 0.05 / (n - rank + 1) AS INTEGER)) OVER (ORDER BY p, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS holm FROM r""",
)
def multiple_tests(spark, sf_dir):
    """Bonferroni and Holm over one family of tests, a small table by nature."""
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(1)).orderBy("p", "id")
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 7 % 25 + 1) / 500.0).alias("p"))
    t = t.withColumns({"rank": F.row_number().over(w).cast("long"), "n": F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))})
    failed = F.max((F.col("p") > 0.05 / (F.col("n") - F.col("rank") + 1)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return t.select("id", "p", "rank", (F.col("p") <= 0.05 / F.col("n")).alias("bonferroni"), (failed == 0).alias("holm"))


@register(
    "false_discovery",
    """WITH t AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 25 + 1) / 500.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS n FROM t), c AS (SELECT sum(1.0::DOUBLE / i) AS c FROM (SELECT unnest(range(1, (SELECT count(*) FROM t) + 1)) AS i)),
k AS (SELECT coalesce(max(rank) FILTER (p <= rank * 0.05 / (n * c)), 0) AS last FROM r, c) SELECT id, p, rank, rank <= last AS rejected FROM r, k""",
)
def false_discovery(spark, sf_dir):
    """Benjamini, Hochberg and Yekutieli's rule over one family of tests, a small table by nature: every test up to the last
    rank whose p is small enough."""
    from pyspark.sql import Window as W

    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 7 % 25 + 1) / 500.0).alias("p"))
    every = W.partitionBy(F.lit(1))
    t = t.withColumns({"rank": F.row_number().over(every.orderBy("p", "id")).cast("long"), "n": F.count(F.lit(1)).over(every)})
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    last = F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") * 0.05 / (F.col("n") * harmonic), F.col("rank"))).over(every), F.lit(0))
    return t.select("id", "p", "rank", (F.col("rank") <= last).alias("rejected"))


forms("backtest_length", {"years": (lambda q, k, p: cf.minimum_backtest(q, k / 4), f"pow((CASE WHEN q < 2 THEN 0.0 ELSE (1 - {cf.EULER}) * {PPF('(1 - 1 / q)')} + {cf.EULER} * {PPF(f'(1 - 1 / (q * {math.e!r}))')} END) / (k / 4), 2)")})


# walks between two barriers under a deadline, over the parts


def walls(spark, sf_dir):
    """A stop a, a target b, a deadline t, a drift m and an exponent h of each part, a unit deviation. What is made of a part
    takes far longer than to read it, so parts are dealt to as many tasks as a shuffle has."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    key = F.col("p_partkey")
    return p.select(
        "p_partkey", (1.0 + F.col("p_size") % 9).alias("a"), (1.0 + key % 13).alias("b"), (F.pow(F.col("p_retailprice") % 50 + 1, 2) / 20).alias("t"), ((key % 7 - 3) / 50).alias("m"), (0.35 + key % 4 / 10).alias("h")
    )


WALLS = "w AS (SELECT p_partkey, 1.0::DOUBLE + p_size % 9 AS a, 1.0::DOUBLE + p_partkey % 13 AS b, pow(p_retailprice % 50 + 1, 2) / 20 AS t, (p_partkey % 7 - 3) / 50.0::DOUBLE AS m, 0.35::DOUBLE + p_partkey % 4 / 10.0::DOUBLE AS h FROM part)"
#: Enough modes for the shortest of these deadlines.
MODES = "range(1, 601)"


def _first_sql(near: str, far: str, drift: str) -> str:
    return f"CASE WHEN m = 0 THEN {far} / ({near} + {far}) ELSE (1 - exp(-2 * ({drift}) * {far})) / (1 - exp(-2 * ({drift}) * ({near} + {far}))) END"


def _met_sql(near: str, far: str, drift: str) -> str:
    """Chance to meet the nearer barrier by the deadline first, by modes alone."""
    rate = f"(n * n * pi() * pi() / (2 * pow({near} + {far}, 2)) + m * m / 2)"
    return f"greatest(0, least(1, {_first_sql(near, far, drift)} - pi() / pow({near} + {far}, 2) * list_sum(list_transform({MODES}, lambda n: n * sin(n * pi() * {near} / ({near} + {far})) * exp(({drift}) * {near} - {rate} * t) / {rate}))))"


def _odd_sql(t: str, term: str) -> str:
    """Sum over odd modes of the survival series' terms, each times `term`."""
    return f"list_sum(list_transform(range(1, 602, 2), lambda n: 4 / (n * pi()) * sin(n * pi() * a / (a + b)) * exp(-n * n * pi() * pi() * {t} / (2 * pow(a + b, 2))) * {term}))"


TIME = f"(a * b - {_odd_sql('t', '2 * pow(a + b, 2) / (n * n * pi() * pi())')})"


@register(
    "double_barrier",
    f"WITH {WALLS}, p AS (SELECT *, {_met_sql('b', 'a', 'm')} AS up, {_met_sql('a', 'b', '-m')} AS down FROM w) SELECT p_partkey, {r6_sql('up', 'target')}, {r6_sql('down', 'stop')}, {r6_sql('greatest(0, 1 - up - down)', 'open')} FROM p",
)
def double_barrier(spark, sf_dir):
    """Chances of target, stop and neither by the deadline, with drift."""
    a, b, t, m = (F.col(x) for x in "abtm")
    rows = walls(spark, sf_dir).withColumn("p", hz.barrier_chances(a, b, t, m, F.lit(1.0)))
    return rows.select("p_partkey", *[r6(F.col(f"p.{x}"), x) for x in ("target", "stop", "open")])


@register(
    "horizon_outcome",
    f"WITH {WALLS}, z AS (SELECT *, 0.0::DOUBLE AS m0 FROM w), p AS (SELECT p_partkey, a, b, t, {_met_sql('b', 'a', '0.0').replace('m = 0', 'm0 = 0').replace('m * m / 2', '0.0')} AS up, {_met_sql('a', 'b', '0.0').replace('m = 0', 'm0 = 0').replace('m * m / 2', '0.0')} AS down, {TIME} AS tau FROM z) SELECT p_partkey, {r6_sql('up', 'target')}, {r6_sql('down', 'stop')}, {r6_sql('down * a - up * b', 'mean_open')}, {r6_sql('tau', 'time')}, {r6_sql('sqrt(tau)', 'deviation')} FROM p",
)
def horizon_outcome(spark, sf_dir):
    """Driftless trades under a deadline: chances, what open ones are worth, mean time and deviation."""
    a, b, t = (F.col(x) for x in "abt")
    rows = walls(spark, sf_dir).withColumn("p", hz.outcome(a, b, t, F.lit(1.0)))
    return rows.select("p_partkey", *[r6(F.col(f"p.{x}"), x) for x in ("target", "stop", "mean_open", "time", "deviation")])


@register(
    "horizon_scaled",
    f"""WITH {WALLS}, s AS (SELECT p_partkey, a, b, t, h, i, CASE WHEN pow(i * t / 128, 2 * h) < 0.02 THEN 1.0 ELSE greatest(0, least(1, {_odd_sql('pow(i * t / 128, 2 * h)', '1.0')})) END AS s FROM w, range(0, 129) AS r(i))
SELECT p_partkey, {r6_sql('sum(s * CASE WHEN i IN (0, 128) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(t) / 128 / 3', 'time', 5)} FROM s GROUP BY 1""",
)
def horizon_scaled(spark, sf_dir):
    """Mean times where deviations grow with another power of time. (Both barriers are seven deviations away at a variance of
    0.02, so the twin, which has modes alone, takes survival as sure before that.)"""
    a, b, t, h = (F.col(x) for x in "abth")
    return walls(spark, sf_dir).select("p_partkey", r6(hz.scaled_outcome(a, b, t, F.lit(1.0), h)["time"], "time", 5))


@register(
    "managed_stops",
    f"""WITH {WALLS}, g AS (SELECT *, b * 0.4 AS g, m + 0.02 AS k FROM w), first AS (SELECT p_partkey, a, b, g, m, k, {_first_sql('g', 'a', 'm')} AS p1, CASE WHEN k = 0 THEN g / b ELSE (1 - exp(-2 * k * g)) / (1 - exp(-2 * k * b)) END AS p2, CASE WHEN k = 0 THEN (g + a) / (a + b) ELSE (1 - exp(-2 * k * (g + a))) / (1 - exp(-2 * k * (a + b))) END AS p3 FROM g),
o AS (SELECT *, (b - 0.2) / a AS v1, -0.2 / a AS v2, -(a + 0.2) / a AS v3 FROM first), e AS (SELECT *, p1 * p2 * v1 + p1 * (1 - p2) * v2 + (1 - p1) * v3 AS mean, p1 * p3 * v1 + (1 - p1 * p3) * v3 AS plain FROM o),
d AS (SELECT *, sqrt(p1 * p2 * pow(v1 - mean, 2) + p1 * (1 - p2) * pow(v2 - mean, 2) + (1 - p1) * pow(v3 - mean, 2)) AS sd FROM e)
SELECT p_partkey, {r6_sql('p1 * p2', 'target')}, {r6_sql('p1 * (1 - p2)', 'even')}, {r6_sql('1 - p1', 'stop')}, {r6_sql('mean', 'mean')}, {r6_sql('sd', 'deviation')}, {r6_sql('plain - mean', 'moving_cost')}, {r6_sql('0.2 / (a + b)', 'lift')} FROM d""",
)
def managed_stops(spark, sf_dir):
    """Trades whose stop moves to the entry at four tenths of the way, with a little more drift from there on."""
    a, b, m, one = F.col("a"), F.col("b"), F.col("m"), F.lit(1.0)
    g, k, cost = b * 0.4, m + 0.02, F.lit(0.2)
    rows = walls(spark, sf_dir).withColumn("p", hz.managed_chances(a, b, g, m, k, one))
    rows = rows.withColumn("q", hz.trade_moments(F.col("p"), a, b, cost))
    return rows.select("p_partkey", *[r6(F.col(f"p.{x}"), x) for x in ("target", "even", "stop")], r6(F.col("q.mean"), "mean"), r6(F.col("q.deviation"), "deviation"), r6(hz.moving_cost(a, b, g, m, k, one, cost), "moving_cost"), r6(hz.required_lift(a, b, cost), "lift"))
