"""Statistics of trades, equity and series, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_order_blocks, in_order_parts, own, running_in_order
from .quantiles import exact_quantiles, few_keys, join_values, valued


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def run_statistics(trades: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """Counts, win rate (of decided trades), mean, deviation, skew, kurtosis, Sharpe, profit factor, averages, break-even."""
    x = F.col(r)
    win, loss = F.when(x > 0, x), F.when(x < 0, -x)
    made = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x != 0).alias("nz"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"),
        F.avg(x).alias("mean_r"), F.stddev_samp(x).alias("sd_r"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"),
        F.sum(x).alias("net"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.sum(win).alias("won"), F.sum(loss).alias("lost"),
    )
    return made.withColumns({
        "win_rate": ratio(F.col("wins"), F.col("nz")), "sharpe": ratio(F.col("mean_r"), F.col("sd_r")), "profit_factor": ratio(F.col("won"), F.col("lost")),
        "break_even": ratio(F.col("avg_loss"), F.col("avg_win") + F.col("avg_loss")),
    }).drop("won", "lost")


def equity(trades: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Running sum, running peak (from zero) and drawdown of each account."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("equity", F.sum(value).over(upto))
    return rows.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(upto))).withColumn("drawdown", F.col("peak") - F.col("equity"))


def drawdown_episodes(trades: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Peak-to-recovery episodes: first and last trade number under water, the trough's, depth, and whether it recovered."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = equity(trades, keys, order, value).withColumns({"i": F.row_number().over(w), "under": F.col("drawdown") > 0})
    start = F.col("under") & ~F.coalesce(F.lag("under").over(w), F.lit(False))
    rows = rows.withColumn("episode", F.sum(start.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max("i").over(W.partitionBy(*keys))
    rows = rows.withColumn("last", last).where("under")
    return rows.groupBy(*keys, "episode").agg(
        F.min("i").alias("start"), F.max("i").alias("end"), F.max("drawdown").alias("depth"), F.min_by("i", F.struct(-F.col("drawdown"), "i")).alias("trough"), F.first("last").alias("_last")
    ).withColumns({"length": F.col("end") - F.col("start") + 1, "recovered": F.col("end") < F.col("_last")}).drop("_last")


def streaks(trades: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends both."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = trades.withColumn("sign", F.signum(F.col(value)).cast("int"))
    rows = rows.withColumn("run", F.sum((F.col("sign") != F.coalesce(F.lag("sign").over(w), F.lit(9))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "run", "sign").agg(F.count(F.lit(1)).alias("size"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("size"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(1).alias("longest_wins"), longest(-1).alias("longest_losses"))


def runs_test(trades: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Number of runs of wins and losses against what chance gives (zeros left out)."""
    rows = in_order_parts(trades.where(F.col(value) != 0).select(*keys, *order, (F.col(value) > 0).alias("up")), order)
    w = W.partitionBy(*keys, "_head", "_part").orderBy(*order)
    rows = rows.withColumns({"_before": F.lag("up").over(w), "_after": F.lead("up").over(w)})
    end = lambda beside: F.max(F.when(F.col(beside).isNull(), F.col("up")))
    made = rows.groupBy(*keys, "_head", "_part").agg(
        F.count_if("up").alias("a"), F.count_if(~F.col("up")).alias("b"), F.count_if(F.col("_before") != F.col("up")).alias("turns"), end("_before").alias("first"), end("_after").alias("last")
    )
    # blocks follow each other along the parts of a head, heads along their keys
    for group, by in (([*keys, "_head"], "_part"), (keys, "_head")):
        turned = F.coalesce((F.lag("last").over(W.partitionBy(*group).orderBy(by)) != F.col("first")).cast("int"), F.lit(0))
        made = made.withColumn("turns", F.col("turns") + turned).groupBy(*group).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("turns").alias("turns"), F.min_by("first", F.struct(by)).alias("first"), F.max_by("last", F.struct(by)).alias("last")
        )
    made = made.withColumn("runs", F.col("turns") + 1)
    n = F.col("a") + F.col("b")
    mean = 1 + ratio(2.0 * F.col("a") * F.col("b"), n)
    spread = ratio((mean - 1) * (mean - 2), n - 1)
    return made.select(*keys, "a", "b", "runs", mean.alias("expected"), F.when(spread > 0, (F.col("runs") - mean) / F.sqrt(spread)).alias("z"))


def lagged_gaps(rows: DataFrame, keys: list[str], order: list[str], value: str, lag: int = 1) -> DataFrame:
    """keys, the value, its number among its keys' rows (_i of _n), its deviation from their mean (_d) and the one a lag before
    (_before). Rows are numbered first; then windows run in blocks of numbers, so no key is one group."""
    x = F.col(value)
    made = running_in_order(rows.select(*dict.fromkeys([*keys, *order, value])), keys, order, {"_i": F.lit(1)}, whole={"_n": F.lit(1), "_x": x, "_known": x.isNotNull().cast("long")})
    made = in_order_blocks(made.select(*keys, value, "_i", "_n", (x - ratio(F.col("_x"), F.col("_known"))).alias("_d")), "_i", lag)
    return own(made.withColumn("_before", F.lag("_d", lag).over(W.partitionBy(*keys, "_block").orderBy("_i"))))


def lag_correlation(rows: DataFrame, keys: list[str], order: list[str], value: str, lag: int = 1) -> DataFrame:
    """Autocorrelation: products of deviations a lag apart over the sum of squares."""
    gap = lagged_gaps(rows, keys, order, value, lag)
    return gap.groupBy(*keys).agg(ratio(F.sum(F.col("_d") * F.col("_before")), F.sum(F.col("_d") * F.col("_d"))).alias("rho"))


def risk_sheet(trades: DataFrame, keys: list[str], r: str = "r", target: float = 0.0) -> DataFrame:
    """Downside deviation (over all records), Sortino, Omega, payoff, Kelly, SQN, tail ratio, value at risk and shortfall."""
    x = F.col(r)
    levels = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"),
        F.sqrt(F.avg(F.pow(F.least(x - target, F.lit(0.0)), 2))).alias("downside"), F.sum(F.greatest(x - target, F.lit(0.0))).alias("above"), F.sum(F.greatest(target - x, F.lit(0.0))).alias("below"),
        F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, -x)).alias("avg_loss"), ratio(F.count_if(x > 0).cast("double"), F.count_if(x != 0)).alias("win_rate"),
    )
    few = few_keys(trades, keys)
    ends = exact_quantiles(trades, keys, r, [0.05, 0.95, 0.01], few=few).select(*keys, *[F.element_at("quantiles", i).alias(q) for i, q in enumerate(("q05", "q95", "q01"), 1)])
    levels = levels.join(ends, keys)
    lowest = join_values(valued(trades, keys, r, few), ends.select(*keys, "q05"), keys, "_v", few).where(F.col("_v") <= F.col("q05"))
    tails = lowest.groupBy(*keys).agg((-F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("shortfall95"))
    payoff = ratio(F.col("avg_win"), F.col("avg_loss"))
    z = -1.6448536269514722
    fisher = z + (z * z - 1) * F.col("skew") / 6 + (z**3 - 3 * z) * F.col("excess") / 24 - (2 * z**3 - 5 * z) * F.col("skew") * F.col("skew") / 36
    return levels.join(tails, keys).select(
        *keys, "n", "downside", ratio(F.col("mean"), F.col("downside")).alias("sortino"), ratio(F.col("above"), F.col("below")).alias("omega"), payoff.alias("payoff"),
        (F.col("win_rate") - ratio(1 - F.col("win_rate"), payoff)).alias("kelly"), (ratio(F.col("mean"), F.col("sd")) * F.sqrt(F.least(F.col("n"), F.lit(100)))).alias("sqn"),
        F.abs(ratio(F.col("q95"), F.col("q05"))).alias("tail_ratio"), (-F.col("q05")).alias("var95"), (-F.col("q01")).alias("var99"), (-(F.col("mean") + z * F.col("sd"))).alias("var95_normal"),
        (-(F.col("mean") + fisher * F.col("sd"))).alias("var95_fisher"), "shortfall95",
    )


def journal(trades: DataFrame, columns: list[str], r: str = "r") -> DataFrame:
    """Group statistics by each of several columns at once: one pass of grouping sets."""
    x = F.col(r)
    sets = [[F.col(c)] for c in columns]
    named = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    made = trades.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        named.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"), F.avg(x).alias("exp_r"), F.stddev_samp(x).alias("sd_r"), F.sum(x).alias("total")
    )
    return made.select("dimension", "value", "n", "wins", "losses", ratio(F.col("wins").cast("double"), F.col("wins") + F.col("losses")).alias("win_rate"), "exp_r", "sd_r", (1.96 * F.col("sd_r") / F.sqrt("n")).alias("ci_r"), "total")


def rolling_ratio(trades: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Sharpe ratio of the last `width` records, null until there are so many."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)
    x = F.col(value)
    return trades.withColumn("rolling", F.when(F.count(x).over(w) == width, ratio(F.avg(x).over(w), F.stddev_samp(x).over(w))))


def cusum(rows: DataFrame, keys: list[str], order: list[str], value: str, target: float, slack: float) -> DataFrame:
    """One-sided cumulative sum max(0, s + x - target - slack), in closed form: the running sum less its running minimum."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(F.col(value) - target - slack).over(upto))
    return rows.withColumn("cusum", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(upto))).drop("_c")


def false_alarm_run(slack: Column, limit: Column, deviation: Column) -> Column:
    """Mean number of records before a one-sided cumulative sum with a slack reaches its limit though nothing changed, by
    Siegmund's formula for normal records; null without deviation or limit."""
    drift, height = -slack / deviation, limit / deviation + 1.166
    x = -2 * drift * height
    run = F.when(F.abs(drift) < 1e-9, height * height).otherwise((F.exp(x) - x - 1) / (2 * drift * drift))
    return F.when((deviation > 0) & (limit > 0), run)


def sequential_test(rows: DataFrame, keys: list[str], order: list[str], win: str, p0: float, p1: float, alpha: float = 0.05, beta: float = 0.1) -> DataFrame:
    """Wald's test of a win rate: the log-likelihood path and the first record at which a bound is met."""
    from math import log

    w = W.partitionBy(*keys).orderBy(*order)
    step = F.when(F.col(win), log(p1 / p0)).otherwise(log((1 - p1) / (1 - p0)))
    rows = rows.withColumns({"i": F.row_number().over(w), "llr": F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))})
    up, down = log((1 - beta) / alpha), log(beta / (1 - alpha))
    hit = (F.col("llr") >= up) | (F.col("llr") <= down)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(hit, F.col("i"))).alias("stopped_at"), F.min_by(F.when(F.col("llr") >= up, "better").otherwise("null"), F.when(hit, F.col("i"))).alias("decision")
    )


def cluster_statistic(trades: DataFrame, day: str, r: str, tau: str, weight: str) -> DataFrame:
    """Ratio of weighted sums over clustered days: estimate, information (1 / variance) and z."""
    days = trades.groupBy(day).agg(F.sum(F.col(weight) * F.col(r)).alias("a"), F.sum(F.col(weight) * F.col(tau)).alias("b"))
    mu = days.agg((F.sum("a") / F.sum("b")).alias("mu"))
    v = days.crossJoin(F.broadcast(mu)).agg(F.first("mu").alias("mu"), F.sum("b").alias("b"), F.sum(F.pow(F.col("a") - F.col("mu") * F.col("b"), 2)).alias("v"), F.count(F.lit(1)).alias("clusters"))
    return v.select("mu", "clusters", (F.col("b") * F.col("b") / F.col("v")).alias("information"), (F.col("mu") * F.col("b") / F.sqrt("v")).alias("z"))


def rolling_sortino(trades: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Mean over downside deviation of the last `width` records, null until there are so many or without a loss."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)
    x = F.col(value)
    below = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)).over(w))
    return trades.withColumn("rolling", F.when(F.count(x).over(w) == width, ratio(F.avg(x).over(w), below)))


def curve_sheet(trades: DataFrame, keys: list[str], order: list[str], pnl4: str, day: str) -> DataFrame:
    """Figures of an equity curve (results in 1e-4, shown in units of 100): greatest drawdown, ulcer index, and the total
    over each; the result of a year of calendar days; the fit of a line; gain to pain."""
    rows = trades.select(*dict.fromkeys([*keys, *order, pnl4, day]))
    rows = running_in_order(rows, keys, order, {"_sum": F.col(pnl4), "_i": F.lit(1), "_known": F.col(pnl4).isNotNull().cast("long")}, {"_top": "_sum"})
    rows = rows.withColumns({"_e": F.when(F.col("_known") > 0, F.col("_sum") / 1e6), "_i": F.col("_i").cast("double")})
    rows = rows.withColumn("_d", F.greatest(F.lit(0.0), F.col("_top") / 1e6) - F.col("_e"))
    x = F.col(pnl4) / 1e6
    made = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("_e", "_i").alias("total"), F.max("_d").alias("max_drawdown"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("ulcer"), F.avg("_d").alias("pain"),
        (F.max(day) - F.min(day) + 1).alias("days"), F.regr_r2("_e", "_i").alias("straightness"), F.sum(F.greatest(x, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-x, F.lit(0.0))).alias("loss"),
    )
    yearly = F.col("total") / F.col("days") * 365.25
    return made.select(
        *keys, "n", "max_drawdown", "ulcer", ratio(F.col("total"), F.col("max_drawdown")).alias("recovery"), yearly.alias("yearly"), ratio(yearly, F.col("max_drawdown")).alias("calmar"),
        ratio(F.col("total"), F.col("ulcer")).alias("martin"), ratio(F.col("total"), F.col("pain")).alias("pain_ratio"), "straightness", ratio(F.col("gain") - F.col("loss"), F.col("loss")).alias("gain_to_pain"),
    )
