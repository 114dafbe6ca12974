"""Reports that put several measures of a track record beside their thresholds."""

from __future__ import annotations

from math import log
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normal
from .blocks import running_sums
from .stats import lagged_gaps

LAW = NormalDist()


def records_needed(effect: Column, level: float = 0.05, power: float = 0.8) -> Column:
    """Records that tell a mean of `effect` deviations from none; null where there is none."""
    return F.when(effect > 0, F.pow((LAW.inv_cdf(1 - level) + LAW.inv_cdf(power)) / effect, 2))


def validation(trades: DataFrame, keys: list[str], order: list[str], value: str, trials: int = 1, effect: float = 0.1, folds: int = 5) -> DataFrame:
    """Checks of each record, all of which have to hold: keys, check, value, threshold, passed, accepted.

    sample: as many records as tell an effect of `effect` deviations. selection: the Sharpe ratio against what the best of
    `trials` is expected to show by chance. interval: the mean's lower bound of 95 %, its error widened for autocorrelation
    (from 30 records on). signs: the chance of such a total if signs were drawn evenly (from 30 on). folds: the share of
    consecutive folds with a positive mean (from 100 on). margin: the mean. A record without spread has a Sharpe ratio of 0.
    """
    x = F.col(value)
    gaps = lagged_gaps(trades, keys, order, value)
    parts = gaps.groupBy(*keys, F.floor((F.col("_i") - 1) * folds / F.col("_n")).alias("_fold")).agg(F.avg(x).alias("_m"), F.sum(F.col("_d") * F.col("_before")).alias("_db"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    told = parts.groupBy(*keys).agg(F.avg((F.col("_m") > 0).cast("double")).alias("_positive"), F.try_divide(F.sum("_db"), F.sum("_dd")).alias("rho"))
    sums = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(x).alias("_total"), F.sum(x * x).alias("_squares"))
    rows = sums.join(told, keys)
    rho = F.least(F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(0.0)), F.lit(0.99))
    n, sharpe = F.col("n"), F.coalesce(F.try_divide(F.col("mean"), F.col("sd")), F.lit(0.0))
    lower = F.when(n >= 30, F.col("mean") - LAW.inv_cdf(0.975) * F.col("sd") / F.sqrt("n") * F.sqrt((1 + rho) / (1 - rho)))
    chance = F.when(n >= 30, 1 - normal.cdf(F.coalesce(F.try_divide(F.col("_total"), F.sqrt("_squares")), F.lit(0.0)))).otherwise(1.0)
    best = F.lit(0.0) if trials < 2 else F.sqrt(2 * log(trials) / n)
    needed = ((LAW.inv_cdf(0.95) + LAW.inv_cdf(0.8)) / effect) ** 2
    told = {
        "sample": (n.cast("double"), F.lit(needed), n >= needed),
        "selection": (sharpe, best, sharpe > best),
        "interval": (lower, F.lit(0.0), F.coalesce(lower > 0, F.lit(False))),
        "signs": (chance, F.lit(0.05), chance < 0.05),
        "folds": (F.when(n >= 100, F.col("_positive")).otherwise(0.0), F.lit(0.6), (n >= 100) & (F.col("_positive") >= 0.6)),
        "margin": (F.col("mean"), F.lit(0.0), F.col("mean") > 0),
    }
    each = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value"), t.cast("double").alias("threshold"), p.alias("passed")) for k, (v, t, p) in told.items()])
    out = rows.withColumn("_all", each).withColumn("accepted", F.forall("_all", lambda c: c["passed"]))
    return out.select(*keys, F.explode("_all").alias("_c"), "accepted").select(*keys, "_c.check", "_c.value", "_c.threshold", "_c.passed", "accepted")


def effective_trials(results: DataFrame, config: str, day: str, value: str) -> DataFrame:
    """How many independent trials the configurations amount to, by the mean correlation of their daily results (days without
    a result count as 0): trials, mean_correlation, effective. Configurations without spread do not count.

    The mean correlation comes from the variance of the sum of standardised results, so no pair of configurations is formed.
    """
    daily = results.groupBy(config, day).agg(F.sum(value).alias("_x"))
    days = results.agg(F.countDistinct(day).alias("_days"))
    sums = daily.groupBy(config).agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q")).crossJoin(F.broadcast(days))  # one row
    mean = F.col("_s") / F.col("_days")
    laws = sums.select(config, mean.alias("_m"), F.sqrt(F.col("_q") / F.col("_days") - mean * mean).alias("_sd"), "_days").where("_sd > 0")
    # a day's sum of standardised results: that of days without any, and what each result adds to it
    base = laws.agg(F.count(F.lit(1)).alias("trials"), F.sum(-F.col("_m") / F.col("_sd")).alias("_base"), F.first("_days").alias("_days"))
    added = daily.join(laws, config).groupBy(day).agg(F.sum(F.col("_x") / F.col("_sd")).alias("_z"))
    made = added.crossJoin(F.broadcast(base)).groupBy("trials", "_days", "_base").agg(F.sum(F.pow(F.col("_z") + F.col("_base"), 2)).alias("_sq"), F.count(F.lit(1)).alias("_met"))  # one row
    total = F.col("_sq") + (F.col("_days") - F.col("_met")) * F.col("_base") * F.col("_base")
    t = F.col("trials")
    rho = F.when(t > 1, F.greatest(F.lit(0.0), (total / F.col("_days") - t) / (t * (t - 1)))).otherwise(0.0)
    return made.select("trials", rho.alias("mean_correlation"), (t / (1 + (t - 1) * rho)).alias("effective"))


def adjusted_chance(p: Column, tests: int, method: str = "dependent") -> Column:
    """The chance of a first-ranked test among many: `plain` multiplies it by their number, `dependent` by the harmonic sum as
    well, which holds under any dependence."""
    factor = tests * (sum(1 / j for j in range(1, tests + 1)) if method == "dependent" else 1)
    return F.least(F.lit(1.0), p * factor)


def haircut(sharpe: Column, n: Column, tests: int, method: str = "dependent") -> Column:
    """The part of a Sharpe ratio that goes when the number of tests is accounted for; all of it where nothing is left."""
    p = adjusted_chance(F.greatest(1 - normal.cdf(sharpe * F.sqrt(n)), F.lit(1e-15)), tests, method)
    left = normal.quantile(1 - p) / F.sqrt(n)
    return F.when((sharpe <= 0) | (n < 2) | (p >= 0.5), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - left / sharpe))


def stability(cells: DataFrame, keys: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """Of the cells of each grid that have a value: how many, the share above a floor, median, least and most."""
    x = F.col(value)
    made = cells.where(x.isNotNull()).groupBy(*keys)
    return made.agg(F.count(F.lit(1)).alias("cells"), F.avg((x > floor).cast("double")).alias("above"), F.percentile(x, F.lit(0.5)).alias("middle"), F.min(x).alias("least"), F.max(x).alias("most"))


def costs_with_floors(commission: Column, slip: Column, least_commission: float, least_slip: float = 1.0) -> tuple[Column, Column, Column]:
    """Commission and slip, no less than their floors, and whether either was raised; what is missing takes its floor."""
    paid, slid = F.greatest(F.coalesce(commission, F.lit(least_commission)), F.lit(least_commission)), F.greatest(F.coalesce(slip, F.lit(least_slip)), F.lit(least_slip))
    return paid, slid, F.coalesce((paid != commission) | (slid != slip), F.lit(True))


def follow_up_plan(trades: DataFrame, keys: list[str], order: list[str], value: str, day: str, cut: Column, cost: float, level: float = 0.05, power: float = 0.8) -> DataFrame:
    """What the days up to a cut say about those after it, and how Wald's test of the latter ended, of each record.

    rate, expected (records after the cut at that rate) and required (to tell the mean from minus the cost) with enough;
    p_even and p_win: the win rate that would break even, and the one seen; decision after the cut: "better", "null",
    "going on", or "none" where the win rate seen is not above the even one; at: the record after the cut (wins and losses
    count, results of nought do not) that ended it.
    """
    x, early = F.col(value), F.col(day) <= cut
    days = lambda seen: F.countDistinct(F.when(seen, F.col(day)))
    known = trades.groupBy(*keys).agg(
        F.count_if(early).alias("_n"), days(early).alias("_days"), days(~early).alias("_more"), F.avg(F.when(early, x)).alias("_mean"), F.stddev_samp(F.when(early, x)).alias("_sd"),
        F.try_divide(F.count_if(early & (x > 0)).cast("double"), F.count_if(early & (x != 0))).alias("p_win"), F.avg(F.when(early & (x > 0), x)).alias("_won"), F.avg(F.when(early & (x < 0), -x)).alias("_lost"),
    ).withColumn("p_even", F.col("_lost") / (F.col("_won") + F.col("_lost")))
    sound = F.col("p_even").between(1e-12, 1 - 1e-12) & F.col("p_win").between(1e-12, 1 - 1e-12) & (F.col("p_win") > F.col("p_even"))
    known = known.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    late = trades.where(~early & (x != 0)).join(known.where("_sound").select(*keys, "p_even", "p_win"), keys)
    w = W.partitionBy(*keys).orderBy(*order)
    step = F.when(x > 0, F.log(F.col("p_win") / F.col("p_even"))).otherwise(F.log((1 - F.col("p_win")) / (1 - F.col("p_even"))))
    late = late.withColumns({"_i": F.row_number().over(w), "_path": F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))})
    up, down = log((1 - (1 - power)) / level), log((1 - power) / (1 - level))
    ended = late.where((F.col("_path") >= up) | (F.col("_path") <= down)).groupBy(*keys).agg(F.min("_i").alias("at"), F.min_by(F.when(F.col("_path") >= up, "better").otherwise("null"), "_i").alias("_how"))
    rate, edge = F.col("_n") / F.col("_days"), F.col("_mean") + cost
    required = records_needed(F.try_divide(edge, F.col("_sd")), level, power)
    out = known.join(ended, keys, "left").withColumns({"rate": rate, "expected": rate * F.col("_more"), "required": required})
    decision = F.when(~F.col("_sound"), "none").otherwise(F.coalesce("_how", F.lit("going on")))
    return out.select(*keys, "rate", "expected", "required", F.coalesce(F.col("expected") >= F.col("required"), F.lit(False)).alias("enough"), "p_even", "p_win", decision.alias("decision"), "at")


def corrected_exponent(ratios: DataFrame, nulls: DataFrame, series: list[str]) -> DataFrame:
    """Scaling exponent of variance ratios (q, vr) divided by what chance gives them (nulls: series, q, vr), one step
    included: half the slope of log (q * ratio) on log q, and its fit."""
    rows = ratios.join(nulls.select(*series, "q", F.col("vr").alias("_null")), [*series, "q"]).where("vr > 0 and _null > 0")
    points = rows.select(*series, F.log(F.col("q").cast("double")).alias("x"), F.log(F.col("q") * F.col("vr") / F.col("_null")).alias("y"))
    one = rows.select(*series).distinct().select(*series, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    made = points.unionByName(one).groupBy(*series)
    return made.agg((F.regr_slope("y", "x") / 2).alias("exponent"), F.regr_r2("y", "x").alias("fit"), F.count(F.lit(1)).alias("points"))




def ratio_null(n: Column, q: Column) -> Column:
    """What the variance ratio of q overlapping steps gives n independent returns whose mean is taken from themselves."""
    return (1 - q / n) / (1 - 1 / n)


def split(trades: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, Sharpe ratio and t of each part."""
    made = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    sharpe = F.coalesce(F.try_divide(F.col("mean"), F.col("sd")), F.lit(0.0))
    return made.withColumn("sharpe", sharpe).withColumn("t", F.col("sharpe") * F.sqrt("n"))


def response(events: DataFrame, keys: list[str], second: str, windows: list[tuple[int, int]]) -> DataFrame:
    """Events a second from `lo` (not included) to `hi` seconds after each event, over those events whose window ends by the
    last one: keys, lo, hi, windows (how many), rate.

    The number of events up to any second is a prefix sum, so a window costs two look-ups and no pair of events is formed.
    """
    ends = events.groupBy(*keys).agg(F.max(second).alias("_end"))
    counts = events.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("_n")).join(ends, keys)
    spans = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in windows]))
    asked = counts.select(*keys, F.col(second).alias("_from"), "_n", "_end", spans.alias("_w")).where(F.col("_from") + F.col("_w.hi") <= F.col("_end"))
    probes = asked.select(*keys, F.explode(F.array(F.col("_from") + F.col("_w.lo"), F.col("_from") + F.col("_w.hi"))).alias(second), F.lit(0).alias("_n"))
    upto = running_sums(counts.select(*keys, second, "_n").unionByName(probes).groupBy(*keys, second).agg(F.sum("_n").alias("_n")), keys, second, {"_upto": F.col("_n")})
    at = lambda name: upto.select(*keys, F.col(second).alias(f"_{name}"), F.col("_upto").alias(name))
    told = asked.withColumns({"_low": F.col("_from") + F.col("_w.lo"), "_high": F.col("_from") + F.col("_w.hi")}).join(at("low"), [*keys, "_low"]).join(at("high"), [*keys, "_high"])
    made = told.groupBy(*keys, "_w.lo", "_w.hi").agg(F.sum("_n").alias("windows"), F.sum(F.col("_n") * (F.col("high") - F.col("low"))).alias("_met"))
    return made.select(*keys, "lo", "hi", "windows", (F.col("_met") / (F.col("windows") * (F.col("hi") - F.col("lo")))).alias("rate"))
