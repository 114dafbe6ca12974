"""Closed-form laws of prices, trades and options, each one column expression. Undefined results are null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal

EULER = 0.5772156649015329


def _some(x: Column) -> Column:
    """null for what is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


# barriers and trades


def hit_probability(target: Column, stop: Column) -> Column:
    """Chance that a driftless walk meets a target before a stop, given their distances."""
    return F.try_divide(stop, stop + target)


def touch_probability(distance: Column, sigma: Column, time: Column) -> Column:
    """Chance that a driftless path touches a level within a time."""
    return 2 * normal.cdf(-F.try_divide(distance, sigma * F.sqrt(time)))


def close_probability(distance: Column, sigma: Column, time: Column) -> Column:
    """Chance that a driftless path ends beyond a level."""
    return normal.cdf(-F.try_divide(distance, sigma * F.sqrt(time)))


def expectancy(p: Column, reward: Column, cost: Column, risk: Column) -> Column:
    """Mean of a trade in units of risk."""
    return p * reward - (1 - p) - F.try_divide(cost, risk)


def break_even(cost: Column, risk: Column, reward: Column) -> Column:
    """Win rate at which a trade's mean is zero."""
    return F.try_divide(1 + F.try_divide(cost, risk), 1 + reward)


def required_drift(cost: Column, mean_time: Column) -> Column:
    """Drift that pays a cost over a mean holding time."""
    return F.try_divide(cost, mean_time)


def information_ratio(cost: Column, sigma: Column, mean_time: Column) -> Column:
    return F.try_divide(cost, sigma * F.sqrt(mean_time))


def noise_band(sigma: Column, time: Column) -> Column:
    """Mean absolute move of a driftless walk."""
    return sigma * F.sqrt(time) * math.sqrt(2 / math.pi)


def one_minute_sigma(dispersion: Column, minutes: Column) -> Column:
    return F.try_divide(dispersion, F.sqrt(minutes))


def wick_probability(k: Column) -> Column:
    """Chance that the upper wick is k bodies at least, in a driftless bar."""
    return F.try_divide(F.lit(1.0), 2 * k + 1)


def new_high_probability(below: Column, beyond: Column) -> Column:
    return F.try_divide(beyond, below + beyond)


def retracement_probability(ahead: Column, behind: Column) -> Column:
    return F.try_divide(behind, ahead + behind)


def martingale_hit(reward: Column) -> Column:
    return F.try_divide(F.lit(1.0), reward + 1)


def all_fail(p: Column, tries: Column) -> Column:
    return F.pow(1 - p, tries)


def kelly(p: Column, payoff: Column) -> Column:
    """Stake of greatest growth."""
    return p - F.try_divide(1 - p, payoff)


def jump_probability(rate: Column, time: Column) -> Column:
    return 1 - F.exp(-rate * time)


def half_life(rate: Column) -> Column:
    return F.try_divide(F.lit(math.log(2)), rate)


# statistics of a track record


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share."""
    p = F.try_divide(wins, n)
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (middle - half) / scale, (middle + half) / scale


def probabilistic_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, excess: Column) -> Column:
    """Probability that the true Sharpe ratio exceeds a benchmark; 0 or 1 where the variance term is not positive."""
    variance = 1 - skew * sharpe + (excess + 2) / 4 * sharpe * sharpe
    return F.when(variance > 0, normal.cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(variance))).otherwise((sharpe > benchmark).cast("double"))


def expected_best_sharpe(trials: Column, deviation: Column) -> Column:
    """Expected greatest Sharpe ratio of trials without skill; 0 below two."""
    return F.when(trials < 2, F.lit(0.0)).otherwise(deviation * ((1 - EULER) * normal.quantile(1 - 1 / trials) + EULER * normal.quantile(1 - 1 / (trials * math.e))))


def deflated_sharpe(sharpe: Column, n: Column, skew: Column, excess: Column, trials: Column, deviation: Column | None = None) -> Column:
    deviation = 1 / F.sqrt(n) if deviation is None else deviation
    return probabilistic_sharpe(sharpe, expected_best_sharpe(trials, deviation), n, skew, excess)


def minimum_track(sharpe: Column, benchmark: Column, skew: Column, excess: Column, z: float = 1.6448536269514722) -> Column:
    """Records needed for a significant Sharpe ratio; null if it is not above the benchmark."""
    variance = 1 - skew * sharpe + (excess + 2) / 4 * sharpe * sharpe
    return F.when(sharpe > benchmark, 1 + variance * F.pow(F.lit(z) / (sharpe - benchmark), 2))


def drawdown_null(deviation: Column, n: Column) -> Column:
    """Mean greatest drawdown of a walk without drift."""
    return math.sqrt(math.pi / 2) * deviation * F.sqrt(n)


def run_null(n: Column, q: Column) -> Column:
    """Expected longest run of losses, win rate 1 - q."""
    return _some(F.try_divide(F.log(n * (1 - q)), F.log(F.try_divide(F.lit(1.0), q))))


def block_length(rho: Column) -> Column:
    """Bootstrap block from a lag-1 autocorrelation."""
    return F.greatest(F.lit(1.0), F.when(rho == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(-1.0), F.log(F.abs(rho)))))


def hurst_of_ratio(ratio: Column, q: Column) -> Column:
    return 0.5 + F.log(ratio) / (2 * F.log(q))


def alpha_spent(alpha: Column, share: Column) -> Column:
    """O'Brien-Fleming-like spending by information share."""
    return F.least(alpha, 2 * (1 - normal.cdf(normal.quantile(1 - alpha / 2) / F.sqrt(share))))


def auc(separation: Column) -> Column:
    return normal.cdf(separation / math.sqrt(2))


def bayes_error(separation: Column) -> Column:
    return normal.cdf(-separation / 2)


def akaike(parameters: Column, log_likelihood: Column) -> Column:
    return 2 * parameters - 2 * log_likelihood


def bayes_criterion(parameters: Column, n: Column, log_likelihood: Column) -> Column:
    return parameters * F.log(n) - 2 * log_likelihood


def cornish_fisher(z: Column, skew: Column, excess: Column) -> Column:
    return z + (z * z - 1) * skew / 6 + (z * z * z - 3 * z) * excess / 24 - (2 * z * z * z - 5 * z) * skew * skew / 36


def bernoulli_entropy(p: Column) -> Column:
    """Bits of a biased coin."""
    part = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return part(p) + part(1 - p)


def divergence(p: Column, q: Column) -> Column:
    """Bits of divergence between two coins; null if q is certain of what p is not."""
    part = lambda a, b: F.when(a == 0, 0.0).when(b > 0, a * F.log2(a / b))
    return part(p, q) + part(1 - p, 1 - q)


def noise_edges(ratio: Column) -> tuple[Column, Column]:
    """Edges of the eigenvalues of pure noise, at a ratio of variables to records."""
    return F.pow(1 - F.sqrt(ratio), 2), F.pow(1 + F.sqrt(ratio), 2)


# options, zero rate


def d1(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    spread = sigma * F.sqrt(time)
    return F.when(spread > 0, (F.log(spot / strike) + sigma * sigma * time / 2) / spread)


def gamma(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    return normal.pdf(d1(spot, strike, sigma, time)) / (spot * sigma * F.sqrt(time))


def delta(spot: Column, strike: Column, sigma: Column, time: Column, call: Column) -> Column:
    up = normal.cdf(d1(spot, strike, sigma, time))
    return F.when(call, up).otherwise(up - 1)


def price(spot: Column, strike: Column, sigma: Column, time: Column, call: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    value = spot * normal.cdf(a) - strike * normal.cdf(a - sigma * F.sqrt(time))
    return F.when(call, value).otherwise(value - spot + strike)


def theta(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    return -sigma * sigma * spot * spot * gamma(spot, strike, sigma, time) / 2


def vega(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    return spot * normal.pdf(d1(spot, strike, sigma, time)) * F.sqrt(time)


def vanna(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    return -normal.pdf(a) * (a - sigma * F.sqrt(time)) / sigma


def volga(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    return vega(spot, strike, sigma, time) * a * (a - sigma * F.sqrt(time)) / sigma


def charm(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    return normal.pdf(a) * (a - sigma * F.sqrt(time)) / (2 * time)


def speed(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    return -gamma(spot, strike, sigma, time) / spot * (1 + d1(spot, strike, sigma, time) / (sigma * F.sqrt(time)))


def zomma(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    return gamma(spot, strike, sigma, time) * (a * (a - sigma * F.sqrt(time)) - 1) / sigma


def color(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    """Decay of gamma as time to expiry shrinks."""
    a, root = d1(spot, strike, sigma, time), sigma * F.sqrt(time)
    return gamma(spot, strike, sigma, time) / (2 * time) * (1 - a * (a - root))


def ultima(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    a = d1(spot, strike, sigma, time)
    b = a - sigma * F.sqrt(time)
    return -vega(spot, strike, sigma, time) / (sigma * sigma) * (a * b * (1 - a * b) + a * a + b * b)


def rho(spot: Column, strike: Column, sigma: Column, time: Column, call: Column) -> Column:
    """Change of value for a rate of one, at a rate of nought."""
    b = d1(spot, strike, sigma, time) - sigma * F.sqrt(time)
    return strike * time * F.when(call, normal.cdf(b)).otherwise(-normal.cdf(-b))


def veta(spot: Column, strike: Column, sigma: Column, time: Column) -> Column:
    """Decay of vega as time to expiry shrinks."""
    a = d1(spot, strike, sigma, time)
    return -vega(spot, strike, sigma, time) * (1 + a * (a - sigma * F.sqrt(time))) / (2 * time)


def minimum_backtest(trials: Column, sharpe: Column) -> Column:
    """Years of data below which the best of so many trials without skill is expected to reach a yearly Sharpe ratio."""
    return F.pow(expected_best_sharpe(trials, F.lit(1.0)) / sharpe, 2)


def implied_volatility(value: Column, spot: Column, strike: Column, time: Column, call: Column, rounds: int = 60) -> Column:
    """Bisection on [1e-8, 10] inside one expression; null if the value is outside what volatilities give."""
    start = F.struct(F.lit(1e-8).alias("lo"), F.lit(10.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        above = price(spot, strike, middle, time, call) > value
        return F.struct(F.when(above, s["lo"]).otherwise(middle).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((found > 1e-6) & (found < 9.999), found)
