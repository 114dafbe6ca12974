"""Walks between two barriers under a deadline, and trades whose stop moves to their entry, as columns.

A walk starts at 0 with a stop at -a, a target at b, a drift and a deviation a unit of time. Two series give the chances until
a deadline: one over modes of the strip, whose terms fall as exp(-n**2 * s), and one over mirror images of the barriers, whose
terms fall as exp(-k**2 / s), with s the deadline's variance over the squared width. Each row takes the one that is short for
it, with as many terms as a double's digits need. The series run over batches of rows. Undefined results are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Below this ratio of variance to squared width the images are used: two on either side do there, thirteen modes beyond.
SHORT_TIME = 0.05
#: exp(-39.2) lies below a double's digits.
DIGITS = 39.2
#: Steps of the integral over time under a scaling law, even.
QUADRATURE = 128


def _tails(z: np.ndarray) -> np.ndarray:
    """Chances that a standard normal value is above each z, to a double's relative digits, also far out."""
    return 0.5 * np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), float, len(z))


def _columns(function: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A function of arrays as one of columns of doubles, null where it gives no number."""

    def made(*columns: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(function(*(c.to_numpy(float) for c in columns)))

    return lambda *columns: F.pandas_udf(made, DoubleType())(*(c.cast("double") for c in columns))


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal value is above z, to a double's relative digits, also far out."""
    return _columns(_tails)(z)


def _sound(stop: Column, target: Column, horizon: Column, sigma: Column) -> Column:
    return (stop > 0) & (target > 0) & (horizon > 0) & (sigma > 0)


def _late(ratio: np.ndarray, odd: bool) -> Iterator[tuple[float, np.ndarray]]:
    """Each mode with the places of the rows that need it, those of short times having none."""
    left = np.flatnonzero(ratio >= SHORT_TIME)
    most = np.ceil(np.sqrt(2 * DIGITS / (math.pi**2 * ratio[left])))
    for n in itertools.count(1, 2 if odd else 1):
        left, most = (left, most) if n == 1 else (left[most >= n], most[most >= n])
        if not len(left):
            return
        yield float(n), left


#: Mirror images on either side that short times need.
IMAGES = range(-2, 3)


def target_first(stop: Column, target: Column, drift: Column, sigma: Column) -> Column:
    """Chance that a walk without a deadline meets its target before its stop."""
    rate = 2 * drift / (sigma * sigma)
    # by the end nearer to the drift's side, so that nothing overflows
    up = F.when(rate > 0, F.expm1(-rate * stop) / F.expm1(-rate * (stop + target))).otherwise(F.exp(rate * target) * F.expm1(rate * stop) / F.expm1(rate * (stop + target)))
    return F.when((stop > 0) & (target > 0) & (sigma > 0), F.when(F.abs(rate * (stop + target)) < 1e-12, stop / (stop + target)).otherwise(up))


def _met(near: np.ndarray, far: np.ndarray, ever: np.ndarray, horizon: np.ndarray, drift: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Chance that a walk meets the barrier `near` above it by a deadline before the one `far` below it; ever: without one."""
    width, variance = near + far, sigma * sigma
    ratio, theta, slow = variance * horizon / width**2, drift / variance, drift * drift / (2 * variance)
    total = np.zeros(len(near))
    for n, i in _late(ratio, odd=False):
        rate = n * n * math.pi**2 * variance[i] / (2 * width[i] ** 2) + slow[i]
        total[i] += n * np.sin(n * math.pi * near[i] / width[i]) * np.exp(theta[i] * near[i] - rate * horizon[i]) / rate
    out = ever - math.pi * variance / width**2 * total
    i = np.flatnonzero(ratio < SHORT_TIME)
    near, width, theta, pull, moved, spread = near[i], width[i], theta[i], np.abs(theta[i]), np.abs(drift[i]) * horizon[i], sigma[i] * np.sqrt(horizon[i])
    early = np.zeros(len(i))
    for k in IMAGES:
        x = near + 2 * k * width
        y = np.abs(x)
        # the second part is below exp(-pull * y), so it counts only where that does; nothing is left in a double 38 deviations out
        back = np.where(pull * y < 50, np.exp(theta * near + np.minimum(pull * y, 50)) * _tails((y + moved) / spread), 0.0)
        there = np.exp(theta * near - pull * y) * _tails((y - moved) / spread) + back
        early += np.where((y - moved) / spread > 38, 0.0, np.sign(x) * there)
    out[i] = early
    return np.clip(out, 0.0, 1.0)


def barrier_chances(stop: Column, target: Column, horizon: Column, drift: Column, sigma: Column) -> Column:
    """(target, stop, open): chances to meet the target first, the stop first, or neither, by the deadline."""
    up = _columns(_met)(target, stop, target_first(stop, target, drift, sigma), horizon, drift, sigma)
    down = _columns(_met)(stop, target, target_first(target, stop, -drift, sigma), horizon, -drift, sigma)
    return F.when(_sound(stop, target, horizon, sigma), F.struct(up.alias("target"), down.alias("stop"), F.greatest(F.lit(0.0), 1 - up - down).alias("open")))


def _survival(stop: np.ndarray, target: np.ndarray, horizon: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    width = stop + target
    ratio = sigma * sigma * horizon / width**2
    out = np.zeros(len(stop))
    for n, i in _late(ratio, odd=True):
        out[i] += 4 / (n * math.pi) * np.sin(n * math.pi * stop[i] / width[i]) * np.exp(-n * n * math.pi**2 * ratio[i] / 2)
    i = np.flatnonzero(ratio < SHORT_TIME)
    lost, spread = np.zeros(len(i)), sigma[i] * np.sqrt(horizon[i])
    for k in IMAGES:
        for first in (target[i], stop[i]):
            x = first + 2 * k * width[i]
            lost += 2 * np.sign(x) * _near_tails(np.abs(x) / spread)
    out[i] = 1 - lost
    return np.clip(out, 0.0, 1.0)


def _near_tails(z: np.ndarray) -> np.ndarray:
    """_tails where they count beside one."""
    out = np.zeros(len(z))
    i = np.flatnonzero(z <= 9)
    out[i] = _tails(z[i])
    return out


def survival(stop: Column, target: Column, horizon: Column, sigma: Column) -> Column:
    """Chance that a driftless walk meets neither barrier by the deadline."""
    return F.when(_sound(stop, target, horizon, sigma), _columns(_survival)(stop, target, horizon, sigma))


def _exit_time(stop: np.ndarray, target: np.ndarray, horizon: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    width, variance = stop + target, sigma * sigma
    ratio = variance * horizon / width**2
    total = np.zeros(len(stop))
    for n, i in _late(ratio, odd=True):
        total[i] += 4 / (n * math.pi) * np.sin(n * math.pi * stop[i] / width[i]) * np.exp(-n * n * math.pi**2 * ratio[i] / 2) * 2 * width[i] ** 2 / (n * n * math.pi**2 * variance[i])
    out = stop * target / variance - total
    i = np.flatnonzero(ratio < SHORT_TIME)
    met, spread = np.zeros(len(i)), sigma[i] * np.sqrt(horizon[i])
    for k in IMAGES:
        for first in (target[i], stop[i]):
            # the integral over the horizon of the chance that a level x away was met, with x's sign
            x = first + 2 * k * width[i]
            z = np.abs(x) / spread
            met += np.sign(x) * 2 * horizon[i] * ((1 + z * z) * _near_tails(z) - z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    out[i] = horizon[i] - met
    return out


def exit_time(stop: Column, target: Column, horizon: Column, sigma: Column) -> Column:
    """Mean time until a driftless walk meets a barrier or the deadline comes."""
    return F.when(_sound(stop, target, horizon, sigma), _columns(_exit_time)(stop, target, horizon, sigma))


def outcome(stop: Column, target: Column, horizon: Column, sigma: Column) -> Column:
    """Of a driftless trade: chances (target, stop, open), mean of the open ones' result over all trades, mean time, deviation.

    A stopped martingale has mean 0 and its variance is that of the time it ran.
    """
    chances = barrier_chances(stop, target, horizon, F.lit(0.0), sigma)
    time = exit_time(stop, target, horizon, sigma)
    parts = [chances[x].alias(x) for x in ("target", "stop", "open")]
    return F.struct(*parts, (chances["stop"] * stop - chances["target"] * target).alias("mean_open"), time.alias("time"), (sigma * F.sqrt(time)).alias("deviation"))


def scaling_exponent(short: Column, long: Column, horizon: Column) -> Column:
    """Exponent at which a deviation over one unit of time grows to that over a horizon."""
    return F.when((short > 0) & (long > 0) & (horizon > 1), F.log(long / short) / F.log(horizon))


def _scaled_time(stop: np.ndarray, target: np.ndarray, horizon: np.ndarray, sigma: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Survival's integral over real time by Simpson's rule."""
    step, total = horizon / QUADRATURE, np.ones(len(stop))
    for i in range(1, QUADRATURE + 1):
        weight = 1.0 if i == QUADRATURE else 4.0 if i % 2 == 1 else 2.0
        total += weight * _survival(stop, target, (i * step) ** (2 * exponent), sigma)
    return total * step / 3


def scaled_outcome(stop: Column, target: Column, horizon: Column, sigma: Column, exponent: Column) -> Column:
    """outcome where deviations grow with a power of time: chances and deviation at the changed time, the mean time in real
    time, as an integral of survival by Simpson's rule."""
    made = outcome(stop, target, F.pow(horizon, 2 * exponent), sigma)
    time = F.when(_sound(stop, target, horizon, sigma), _columns(_scaled_time)(stop, target, horizon, sigma, exponent))
    return F.when((exponent > 0) & (exponent < 1), made.withField("time", time))


# trades whose stop moves to the entry


def managed_chances(stop: Column, target: Column, trigger: Column, drift: Column, after: Column, sigma: Column) -> Column:
    """(target, even, stop) of a trade whose stop moves to its entry at a trigger, with another drift from there on. Without a
    trigger the stop stays."""
    reached, paid = target_first(stop, trigger, drift, sigma), target_first(trigger, target - trigger, after, sigma)
    plain = target_first(stop, target, drift, sigma)
    p = lambda a, b: F.when(trigger.isNull(), a).otherwise(b)
    return F.struct(p(plain, reached * paid).alias("target"), p(F.lit(0.0), reached * (1 - paid)).alias("even"), p(1 - plain, 1 - reached).alias("stop"))


def unmanaged_chances(stop: Column, target: Column, trigger: Column, drift: Column, after: Column, sigma: Column) -> Column:
    """The same trade and drifts with the stop left where it was."""
    won = F.when(trigger.isNull(), target_first(stop, target, drift, sigma)).otherwise(target_first(stop, trigger, drift, sigma) * target_first(trigger + stop, target - trigger, after, sigma))
    return F.struct(won.alias("target"), F.lit(0.0).alias("even"), (1 - won).alias("stop"))


def trade_moments(chances: Column, stop: Column, target: Column, cost: Column) -> Column:
    """(mean, deviation) of a trade in units of its stop."""
    paid = {"target": (target - cost) / stop, "even": -cost / stop, "stop": -(stop + cost) / stop}
    mean = sum((chances[k] * v for k, v in paid.items()), F.lit(0.0))
    variance = sum((chances[k] * F.pow(v - mean, 2) for k, v in paid.items()), F.lit(0.0))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("deviation"))


def trades_needed(moments: Column, t: float = 2.0) -> Column:
    """Trades after which a t statistic is expected; null for a mean that is not positive."""
    return F.when(moments["mean"] > 0, F.pow(t * moments["deviation"] / moments["mean"], 2))


def moving_cost(stop: Column, target: Column, trigger: Column, drift: Column, after: Column, sigma: Column, cost: Column) -> Column:
    """What moving the stop to the entry costs in the mean, in units of the stop."""
    left = trade_moments(unmanaged_chances(stop, target, trigger, drift, after, sigma), stop, target, cost)["mean"]
    return left - trade_moments(managed_chances(stop, target, trigger, drift, after, sigma), stop, target, cost)["mean"]


def neutral_drift(stop: Column, target: Column, trigger: Column, sigma: Column, low: float = -5.0, high: float = 5.0, steps: int = 50) -> Column:
    """The drift after the trigger at which moving the stop costs nothing, by halving an interval; null if no sign changes in
    it. Drift before it and costs scale or cancel."""
    gain = lambda after: moving_cost(stop, target, trigger, F.lit(0.0), after, sigma, F.lit(0.0))

    def halve(acc: Column, _) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        below = gain(middle) < 0
        return F.struct(F.when(below, middle).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), halve)
    return F.when(gain(F.lit(low)) * gain(F.lit(high)) < 0, (found["lo"] + found["hi"]) / 2)


def required_lift(stop: Column, target: Column, cost: Column) -> Column:
    """How much the chance of the target must rise over a driftless walk's to pay the cost."""
    return F.try_divide(cost, stop + target)
