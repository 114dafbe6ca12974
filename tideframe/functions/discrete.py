"""Discrete laws as columns: log-gamma, binomials, and what a ladder of volumes shows by chance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal

# Stirling's series of log-gamma, coefficients of 1/x, 1/x**3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
#: Arguments below this are shifted up by it.
SHIFT = 8


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0, to about 1e-13."""
    y = F.when(x < SHIFT, x + SHIFT).otherwise(x)
    series = sum((c / F.pow(y, 2 * i + 1) for i, c in enumerate(STIRLING)), F.lit(0.0))
    made = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    rise = F.lit(1.0)
    for i in range(SHIFT):
        rise = rise * (x + i)
    return F.when(x > 0, made - F.when(x < SHIFT, F.log(rise)).otherwise(0.0))


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def even_binomial(n: Column, k: Column) -> Column:
    """Chance of k heads in n throws of an even coin; 0 outside."""
    return F.when((k >= 0) & (k <= n), F.exp(log_choose(n, k) - n * math.log(2))).otherwise(0.0)


#: exp(-80) lies far below a double's digits of a sum of chances.
FAR = 80.0
#: Terms of binomials held at once.
TERMS = 1 << 18
#: Log-factorials of the first whole numbers.
FACTORIALS = np.array([math.lgamma(k + 1.0) for k in range(256)])


def _even_chances(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Chances of k heads in n throws, for k in the binomial's body: by a table for few throws, else by Stirling's series about
    the middle, which keeps its digits for any n."""
    out, few = np.empty(len(n)), n < len(FACTORIALS)
    i, j = n[few].astype(np.int64), k[few].astype(np.int64)
    out[few] = FACTORIALS[i] - FACTORIALS[j] - FACTORIALS[i - j] - i * math.log(2)
    n, k = n[~few], k[~few]
    rest, lean = n - k, (2 * k - n) / n
    series = lambda x: sum(c / x ** (2 * i + 1) for i, c in enumerate(STIRLING))
    out[~few] = series(n) - series(k) - series(rest) + 0.5 * np.log(n / (2 * math.pi * k * rest)) - k * np.log1p(lean) - rest * np.log1p(-lean)
    return np.exp(out)


def _body(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of heads in n throws of an even coin beyond which chances add nothing in a double."""
    reach = np.sqrt(FAR * n / 2) + 1
    return np.floor(np.maximum(n / 2 - reach, 0)), np.ceil(np.minimum(n / 2 + reach, n))


def _terms(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of binomials of even coins: where each begins, its numbers of heads in order, and their chances."""
    first, last = _body(n)
    size = (last - first + 1).astype(np.int64)
    begin = np.cumsum(size) - size
    k = (np.arange(size.sum()) - np.repeat(begin - first.astype(np.int64), size)).astype(float)
    return begin, k, _even_chances(np.repeat(n, size), k)


def _chances(n: np.ndarray, m: np.ndarray, ratio: float, least: float, clump: float) -> np.ndarray:
    """imbalance_chance of levels of n clumps beside neighbours of m."""
    begin, a, high = _terms(n)
    other, _, low = _terms(m)
    rows = np.repeat(np.arange(len(n)), np.diff(np.append(begin, len(a))))
    first, last = _body(m)
    # the neighbour's distribution function, each row's from its own start
    upto = np.cumsum(low)
    upto = upto - np.repeat(upto[other] - low[other], np.diff(np.append(other, len(low))))
    bound = np.floor(a / ratio)
    at = other[rows] + np.clip(bound - first[rows], 0, (last - first)[rows]).astype(np.int64)
    below = np.where(bound < first[rows], 0.0, np.minimum(upto[at], 1.0))
    counts = (a * clump >= least) & (a >= ratio)
    return np.bincount(rows, np.where(counts, high * below, 0.0), len(n))


def imbalance_chance(high: Column, low: Column, ratio: float = 3.0, least: float = 10.0, clump: float = 1.0) -> Column:
    """Chance that one side of a level (volume `high`) is `ratio` times the other side of its neighbour (volume `low`) and at
    least `least`, where each clump of either level is as likely on either side.

    The sum runs over the first level's clumps and takes the neighbour's distribution function at each. Both binomials are
    summed over their bodies alone, as many terms as the root of a volume; what lies outside is below a double's digits. A
    side of nothing counts as one, as in the reading.
    """

    @F.pandas_udf("double")
    def chance(high: pd.Series, low: pd.Series) -> pd.Series:
        n, m = np.rint(high.to_numpy(float) / clump), np.rint(low.to_numpy(float) / clump)
        out = np.zeros(len(n))
        rows = np.flatnonzero((n >= 1) & (m >= 0))  # what is missing compares with nothing
        size = np.cumsum(sum(last - first + 1 for first, last in (_body(n[rows]), _body(m[rows]))))
        for part in np.split(rows, np.flatnonzero(np.diff(np.floor(size / TERMS))) + 1):
            out[part] = _chances(n[part], m[part], ratio, least, clump)
        return pd.Series(out)

    return chance(high.cast("double"), low.cast("double"))


def impact_z(move: Column, volume: Column, impact: float) -> Column:
    """A bar's move over what its volume's square root would bring."""
    return move / (impact * F.sqrt(F.greatest(volume, F.lit(1.0))))


def central_chance(z: Column) -> Column:
    """Chance of a normal value no farther from 0 than z: small where a move is unusually small."""
    return 2 * normal.cdf(F.abs(z)) - 1
