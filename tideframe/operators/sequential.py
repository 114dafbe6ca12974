"""Group-sequential plans by numbers: the law of a test's walk is carried from look to look, bounds are solved on the way.

At information fraction t the walk B is normal with mean drift * t and variance t. Between looks its law, as far as no bound
ended it, is a density on nodes of the interval that goes on; the chance to end at the next look is a sum of normal tails, so
it is exact up to the nodes' rule (Simpson). A plan is a row, plans are independent, and tasks solve them batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .protocols import spent

LAW = NormalDist()
_erfc = np.frompyfunc(math.erfc, 1, 1)
#: Nodes for a deviation of the next step, deviations on either side that count, and the greatest inflation searched.
NODES, FAR, MOST_INFLATION = 6, 8.5, 3.0


def upper(z: np.ndarray) -> np.ndarray:
    """Chance of a standard normal value above z."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)).astype(float)


@dataclass
class Walk:
    """What goes on after a look: places and their masses."""

    t: float
    drift: float
    x: np.ndarray
    mass: np.ndarray

    def ends_above(self, t: float, bound: float) -> float:
        step = t - self.t
        return float((self.mass * upper((bound - self.x - self.drift * step) / math.sqrt(step))).sum())

    def ends_below(self, t: float, bound: float) -> float:
        step = t - self.t
        return float((self.mass * upper((self.x + self.drift * step - bound) / math.sqrt(step))).sum())

    def bound(self, t: float, mass: float, above: bool) -> float:
        """The place beyond which (above or below) a mass ends at t."""
        reach = FAR * math.sqrt(t) + 1
        lo, hi = self.drift * t - reach, self.drift * t + reach
        ends = self.ends_above if above else self.ends_below
        for _ in range(60):
            middle = (lo + hi) / 2
            if (ends(t, middle) > mass) == above:
                lo = middle
            else:
                hi = middle
        return (lo + hi) / 2

    def on(self, t: float, low: float, high: float, following: float) -> "Walk":
        """The law between two bounds at t; `following`: the step to the look after."""
        step = t - self.t
        low, high = max(low, self.drift * t - FAR * math.sqrt(t)), min(high, self.drift * t + FAR * math.sqrt(t))
        if high <= low:
            return Walk(t, self.drift, np.zeros(1), np.zeros(1))
        n = 2 * math.ceil(max(32.0, NODES * (high - low) / math.sqrt(min(step, following) if len(self.x) > 1 else min(t, following))) / 2)
        x, weight = np.linspace(low, high, n + 1), np.ones(n + 1)
        weight[1:-1:2], weight[2:-1:2] = 4, 2
        z = (x[:, None] - self.x - self.drift * step) / math.sqrt(step)
        density = np.exp(-z * z / 2) @ self.mass / math.sqrt(2 * math.pi * step)
        return Walk(t, self.drift, x, density * weight * (high - low) / (3 * n))


@dataclass
class Looks:
    """Bounds of each look on the scale of z, and the chances to end there above and below."""

    efficacy: list[float]
    futility: list[float]
    above: list[float]
    below: list[float]


def run(fractions: list[float], drift: float, level: float | None = None, efficacy: list[float] | None = None, miss: float | None = None, futility: list[float] | None = None) -> Looks:
    """One pass over the looks. Upper bounds spend `level` or are given; lower bounds spend `miss`, are given, or are none."""
    out, walk, last = Looks([], [], [], []), Walk(0.0, drift, np.zeros(1), np.ones(1)), len(fractions) - 1
    for k, t in enumerate(fractions):
        root, before = math.sqrt(t), fractions[k - 1] if k else 0.0
        part = lambda total: spent(t, total) - (spent(before, total) if k else 0.0)
        high = efficacy[k] * root if efficacy is not None else walk.bound(t, part(level), True)
        if miss is not None:
            low = high if k == last else min(high, walk.bound(t, part(miss), False))
        else:
            low = futility[k] * root if futility is not None else -math.inf
        out.efficacy.append(high / root)
        out.futility.append(low / root)
        out.above.append(walk.ends_above(t, high))
        out.below.append(walk.ends_below(t, low) if low > -math.inf else 0.0)
        if k < last:
            walk = walk.on(t, low, high, fractions[k + 1] - t)
    return out


@dataclass
class Plan:
    """A solved plan: bounds, information over that of a single look, power, and both laws' ends."""

    fractions: list[float]
    inflation: float
    power: float
    null: Looks
    moved: Looks

    def mean_fraction(self, looks: Looks) -> float:
        """Information used in the mean."""
        ends = [a + b for a, b in zip(looks.above, looks.below, strict=True)]
        return sum(t * p for t, p in zip(self.fractions, ends, strict=True)) + self.fractions[-1] * max(0.0, 1 - sum(ends))


def solve(fractions: list[float], level: float, power: float) -> Plan:
    """Upper bounds hold the level without the lower ones, which so bind nobody; lower bounds spend the chance to miss, under
    the drift that gives the power. Its size, by the information needed, is found by halving with secants."""
    efficacy = run(fractions, 0.0, level=level).efficacy
    needed = LAW.inv_cdf(1 - level) + LAW.inv_cdf(power)
    under = lambda inflation: run(fractions, needed * math.sqrt(inflation), efficacy=efficacy, miss=1 - power)
    lo, hi = 1.0, MOST_INFLATION
    f_lo, f_hi = sum(under(lo).above) - power, sum(under(hi).above) - power
    middle = lo
    if f_lo < 0 < f_hi:
        for turn in range(60):
            middle = (lo * f_hi - hi * f_lo) / (f_hi - f_lo) if turn % 3 else (lo + hi) / 2
            f = sum(under(middle).above) - power
            lo, f_lo, hi, f_hi = (middle, f, hi, f_hi) if f < 0 else (lo, f_lo, middle, f)
            if hi - lo < 1e-9 or abs(f) < 1e-11:
                break
    moved = under(middle)
    return Plan(fractions, middle, sum(moved.above), run(fractions, 0.0, efficacy=efficacy, futility=moved.futility), moved)


def information(trades: DataFrame, keys: list[str], day: str, looks: int) -> DataFrame:
    """keys and fractions: of each key's trades, the share made by the end of each of `looks` equal spans of its days. A span
    without trades makes no look; the last fraction is 1."""
    ends = trades.groupBy(*keys).agg(F.min(day).alias("_first"), (F.max(day) - F.min(day) + 1).alias("_days"), F.count(F.lit(1)).alias("_all"))
    look = F.floor((F.col(day) - F.col("_first")) * looks / F.col("_days"))
    counts = trades.join(ends, keys).groupBy(*keys, "_all", look.alias("_look")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_look")) / F.col("_all")
    return counts.withColumn("_t", upto).groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("fractions"))


LOOK = "look int, fraction double, efficacy double, futility double, reject_null double, abandon_null double, reject_moved double, abandon_moved double, inflation double, power double, mean_null double, mean_moved double"


def boundaries(plans: DataFrame, keys: list[str], level: float = 0.025, power: float = 0.9) -> DataFrame:
    """One row a look of each plan (keys, fractions rising to 1): bounds on z to reject and to abandon, the chances to end there
    without and with the drift that the plan is made for, the information over a single look's, and the mean share of it used.

    Plans with the same fractions in one batch are solved once. Null or empty fractions give no row.
    """
    names = [x.split()[0] for x in LOOK.split(", ")]
    kinds = dict(plans.dtypes)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[tuple, Plan] = {}
            rows = []
            for row in pdf.itertuples(index=False):
                t = tuple(row.fractions) if row.fractions is not None else ()
                if not t:
                    continue
                plan = known.setdefault(t, None) or solve(list(t), level, power)
                known[t] = plan
                for k in range(len(t)):
                    a, b = plan.null, plan.moved
                    rows.append((*row[:-1], k + 1, t[k], a.efficacy[k], a.futility[k], a.above[k], a.below[k], b.above[k], b.below[k], plan.inflation, plan.power, plan.mean_fraction(a), plan.mean_fraction(b)))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return plans.select(*keys, "fractions").mapInPandas(make, ", ".join([*[f"{k} {kinds[k]}" for k in keys], LOOK]))
