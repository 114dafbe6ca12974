"""Measures of sessions: volume-weighted means, dispersion, the noise band's trades, the local scale of a stop."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Mean absolute move of a driftless walk over its deviation.
ABS_MOVE = math.sqrt(2 / math.pi)


def session_vwap(bars: DataFrame) -> DataFrame:
    """bars with the running mean price and deviation of their session (vwap, sd), weighted by volume. If no bar of the
    whole table has volume all weigh alike; else both are null until the session has some."""
    some = bars.agg((F.max("v") > 0).alias("_some"))
    upto = W.partitionBy("instrument", "session").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3
    rows = bars.crossJoin(F.broadcast(some))  # one row
    rows = rows.withColumn("_w", F.when(F.col("_some"), F.greatest("v", F.lit(0.0))).otherwise(1.0)).withColumn("_p0", F.first(typical).over(upto)).withColumn("_x", typical - F.col("_p0"))
    total = F.sum("_w").over(upto)
    mean = F.when(total > 0, F.try_divide(F.sum(F.col("_w") * F.col("_x")).over(upto), total))
    square = F.try_divide(F.sum(F.col("_w") * F.col("_x") * F.col("_x")).over(upto), total)
    rows = rows.withColumns({"_m": mean, "_v": square - mean * mean})
    return rows.withColumns({"vwap": F.col("_p0") + F.col("_m"), "sd": F.when(F.col("_v") > 1e-12, F.sqrt("_v")).when(F.col("_v").isNotNull(), 0.0)}).drop("_some", "_w", "_p0", "_x", "_m", "_v")


def period_vwap(bars: DataFrame, period: str, epoch_day: str = "session") -> DataFrame:
    """bars with the running volume-weighted mean price since their `week` (from Monday) or `month` began; null until it has
    volume. A period's running sums start from totals of the sessions before, so one group is a session, not a period.

    epoch_day: the session's day number since 1970.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col(epoch_day).cast("int"))
    rows = bars.withColumns({"_period": F.trunc(day, period), "_x": (F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v")})
    keys = ["instrument", "_period"]
    days = rows.groupBy(*keys, "session").agg(F.sum("v").alias("_v"), F.sum("_x").alias("_px"))
    before = W.partitionBy(*keys).orderBy("session").rowsBetween(W.unboundedPreceding, -1)  # the sessions of a period: few
    days = days.select(*keys, "session", F.coalesce(F.sum("_v").over(before), F.lit(0.0)).alias("_v0"), F.coalesce(F.sum("_px").over(before), F.lit(0.0)).alias("_x0"))
    upto = W.partitionBy(*keys, "session").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    made = rows.join(days, [*keys, "session"]).withColumns({"_w": F.sum("v").over(upto) + F.col("_v0"), "_s": F.sum("_x").over(upto) + F.col("_x0")})
    return made.withColumn("vwap", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w"))).drop("_period", "_x", "_v0", "_x0", "_w", "_s")


def day_vwap(bars: DataFrame) -> DataFrame:
    """Mean price of each session: a quarter of open, high, low and close by volume; the mean close where there is none."""
    price = (F.col("o") + F.col("h") + F.col("l") + F.col("c")) / 4
    return bars.groupBy("instrument", "session").agg(F.coalesce(F.when(F.sum("v") > 0, F.try_divide(F.sum(price * F.col("v")), F.sum("v"))), F.avg("c")).alias("vwap"))


def rolling_dispersion(days: DataFrame, width: int = 14) -> DataFrame:
    """days (open, close) with the deviation of open-to-close moves of the `width` sessions before, null until there are so many."""
    past = W.partitionBy("instrument").orderBy("session").rowsBetween(-width, -1)
    move = F.col("close") - F.col("open")
    return days.withColumn("dispersion", F.when(F.count(move).over(past) == width, F.stddev_samp(move).over(past)))


def median_step_deviation(bars: DataFrame, lo: int, hi: int) -> DataFrame:
    """Of each instrument: the median over sessions of the deviation of close changes between bars that follow each other
    inside [lo, hi) of the session. Sessions of fewer than two changes do not count."""
    w = W.partitionBy("instrument", "session").orderBy("t")
    step = F.when((F.col("t") - F.lag("t").over(w) == 1) & (F.lag("sessmin").over(w) >= lo) & (F.col("sessmin") < hi), F.col("c") - F.lag("c").over(w))
    per = bars.withColumn("_step", step).groupBy("instrument", "session").agg(F.stddev_samp("_step").alias("_sd"), F.count("_step").alias("_n")).where("_n >= 2")
    return per.groupBy("instrument").agg(F.percentile("_sd", F.lit(0.5)).alias("sigma"), F.count(F.lit(1)).alias("sessions"))


def noise_band(sigma: Column, minute: Column) -> Column:
    """Mean absolute move after `minute` bars of a walk whose steps have deviation sigma."""
    return sigma * F.sqrt(minute) * ABS_MOVE


NOISE_TRADES = "instrument string, session long, direction int, entry_bar int, entry double, stop double, exit_bar int, exit double, stopped boolean"


def noise_trades(bars: DataFrame, sigma: DataFrame, opens: int, closes: int, most: int = 3, fill: str = "stop") -> DataFrame:
    """Trades of the noise-band rule, each session by itself: enter at the first close farther from the session's open than the
    band of that bar; the stop lies one band away; after a stop a close inside the band is needed first; `most` entries.

    sigma: (instrument, session, sigma), the deviation of a step known before the session; sessions without one make no
    trade. fill: a stop is filled at its level ("stop") or at the bar's worst price ("extreme").
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        pdf = pdf.sort_values("sessmin")
        first, rows = pdf["o"].iloc[0], pdf[(pdf["sessmin"] >= opens) & (pdf["sessmin"] <= closes)]
        band = pdf["sigma"].iloc[0] * np.sqrt(rows["sessmin"].to_numpy() + 1) * ABS_MOVE
        live, armed, key = None, True, (pdf["instrument"].iloc[0], int(pdf["session"].iloc[0]))
        for k, (at, high, low, close) in enumerate(rows[["sessmin", "h", "l", "c"]].itertuples(index=False)):
            away = close - first
            if live is not None:
                way, since, entry, stop = live
                if (low <= entry - stop) if way > 0 else (high >= entry + stop):
                    price = entry - way * stop if fill == "stop" else low if way > 0 else high
                    out.append((*key, way, since, entry, stop, int(at), price, True))
                    live, armed = None, False
                elif at >= closes:
                    out.append((*key, way, since, entry, stop, int(at), close, False))
                    live = None
            elif not armed:
                armed = abs(away) < band[k]
            elif len(out) < most and at < closes and abs(away) > band[k]:
                live = (1 if away > 0 else -1, int(at), close, band[k])
        if live is not None:
            out.append((*key, live[0], live[1], live[2], live[3], int(pdf["sessmin"].iloc[-1]), pdf["c"].iloc[-1], False))
        return pd.DataFrame(out, columns=[x.split()[0] for x in NOISE_TRADES.split(", ")])

    rows = bars.select("instrument", "session", "sessmin", "o", "h", "l", "c").join(sigma.where("sigma > 0"), ["instrument", "session"])
    return rows.groupBy("instrument", "session").applyInPandas(walk, NOISE_TRADES)


def trigger_rate(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of each instrument: sessions with a trade, all sessions, and their ratio."""
    met = trades.groupBy("instrument").agg(F.count_distinct("session").alias("traded"))
    every = sessions.groupBy("instrument").agg(F.count_distinct("session").alias("sessions"))
    return every.join(met, "instrument", "left").select("instrument", F.coalesce("traded", F.lit(0)).alias("traded"), "sessions", (F.coalesce("traded", F.lit(0)) / F.col("sessions")).alias("rate"))


def local_scale(bars: DataFrame, bins: int = 40) -> DataFrame:
    """bars with the scale of a stop there: the root of the mean share of a price bin over the share of the bar's own, of the
    volume of its session so far, between 0.6 and 1.8; 1 until `bins` bars have traded. A session is one group."""

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        h, l, c, v = (pdf[k].to_numpy(float) for k in "hlcv")
        sound, out = v > 0, np.ones(len(pdf))
        for i in range(len(pdf)):
            used = np.flatnonzero(sound[: i + 1])
            if len(used) < bins:
                continue
            lo, hi = l[used].min(), h[used].max()
            if hi <= lo:
                continue
            at = np.clip(((c[used] - lo) / ((hi - lo) / bins)).astype(int), 0, bins - 1)
            share = v[used][at == at[-1]].sum() / v[used].sum()
            out[i] = min(1.8, max(0.6, math.sqrt(1 / bins / share)))
        return pdf[["instrument", "session", "t"]].assign(scale=out)

    return bars.select("instrument", "session", "t", "h", "l", "c", "v").groupBy("instrument", "session").applyInPandas(scale, "instrument string, session long, t long, scale double")


BAND_TRADES = "instrument string, session long, entry_t long, exit_t long, side int, entry double, stop double, exit double, reason string, points double"


def band_trades(bars: DataFrame, k: float, stop: float, mode: str = "reject", lo: int = 0, hi: int = 1 << 30, warm: int = 0, most: int = 0) -> DataFrame:
    """Trades back to a session's moving mean from its band k deviations away (bars with vwap and sd).

    mode "reject": at the close of a bar that reached the band and closed inside it, on the mean's outer side. mode "touch":
    at the band of the bar before. The stop lies `stop` points beyond the band; in a bar that meets both, the stop counts.
    Positions close at the last bar of the window [lo, hi) or of the session. A session is one group.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, m, o, h, l, c, mean, sd = (pdf[x].to_numpy() for x in ("t", "sessmin", "o", "h", "l", "c", "vwap", "sd"))
        n, out = len(t), []
        inside = (m >= lo) & (m < hi)
        last = np.array([i == n - 1 or not inside[i + 1] for i in range(n)])

        def signal(i: int):
            if not inside[i] or last[i] or t[i] - t[0] < warm:
                return None
            j = i - 1 if mode == "touch" else i
            if j < 0 or not sd[j] > 0:
                return None
            up, down = mean[j] + k * sd[j], mean[j] - k * sd[j]
            above, below = h[i] >= up, l[i] <= down
            if mode == "touch":
                if above == below or (o[i] >= up + stop if above else o[i] <= down - stop):
                    return None
                return (-1, max(o[i], up), up + stop, h[i] >= up + stop) if above else (1, min(o[i], down), down - stop, l[i] <= down - stop)
            if above and mean[i] < c[i] < up:
                return -1, c[i], up + stop, False
            if below and down < c[i] < mean[i]:
                return 1, c[i], down - stop, False
            return None

        def leave(i: int, side: int, level: float):
            for j in range(i + 1, n):
                goal = mean[j - 1]
                if (h[j] >= level) if side < 0 else (l[j] <= level):
                    return j, max(o[j], level) if side < 0 else min(o[j], level), "stop"
                if (l[j] <= goal) if side < 0 else (h[j] >= goal):
                    return j, min(o[j], goal) if side < 0 else max(o[j], goal), "target"
                if last[j]:
                    return j, c[j], "end"
            return n - 1, c[-1], "end"

        i = 0
        while i < n:
            found = signal(i) if not most or len(out) < most else None
            if found is None:
                i += 1
                continue
            side, entry, level, same = found
            j, price, why = (i, level, "stop") if same else leave(i, side, level)
            out.append((pdf["instrument"].iloc[0], int(pdf["session"].iloc[0]), int(t[i]), int(t[j]), side, entry, level, price, why, side * (price - entry)))
            i = j + 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in BAND_TRADES.split(", ")])

    return bars.select("instrument", "session", "t", "sessmin", "o", "h", "l", "c", "vwap", "sd").groupBy("instrument", "session").applyInPandas(walk, BAND_TRADES)


def excursions(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Mean worst and best excursion, the share of the best that was kept, and the deciles of the worst, by keys."""
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe"), F.try_divide(F.sum("points"), F.sum("mfe")).alias("kept"), F.percentile("mae", F.lit(0.1)).alias("mae10")
    )


def flows(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Links between the values of two columns: count and total, as a flow chart needs them."""
    return rows.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def downsample(rows: DataFrame, series: list[str], order: str, value: str, points: int) -> DataFrame:
    """At most four rows for each of `points` equal runs of a series: its first, last, least and greatest value."""
    w = W.partitionBy(*series).orderBy(order)
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*series))})
    rows = rows.withColumn("run", F.floor(F.col("_i") * points / F.col("_n")))
    picks = rows.groupBy(*series, "run").agg(*[f(F.struct(order, value), F.struct(*k)).alias(n) for n, f, k in (("a", F.min_by, ["_i"]), ("b", F.max_by, ["_i"]), ("c", F.min_by, [value, "_i"]), ("d", F.max_by, [F.col(value), -F.col("_i")]))])
    return picks.select(*series, "run", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("_p")).select(*series, "run", f"_p.{order}", f"_p.{value}")


def synthetic_walk(spark, sessions: int, bars: int, sigma: float, drift: float = 0.0, momentum: float = 0.0, wick: float = 0.5, seed: int = 1, price: float = 100.0) -> DataFrame:
    """Bars of independent sessions of a Gaussian walk: each step drifts, and by `momentum` goes on with the session's move
    so far; wicks are half-normal. Every session has its own seed, so parts and repeats give the same bars."""
    schema = "instrument string, session long, t long, sessmin int, o double, h double, l double, c double, v double, n long"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"].tolist():
                rng = np.random.default_rng([seed, s])
                steps, c = rng.normal(drift, sigma, bars), np.empty(bars)
                at = 0.0
                for i, x in enumerate(steps.tolist()):
                    at += x + momentum * np.sign(at) * sigma
                    c[i] = price + at
                o = np.concatenate([[price], c[:-1]])
                up, down = np.abs(rng.normal(0, wick * sigma, (2, bars)))
                yield pd.DataFrame({"instrument": "walk", "session": s, "t": s * bars + np.arange(bars), "sessmin": np.arange(bars, dtype=np.int32), "o": o, "h": np.maximum(o, c) + up, "l": np.minimum(o, c) - down, "c": c, "v": rng.integers(1, 1000, bars).astype(float), "n": 1})

    return spark.range(sessions).mapInPandas(make, schema)


def synthetic_trades(spark, n: int, win_rate: float, payoff: float, seed: int = 1) -> DataFrame:
    """(i, r) of n independent trades that win `payoff` with a probability, else lose one."""
    won = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) < win_rate
    return spark.range(n).select(F.col("id").alias("i"), F.when(won, F.lit(float(payoff))).otherwise(-1.0).alias("r"))
