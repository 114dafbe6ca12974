"""Null laws by simulation: random entries, permuted bars, the stationary bootstrap. Draws are seeded, so results repeat."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import session_places
from .execution import Settings, firing, replay, session_arrays


def uniform(*columns):
    """A fixed number in [0, 1) of some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


def drawn_entries(bars: dict[str, np.ndarray], draw: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Long and short signals of one draw in one session: as many of each as the real ones, on executable bars at random
    (no more than there are such bars)."""
    n_long, n_short = int(bars["long"].sum()), int(bars["short"].sum())
    rng = np.random.default_rng([seed, draw, int(bars["t"][0]) & (1 << 62) - 1])
    picked = rng.permutation(np.flatnonzero(bars["status"] == 0))[: n_long + n_short]
    long, short = np.zeros(len(bars["t"]), bool), np.zeros(len(bars["t"]), bool)
    long[picked[:n_long]], short[picked[n_long:]] = True, True
    return long, short


DRAWN = "draw int, n long, sum_r double"


def random_null(frame: DataFrame, settings: Settings, draws: int, seed: int = 1) -> DataFrame:
    """Mean result of the real signals (draw -1) and of each draw of random ones.

    Bars move once: a session's draws are made and replayed where its bars are, each with a generator of its own (seed, draw,
    session), and only their counts and sums come back.
    """
    plan = asdict(settings)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bars, rows = session_arrays(pdf), []
        for draw in range(-1, draws):
            long, short = (bars["long"], bars["short"]) if draw < 0 else drawn_entries(bars, draw, seed)
            made, _ = replay({**bars, "long": long, "short": short}, Settings(**plan))
            rows.append((draw, len(made), sum(x["r"] for x in made)))
        return pd.DataFrame(rows, columns=["draw", "n", "sum_r"])

    keys = ["instrument", "session"]
    found = firing(frame, keys, F.col("long") | F.col("short")).groupBy(*keys).applyInPandas(run, DRAWN)
    sums = found.groupBy("draw").agg(F.sum("n").alias("n"), F.sum("sum_r").alias("sum_r"))
    return sums.where("n > 0").select("draw", "n", (F.col("sum_r") / F.col("n")).alias("mean_r"))


def p_value(results: DataFrame) -> DataFrame:
    """(1 + draws at least as good) / (draws + 1)."""
    both = results.agg(F.max(F.when(F.col("draw") < 0, F.col("mean_r"))).alias("real"))
    return results.where("draw >= 0").crossJoin(F.broadcast(both)).agg(F.first("real").alias("real"), F.count(F.lit(1)).alias("draws"), ((1 + F.count_if(F.col("mean_r") >= F.col("real"))) / (F.count(F.lit(1)) + 1)).alias("p"))


PERMUTED = "instrument string, session long, t long, sessmin int, o double, h double, l double, c double, v double, n long, draw int"


def permuted_bars(bars: DataFrame, draws: int, bucket: int, seed: int = 1) -> DataFrame:
    """Bars of each draw with their moves shuffled inside buckets of a session and prices rebuilt: the day's total move, the
    bucket's set of moves and the bar shapes stay. A session's draws are made where its bars are, so bars move once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        o, h, l, c = (pdf[x].to_numpy(float) for x in "ohlc")
        gap = o - np.concatenate([o[:1], c[:-1]])
        place = pdf["sessmin"].to_numpy() // bucket
        out = []
        for draw in range(draws):
            rng = np.random.default_rng([seed, draw, int(pdf["t"].iloc[0]) & (1 << 62) - 1])
            order = np.lexsort((rng.random(len(o)), place))
            close = o[0] + np.cumsum(gap[order] + (c - o)[order])
            opened = close - (c - o)[order]
            part = pdf[["session", "t", "sessmin"]].copy()
            part.insert(0, "instrument", f"{pdf['instrument'].iloc[0]}#{draw}")
            out.append(part.assign(o=opened, h=opened + (h - o)[order], l=opened + (l - o)[order], c=close, v=pdf["v"].to_numpy()[order], n=pdf["n"].to_numpy()[order], draw=draw))
        return pd.concat(out)

    return bars.select("instrument", "session", "t", "sessmin", "o", "h", "l", "c", "v", "n").groupBy("instrument", "session").applyInPandas(run, PERMUTED)


def permuted_places(bars: DataFrame, draws: int) -> DataFrame:
    """session_places of permuted_bars, from the bars themselves: each draw has their sessions."""
    places = session_places(bars).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return places.withColumn("instrument", F.concat("instrument", F.lit("#"), F.col("_draw").cast("string"))).drop("_draw")


def stationary_bootstrap(spark: SparkSession, values: list[float], draws: int, block: float, seed: int = 1) -> DataFrame:
    """Mean, total and greatest drawdown of each resampled path: blocks of geometric length `block` of a session series.

    values: a number a session, thousands at most; every task holds them.
    """
    shared = spark.sparkContext.broadcast(np.asarray(values, float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for pdf in batches:
            rows = []
            for draw in pdf["id"].tolist():
                rng = np.random.default_rng([seed, draw])
                jump = rng.random(len(x)) < 1 / block
                jump[0] = True
                start = rng.integers(0, len(x), len(x))
                last = np.maximum.accumulate(np.where(jump, np.arange(len(x)), -1))
                path = np.cumsum(x[(start[last] + np.arange(len(x)) - last) % len(x)])
                fall = (np.maximum.accumulate(np.maximum(path, 0)) - path).max()
                rows.append((draw, path[-1] / len(x), path[-1], fall))
            yield pd.DataFrame(rows, columns=["draw", "mean", "total", "drawdown"])

    return spark.range(draws).mapInPandas(run, "draw long, mean double, total double, drawdown double")


def fan(draws: DataFrame) -> DataFrame:
    """Five, fifty and ninety-five per cent levels of the resampled mean, total and drawdown."""
    levels = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    return draws.agg(*[F.percentile(c, levels).alias(c) for c in ("mean", "total", "drawdown")])


def repeatable_draw(seed):
    """A number in [0, 1) of a non-negative long column, by three steps of a multiplicative generator any engine can repeat."""
    x = F.pmod(seed, F.lit(2147483646)) + 1
    for _ in range(3):
        x = F.pmod(x * 48271, F.lit(2147483647))
    return x / 2147483647.0


def sign_permutation(rows: DataFrame, keys: list[str], value: str, seed, draws: int) -> DataFrame:
    """Total of a value by keys, and the share of draws of random signs whose total is as great (the real one counts too).

    seed: a long column that tells rows apart. Every task sums all draws of its own rows, so rows are not copied in a shuffle.
    """
    sign = lambda k: F.when(repeatable_draw(F.col("_s") + 1000003 * k) < 0.5, 1).otherwise(-1)
    drawn = rows.withColumn("_s", seed).groupBy(*keys).agg(F.sum(value).alias("total"), *[F.sum(sign(k) * F.col(value)).alias(f"_d{k}") for k in range(1, draws + 1)])
    greater = sum(((F.col(f"_d{k}") >= F.col("total")).cast("int") for k in range(2, draws + 1)), (F.col("_d1") >= F.col("total")).cast("int"))
    return drawn.select(*keys, "total", ((1 + greater) / (draws + 1)).alias("p"))
