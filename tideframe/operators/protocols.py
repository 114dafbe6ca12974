"""Protocols of a test that is fixed before its data: looks and their bounds, sealed plans and decisions, exits side by side,
and null laws by seeded simulation. Simulated paths are made in tasks, each block with a seed of its own, and only counts and
quantiles are aggregated."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .execution import Settings

BLOCK = 10_000


def walks_at_looks(spark: SparkSession, fractions: list[float], paths: int, drift: float = 0.0, seed: int = 1) -> DataFrame:
    """Standardised values (array z) of simulated walks at information fractions; drift is the mean of the last one."""
    t = np.asarray(fractions, float)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["id"].tolist():
                rng = np.random.default_rng([seed, block])
                steps = rng.normal(size=(BLOCK, len(t))) * np.sqrt(np.diff(t, prepend=0.0))
                z = (np.cumsum(steps, axis=1) + drift * t) / np.sqrt(t)
                yield pd.DataFrame({"z": list(z)})

    return spark.range(-(-paths // BLOCK)).mapInPandas(make, "z array<double>")


def spent(fraction: float, level: float, sides: int = 1) -> float:
    """Level that O'Brien and Fleming's rule, as Lan and DeMets spend it, has used up at an information fraction; with two
    sides each spends half of the level by itself."""
    law = NormalDist()
    return level if fraction >= 1 else min(level, 2 * sides * (1 - law.cdf(law.inv_cdf(1 - level / (2 * sides)) / fraction**0.5)))


def sequential_bounds(spark: SparkSession, fractions: list[float], level: float = 0.05, paths: int = 400_000, drift: float = 3.0, seed: int = 1, sides: int = 1) -> DataFrame:
    """One row a look: fraction, level spent, bound on |z|, and the shares of paths without and with drift stopped by then.

    Each bound is the quantile of the walks that no earlier look stopped which spends that look's part of the level. The first
    is exact; of the others the last digits hang on the number of paths.
    """
    null, moved = (walks_at_looks(spark, fractions, paths, d, seed + k) for k, d in enumerate((0.0, drift)))
    total, used, bounds = -(-paths // BLOCK) * BLOCK, 0.0, []
    for k, t in enumerate(fractions):
        part, used = spent(t, level, sides) - used, spent(t, level, sides)
        going = null.where(_inside(bounds))
        if k == 0:
            bounds.append(NormalDist().inv_cdf(1 - part / 2))
        else:
            left = going.count()
            bounds.append(going.agg(F.percentile(F.abs(F.get("z", F.lit(k))), F.lit(1 - part * total / left))).first()[0])
    stopped = [df.agg(*[F.avg((~_inside(bounds[: k + 1])).cast("double")).alias(f"s{k}") for k in range(len(bounds))]).first() for df in (null, moved)]
    rows = [(k + 1, float(t), spent(t, level, sides), float(b), stopped[0][k], stopped[1][k]) for k, (t, b) in enumerate(zip(fractions, bounds, strict=True))]
    return spark.createDataFrame(rows, "look int, fraction double, spent double, bound double, stopped_null double, stopped_drift double")


def _inside(bounds: list[float]) -> Column:
    """Whether a path stays within all bounds so far."""
    out = F.lit(True)
    for k, b in enumerate(bounds):
        out = out & (F.abs(F.get("z", F.lit(k))) < b)
    return out


def looks(trades: DataFrame, keys: list[str], order: list[str], value: str, every: int, bounds: list[float]) -> DataFrame:
    """z of the mean after each `every` records, as many looks as bounds, and the decision of each: the first look at which |z|
    reaches its bound ends a group's test; later ones are not taken."""
    from pyspark.sql import Window as W

    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumns({"_i": F.count(F.lit(1)).over(upto), "_z": F.try_divide(F.avg(value).over(upto), F.stddev_samp(value).over(upto)) * F.sqrt(F.count(F.lit(1)).over(upto))})
    rows = rows.where((F.col("_i") % every == 0) & (F.col("_i") <= every * len(bounds))).withColumn("look", (F.col("_i") / every).cast("int"))
    rows = rows.withColumn("crossed", F.abs("_z") >= F.get(F.array(*[F.lit(float(b)) for b in bounds]), F.col("look") - 1))
    before = F.max(F.col("crossed").cast("int")).over(W.partitionBy(*keys).orderBy("look").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_done", F.coalesce(before, F.lit(0))).where("_done = 0").select(*keys, "look", F.col("_i").alias("n"), F.col("_z").alias("z"), "crossed")


def seal(document: dict) -> str:
    """Fingerprint of a plan: SHA-256 of its JSON with sorted keys, so any change of a figure breaks it."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sealed_decisions(trades: DataFrame, plans: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Decision of each sealed plan (keys, sealed, least, bound) on the trades made after its seal: "pass" or "fail" once there
    are `least` of them, else "wait". Trades up to the day of the seal never count."""
    rows = trades.join(plans, keys).where(F.col(day) > F.col("sealed")).groupBy(*keys, "least", "bound")
    made = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    z = F.try_divide(F.col("mean"), F.col("sd")) * F.sqrt("n")
    return made.select(*keys, "n", "mean", z.alias("z"), F.when(F.col("n") < F.col("least"), "wait").when(z >= F.col("bound"), "pass").otherwise("fail").alias("decision"))


def exit_concepts(base: Settings) -> dict[str, Settings]:
    """Ways to leave the same entries: fixed multiples, no target, break-even, trails, time, range and swing stops, the
    opposite signal."""
    fixed = replace(base, target_kind="r")
    return {
        "stop_only": replace(base, target_kind="none"), "one_r": replace(fixed, target_x=1.0), "two_r": replace(fixed, target_x=2.0), "three_r": replace(fixed, target_x=3.0),
        "break_even": replace(fixed, target_x=3.0, break_even_r=1.0), "trail_one": replace(base, target_kind="none", trail=base.stop_x), "trail_two": replace(base, target_kind="none", trail=2 * base.stop_x),
        "time": replace(base, target_kind="none", max_bars=3), "range_stop": replace(fixed, stop_kind="atr", stop_x=2.0), "swing_stop": replace(fixed, stop_kind="swing", stop_x=0.0), "opposite": replace(base, target_kind="none", opposite=True),
    }


def best_of_nothing(spark: SparkSession, trials: int, n: int, draws: int, seed: int = 1) -> DataFrame:
    """(draw, best): the greatest Sharpe ratio of `trials` rules without skill over n records each."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = []
            for draw in pdf["id"].tolist():
                x = np.random.default_rng([seed, draw]).normal(size=(trials, n))
                best.append((x.mean(axis=1) / x.std(axis=1, ddof=1)).max())
            yield pd.DataFrame({"draw": pdf["id"], "best": best})

    return spark.range(draws).mapInPandas(make, "draw long, best double")


def trade_paths(spark: SparkSession, results: list[float], draws: int, length: int, ruin: float, seed: int = 1) -> DataFrame:
    """(draw, total, drawdown, ruined) of paths of `length` results drawn with replacement; ruined: the path falls to -ruin.

    results: distinct outcomes of trades, thousands at most; every task holds them."""
    shared = spark.sparkContext.broadcast(np.asarray(results, float))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for draw in pdf["id"].tolist():
                path = np.cumsum(np.random.default_rng([seed, draw]).choice(shared.value, length))
                rows.append((draw, path[-1], (np.maximum.accumulate(np.maximum(path, 0)) - path).max(), bool((path <= -ruin).any())))
            yield pd.DataFrame(rows, columns=["draw", "total", "drawdown", "ruined"])

    return spark.range(draws).mapInPandas(make, "draw long, total double, drawdown double, ruined boolean")


GATES = {"volume": ("profile", "vwap_band", "low_node"), "range": ("noise_band", "range_stop"), "gamma": ("regime", "walls"), "book": ("persistence",)}


def available_gates(assets: DataFrame, keys: list[str], has: dict[str, Column]) -> DataFrame:
    """One row for each gate that the data of a group allow: has tells, by kind of data, whether a group has them."""
    held = F.array(*[F.struct(F.lit(kind).alias("data"), F.lit(gate).alias("gate"), F.coalesce(has.get(kind, F.lit(False)), F.lit(False)).alias("on")) for kind, gates in GATES.items() for gate in gates])
    return assets.select(*keys, F.explode(held).alias("g")).where("g.on").select(*keys, "g.data", "g.gate")
