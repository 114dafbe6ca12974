"""Sweeps, walk-forward, combinatorial cross-validation, plateaus and account rules over session records."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.document import grid, mirror, resolve
from .execution import COLUMNS, Settings, cell_records, compiled, execute, features, session_records, wants_range, with_quiet_sessions


def cells(compiler: Compiler, document: dict, points: list[dict[str, float]], settings: Settings) -> DataFrame:
    """One row a bar with the signals of all settings as arrays (longs, shorts).

    All settings are compiled on one frame, so operands that they share are computed once and those of one kind share a
    window.
    """
    made = [compiled(compiler, document, points[0], wants_range([settings]))]
    for point in points[1:]:
        told = resolve({k: v for k, v in document.items() if k != "params"}, {**document.get("params", {}), **point})
        rule = [*told.get("setup", []), told["trigger"]]
        compiler.prepare(rule + [mirror(x) for x in rule] if document.get("mirror", True) else rule)
    made += [compiled(compiler, document, point, wants_range([settings])) for point in points[1:]]
    signals = [F.array(*[F.coalesce(x[side], F.lit(False)) for x in made]).alias(f"{side}s") for side in ("long", "short")]
    return compiler.frame.select(*COLUMNS, *[made[-1][k].alias(k) for k in ("status", "atr", "level", "goal")], *signals)


def levels_vary(document: dict) -> bool:
    """Whether a document's stop or goal level, or its range, depends on a parameter."""
    return "$" in json.dumps({k: v for k, v in document.items() if k not in ("params", "setup", "trigger", "domain")})


def sweep(compiler: Compiler, document: dict, params: dict[str, list[float]], settings: Settings) -> tuple[DataFrame, list[dict[str, float]]]:
    """Trades of every setting of one or two parameters: bars move once, and a session is replayed under all settings in one
    group. Documents whose stop or goal level depends on a parameter become a frame for each setting instead."""
    points = grid(params)
    if not levels_vary(document):
        return execute(cells(compiler, document, points, settings), [settings] * len(points), cells=True), points
    out = None
    for k, point in enumerate(points):
        part = features(compiler, document, point, wants_range([settings])).withColumn("cfg", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return execute(out, [settings] * len(points), by="cfg"), points


def sweep_records(compiler: Compiler, document: dict, params: dict[str, list[float]], settings: Settings) -> tuple[DataFrame, list[dict[str, float]]]:
    """Session records of every setting, quiet sessions included: the matrix that walk-forward and cross-validation read."""
    points = grid(params)
    if levels_vary(document):
        trades, points = sweep(compiler, document, params, settings)
        return session_records(trades, compiler.frame, len(points)), points
    sums = cell_records(cells(compiler, document, points, settings), [settings] * len(points))
    return with_quiet_sessions(sums, compiler.bars, len(points)), points


def best_config(matrix: DataFrame, least_trades: int = 1) -> DataFrame:
    """The setting of greatest mean r, the first on a tie, among those with enough trades."""
    total = matrix.groupBy("config").agg(F.sum("n").alias("n"), (F.sum("sum_r") / F.sum("n")).alias("mean_r")).where(F.col("n") >= least_trades)
    return total.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("mean_r"), "config")))  # a row a setting: few


def walk_forward(matrix: DataFrame, train: int, test: int, anchored: bool, last: int) -> DataFrame:
    """For each window of session numbers: the best setting in `train` sessions, and what it made in the next `test` ones.

    matrix: config, s (session number from 0), n, sum_r. It is not run anew: windows re-aggregate its sums.
    """
    count = max(0, (last + 1 - train) // test)
    w = matrix.sparkSession.range(count).select(F.col("id").alias("w"), ((F.lit(0) if anchored else F.col("id") * test)).cast("long").alias("lo"), (F.col("id") * test + train).alias("mid"), (F.col("id") * test + train + test).alias("hi"))
    rows = matrix.join(F.broadcast(w), (F.col("s") >= F.col("lo")) & (F.col("s") < F.col("hi")))  # a row a window: few
    inside = F.col("s") < F.col("mid")
    pick: dict[str, Column] = {"is_n": F.when(inside, F.col("n")), "is_r": F.when(inside, F.col("sum_r")), "os_n": F.when(~inside, F.col("n")), "os_r": F.when(~inside, F.col("sum_r"))}
    sums = rows.groupBy("w", "config").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in pick.items()])
    order = W.partitionBy("w").orderBy(F.desc(F.try_divide(F.col("is_r"), F.col("is_n"))), "config")
    best = sums.where("is_n > 0").withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("w", "config", F.try_divide(F.col("is_r"), F.col("is_n")).alias("is_mean"), "os_n", F.try_divide(F.col("os_r"), F.col("os_n")).alias("os_mean"))


def cross_validation(matrix: DataFrame, blocks: int) -> DataFrame:
    """Combinatorially symmetric splits of session blocks: the in-sample best, its out-of-sample rank and logit."""
    halves = [(k, list(c)) for k, c in enumerate(combinations(range(blocks), blocks // 2))]
    splits = matrix.sparkSession.createDataFrame(halves, "split int, chosen array<int>")
    block = matrix.groupBy("config", "block").agg(F.sum("n").alias("n"), F.sum("sum_r").alias("sum_r"))
    rows = block.join(F.broadcast(splits))  # settings x blocks x splits, all bounded
    inside = F.array_contains("chosen", F.col("block"))
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("sum_r"))), F.sum(F.when(c, F.col("n"))))
    sums = rows.groupBy("split", "config").agg(mean(inside).alias("is_mean"), mean(~inside).alias("os_mean"))
    order = W.partitionBy("split")
    ranked = sums.withColumns({"best": F.row_number().over(order.orderBy(F.desc("is_mean"), "config")), "os_rank": F.rank().over(order.orderBy("os_mean")), "configs": F.count(F.lit(1)).over(order)}).where("best = 1")
    omega = F.col("os_rank") / (F.col("configs") + 1)
    return ranked.select("split", "config", "is_mean", "os_mean", "os_rank", F.log(omega / (1 - omega)).alias("logit"))


def overfit_probability(splits: DataFrame) -> DataFrame:
    return splits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"))


def plateau(totals: DataFrame, axis: str, value: str) -> DataFrame:
    """Each setting's value against its neighbours on an axis: a peak without neighbours is no plateau."""
    w = W.partitionBy(F.lit(1)).orderBy(axis)  # a row a setting
    beside = (F.coalesce(F.lag(value).over(w), F.col(value)) + F.coalesce(F.lead(value).over(w), F.col(value))) / 2
    return totals.withColumns({"beside": beside, "plateau": F.when(F.col(value) > 0, F.col("beside") >= 0.5 * F.col(value)).otherwise(F.lit(False))})


def account_rule(days: DataFrame, keys: list[str], day: str, pnl: str, target: float, drawdown: float, daily: float) -> DataFrame:
    """Outcome of an account that ends at a profit target, at a trailing drawdown from its peak, or at a daily loss."""
    w = W.partitionBy(*keys).orderBy(day)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = days.withColumns({"i": F.row_number().over(w), "equity": F.sum(pnl).over(upto)})
    rows = rows.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(upto)))
    lost = (F.col("peak") - F.col("equity") >= drawdown) | (F.col(pnl) <= -daily)
    end = F.when(lost, "failed").when(F.col("equity") >= target, "passed")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.min_by(end, F.when(end.isNotNull(), F.col("i"))).alias("outcome"), F.min(F.when(end.isNotNull(), F.col("i"))).cast("long").alias("day_no"))


def break_even_slip(stress: DataFrame) -> DataFrame:
    """Slip at which the mean result is zero, by a line through the stressed runs (slip, mean_r)."""
    return stress.agg(F.regr_slope("mean_r", "slip").alias("slope"), F.regr_intercept("mean_r", "slip").alias("intercept")).select("slope", "intercept", F.try_divide(-F.col("intercept"), F.col("slope")).alias("break_even"))


def verdict(sheet: DataFrame) -> DataFrame:
    """Items of a verdict over aggregated figures (n, mean_r, psr, dsr, pbo, os_mean): passed, failed or not available."""
    gates = {"trades": F.col("n") >= 100, "edge": F.col("mean_r") > 0, "psr": F.col("psr") >= 0.95, "dsr": F.col("dsr") >= 0.95, "pbo": F.col("pbo") <= 0.2, "out_of_sample": F.col("os_mean") > 0}
    items = F.array(*[F.struct(F.lit(k).alias("item"), F.when(c.isNull(), "missing").when(c, "passed").otherwise("failed").alias("state")) for k, c in gates.items()])
    return sheet.select("*", F.explode(items).alias("x")).select(*sheet.columns, "x.item", "x.state")


def purged_folds(days: DataFrame, day: str, value: str, folds: int, before: int, after: int) -> DataFrame:
    """Consecutive folds of near-equal size: days and mean value of each, and of the days that may train for it, which are more
    than `before` days ahead of it or `after` behind it. days: one row a day, so one window over all of them is small."""
    everything = W.partitionBy(F.lit(1))
    rows = days.withColumn("fold", F.floor((F.row_number().over(everything.orderBy(day)) - 1) * folds / F.count(F.lit(1)).over(everything)).cast("int"))
    ends = rows.groupBy("fold").agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    both = rows.withColumnRenamed("fold", "_own").crossJoin(F.broadcast(ends))  # folds: a parameter, few
    test, train = F.col("_own") == F.col("fold"), (F.col(day) < F.col("_lo") - before) | (F.col(day) > F.col("_hi") + after)
    return both.groupBy("fold").agg(F.count_if(test).alias("test_days"), F.count_if(train).alias("train_days"), F.avg(F.when(test, F.col(value))).alias("test_mean"), F.avg(F.when(train, F.col(value))).alias("train_mean"))
