"""Information and scaling measures of series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_order_blocks, own, running_sums
from .quantiles import exact_quantiles


def log_returns(bars: DataFrame, series: list[str], order: str, price: str = "c", segments: bool = True) -> DataFrame:
    """Log returns between consecutive bars; a gap gives none and begins a new segment, numbered if asked for."""
    rows = in_order_blocks(bars, order, 1)
    w = W.partitionBy(*series, "_block").orderBy(order)
    rows = rows.withColumn("joined", F.coalesce(F.col(order) - F.lag(order).over(w) == 1, F.lit(False)))
    rows = own(rows.withColumn("ret", F.when(F.col("joined"), F.log(F.col(price) / F.lag(price).over(w)))))
    return (running_sums(rows, series, order, {"segment": (~F.col("joined")).cast("long")}) if segments else rows).where("ret is not null")


def _of_series(rows: DataFrame, keys: list[str], **made: Column) -> DataFrame:
    """rows with aggregates of their series, summed on the way to it."""
    return rows.join(rows.groupBy(*keys).agg(*[c.alias(k) for k, c in made.items()]), keys)


def variance_ratio(returns: DataFrame, series: list[str], q: int, order: str = "t") -> DataFrame:
    """Variance of overlapping q-step returns over q times that of single ones (mean known to be that of all)."""
    rows = in_order_blocks(returns, order, q)
    # returns follow each other without a gap where there are q of them in q steps
    last = W.partitionBy(*series, "_block").orderBy(order).rangeBetween(1 - q, 0)
    rows = own(rows.withColumn("sum_q", F.when(F.count("ret").over(last) == q, F.sum("ret").over(last))))
    sums = rows.groupBy(*series).agg(F.avg("ret").alias("m"), F.avg(F.col("ret") * F.col("ret")).alias("a"), F.avg("sum_q").alias("b"), F.avg(F.col("sum_q") * F.col("sum_q")).alias("c"), F.count("sum_q").alias("n"))
    one, many = F.col("a") - F.col("m") * F.col("m"), F.col("c") - 2 * q * F.col("m") * F.col("b") + q * q * F.col("m") * F.col("m")
    return sums.select(*series, F.lit(q).alias("q"), "n", F.try_divide(many, q * one).alias("vr"))


def hurst(ratios: DataFrame, series: list[str]) -> DataFrame:
    """Half the slope of log (q times variance ratio) on log q, and its fit."""
    y, x = F.log(F.col("vr") * F.col("q")), F.log(F.col("q").cast("double"))
    return ratios.groupBy(*series).agg((F.regr_slope(y, x) / 2).alias("hurst"), F.regr_r2(y, x).alias("r2"))


def ordinal_patterns(rows: DataFrame, series: list[str], order: str, value: str, d: int = 3) -> DataFrame:
    """Counts of order patterns of d consecutive values (ties: earlier first)."""
    w = W.partitionBy(*series).orderBy(order)
    points = F.array(*[F.struct(F.lag(value, d - 1 - i).over(w).alias("v"), F.lit(i).alias("i")) for i in range(d)])
    pattern = F.array_join(F.transform(F.array_sort(points), lambda p: p["i"].cast("string")), "")
    made = rows.withColumns({"_n": F.count(value).over(w.rowsBetween(1 - d, 0)), "pattern": pattern}).where(F.col("_n") == d)
    return made.groupBy(*series, "pattern").agg(F.count(F.lit(1)).alias("n"))


def permutation_entropy(rows: DataFrame, series: list[str], order: str, value: str, d: int = 3) -> DataFrame:
    """Entropy of order patterns over its greatest value."""
    counts = ordinal_patterns(rows, series, order, value, d)
    p = F.col("n") / F.sum("n").over(W.partitionBy(*series))
    return counts.withColumn("p", p).groupBy(*series).agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("patterns"), (-F.sum(F.col("p") * F.log2("p")) / log2(factorial(d))).alias("entropy"))


def fluctuation(rows: DataFrame, series: list[str], order: str, value: str, scales: list[int]) -> DataFrame:
    """Detrended fluctuation of the running sum for each box size: root mean square of residuals of lines in boxes."""
    w = W.partitionBy(*series).orderBy(order)
    base = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(*series)), "m": F.avg(value).over(W.partitionBy(*series))})
    base = base.withColumn("y", F.sum(F.col(value) - F.col("m")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    boxed = base.select(*series, "i", "y", "n", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")).withColumn("box", F.floor(F.col("i") / F.col("scale"))).where((F.col("box") + 1) * F.col("scale") <= F.col("n"))
    x, y = F.col("i").cast("double"), F.col("y")
    sums = boxed.groupBy(*series, "scale", "box").agg((F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))).alias("ss"))
    return sums.groupBy(*series, "scale").agg(F.sqrt(F.sum(F.greatest("ss", F.lit(0.0))) / (F.count(F.lit(1)) * F.col("scale"))).alias("f"), F.count(F.lit(1)).alias("boxes"))


def scaling_exponent(fluctuations: DataFrame, series: list[str]) -> DataFrame:
    return fluctuations.where("f > 0").groupBy(*series).agg(F.regr_slope(F.log("f"), F.log(F.col("scale").cast("double"))).alias("alpha"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Bits two columns share, by counts, and less the bias of finite counts (Miller and Madow)."""
    joint = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy(F.lit(1))
    joint = joint.withColumns({"na": F.sum("n").over(W.partitionBy(a)), "nb": F.sum("n").over(W.partitionBy(b)), "all": F.sum("n").over(everything)})
    p = F.col("n") / F.col("all")
    made = joint.agg(F.sum(p * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("bits"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.count(F.lit(1)).alias("kab"), F.first("all").alias("n"))
    return made.select("n", "bits", (F.col("bits") + (F.col("ka") + F.col("kb") - F.col("kab") - 1) / (2 * F.col("n") * F.log(F.lit(2.0)))).alias("corrected"))


def hill(rows: DataFrame, series: list[str], value: str, k: int) -> DataFrame:
    """Tail index by the k greatest values: k over the sum of their logs above the next one."""
    w = W.partitionBy(*series).orderBy(F.desc(value))
    top = rows.where(F.col(value) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    made = top.groupBy(*series).agg(F.sum(F.when(F.col("rank") <= k, F.log(value))).alias("logs"), F.max(F.when(F.col("rank") == k + 1, F.log(value))).alias("base"))
    return made.select(*series, (k / (F.col("logs") - k * F.col("base"))).alias("hill"))


def excess_law(rows: DataFrame, series: list[str], value: str, level: float) -> DataFrame:
    """Generalised Pareto law of what exceeds a quantile, by moments."""
    u = exact_quantiles(rows, series, value, [level]).select(*series, F.element_at("quantiles", 1).alias("u"))
    over = rows.join(u, series).where(F.col(value) > F.col("u")).withColumn("y", F.col(value) - F.col("u"))
    made = over.groupBy(*series).agg(F.first("u").alias("u"), F.count(F.lit(1)).alias("exceedances"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    square = F.col("m") * F.col("m") / F.col("v")
    return made.select(*series, "u", "exceedances", (0.5 * (1 - square)).alias("shape"), (0.5 * F.col("m") * (square + 1)).alias("scale"))


def survival(rows: DataFrame, keys: list[str], time: str, event: str) -> DataFrame:
    """Kaplan-Meier survival after each event time: running product of 1 - deaths / at risk."""
    t = rows.groupBy(*keys, time).agg(F.count_if(event).alias("d"), F.count(F.lit(1)).alias("leaving"))
    after = W.partitionBy(*keys).orderBy(time).rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("at_risk", F.sum("leaving").over(after))
    upto = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk")))
    dead = F.max((F.col("d") >= F.col("at_risk")).cast("int")).over(upto) == 1
    return t.withColumn("survival", F.when(dead, 0.0).otherwise(F.exp(F.sum(step).over(upto)))).drop("leaving")


def fano(events: DataFrame, keys: list[str], second: str, width: int) -> DataFrame:
    """Variance over mean of counts in windows of a width, empty windows between first and last included."""
    counts = events.groupBy(*keys, F.floor(F.col(second) / width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    made = counts.groupBy(*keys).agg((F.max("w") - F.min("w") + 1).alias("windows"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    mean = F.col("s") / F.col("windows")
    return made.select(*keys, "windows", mean.alias("mean"), ((F.col("s2") / F.col("windows") - mean * mean) / mean).alias("fano"))


def shapley(trades: DataFrame, levers: list[str], value: str) -> DataFrame:
    """Shares of the mean value of trades that meet all levers, by exact Shapley weights over coalitions (levers: booleans)."""
    k = len(levers)
    masks = list(range(1 << k))
    ok = lambda m: F.expr(" and ".join([levers[i] for i in range(k) if m >> i & 1]) or "true")
    means = trades.agg(*[F.coalesce(F.avg(F.when(ok(m), F.col(value))), F.lit(0.0)).alias(f"v{m}") for m in masks])
    out = []
    for i, name in enumerate(levers):
        total = F.lit(0.0)
        for m in masks:
            if not m >> i & 1:
                s = m.bit_count()
                total = total + factorial(s) * factorial(k - s - 1) / factorial(k) * (F.col(f"v{m | 1 << i}") - F.col(f"v{m}"))
        out.append(F.struct(F.lit(name).alias("lever"), total.alias("share")))
    return means.select(F.explode(F.array(*out)).alias("x")).select("x.lever", "x.share")


@dataclass
class GaussianStates:
    """A fitted hidden Markov model of one series; states in the order of their means."""

    mean: np.ndarray
    sd: np.ndarray
    start: np.ndarray
    move: np.ndarray
    share: np.ndarray
    log_likelihood: float

    def density(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((x[:, None] - self.mean) / self.sd) ** 2) / (self.sd * np.sqrt(2 * np.pi)) + 1e-300

    def path(self, x: np.ndarray) -> np.ndarray:
        """The most likely states, by Viterbi's recursion in logs; the lower state on a tie."""
        emit, move = np.log(self.density(x)), np.log(self.move)
        best, came = np.log(self.start + 1e-300) + emit[0], np.zeros((len(x), len(self.mean)), int)
        for t in range(1, len(x)):
            options = best[:, None] + move
            came[t] = options.argmax(axis=0)
            best = options.max(axis=0) + emit[t]
        out = [int(best.argmax())]
        for t in range(len(x) - 1, 0, -1):
            out.append(int(came[t][out[-1]]))
        return np.array(out[::-1])


def fit_states(x: np.ndarray, states: int, rounds: int) -> GaussianStates | None:
    """Baum-Welch from quantiles of x; none for series shorter than two values a state."""
    if len(x) < 2 * states:
        return None
    model = GaussianStates(np.quantile(x, (np.arange(states) + 0.5) / states), np.full(states, max(x.std(), 1e-9)), np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), np.zeros(states), 0.0)
    np.fill_diagonal(model.move, 0.9)
    for _ in range(rounds):
        b = model.density(x)
        a, c = np.empty_like(b), np.empty(len(x))
        for t in range(len(x)):
            a[t] = (model.start if t == 0 else a[t - 1] @ model.move) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        beta = np.ones_like(b)
        for t in range(len(x) - 2, -1, -1):
            beta[t] = model.move @ (b[t + 1] * beta[t + 1]) / c[t + 1]
        gamma = a * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = model.move * (a[:-1].T @ (b[1:] * beta[1:] / c[1:, None])) + 1e-12
        mean = (gamma * x[:, None]).sum(axis=0) / gamma.sum(axis=0)
        sd = np.sqrt(np.maximum(1e-18, (gamma * (x[:, None] - mean) ** 2).sum(axis=0) / gamma.sum(axis=0)))
        model = GaussianStates(mean, sd, gamma[0], xi / xi.sum(axis=1, keepdims=True), gamma.mean(axis=0), float(np.log(c).sum()))
    order = np.argsort(model.mean, kind="stable")
    return GaussianStates(model.mean[order], model.sd[order], model.start[order], model.move[np.ix_(order, order)], model.share[order], model.log_likelihood)


def hidden_states(rows: DataFrame, series: list[str], order: str, value: str, states: int = 2, rounds: int = 20) -> DataFrame:
    """Gaussian hidden Markov fit of each series: mean, deviation and share of each state, log-likelihood and criteria.

    A series is one group; split long ones into sessions first.
    """
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in series) + ", state int, mean double, sd double, share double, log_likelihood double, aic double, bic double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        columns, model, p = [*series, "state", "mean", "sd", "share", "log_likelihood", "aic", "bic"], fit_states(x, states, rounds), states * states + 2 * states - 1
        if model is None:
            return pd.DataFrame([], columns=columns)
        keys, ll = [pdf[k].iloc[0] for k in series], model.log_likelihood
        return pd.DataFrame([[*keys, s, model.mean[s], model.sd[s], model.share[s], ll, 2 * p - 2 * ll, p * np.log(len(x)) - 2 * ll] for s in range(states)], columns=columns)

    return rows.groupBy(*series).applyInPandas(fit, schema)


def state_paths(rows: DataFrame, series: list[str], order: str, value: str, states: int = 2, rounds: int = 20) -> DataFrame:
    """Each row's state on the most likely path of its series' fitted model; rows without a value, and series too short to fit,
    give none."""
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in [*series, order]) + ", state int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order)
        x = pdf[value].to_numpy(float)
        model = fit_states(x, states, rounds)
        if model is None:
            return pd.DataFrame([], columns=[*series, order, "state"])
        return pdf[[*series, order]].assign(state=model.path(x))

    return rows.select(*series, order, value).groupBy(*series).applyInPandas(walk, schema)


def correlation_spectrum(rows: DataFrame, vector: str) -> DataFrame:
    """Eigenvalues of the correlations of an array column's coordinates, and the edges that pure noise would have.

    Each task sums its own products; the driver sees one matrix, the square of the width. Rows that are null, not finite or
    of another width than the first sound row's are left out.
    """
    width = rows.where(F.size(vector) > 0).select(F.size(vector).alias("w")).first()
    schema = "rank int, eigenvalue double, noise_low double, noise_high double"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = width["w"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
            x = x[np.isfinite(x).all(axis=1)]
            x = np.hstack([np.ones((len(x), 1)), x])
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "s": total.ravel()})

    sums = rows.where(F.size(vector) == k).select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((k + 1, k + 1))
    total[sums.i, sums.j] = sums.s
    n = max(1.0, total[0, 0])
    mean = total[0, 1:] / n
    spread = total[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread), 0))
    matrix = np.where(np.outer(sd, sd) > 0, spread / np.maximum(1e-300, np.outer(sd, sd)), 0.0)
    np.fill_diagonal(matrix, 1.0)
    found, ratio = np.sort(np.linalg.eigvalsh(matrix))[::-1], k / n
    return rows.sparkSession.createDataFrame([(r, float(v), float((1 - ratio**0.5) ** 2), float((1 + ratio**0.5) ** 2)) for r, v in enumerate(found)], schema)


def robust_ratio(returns: DataFrame, series: list[str], q: int, order: str = "t") -> DataFrame:
    """Variance ratio of q steps with the factor for finite segments, summed over segments longer than q, and its z under
    changing variance (Lo and MacKinlay). Null z where products of squares are nought; no row without variance."""
    lengths = returns.groupBy(*series, "segment").agg(F.count("ret").alias("len"))
    rows = in_order_blocks(_of_series(returns, series, m=F.avg("ret")).join(lengths, [*series, "segment"]), order, q)
    seg = W.partitionBy(*series, "segment", "_block").orderBy(order)
    last = seg.rowsBetween(1 - q, 0)
    rows = rows.withColumns({"wide": F.when(F.count("ret").over(last) == q, F.sum("ret").over(last)), "d": F.pow(F.col("ret") - F.col("m"), 2)})
    rows = own(rows.withColumns({f"p{j}": F.col("d") * F.lag("d", j).over(seg) for j in range(1, q)}))
    weights = lengths.where(F.col("len") > q).groupBy(*series).agg(F.sum(q * (F.col("len") - q + 1) * (1 - q / F.col("len"))).alias("weight"))
    sums = rows.groupBy(*series).agg(
        F.var_samp("ret").alias("one"), F.sum(F.when(F.col("len") > q, F.pow(F.col("wide") - q * F.col("m"), 2))).alias("many"), F.sum("d").alias("total"), *[F.coalesce(F.sum(f"p{j}"), F.lit(0.0)).alias(f"p{j}") for j in range(1, q)]
    ).join(weights, series, "left")
    psi = sum(((2 * (q - j) / q) ** 2 * F.col(f"p{j}") for j in range(2, q)), (2 * (q - 1) / q) ** 2 * F.col("p1")) / (F.col("total") * F.col("total"))
    return sums.where("one > 0 and weight is not null").withColumn("vr", F.try_divide(F.col("many"), F.col("weight")) / F.col("one")).withColumn("psi", psi).select(*series, "vr", F.when(F.col("psi") > 0, (F.col("vr") - 1) / F.sqrt("psi")).alias("z"))


def tail_levels(rows: DataFrame, series: list[str], value: str, level: float, confidence: float) -> DataFrame:
    """Value at risk and expected shortfall at a confidence, by the law of what exceeds a quantile; no shortfall if the law
    has no mean."""
    law = excess_law(rows, series, value, level).join(rows.groupBy(*series).agg(F.count(F.lit(1)).alias("n")), series)
    ratio = (1 - confidence) / (F.col("exceedances") / F.col("n"))
    risk = F.when(F.abs("shape") < 1e-9, F.col("u") - F.col("scale") * F.log(ratio)).otherwise(F.col("u") + F.col("scale") / F.col("shape") * (F.pow(ratio, -F.col("shape")) - 1))
    law = law.withColumn("value_at_risk", risk)
    return law.select(*series, "value_at_risk", F.when(F.col("shape") < 1, (F.col("value_at_risk") + F.col("scale") - F.col("shape") * F.col("u")) / (1 - F.col("shape"))).alias("shortfall"))


def restricted_mean(curve: DataFrame, keys: list[str], time: str, end: float) -> DataFrame:
    """Area under a survival curve (time, survival; 1 before the first time) up to `end`."""
    w = W.partitionBy(*keys).orderBy(time)
    rows = curve.withColumns({"_before": F.coalesce(F.lag("survival").over(w), F.lit(1.0)), "_since": F.coalesce(F.lag(time).over(w), F.lit(0)), "_next": F.lead(time).over(w)})
    inside = F.when(F.col("_since") < end, F.col("_before") * (F.least(F.col(time), F.lit(end)) - F.col("_since"))).otherwise(0.0)
    tail = F.when(F.col("_next").isNull() & (F.col(time) < end), F.col("survival") * (end - F.col(time))).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.sum(inside) + F.sum(tail)).alias("rmst"))


def branching(dispersed: DataFrame, keys: list[str]) -> DataFrame:
    """Branching ratio n of self-exciting counts, whose variance over mean is 1 / (1 - n)**2, and the events that one brings
    in all, 1 / (1 - n); no branching where counts are no wider than by chance."""
    wide = F.col("fano") > 1
    return dispersed.select(*keys, F.when(wide, 1 - 1 / F.sqrt("fano")).otherwise(0.0).alias("branching"), F.when(wide, F.sqrt("fano")).otherwise(1.0).alias("response"))
