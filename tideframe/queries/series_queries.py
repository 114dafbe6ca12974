"""Scaling, entropy, tails, survival and attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inputs as I
from ..operators import recursions as R
from ..operators import series as X
from ..registry import register
from .common import r6, r6_all, r6_sql
from .trade_queries import T

BARS = I.BARS_SQL
RET = f"""{BARS}, jn AS (SELECT *, coalesce(t - lag(t) OVER w = 1, false) AS joined, lag(c) OVER w AS p FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t)),
rt AS (SELECT instrument, t, sum(CAST(NOT joined AS BIGINT)) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment, CASE WHEN joined THEN ln(c / p) END AS ret FROM jn),
ret AS (SELECT * FROM rt WHERE ret IS NOT NULL)"""


def ratio_sql(q: int) -> str:
    return f"""SELECT instrument, {q} AS q, count(s) AS n, avg(pow(s - {q} * m, 2)) / nullif({q} * avg(pow(ret - m, 2)), 0) AS vr FROM (SELECT *, avg(ret) OVER (PARTITION BY instrument) AS m,
 CASE WHEN count(ret) OVER x = {q} THEN sum(ret) OVER x END AS s FROM ret WINDOW x AS (PARTITION BY instrument, segment ORDER BY t ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW)) GROUP BY 1"""


QS = (2, 4, 8)
RATIOS = f"{RET}, vr AS ({' UNION ALL '.join(ratio_sql(q) for q in QS)})"


def ratios(spark, sf_dir) -> DataFrame:
    ret = X.log_returns(I.bars(spark, sf_dir), ["instrument"], "t", segments=False)
    return reduce(DataFrame.unionByName, [X.variance_ratio(ret, ["instrument"], q) for q in QS])


@register("log_returns", f"WITH {RET} SELECT instrument, t, CAST(segment AS BIGINT) AS segment, {r6_sql('ret', 'ret', 9)} FROM ret")
def log_returns(spark, sf_dir):
    return X.log_returns(I.bars(spark, sf_dir), ["instrument"], "t").select("instrument", "t", "segment", r6(F.col("ret"), "ret", 9))


@register("variance_ratio", f"WITH {RATIOS} SELECT instrument, CAST(q AS INTEGER) AS q, n, {r6_sql('vr', 'vr')} FROM vr")
def variance_ratio(spark, sf_dir):
    return r6_all(ratios(spark, sf_dir), "vr")


@register(
    "hurst_regression",
    f"""WITH {RATIOS} SELECT instrument, {r6_sql('CASE WHEN count(*) > 1 THEN regr_slope(ln(vr * q), ln(q)) / 2 END', 'hurst')}, {r6_sql('CASE WHEN count(*) > 1 THEN regr_r2(ln(vr * q), ln(q)) END', 'r2')} FROM vr WHERE vr > 0 GROUP BY 1""",
)
def hurst_regression(spark, sf_dir):
    """Slopes over the positive ratios of each instrument; null with fewer than two of them."""
    return r6_all(X.hurst(ratios(spark, sf_dir).where("vr > 0"), ["instrument"]), "hurst", "r2")


PATTERN = f"""{BARS}, lg AS (SELECT instrument, lag(c, 2) OVER w AS a, lag(c, 1) OVER w AS b, c AS d FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t)),
pt AS (SELECT instrument, CASE WHEN a <= b THEN CASE WHEN b <= d THEN '012' WHEN a <= d THEN '021' ELSE '201' END ELSE CASE WHEN a <= d THEN '102' WHEN b <= d THEN '120' ELSE '210' END END AS pattern FROM lg WHERE a IS NOT NULL), pc AS (SELECT instrument, pattern, count(*) AS n FROM pt GROUP BY 1, 2)"""


@register("ordinal_patterns", f"WITH {PATTERN} SELECT * FROM pc")
def ordinal_patterns(spark, sf_dir):
    return X.ordinal_patterns(I.bars(spark, sf_dir), ["instrument"], "t", "c")


@register("permutation_entropy", f"WITH {PATTERN}, pp AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY instrument) AS DOUBLE) AS p FROM pc) SELECT instrument, CAST(sum(n) AS BIGINT) AS windows, count(*) AS patterns, {r6_sql('-sum(p * log2(p)) / log2(6)', 'entropy')} FROM pp GROUP BY 1")
def permutation_entropy(spark, sf_dir):
    return r6_all(X.permutation_entropy(I.bars(spark, sf_dir), ["instrument"], "t", "c"), "entropy")


SCALES = [4, 8, 16, 32]
DFA = f"""{BARS}, ib AS (SELECT instrument, t, row_number() OVER (PARTITION BY instrument ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n, c - avg(c) OVER (PARTITION BY instrument) AS d FROM bars),
yb AS (SELECT instrument, i, n, sum(d) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM ib), bx AS (SELECT instrument, i, y, scale, CAST(floor(i / CAST(scale AS DOUBLE)) AS BIGINT) AS box, n FROM yb, (SELECT unnest({SCALES}) AS scale)),
ss AS (SELECT instrument, scale, box, regr_syy(y, i) - pow(regr_sxy(y, i), 2) / regr_sxx(y, i) AS ss FROM bx WHERE (box + 1) * scale <= n GROUP BY 1, 2, 3), fl AS (SELECT instrument, scale, sqrt(sum(greatest(ss, 0)) / (count(*) * scale)) AS f, count(*) AS boxes FROM ss GROUP BY 1, 2)"""


@register("dfa", f"WITH {DFA} SELECT instrument, CAST(scale AS INTEGER) AS scale, {r6_sql('f', 'f', 4)}, boxes FROM fl")
def dfa(spark, sf_dir):
    return r6_all(X.fluctuation(I.bars(spark, sf_dir), ["instrument"], "t", "c", SCALES), "f", digits=4)


@register("dfa_exponent", f"WITH {DFA} SELECT instrument, {r6_sql('regr_slope(ln(f), ln(scale))', 'alpha', 4)} FROM fl WHERE f > 0 GROUP BY 1")
def dfa_exponent(spark, sf_dir):
    return r6_all(X.scaling_exponent(X.fluctuation(I.bars(spark, sf_dir), ["instrument"], "t", "c", SCALES), ["instrument"]), "alpha", digits=4)


@register(
    "mutual_information",
    f"""WITH {T}, j AS (SELECT setup, reason, count(*) AS n FROM trades GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY setup) AS na, sum(n) OVER (PARTITION BY reason) AS nb, sum(n) OVER () AS t FROM j),
s AS (SELECT CAST(max(t) AS BIGINT) AS n, sum(n / CAST(t AS DOUBLE) * log2(CAST(n AS DOUBLE) * t / (CAST(na AS DOUBLE) * nb))) AS bits, count(DISTINCT setup) AS ka, count(DISTINCT reason) AS kb, count(*) AS kab FROM m)
SELECT n, {r6_sql('bits', 'bits', 9)}, {r6_sql('bits + (ka + kb - kab - 1) / (2 * n * ln(2.0))', 'corrected', 9)} FROM s""",
)
def mutual_information(spark, sf_dir):
    return r6_all(X.mutual_information(I.trades(spark, sf_dir), "setup", "reason"), "bits", "corrected", digits=9)


@register(
    "hill_tail",
    f"""WITH {T}, rk AS (SELECT setup, r, row_number() OVER (PARTITION BY setup ORDER BY r DESC) AS rank FROM trades WHERE r > 0) SELECT setup, {r6_sql('50 / (sum(CASE WHEN rank <= 50 THEN ln(r) END) - 50 * max(CASE WHEN rank = 51 THEN ln(r) END))', 'hill')} FROM rk WHERE rank <= 51 GROUP BY 1""",
)
def hill_tail(spark, sf_dir):
    return r6_all(X.hill(I.trades(spark, sf_dir), ["setup"], "r", 50), "hill")


@register(
    "excess_law",
    f"""WITH {T}, u AS (SELECT setup, quantile_cont(-r, 0.95) AS u FROM trades GROUP BY 1), m AS (SELECT setup, max(u) AS u, count(*) AS exceedances, avg(-r - u) AS m, var_samp(-r - u) AS v FROM trades JOIN u USING (setup) WHERE -r > u GROUP BY 1)
SELECT setup, {r6_sql('u', 'u')}, exceedances, {r6_sql('0.5 * (1 - m * m / v)', 'shape')}, {r6_sql('0.5 * m * (m * m / v + 1)', 'scale')} FROM m""",
)
def excess_law(spark, sf_dir):
    losses = I.trades(spark, sf_dir).withColumn("loss", -F.col("r"))
    return r6_all(X.excess_law(losses, ["setup"], "loss", 0.95), "u", "shape", "scale")


@register(
    "kaplan_meier",
    f"""WITH {T}, t AS (SELECT setup, qty, count(*) FILTER (reason <> 'time') AS d, count(*) AS leaving FROM trades GROUP BY 1, 2), k AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY setup ORDER BY qty ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM t)
SELECT setup, qty, d, at_risk, {r6_sql('CASE WHEN max(CAST(d >= at_risk AS INTEGER)) OVER u = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / CAST(at_risk AS DOUBLE)) END) OVER u) END', 'survival')} FROM k WINDOW u AS (PARTITION BY setup ORDER BY qty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def kaplan_meier(spark, sf_dir):
    x = I.trades(spark, sf_dir).withColumn("ended", F.col("reason") != "time")
    return r6_all(X.survival(x, ["setup"], "qty", "ended"), "survival")


@register(
    "fano_factor",
    f"""WITH {I.TICKS_SQL}, c AS (SELECT instrument, CAST(floor(sec / 7200.0) AS BIGINT) AS w, count(*) AS n FROM ticks GROUP BY 1, 2), m AS (SELECT instrument, max(w) - min(w) + 1 AS windows, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS s2 FROM c GROUP BY 1)
SELECT instrument, windows, {r6_sql('s / windows', 'mean')}, {r6_sql('(s2 / windows - s / windows * (s / windows)) / (s / windows)', 'fano')} FROM m""",
)
def fano_factor(spark, sf_dir):
    return r6_all(X.fano(I.ticks(spark, sf_dir), ["instrument"], "sec", 7200), "mean", "fano")


LEVERS = {"morning": "k3 <= 3", "small": "qty <= 25", "open_side": "side = 'O'"}


def _shapley_sql() -> str:
    names = list(LEVERS)
    means = ", ".join(f"coalesce(avg(CASE WHEN {' AND '.join([LEVERS[names[i]] for i in range(3) if m >> i & 1]) or 'true'} THEN r END), 0.0) AS v{m}" for m in range(8))
    weight = {0: "2.0/6", 1: "1.0/6", 2: "2.0/6"}
    rows = [f"SELECT '{n}' AS lever, " + r6_sql(" + ".join(f"{weight[m.bit_count()]} * (v{m | 1 << i} - v{m})" for m in range(8) if not m >> i & 1), "share") + " FROM v" for i, n in enumerate(names)]
    return f"WITH {T}, v AS (SELECT {means} FROM trades) {' UNION ALL '.join(rows)}"


@register("shapley", _shapley_sql())
def shapley(spark, sf_dir):
    x = I.trades(spark, sf_dir).withColumns({n: F.expr(e) for n, e in LEVERS.items()})
    return r6_all(X.shapley(x, list(LEVERS), "r"), "share")


@register("zigzag_swings")
def zigzag_swings(spark, sf_dir):
    """Pivots of each session's closes; the path decides, so SQL has no twin and tests hold it against a plain loop."""
    return R.zigzag(I.bars(spark, sf_dir), ["instrument", "session"], "t", "c", 20.0)


@register("hmm_fit")
def hmm_fit(spark, sf_dir):
    """Two Gaussian states of each session's hourly closes; an iterative fit without a SQL twin."""
    return X.hidden_states(I.bars(spark, sf_dir, 600), ["instrument", "session"], "t", "c")


@register("hmm_paths")
def hmm_paths(spark, sf_dir):
    """Bars of each session in each state of its most likely path; tests hold the path against all paths."""
    paths = X.state_paths(I.bars(spark, sf_dir, 600), ["instrument", "session"], "t", "c")
    return paths.groupBy("instrument", "session", "state").agg(F.count(F.lit(1)).alias("bars"))


@register("correlation_spectrum")
def correlation_spectrum(spark, sf_dir):
    """Spectrum of all coordinates of the embeddings; eigenvalues have no SQL twin, tests hold them against numpy."""
    return X.correlation_spectrum(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")


ROBUST = f"""{RET}, mu AS (SELECT instrument, avg(ret) AS m, var_samp(ret) AS va FROM ret GROUP BY 1), dv AS (SELECT ret.*, m, va, pow(ret - m, 2) AS d, count(*) OVER (PARTITION BY instrument, segment) AS len, CASE WHEN count(ret) OVER x = 4 THEN pow(sum(ret) OVER x - 4 * m, 2) END AS wide,
 lag(pow(ret - m, 2), 1) OVER s AS d1, lag(pow(ret - m, 2), 2) OVER s AS d2, lag(pow(ret - m, 2), 3) OVER s AS d3 FROM ret JOIN mu USING (instrument) WINDOW s AS (PARTITION BY instrument, segment ORDER BY t), x AS (PARTITION BY instrument, segment ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
lg AS (SELECT instrument, segment, max(len) AS n FROM dv WHERE len > 4 GROUP BY 1, 2), dn AS (SELECT instrument, sum(4 * (n - 3) * (1 - 4.0 / n)) AS weight FROM lg GROUP BY 1),
sm AS (SELECT instrument, max(va) AS va, sum(CASE WHEN len > 4 THEN wide END) AS wide, sum(d) AS total, coalesce(sum(d * d1), 0) AS c1, coalesce(sum(d * d2), 0) AS c2, coalesce(sum(d * d3), 0) AS c3 FROM dv GROUP BY 1),
rb AS (SELECT instrument, wide / weight / va AS vr, (pow(2.0 * 3 / 4, 2) * c1 + pow(2.0 * 2 / 4, 2) * c2 + pow(2.0 * 1 / 4, 2) * c3) / (total * total) AS psi FROM sm JOIN dn USING (instrument) WHERE va > 0)"""


@register("robust_ratio", f"WITH {ROBUST} SELECT instrument, {r6_sql('vr', 'vr')}, {r6_sql('CASE WHEN psi > 0 THEN (vr - 1) / sqrt(psi) END', 'z')} FROM rb")
def robust_ratio(spark, sf_dir):
    """Variance ratio of four steps with the factor for finite segments, and its z robust to changing variance."""
    return r6_all(X.robust_ratio(X.log_returns(I.bars(spark, sf_dir), ["instrument"], "t"), ["instrument"], 4), "vr", "z")


@register(
    "tail_levels",
    f"""WITH {T}, n AS (SELECT setup, quantile_cont(-r, 0.95) AS u, count(*) AS n FROM trades GROUP BY 1), m AS (SELECT setup, max(u) AS u, max(n) AS n, count(*) AS k, avg(-r - u) AS m, var_samp(-r - u) AS v FROM trades JOIN n USING (setup) WHERE -r > u GROUP BY 1),
f AS (SELECT setup, u, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS beta, 0.001 / (k / CAST(n AS DOUBLE)) AS ratio FROM m), w AS (SELECT *, CASE WHEN abs(xi) < 1e-9 THEN u - beta * ln(ratio) ELSE u + beta / xi * (pow(ratio, -xi) - 1) END AS var FROM f)
SELECT setup, {r6_sql('var', 'value_at_risk')}, {r6_sql('CASE WHEN xi < 1 THEN (var + beta - xi * u) / (1 - xi) END', 'shortfall')} FROM w""",
)
def tail_levels(spark, sf_dir):
    losses = I.trades(spark, sf_dir).withColumn("loss", -F.col("r"))
    return r6_all(X.tail_levels(losses, ["setup"], "loss", 0.95, 0.999), "value_at_risk", "shortfall")


@register(
    "restricted_mean",
    f"""WITH {T}, t AS (SELECT setup, qty, count(*) FILTER (reason <> 'time') AS d, count(*) AS leaving FROM trades GROUP BY 1, 2), k AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY setup ORDER BY qty ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM t),
s AS (SELECT setup, qty, CASE WHEN max(CAST(d >= at_risk AS INTEGER)) OVER u = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / CAST(at_risk AS DOUBLE)) END) OVER u) END AS sv FROM k WINDOW u AS (PARTITION BY setup ORDER BY qty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT setup, qty, coalesce(lag(sv) OVER w, 1.0) AS before, coalesce(lag(qty) OVER w, 0) AS since, sv, lead(qty) OVER w AS following FROM s WINDOW w AS (PARTITION BY setup ORDER BY qty))
SELECT setup, {r6_sql('sum(CASE WHEN since < 30 THEN before * (least(qty, 30) - since) ELSE 0 END) + sum(CASE WHEN following IS NULL AND qty < 30 THEN sv * (30 - qty) ELSE 0 END)', 'rmst')} FROM g GROUP BY 1""",
)
def restricted_mean(spark, sf_dir):
    """Area under the survival curve up to 30."""
    x = I.trades(spark, sf_dir).withColumn("ended", F.col("reason") != "time")
    return r6_all(X.restricted_mean(X.survival(x, ["setup"], "qty", "ended"), ["setup"], "qty", 30.0), "rmst")


@register(
    "branching",
    f"""WITH {I.TICKS_SQL}, c AS (SELECT instrument, CAST(floor(sec / 7200.0) AS BIGINT) AS w, count(*) AS n FROM ticks GROUP BY 1, 2), m AS (SELECT instrument, max(w) - min(w) + 1 AS windows, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS s2 FROM c GROUP BY 1),
f AS (SELECT instrument, (s2 / windows - s / windows * (s / windows)) / (s / windows) AS fano FROM m) SELECT instrument, {r6_sql('CASE WHEN fano <= 1 THEN 0.0 ELSE 1 - 1 / sqrt(fano) END', 'branching')}, {r6_sql('CASE WHEN fano <= 1 THEN 1.0 ELSE sqrt(fano) END', 'response')} FROM f""",
)
def branching(spark, sf_dir):
    """Branching ratio of self-exciting counts from their variance over mean, and the total response to one event."""
    return r6_all(X.branching(X.fano(I.ticks(spark, sf_dir), ["instrument"], "sec", 7200), ["instrument"]), "branching", "response")
