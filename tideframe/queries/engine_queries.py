"""Engine verbs: runs, envelopes, sweeps, walk-forward, cross-validation, nulls."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import execution as E
from ..operators import inputs as I
from ..operators import resampling as R
from ..operators import search as S
from ..plans.compiler import Compiler
from ..plans.document import TEMPLATES
from ..registry import register
from .common import r6, r6_all, r6_sql
from .trade_queries import T

ANCHOR = (6, 21)
BASE = E.Settings(tick=0.01, point_value=2.0, commission=0.2, slip=1.0, stop_kind="points", stop_x=15.0, target_kind="r", target_x=1.5)
DOCUMENT = {**TEMPLATES["vwap_band"], "trigger": {"reject": "above", "level": {"ind": "vwap", "k": "$k"}}, "params": {"k": -1.0}}


def compiler(spark: SparkSession, sf_dir: str) -> Compiler:
    return Compiler(I.bars(spark, sf_dir), anchor=ANCHOR)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.features(compiler(spark, sf_dir), DOCUMENT, average_range=E.wants_range([BASE]))


ROUNDED = ["entry", "stop", "target", "exit", "points", "pnl", "r", "mae", "mfe"]


@register("execute_run")
def execute_run(spark, sf_dir):
    """Trades of the band document; the replay is a path, held by tests against hand-made sessions."""
    return r6_all(E.execute(frame(spark, sf_dir), [BASE]), *ROUNDED)


@register("refusals")
def refusals(spark, sf_dir):
    """Signals that made no trade, by reason: once as they are, once with at most one trade a session."""
    found = E.refusals(frame(spark, sf_dir), [BASE, E.replace(BASE, max_per_session=1)])
    return found.groupBy("config", "reason").agg(F.sum("n").alias("n"))


@register("envelope")
def envelope(spark, sf_dir):
    return E.envelope(frame(spark, sf_dir), BASE).groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"), r6(F.sum("pnl"), "net"))


@register("stress_grid")
def stress_grid(spark, sf_dir):
    return E.execute(frame(spark, sf_dir), E.stress_grid(BASE)).groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"), r6(F.sum("pnl"), "net"))


@register("sweep_matrix")
def sweep_matrix(spark, sf_dir):
    """Session records of every setting, sessions without trades included."""
    records, _ = S.sweep_records(compiler(spark, sf_dir), DOCUMENT, {"k": [-0.5, -1.0, -1.5, -2.0]}, BASE)
    return r6_all(records, "sum_r", "sum_r2", "net")


@register("random_null")
def random_null(spark, sf_dir):
    return r6_all(R.random_null(frame(spark, sf_dir), BASE, 20), "mean_r")


@register("random_p_value")
def random_p_value(spark, sf_dir):
    """The real mean against twenty draws of random entries."""
    return r6_all(R.p_value(R.random_null(frame(spark, sf_dir), BASE, 20)), "real", "p")


@register("permute_null")
def permute_null(spark, sf_dir):
    """Mean result of the document on ten sets of permuted bars."""
    bars = I.bars(spark, sf_dir)
    shuffled = Compiler(R.permuted_bars(bars, 10, 4), anchor=ANCHOR, places=R.permuted_places(bars, 10))
    trades = E.execute(E.features(shuffled, DOCUMENT, average_range=E.wants_range([BASE])), [BASE])
    return trades.groupBy(F.substring_index("instrument", "#", -1).cast("int").alias("draw")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"))


@register("stationary_bootstrap")
def stationary_bootstrap(spark, sf_dir):
    """Paths resampled from the daily results of all trades (a number a day)."""
    days = I.trades(spark, sf_dir).groupBy("day").agg((F.sum("pnl4") / 1e6).alias("x")).orderBy("day").collect()
    return r6_all(R.stationary_bootstrap(spark, [d["x"] for d in days], 200, 5.0), "mean", "total", "drawdown")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of settings and sessions made of trades: setting = conviction, session = day modulo 120, six blocks."""
    rows = I.trades(spark, sf_dir).groupBy((F.col("conviction") - 1).alias("config"), (F.col("day") % 120).alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r")).withColumn("block", F.floor(F.col("s") / 20).cast("int"))


MATRIX = f"{T}, mx AS (SELECT conviction - 1 AS config, day % 120 AS s, count(*) AS n, sum(r) AS sum_r, CAST(floor(day % 120 / 20.0) AS INTEGER) AS block FROM trades GROUP BY 1, 2, 5)"


@register("best_config_topk", f"WITH {MATRIX}, t AS (SELECT config, CAST(sum(n) AS BIGINT) AS n, sum(sum_r) / sum(n) AS m FROM mx GROUP BY 1) SELECT config, n, {r6_sql('m', 'mean_r')}, CAST(row_number() OVER (ORDER BY m DESC, config) AS BIGINT) AS rank FROM t")
def best_config_topk(spark, sf_dir):
    return r6_all(S.best_config(matrix(spark, sf_dir)), "mean_r").withColumn("rank", F.col("rank").cast("long"))


@register(
    "wfa_matrix",
    f"""WITH {MATRIX}, w AS (SELECT unnest(range(3)) AS w), x AS (SELECT w, config, sum(CASE WHEN s < w * 20 + 60 THEN n ELSE 0 END) AS in_n, sum(CASE WHEN s < w * 20 + 60 THEN sum_r ELSE 0 END) AS in_r, sum(CASE WHEN s >= w * 20 + 60 THEN n ELSE 0 END) AS os_n, sum(CASE WHEN s >= w * 20 + 60 THEN sum_r ELSE 0 END) AS os_r
FROM mx, w WHERE s >= w * 20 AND s < w * 20 + 80 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY in_r / nullif(in_n, 0) DESC NULLS LAST, config) AS k FROM x WHERE in_n > 0)
SELECT w, config, {r6_sql('in_r / in_n', 'is_mean')}, CAST(os_n AS BIGINT) AS os_n, {r6_sql('os_r / nullif(os_n, 0)', 'os_mean')} FROM k WHERE k = 1""",
)
def wfa_matrix(spark, sf_dir):
    return r6_all(S.walk_forward(matrix(spark, sf_dir), 60, 20, False, 119), "is_mean", "os_mean")


SPLITS = ", ".join(f"({k}, {list(c)})" for k, c in enumerate(combinations(range(6), 3)))
CSCV = f"""{MATRIX}, sp(split, chosen) AS (VALUES {SPLITS}), x AS (SELECT split, config, sum(CASE WHEN list_contains(chosen, block) THEN sum_r END) / sum(CASE WHEN list_contains(chosen, block) THEN n END) AS im, sum(CASE WHEN NOT list_contains(chosen, block) THEN sum_r END) / sum(CASE WHEN NOT list_contains(chosen, block) THEN n END) AS om FROM mx, sp GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY im DESC, config) AS best, rank() OVER (PARTITION BY split ORDER BY om) AS os_rank, count(*) OVER (PARTITION BY split) AS configs FROM x),
sel AS (SELECT *, os_rank / (configs + 1.0) AS om_share FROM k WHERE best = 1)"""


@register("cscv_pbo", f"WITH {CSCV} SELECT {r6_sql('avg(CASE WHEN ln(om_share / (1 - om_share)) <= 0 THEN 1.0 ELSE 0.0 END)', 'pbo')}, count(*) AS splits FROM sel")
def cscv_pbo(spark, sf_dir):
    return r6_all(S.overfit_probability(S.cross_validation(matrix(spark, sf_dir), 6)), "pbo")


@register("cscv_splits", f"WITH {CSCV} SELECT CAST(split AS INTEGER) AS split, config, {r6_sql('im', 'is_mean')}, {r6_sql('om', 'os_mean')}, CAST(os_rank AS INTEGER) AS os_rank, {r6_sql('ln(om_share / (1 - om_share))', 'logit')} FROM sel")
def cscv_splits(spark, sf_dir):
    return r6_all(S.cross_validation(matrix(spark, sf_dir), 6), "is_mean", "os_mean", "logit")


@register(
    "account_rule",
    f"""WITH {T}, d AS (SELECT account, day, sum(pnl4) / 1e4 AS pnl FROM trades GROUP BY 1, 2), e AS (SELECT *, row_number() OVER w AS i, sum(pnl) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM d WINDOW w AS (PARTITION BY account ORDER BY day)),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY account ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM e),
x AS (SELECT *, CASE WHEN peak - equity >= 20000 OR pnl <= -5000 THEN 'failed' WHEN equity >= 30000 THEN 'passed' END AS e FROM p) SELECT account, count(*) AS days, arg_min(e, i) FILTER (e IS NOT NULL) AS outcome, min(i) FILTER (e IS NOT NULL) AS day_no FROM x GROUP BY 1""",
)
def account_rule(spark, sf_dir):
    days = I.trades(spark, sf_dir).groupBy("account", "day").agg((F.sum("pnl4") / 1e4).alias("pnl"))
    return S.account_rule(days, ["account"], "day", "pnl", 30_000.0, 20_000.0, 5_000.0)


@register("plateau", f"WITH {MATRIX}, t AS (SELECT config, sum(sum_r) / sum(n) AS m FROM mx GROUP BY 1), b AS (SELECT config, m, (coalesce(lag(m) OVER w, m) + coalesce(lead(m) OVER w, m)) / 2 AS beside FROM t WINDOW w AS (ORDER BY config)) SELECT config, {r6_sql('m', 'mean_r')}, {r6_sql('beside', 'beside')}, CASE WHEN m > 0 THEN beside >= 0.5 * m ELSE false END AS plateau FROM b")
def plateau(spark, sf_dir):
    totals = matrix(spark, sf_dir).groupBy("config").agg((F.sum("sum_r") / F.sum("n")).alias("mean_r"))
    return r6_all(S.plateau(totals, "config", "mean_r"), "mean_r", "beside")
