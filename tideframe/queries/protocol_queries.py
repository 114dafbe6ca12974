"""Looks, sealed plans, exits side by side, and simulated nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution as E
from ..operators import inputs as I
from ..operators import protocols as P
from ..operators import sequential as S
from ..operators.quantiles import whole_quantiles
from ..registry import register
from . import engine_queries as Q
from .common import r6, r6_all, r6_sql
from .trade_queries import SEQ, SEQ_SQL, UPTO, T

BOUNDS = [4.877, 3.357, 2.680, 2.290, 2.031]


@register("sequential_bounds")
def sequential_bounds(spark, sf_dir):
    """Plans of five looks of each setup, at the information its trades had by then; tests hold bounds to published ones."""
    plans = S.information(I.trades(spark, sf_dir), ["setup"], "day", 5)
    return r6_all(S.boundaries(plans, ["setup"]), *[x.split()[0] for x in S.LOOK.split(", ")[1:]])


FRACTIONS = f"WITH {T}, e AS (SELECT account, min(day) AS f, max(day) - min(day) + 1 AS d, count(*) AS n FROM trades GROUP BY 1), l AS (SELECT account, CAST(floor((day - f) * 5 / d) AS BIGINT) AS look, count(*) AS k, any_value(n) AS n FROM trades JOIN e USING (account) GROUP BY 1, 2)"


@register("information_fractions", f"{FRACTIONS} SELECT account, {r6_sql('sum(k) OVER (PARTITION BY account ORDER BY look) / n', 'fraction')} FROM l")
def information_fractions(spark, sf_dir):
    """What part of each account's trades was made by the end of each fifth of its days."""
    found = S.information(I.trades(spark, sf_dir), ["account"], "day", 5)
    return found.select("account", F.explode("fractions").alias("fraction")).select("account", r6(F.col("fraction"), "fraction"))


@register(
    "sequential_looks",
    f"""WITH {T}, r AS (SELECT account, row_number() OVER (PARTITION BY account ORDER BY {SEQ_SQL}) AS i, avg(r) OVER {UPTO} / nullif(stddev_samp(r) OVER {UPTO}, 0) * sqrt(count(*) OVER {UPTO}) AS z FROM trades),
l AS (SELECT account, CAST(i / 40 AS INTEGER) AS look, i AS n, z, abs(z) >= [{', '.join(map(str, BOUNDS))}][CAST(i / 40 AS INTEGER)] AS crossed FROM r WHERE i % 40 = 0 AND i <= 200),
d AS (SELECT *, coalesce(max(CAST(crossed AS INTEGER)) OVER (PARTITION BY account ORDER BY look ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l) SELECT account, look, n, {r6_sql('z', 'z')}, crossed FROM d WHERE done = 0""",
)
def sequential_looks(spark, sf_dir):
    return r6_all(P.looks(I.trades(spark, sf_dir), ["account"], SEQ, "r", 40, BOUNDS), "z")


@register(
    "sealed_decisions",
    f"""WITH {T}, p AS (SELECT setup, CAST(floor(avg(day)) AS BIGINT) AS sealed, 500 AS least, 1.645::DOUBLE AS bound FROM trades GROUP BY 1), a AS (SELECT setup, max(least) AS least, max(bound) AS bound, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM trades JOIN p USING (setup) WHERE day > sealed GROUP BY 1)
SELECT setup, n, {r6_sql('mean', 'mean')}, {r6_sql('mean / nullif(sd, 0) * sqrt(n)', 'z')}, CASE WHEN n < least THEN 'wait' WHEN mean / nullif(sd, 0) * sqrt(n) >= bound THEN 'pass' ELSE 'fail' END AS decision FROM a""",
)
def sealed_decisions(spark, sf_dir):
    """Plans sealed at the middle of each setup's days, decided on what came after."""
    x = I.trades(spark, sf_dir)
    plans = x.groupBy("setup").agg(F.floor(F.avg("day")).alias("sealed")).withColumns({"least": F.lit(500), "bound": F.lit(1.645)})
    return r6_all(P.sealed_decisions(x, plans, ["setup"], "day", "r"), "mean", "z")


@register("exit_concepts")
def exit_concepts(spark, sf_dir):
    """The band document's entries left in eleven ways, replayed together; a path, as execute_run."""
    concepts = P.exit_concepts(Q.BASE)
    trades = E.execute(E.features(Q.compiler(spark, sf_dir), Q.DOCUMENT), list(concepts.values()))
    names = F.array(*[F.lit(n) for n in concepts])
    return trades.groupBy(F.get(names, F.col("config")).alias("exit")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"), r6(F.avg("bars"), "mean_bars"), r6(F.avg((F.col("pnl") > 0).cast("double")), "win_rate"))


@register("best_of_nothing")
def best_of_nothing(spark, sf_dir):
    """Mean and upper levels of the best Sharpe ratio of as many rules without skill as there are orders' priorities times ten."""
    trials = 10 * spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority").distinct().count()
    return r6_all(P.best_of_nothing(spark, trials, 100, 400).agg(F.avg("best").alias("mean"), F.percentile("best", F.lit(0.5)).alias("median"), F.percentile("best", F.lit(0.95)).alias("upper")), "mean", "median", "upper")


@register("trade_paths")
def trade_paths(spark, sf_dir):
    """Paths of 250 results drawn from the hundredths of all results' law."""
    found = whole_quantiles(I.trades(spark, sf_dir), "pnl4", [(k + 0.5) / 100 for k in range(100)], 1e6).first()["quantiles"]
    return r6_all(P.trade_paths(spark, list(found), 300, 250, 100.0), "total", "drawdown")


@register(
    "gate_availability",
    f"""WITH {I.TICKS_SQL}, a AS (SELECT instrument, max(size) > 0 AS volume, count(*) >= 100 AS wide FROM ticks GROUP BY 1)
SELECT instrument, 'volume' AS data, unnest(['profile', 'vwap_band', 'low_node']) AS gate FROM a WHERE volume UNION ALL SELECT instrument, 'range', unnest(['noise_band', 'range_stop']) FROM a WHERE wide""",
)
def gate_availability(spark, sf_dir):
    """Gates that each instrument's ticks allow: those of volume where some have a size, those of range from 100 ticks on."""
    a = I.ticks(spark, sf_dir).groupBy("instrument").agg((F.max("size") > 0).alias("sized"), (F.count(F.lit(1)) >= 100).alias("wide"))
    return P.available_gates(a, ["instrument"], {"volume": F.col("sized"), "range": F.col("wide")})
