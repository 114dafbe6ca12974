"""Bounds against published ones, seals, and simulations against closed forms."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tideframe import registry
from tideframe.functions import closed_forms as cf
from tideframe.operators import protocols as P
from tideframe.queries import engine_queries as Q

from .conftest import SMALL
from .test_proofs import ENGINE, plain_replay, sessions_of


def test_bounds_of_five_looks(spark):
    rows = P.sequential_bounds(spark, [0.2, 0.4, 0.6, 0.8, 1.0], paths=400_000, sides=2).orderBy("look").collect()
    # published bounds for five equal looks at a two-sided level of 0.05
    for r, want, room in zip(rows, (4.877, 3.357, 2.680, 2.290, 2.031), (0.001, 0.06, 0.03, 0.02, 0.02), strict=True):
        assert r["bound"] == pytest.approx(want, abs=room)
    assert rows[-1]["stopped_null"] == pytest.approx(0.05, abs=0.002)
    assert [r["stopped_null"] for r in rows] == pytest.approx([r["spent"] for r in rows], abs=0.001)
    assert rows[-1]["stopped_drift"] > 0.8 and rows[0]["stopped_drift"] < rows[-1]["stopped_drift"]


def test_seal_breaks_with_any_change():
    plan = {"a": 1, "b": [1, 2.5], "c": {"x": "é"}}
    assert P.seal(plan) == P.seal({"c": {"x": "é"}, "b": [1, 2.5], "a": 1}) != P.seal({**plan, "a": 2})


def test_exit_concepts_against_a_plain_walk(spark):
    groups = sessions_of(Q.frame(spark, ENGINE))
    got = {r["exit"]: (r["n"], r["mean_r"]) for r in registry.queries()["exit_concepts"](spark, ENGINE).collect()}
    assert set(got) == set(P.exit_concepts(Q.BASE))
    for name in ("one_r", "two_r", "three_r"):
        s = P.exit_concepts(Q.BASE)[name]
        trades = [x for g in groups.values() for x in plain_replay(g, s)]
        assert got[name] == (len(trades), pytest.approx(sum(x[-1] for x in trades) / len(trades), abs=1e-5))
    far = replace(Q.BASE, target_x=1e6)
    trades = [x for g in groups.values() for x in plain_replay(g, far)]
    assert got["stop_only"] == (len(trades), pytest.approx(sum(x[-1] for x in trades) / len(trades), abs=1e-5))


def test_simulated_nulls(spark):
    mean = P.best_of_nothing(spark, 50, 100, 400).agg(F.avg("best")).first()[0]
    closed = spark.range(1).select(cf.expected_best_sharpe(F.lit(50.0), F.lit(0.1))).first()[0]
    assert mean == pytest.approx(closed, rel=0.05)
    paths = P.trade_paths(spark, [1.0, -1.0], 400, 100, 15.0)
    row = paths.agg(F.avg("total").alias("m"), F.stddev("total").alias("s"), F.avg(F.col("ruined").cast("double")).alias("ruin")).first()
    assert abs(row["m"]) < 1.5 and row["s"] == pytest.approx(10, rel=0.12)
    assert row["ruin"] == pytest.approx(2 * (1 - 0.5 * (1 + math.erf(1.45 / math.sqrt(2)))), abs=0.06)
    assert registry.queries()["trade_paths"](spark, SMALL).count() == 300
    assert registry.queries()["best_of_nothing"](spark, SMALL).first()["upper"] > 0


def test_levels_of_results_are_numbered_not_held(spark):
    """Levels of all results as a percentile of the table gives them, to the last bit, without one task that holds every value."""
    import inspect

    from pyspark.sql import functions as F

    from tideframe.operators import inputs as I
    from tideframe.operators.quantiles import whole_quantiles

    levels = [0.0, 0.13, 0.5, 0.995, 1.0] + [(k + 0.5) / 100 for k in range(100)]
    rows = I.trades(spark, SMALL)
    plain = rows.agg(F.percentile("r", F.array(*[F.lit(x) for x in levels])).alias("q")).first()["q"]
    assert whole_quantiles(rows, "pnl4", levels, 1e6).first()["quantiles"] == plain
    few = spark.createDataFrame([(-3,), (None,), (-3,), (20,), (7,)], "v long")
    assert whole_quantiles(few, "v", [0.0, 0.5, 0.75, 1.0]).first()["quantiles"] == [-3.0, 2.0, 10.25, 20.0]
    assert "percentile" not in inspect.getsource(registry.queries()["trade_paths"])
