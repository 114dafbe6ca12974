"""Operands and conditions: plain loops, causality, reflection, three-valued logic."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideframe.plans.compiler import Compiler
from tideframe.plans.document import mirror

SCHEMA = "instrument string, t long, session long, sessmin int, o double, h double, l double, c double, v double, n long"


def bars(spark, n=60, seed=1, reflect=None, change_after=None):
    rng, price, rows = random.Random(seed), 100.0, []
    for t in range(n):
        o = price
        c = o + rng.randint(-4, 4) / 4
        h, l = max(o, c) + rng.randint(0, 3) / 4, min(o, c) - rng.randint(0, 3) / 4
        if change_after is not None and t > change_after:
            o, h, l, c = o + 50, h + 90, l - 30, c + 7
        price = c
        if reflect is not None:
            o, h, l, c = reflect - o, reflect - l, reflect - h, reflect - c
        rows.append(("x", t, t // 20, t % 20, o, h, l, c, float(rng.randint(1, 9)), 1))
    return spark.createDataFrame(rows, SCHEMA), rows


def values(compiler, column):
    return [r["x"] for r in compiler.frame.select("t", column.alias("x")).orderBy("t").collect()]


def test_recursions_match_loops(spark):
    df, rows = bars(spark)
    c = Compiler(df)
    close = [r[7] for r in rows]
    got = values(c, c.operand({"ind": "ema", "n": 5}))
    want, e = [None] * 4, sum(close[:5]) / 5
    want.append(e)
    for x in close[5:]:
        e += 2 / 6 * (x - e)
        want.append(e)
    assert got[:4] == [None] * 4
    assert got[4:] == pytest.approx(want[4:])
    fast = values(c, c.operand({"ind": "ema", "n": 2}))
    e = sum(close[:2]) / 2
    for i, x in enumerate(close[2:], 2):
        e += 2 / 3 * (x - e)
        assert fast[i] == pytest.approx(e)


def test_no_look_ahead(spark):
    for spec in ("hlc3", {"ind": "sma", "n": 5}, {"ind": "ema", "n": 5}, {"ind": "rsi", "n": 5}, {"ind": "atr", "n": 5}, {"ind": "vwap", "k": 1}, {"ind": "or", "field": "high", "from": 0, "to": 5}, {"ind": "tf", "m": 5, "of": "close"}, {"ind": "prev", "field": "low", "n": 1}, {"ind": "sess", "field": "high"}):
        a, b = Compiler(bars(spark)[0], expected=20), Compiler(bars(spark, change_after=33)[0], expected=20)
        assert values(a, a.operand(spec))[:34] == values(b, b.operand(spec))[:34], spec


def test_reflection(spark):
    for cond in ({"reject": "above", "level": {"ind": "sma", "n": 5}}, {"cross": "up", "a": "close", "b": {"ind": "ema", "n": 4}}, {"break": "up", "level": {"ind": "hh", "n": 4}}, {"bar": "up"}, {"touch": "below", "level": {"ind": "sess", "field": "high"}}):
        a, b = Compiler(bars(spark)[0]), Compiler(bars(spark, reflect=256.0)[0])
        assert values(a, a.condition(cond)) == values(b, b.condition(mirror(cond))), cond


def test_edges_are_false_and_gaps_null(spark):
    c = Compiler(bars(spark)[0])
    got = values(c, c.condition({"cross": "up", "a": "close", "b": {"ind": "sma", "n": 5}}))
    assert got[0] is False and got[20] is False and got[1] is None


def test_kleene_table(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame([(f"{i}", i, 0, i, 1.0 if a is None else 3.0 if a else 0.0, 1.0, 1.0, 2.0, 1.0, 1) for i, (a, b) in enumerate(rows)], SCHEMA)
    both = df.withColumns({"a": F.when(F.col("o") != 1.0, F.col("o") > 1), "b": F.lit(None).cast("boolean")})
    assert both.where("(a and b) = true").count() == 0
    assert both.where("(a and b) = false").count() == 3


def test_time_window_wraps(spark):
    c = Compiler(bars(spark)[0])
    got = values(c, c.condition({"time": [18, 2]}))
    assert [i for i, x in enumerate(got[:20]) if x] == [0, 1, 18, 19]
