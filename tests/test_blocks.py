"""Series in blocks and ranges against whole series and plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import blocks, profiles, series
from tideframe.plans.compiler import Compiler, reach
from tideframe.queries import bar_queries

from .conftest import SMALL
from .test_compiler import SCHEMA

OPERANDS = [
    {"ind": "close", "lag": 7}, {"ind": "sma", "n": 9}, {"ind": "sd", "n": 4}, {"ind": "hh", "n": 30}, {"ind": "ll", "n": 3, "lag": 2}, {"ind": "ema", "n": 3}, {"ind": "ema", "n": 2, "of": {"ind": "sma", "n": 3}}, {"ind": "atr", "n": 3}, {"ind": "rsi", "n": 2},
    {"ind": "rvol", "n": 2}, {"ind": "vwap", "k": 1}, {"ind": "sess", "field": "low"}, {"ind": "or", "field": "mid", "from": 1, "to": 3}, {"ind": "at", "bar": 2}, {"ind": "prev", "field": "high", "n": 2}, {"ind": "tf", "m": 3, "of": "close"},
    {"ind": "tf", "m": 3, "of": {"ind": "ema", "n": 2}}, {"ind": "dist", "a": "close", "b": {"ind": "ema", "n": 2}, "unit": "atr", "n": 2}, {"op": "-", "a": {"ind": "sma", "n": 5, "of": {"ind": "close", "lag": 3}}, "b": {"ind": "rvol", "n": 3}},
]
CONDITIONS = [{"cross": "up", "a": "close", "b": {"ind": "ema", "n": 2}}, {"for": 4, "cond": {"cmp": ">", "a": "close", "b": {"ind": "sma", "n": 6}}}, {"within": 3, "cond": {"reject": "above", "level": {"ind": "vwap", "k": -1}}}, {"break": "down", "level": {"ind": "ll", "n": 5}}]


def bars(spark, segments=False):
    rng, rows = random.Random(4), []
    for name in "xyz":
        price, t = 100.0, rng.randrange(50)
        for _ in range({"x": 400, "y": 90, "z": 3}[name]):
            t += 1 if rng.random() < 0.9 else rng.randrange(2, 60)
            o, price = price, price + rng.randint(-4, 4) / 4
            rows.append((name, t, t // 20, t % 20, o, max(o, price) + 0.25, min(o, price) - 0.5, price, float(rng.randint(1, 9)), 1))
    made = spark.createDataFrame(rows, SCHEMA)
    return made.withColumn("segment", F.floor(F.col("session") / 7)) if segments else made


def table(compiler, columns):
    made = compiler.frame.select("instrument", "t", *[c.alias(f"v{i}") for i, c in enumerate(columns)])
    return {(r["instrument"], r["t"]): tuple(r)[2:] for r in made.collect()}


@pytest.mark.parametrize("segments", [False, True])
def test_short_ranges_give_what_one_range_gives(spark, segments):
    source, operands = bars(spark, segments), OPERANDS[:8] if segments else OPERANDS
    whole, parts = Compiler(source, expected=12, rows=1 << 20), Compiler(source, expected=12, rows=1, first_reach=1)
    made = []
    for c in (whole, parts):
        columns = [c.operand(x) for x in operands] + [c.condition(x) for x in CONDITIONS]
        made.append(table(c, columns))
    assert made[0].keys() == made[1].keys() and len(made[0]) == 493
    assert parts._frame.select("_range").distinct().count() >= 3 if parts.reach < 100 else True
    for key, want in made[0].items():
        for got, w, spec in zip(made[1][key], want, operands + CONDITIONS, strict=True):
            assert (got == w) if w is None or isinstance(w, bool) else got == pytest.approx(w, rel=1e-9, abs=1e-12), (key, spec)


def test_ranges_have_the_bars_before_them(spark):
    source = bars(spark)
    placed = source.join(blocks.session_places(source), ["instrument", "session"])
    for far, rows in ((1, 7), (25, 10), (60, 200)):
        made = blocks.in_ranges(placed, far, rows).select("instrument", "_range", "t", "session", "_own").collect()
        whole = {}
        for r in source.select("instrument", "t").collect():
            whole.setdefault(r["instrument"], []).append(r["t"])
        groups = {}
        for r in made:
            groups.setdefault((r["instrument"], r["_range"]), []).append((r["t"], r["_own"]))
        assert sorted((k[0], t) for k, v in groups.items() for t, own in v if own) == sorted((k, t) for k, v in whole.items() for t in v)
        for (name, _), v in groups.items():
            own = sorted(t for t, o in v if o)
            if own:
                before = [t for t in sorted(whole[name]) if t < own[0]][-far:]
                assert set(before) <= {t for t, o in v if not o} and max([t for t, o in v if not o], default=-1) < own[0]


def test_reach_adds_up():
    assert reach({"ind": "sma", "n": 5, "of": {"ind": "hh", "n": 3}, "lag": 2}) == 10
    assert reach({"cross": "up", "a": "close", "b": {"ind": "sma", "n": 5}}) == 6
    assert reach({"for": 3, "cond": {"all": [{"bar": "up"}, {"touch": "above", "level": {"ind": "sma", "n": 5}}]}}) == 9


@pytest.mark.parametrize("bits", [(14, 16, 3), (1, 2, 5), (2, 3, 3)])
def test_running_sums(spark, monkeypatch, bits):
    monkeypatch.setattr(blocks, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(blocks, "LEVEL_BITS", bits[1])
    monkeypatch.setattr(blocks, "LEVELS", bits[2])
    rng = random.Random(1)
    rows = [(k, t, None if rng.random() < 0.2 else rng.randint(-9, 9)) for k in "ab" for t in rng.sample(range(-200, 200), 150)]
    table = spark.createDataFrame(rows, "k string, t long, x int")
    for inclusive in (True, False):
        got = {(r["k"], r["t"]): (r["s"], r["n"]) for r in blocks.running_sums(table, ["k"], "t", {"s": F.col("x"), "n": F.lit(1)}, inclusive).collect()}
        for k, t, _ in rows:
            upto = [x or 0 for j, u, x in rows if j == k and (u < t or inclusive and u == t)]
            assert got[k, t] == (sum(upto), len(upto))


def test_series_measures_in_short_blocks(spark, monkeypatch):
    source = bars(spark)
    def results():
        returns = series.log_returns(source, ["instrument"], "t")
        out = [sorted((r["instrument"], r["t"], r["ret"], r["segment"]) for r in returns.collect())]
        for frame in (series.variance_ratio(returns, ["instrument"], 3), series.robust_ratio(returns, ["instrument"], 3)):
            out.append(sorted(map(tuple, frame.collect()), key=str))
        return out
    want = results()
    monkeypatch.setattr(blocks, "BLOCK_BITS", 2)
    got = results()
    assert got[0] == want[0] and len(got[0]) > 300
    for a, b in zip(got[1] + got[2], want[1] + want[2], strict=True):
        assert a == pytest.approx(b)


def partitioned(frame) -> list[str]:
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [", ".join(sorted(re.findall(r"([A-Za-z_]\w*)#", keys))) for keys in re.findall(r"Window \[.*\], \[([^\]]*)\], \[", plan)]


def test_no_window_is_keyed_by_an_instrument_alone(spark):
    for source in (bars(spark), bars(spark, True)):
        c = Compiler(source, expected=12)
        made = [c.operand(x) for x in OPERANDS] + [c.condition(x) for x in CONDITIONS]
        keys = partitioned(c.frame.select("instrument", "t", *[x.alias(f"v{i}") for i, x in enumerate(made)]))
        assert len(keys) > 10 and not {"", "instrument", "instrument, segment"} & set(keys), keys
    returns = series.log_returns(bars(spark), ["instrument"], "t")
    for frame in (returns, series.variance_ratio(returns, ["instrument"], 3), series.robust_ratio(returns, ["instrument"], 3)):
        assert not {"", "instrument"} & set(partitioned(frame))
    assert "instrument" not in partitioned(bar_queries.frame(spark, SMALL).frame)


def plain_prominence(x, i):
    out = []
    for way in (-1, 1):
        j, least = i + way, x[i]
        while 0 <= j < len(x) and x[j] <= x[i]:
            least = min(least, x[j])
            j += way
        out.append(least)
    return x[i] - max(out)


def test_prominence_against_a_plain_walk(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 200):
        for top in (2, 5, 1000):
            x = rng.integers(0, top, n).astype(float)
            assert profiles.prominences(x).tolist() == [plain_prominence(x, i) for i in range(n)]
    rows = [("a", b, float(v)) for b, v in ((-3, 5), (-2, 1), (-1, 9), (4, 2), (6, 2), (7, 8), (9, 3))]
    got = profiles.prominent_nodes(spark.createDataFrame(rows, "k string, bin long, volume double"), ["k"]).collect()
    dense = {b: 0.0 for b in range(-3, 10)} | {b: v for _, b, v in rows}
    x = [dense[b] for b in range(-3, 10)]
    want = set()
    for i in range(1, len(x) - 1):
        for name, y in (("high", x), ("low", [-v for v in x])):
            if y[i] >= y[i - 1] and y[i] >= y[i + 1] and (y[i] > y[i - 1] or y[i] > y[i + 1]) and plain_prominence(y, i) >= 0.05 * 9:
                want.add((i - 3, name, x[i], plain_prominence(y, i)))
    assert {(r["bin"], r["node"], r["volume"], r["prominence"]) for r in got} == want and len(want) > 4


def test_traversal_times(spark):
    profile = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 1.0), ("a", 4, 0.01)], "k string, bin long, volume double")
    spans = spark.createDataFrame([("a", 4, 0), ("a", 1, 3), ("a", -5, 0), ("a", 7, 9)], "k string, start long, stop long")
    got = {(r["start"], r["stop"]): r["minutes"] for r in profiles.traversal_times(profile, spans, ["k"], 2.0, 0.5).collect()}
    mean = 5.01 / 5
    time = {b: (2 / 0.5) ** 2 / min(mean / v, 16) if v else 1.0 for b, v in {0: 4.0, 1: 1.0, 2: 0, 3: 0, 4: 0.01}.items()}
    assert got == pytest.approx({(4, 0): sum(time.values()), (1, 3): time[1] + 2, (-5, 0): time[0], (7, 9): 0.0})


def test_running_sums_in_an_order_of_columns(spark, monkeypatch):
    """Sums, maxima and totals over blocks of any width as a plain loop gives them; null keys, order columns and values too."""
    rng = random.Random(8)
    rows = [(rng.choice("ab") if i % 40 else None, rng.randrange(4) if i % 9 else None, rng.randrange(60) if i % 7 else None, i, rng.randint(-9, 9) if i % 5 else None) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, day long, k1 long, k2 long, v long")
    low = lambda x: (x is not None, x or 0)
    want = {}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (low(r[1]), low(r[2]), r[3]))
        total, top = 0, None
        for i, r in enumerate(mine):
            total += r[4] or 0
            top = total if top is None else max(top, total)
            want[r[3]] = (total, i + 1, top, len(mine))
    for bits in (0, 3, 20):
        monkeypatch.setattr(blocks, "PART_BITS", bits)
        got = blocks.running_in_order(table, ["k"], ["day", "k1", "k2"], {"s": F.col("v"), "i": F.lit(1)}, {"top": "s"}, {"n": F.lit(1)})
        assert {r["k2"]: (r["s"], r["i"], r["top"], r["n"]) for r in got.collect()} == want
    for order in (["k2"], ["day", "k2"]):
        got = blocks.running_in_order(table.where("k = 'a'"), ["k"], order, {"i": F.lit(1)}).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(1, len(got) + 1)) and all(low(p[order[0]]) <= low(q[order[0]]) for p, q in zip(got, got[1:]))


def test_runs_and_lags_across_blocks(spark, monkeypatch):
    from tideframe.operators import stats

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(5), rng.randrange(50), i, rng.randint(-3, 3)) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, day long, k1 long, k2 long, v long")
    monkeypatch.setattr(blocks, "PART_BITS", 2)
    order = ["day", "k1", "k2"]
    runs = {r["k"]: (r["a"], r["b"], r["runs"]) for r in stats.runs_test(table, ["k"], order, "v").collect()}
    rho = {lag: {r["k"]: r["rho"] for r in stats.lag_correlation(table, ["k"], order, "v", lag).collect()} for lag in (1, 6)}
    for key in "ab":
        v = np.array([r[4] for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:4])])
        up = v[v != 0] > 0
        assert runs[key] == (up.sum(), (~up).sum(), 1 + (up[1:] != up[:-1]).sum())
        d = v - v.mean()
        for lag, found in rho.items():
            assert found[key] == pytest.approx((d[lag:] * d[:-lag]).sum() / (d * d).sum())


#: Reports over all trades of a setup, whose windows must not take a setup, or a setup and side, as one group.
SHEETS = ["curve_sheet", "metrics_sheet", "validation_report"]


@pytest.mark.parametrize("name", SHEETS)
def test_no_window_of_a_sheet_has_a_setup_as_one_group(spark, name):
    import tideframe.queries  # noqa: F401
    from tideframe import registry

    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    windows = [re.sub(r"#\d+L?", "", line) for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
    assert windows
    for line in windows:
        # the windows with the keys alone run along heads, one row a head, or bands of distinct values, one row a value
        assert "_head" in line or "_block" in line or "_v ASC" in line or "_s_" in line, line


def test_no_join_of_the_risk_sheet_has_a_setup_as_one_group(spark):
    """Values of a setup meet its levels in several tasks."""
    import tideframe.queries  # noqa: F401
    from tideframe import registry

    plan = registry.queries()["risk_sheet"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [re.sub(r"#\d+L?", "", line) for line in plan.split("\n") if re.search(r"\bJoin Inner", line)]
    # rows meet in salted joins; those by setup alone, or by setup and level, are of aggregates
    assert sum("_salt" in line for line in joins) >= 2, joins


@pytest.mark.parametrize("name", ["curve_sheet", "metrics_sheet"])
def test_rows_of_a_curve_are_shuffled_once(spark, name):
    """Totals of blocks and the rows that they go back to come from one shuffle of rows, which no second one follows."""
    import tideframe.queries  # noqa: F401
    from tideframe import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = re.sub(r"#\d+L?", "", registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(_at, _block," in line]
    # rows, and what comes before each block; the other side of the rows is the same shuffle again
    assert sum("ReusedExchange" not in line for line in dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1, dealt


def test_quantiles_of_few_keys_tell_apart_values_in_bands_only(spark, monkeypatch):
    from tideframe.operators import quantiles

    rng = random.Random(4)
    groups = {"one": [3.0], "ties": [7.0] * 3000 + [1.0, 9.0], "many": [rng.gauss(0, 1) for _ in range(20_000)], "few": [float(rng.randrange(5)) for _ in range(101)]}
    table = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("one", None), ("none", None)], "k string, x double")
    levels = [0.5, 0.05, 0.0, 1.0, 0.999]
    found = quantiles.exact_quantiles(table, ["k"], "x", levels, few=True)
    got = {r["k"]: (r["n"], r["quantiles"]) for r in found.collect()}
    assert got == {k: (len(v), pytest.approx(np.quantile(v, levels).tolist(), abs=1e-12)) for k, v in groups.items()}
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().optimizedPlan().toString())
    assert not any("Aggregate [k, _v]," in line for line in plan.split("\n"))
    assert quantiles.few_keys(table, ["k"]) and quantiles.few_keys(table, [])
    monkeypatch.setattr(quantiles, "MOST_KEYS", 4)
    assert not quantiles.few_keys(table, ["k"])


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_are_exact_where_bounds_differ_by_run(spark, monkeypatch, few):
    """Bounds of a sketch depend on the order in which its parts arrive; here each run of one gives wider bands of its own."""
    from tideframe.operators import quantiles

    rng = random.Random(5)
    groups = {k: [round(rng.gauss(0, 1), 4) for _ in range(4000)] for k in "abcdef"}
    table = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    sketch, wider = F.percentile_approx, F.udf(lambda ends: [x + random.SystemRandom().random() / 5 * (-1, 1)[j % 2] for j, x in enumerate(ends)], "array<double>")
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: wider(sketch(*a)))
    levels = [0.05, 0.25, 0.5, 0.95]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(table, ["k"], "x", levels, few=few).collect()}
    assert got == {k: (len(v), pytest.approx(np.quantile(v, levels).tolist(), abs=1e-12)) for k, v in groups.items()}
    every = quantiles.exact_quantiles(table, [], "x", levels).first()
    assert every["quantiles"] == pytest.approx(np.quantile([x for v in groups.values() for x in v], levels).tolist(), abs=1e-12)
