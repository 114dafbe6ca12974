"""Contacts, exact quantiles, level files, sequential plans and discrete tails against plain loops and published figures."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import discrete, horizon
from tideframe.operators import contacts as C
from tideframe.operators import sequential
from tideframe.operators.quantiles import exact_quantiles
from tideframe.sources.level_files import level_lines, parse_level_texts, read_level_files
from tideframe.sources.trade_files import read_trades

from .conftest import SMALL

G = C.Grammar(start=60, sigma=1.0, rearm=2.0, step=1.0, threshold=3.0, horizons={k: h // 5 for k, h in C.HORIZONS.items()}, watch=4)
BARS = "instrument string, session long, t long, sessmin int, o double, h double, l double, c double, v double, delta double"


def sessions(n=3, bars=140):
    rng, out = random.Random(9), []
    for s in range(n):
        c = 100.0
        for i in range(bars):
            o = c
            c = o + rng.choice([-1, -0.5, 0, 0.5, 1])
            h, low = max(o, c) + rng.choice([0, 0.5, 2]), min(o, c) - rng.choice([0, 0.5, 2])
            v = float(rng.randint(1, 20))
            out.append(("x", s, 1000 * s + i, i, o, h, low, c, v, float(rng.randint(-int(v), int(v)))))
    return out


def plain_levels(rows, i):
    """Levels of each kind at bar i of one session."""
    early = rows[: G.start]
    bins = {}
    for r in early:
        bins[math.floor(r[7] + 0.5)] = bins.get(math.floor(r[7] + 0.5), 0) + 1
    lo, hi = min(bins), max(bins)
    x = [bins.get(b, 0) for b in range(lo, hi + 1)]
    poc = x.index(max(x))
    a = b = poc
    held = x[poc]
    while held < 0.7 * sum(x) and (a > 0 or b < len(x) - 1):
        up, down = x[b + 1] if b < len(x) - 1 else -1, x[a - 1] if a > 0 else -1
        if up >= down:
            b, held = b + 1, held + up
        else:
            a, held = a - 1, held + down
    out = [("control", float(lo + poc)), ("value", lo + a - 0.5), ("value", lo + b + 0.5)]
    for k in range(1, len(x) - 1):
        if x[k] <= x[k - 1] and x[k] <= x[k + 1] and (x[k] < x[k - 1] or x[k] < x[k + 1]):
            sides = []
            for way in (-1, 1):
                j, most = k + way, x[k]
                while 0 <= j < len(x) and x[j] >= x[k]:
                    most, j = max(most, x[j]), j + way
                sides.append(most)
            if min(sides) - x[k] >= 0.05 * max(x):
                out.append(("low_node", float(lo + k)))
    w = sum(r[8] for r in rows[: i + 1])
    p = [(r[5] + r[6] + r[7]) / 3 for r in rows[: i + 1]]
    m = sum(q * r[8] for q, r in zip(p, rows, strict=False)) / w
    s = math.sqrt(max(0.0, sum(q * q * r[8] for q, r in zip(p, rows, strict=False)) / w - m * m))
    out += [("band", m - 2 * s), ("band", m + 2 * s)] if s > 0 else []
    swings, way, hi_p, lo_p = [], 0, rows[0][7], rows[0][7]
    for r in rows[: i + 1]:
        c = r[7]
        if way >= 0:
            hi_p = max(hi_p, c)
        if way <= 0:
            lo_p = min(lo_p, c)
        if way >= 0 and hi_p - c >= G.threshold:
            swings.append(hi_p)
            way, lo_p = -1, c
        elif way <= 0 and c - lo_p >= G.threshold:
            swings.append(lo_p)
            way, hi_p = 1, c
    out += [("pivot", q) for q in swings[-3:]]
    if len(swings) > 1:
        leg = swings[-1] - swings[-2]
        out += [("retrace", swings[-1] - 0.618 * leg), ("retrace", swings[-1] - 0.79 * leg)]
    return set(out)


def plain_contacts(rows):
    out = []
    early = rows[: G.start]
    median = statistics.median(r[8] for r in early)
    impact = math.sqrt(statistics.fmean((r[7] - r[4]) ** 2 / r[8] for r in early))
    away = {}
    for i in range(G.start, len(rows) - 1):
        _, s, t, _, o, h, low, c, v, delta = rows[i]
        for kind, level in plain_levels(rows, i):
            key = (kind, round(level, 9))
            if not low <= level <= h:
                if abs(c - level) >= G.rearm:
                    away[key] = True
                continue
            if not away.get(key, True):
                continue
            away[key] = False
            side = 1 if rows[i - 1][7] < level else -1
            past = side * (c - level)
            wick = ((h - max(o, c)) if side > 0 else (min(o, c) - low)) / (h - low) if h > low else 0.0
            after = [side * (r[7] - level) for r in rows[i + 1 : i + 1 + G.watch]]
            held = {
                "absorbed": v >= 1.5 * median and abs(c - o) / (impact * math.sqrt(v)) <= 0.25 and past <= 0,
                "rejected": wick >= 0.6 and past <= 0,
                "passed": past >= G.sigma and side * delta / v >= 1 / 3,
            }
            lost = {"absorbed": max(after) >= G.sigma, "rejected": max(after) >= G.sigma, "passed": min(after) <= 0}
            end = min(i + G.horizons[kind], len(rows) - 1)
            seen = [side * (x - c) for r in rows[i + 1 : end + 1] for x in (r[5], r[6])]
            out.append((s, t, kind, round(level, 9), side, tuple(k for k in held if held[k]), tuple(k for k in held if held[k] and lost[k]), side * (rows[end][7] - c), max(seen), min(seen)))
    return out


def test_contacts_and_measures(spark):
    rows = sessions()
    table = spark.createDataFrame(rows, BARS)
    found = C.contacts(table, C.level_kinds(table, G), G)
    got = {(r["session"], r["t"], r["kind"], round(r["price"], 9), r["side"], tuple(r["confirmed"]), tuple(r["refuted"]), r["follow"], r["best"], r["worst"]) for r in found.collect()}
    want = [c for s in range(3) for c in plain_contacts([r for r in rows if r[1] == s])]
    assert {c[2] for c in want} == set(C.HORIZONS) and any(c[6] for c in want)
    near = lambda rows: {(*r[:7], *(round(x, 6) for x in r[7:])) for r in rows}
    assert near(got) == near(want)

    measures = {(r["kind"], r["confirmation"]): r for r in C.setup_measures(found, 3, G).collect()}
    for kind, confirmation in C.SETUPS:
        mine = sorted((c for c in want if c[2] == kind), key=lambda c: (c[0], c[1], c[3]))
        way, far = C.EXPECTED[confirmation], G.horizons[kind]

        def free(rows, far=far):
            out, day, least = [], None, 0
            for c in rows:
                if c[0] != day:
                    day, least = c[0], -1
                if c[1] >= least:
                    out.append(c)
                    least = c[1] + far
            return out

        held = [c for c in mine if confirmation in c[5]]
        r = measures[kind, confirmation]
        assert (r["contacts"], r["held"], r["free_held"]) == (len(mine), len(held), len(free(held)))
        assert r["p_any"] == pytest.approx(statistics.fmean(way * c[7] > 0 for c in free(mine)))
        if held:
            assert r["lost_share"] == pytest.approx(sum(confirmation in c[6] for c in held) / len(held))
            assert r["p_held"] == pytest.approx(statistics.fmean(way * c[7] > 0 for c in free(held)))
            assert r["gain"] == pytest.approx(statistics.median(c[8] if way > 0 else -c[9] for c in free(held)))
            assert r["pain"] == pytest.approx(statistics.median(c[9] if way > 0 else -c[8] for c in free(held)))


def test_exact_quantiles(spark):
    rng = random.Random(2)
    groups = {"one": [3.0], "two": [1.0, 5.0], "ties": [7.0] * 5000 + [1.0, 9.0], "many": [rng.gauss(0, 1) for _ in range(30_000)], "few": [float(rng.randrange(5)) for _ in range(101)]}
    table = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("one", None), ("none", None)], "k string, x double")
    levels = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in exact_quantiles(table, ["k"], "x", levels).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k] == (len(v), pytest.approx(np.quantile(v, levels).tolist(), abs=1e-12))
    every = exact_quantiles(table, [], "x", [0.3]).first()
    assert every["quantiles"] == pytest.approx([np.quantile([x for v in groups.values() for x in v], 0.3)])


PASTE = """﻿Gamma wall : 21,450.25
21 300,5 = put support
**HVL** | 21400

# Context
horizon: 0 dte
99 : is no level here
# other words
21500 : not read
## Levels
- Call resistance: 21600
call resistance : 21600.1
call resistance : 21650
my own - words = 21350
21410
21420
rm: 21333
far : 2
nothing here
# Data
Strike,calls,Net gex
21700,9,-5
21700,9,6
21800,9,8
21600,9,50
21200,9,1
21100,9,2
21000,9,1
x,y,z
"""


def test_level_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PASTE.replace("\n", "\r\n"), encoding="utf-8")
    (tmp_path / "b.txt").write_text("mp : 5\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("", encoding="utf-8")
    texts = read_level_files(spark, str(tmp_path))
    lines = level_lines(texts).where("file like '%a.txt'").orderBy("line").collect()
    assert [(r["line"], r["why"]) for r in lines if r["why"]] == [(18, "outside"), (19, "no number")]
    got = parse_level_texts(texts, price=21450.0).collect()
    named = {r["name"]: (r["price"], r["line"]) for r in got if r["file"].endswith("a.txt")}
    assert named == {
        "0GW": (21450.25, 1), "0PS": (21300.5, 2), "0HVL": (21400.0, 3), "0CR": (21600.0, 11), "0CR2": (21650.0, 13), "0MY OWN   WORDS".replace("   ", " "): (21350.0, 14), "N1": (21410.0, 15), "N2": (21420.0, 16), "RM": (21333.0, 17),
        "0R1": (21700.0, 22), "0R2": (21800.0, 24), "0S1": (21100.0, 27), "0S2": (21200.0, 26),
    }
    assert [(r["name"], r["price"]) for r in got if r["file"].endswith("b.txt")] == [("MP", 5.0)]


def test_bought_and_sold_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("symbol;qty;buyPrice;sellPrice;boughtTimestamp;soldTimestamp;status\nMNQZ4;2;21.450,25;21.460,5;2024-11-05 15:30:00;2024-11-05 15:29:00;filled\nMNQZ4;1;1,5;2;2024-11-05 15:30:00;2024-11-05 15:31:00;cancelled\n")
    got = [(r["side"], r["qty"], r["price"], str(r["ts"])) for r in read_trades(spark, str(tmp_path / "t.csv"), sep=";").orderBy("ts").collect()]
    assert got == [("S", 2.0, 21460.5, "2024-11-05 15:29:00"), ("B", 2.0, 21450.25, "2024-11-05 15:30:00")]


def test_published_sequential_bounds(spark):
    plan = sequential.solve([0.2, 0.4, 0.6, 0.8, 1.0], 0.025, 0.9)
    assert plan.null.efficacy == pytest.approx([4.877, 3.357, 2.680, 2.290, 2.031], abs=6e-4)
    assert plan.power == pytest.approx(0.9, abs=1e-9) and 1 < plan.inflation < 1.2
    assert sum(sequential.run(plan.fractions, 0.0, efficacy=plan.null.efficacy).above) == pytest.approx(0.025, abs=1e-6)
    rng = np.random.default_rng(4)
    t = np.array([0.15, 0.5, 0.62, 1.0])
    plan = sequential.solve(t.tolist(), 0.05, 0.8)
    walks = np.cumsum(rng.normal(size=(200_000, 4)) * np.sqrt(np.diff(t, prepend=0)), axis=1)
    for drift, looks in ((0.0, plan.null), ((1.6448536 + 0.8416212) * math.sqrt(plan.inflation), plan.moved)):
        z, going = (walks + drift * t) / np.sqrt(t), np.ones(len(walks), bool)
        for k in range(4):
            above, below = going & (z[:, k] >= looks.efficacy[k]), going & (z[:, k] <= plan.moved.futility[k])
            assert above.mean() == pytest.approx(looks.above[k], abs=0.004)
            if k < 3:
                assert below.mean() == pytest.approx(looks.below[k], abs=0.004)
            going &= ~above & ~below
    rows = spark.createDataFrame([("a", [0.5, 1.0]), ("b", None), ("c", [])], "k string, fractions array<double>")
    got = sequential.boundaries(rows, ["k"]).orderBy("look").collect()
    assert [(r["k"], r["look"]) for r in got] == [("a", 1), ("a", 2)] and got[0]["efficacy"] == pytest.approx(2.9626, abs=1e-3)


def test_information_by_days(spark):
    days = [0, 0, 1, 9, 9, 9, 4]
    table = spark.createDataFrame([("a", d) for d in days] + [("b", 3)], "k string, day long")
    got = {r["k"]: r["fractions"] for r in sequential.information(table, ["k"], "day", 5).collect()}
    assert got["a"] == pytest.approx([3 / 7, 4 / 7, 1.0]) and got["b"] == [1.0]


def test_discrete_tails(spark):
    xs = [0.5, 1.0, 1.5, 3.0, 7.9, 8.0, 50.0, 1e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(discrete.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-12)

    def plain(high, low, ratio, least, clump):
        n, m = round(high / clump), round(low / clump)
        return sum(math.comb(n, a) / 2**n * sum(math.comb(m, b) / 2**m for b in range(min(m, math.floor(a / ratio)) + 1)) for a in range(n + 1) if a >= least / clump and a >= ratio)

    rows = [(float(a), float(b)) for a in (0, 1, 4, 9, 30, 200) for b in (0, 1, 7, 60)]
    table = spark.createDataFrame(rows, "a double, b double")
    for ratio, least, clump in ((3.0, 10.0, 1.0), (2.5, 0.0, 2.0), (1.0, 4.0, 1.0)):
        got = [r[0] for r in table.select(discrete.imbalance_chance(F.col("a"), F.col("b"), ratio, least, clump)).collect()]
        assert got == pytest.approx([plain(a, b, ratio, least, clump) if round(a / clump) else 0.0 for a, b in rows], abs=1e-12)


def test_chances_of_large_volumes(spark):
    """A level of very much volume takes as many terms as its root: equal levels are on either side with a half, a few points
    less than half of the neighbour's with a normal law's chance."""
    from statistics import NormalDist

    rows = [(4e9, 4e9), (1e6, 1e6 + 2000), (4e9, None), (None, 9.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(discrete.imbalance_chance(F.col("a"), F.col("b"), 1.0, 10.0, 1.0)).collect()]
    assert got[0] == pytest.approx(0.5 + 0.5 / math.sqrt(math.pi * 4e9), abs=1e-9)
    assert got[1] == pytest.approx(NormalDist(1000 - 0.5, math.sqrt((2e6 + 2000) / 4)).cdf(0), abs=1e-6)
    assert got[2:] == [0.0, 0.0]


def test_horizon_series_meet(spark):
    """Both series where either does, the far tail, and what a drift and a deadline without end give."""
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, (rng.uniform(0.5, 4), rng.uniform(0.5, 4), 10 ** rng.uniform(-0.5, 2), rng.normal() * 0.3, 1.0))) for _ in range(60)]
    table = spark.createDataFrame(rows, "a double, b double, t double, m double, s double")
    a, b, t, m, s = (F.col(x) for x in "abtms")
    got = table.select(horizon.barrier_chances(a, b, t, m, s).alias("p"), horizon.survival(a, b, t, s).alias("open"), horizon.exit_time(a, b, t, s).alias("time"), horizon.target_first(a, b, m, s).alias("ever"), horizon.barrier_chances(a, b, F.lit(1e6), m, s)["target"].alias("late")).collect()
    n = np.arange(1, 3000)
    for (A, B, T, M, _), r in zip(rows, got, strict=True):
        w = A + B
        rate = (n * np.pi / w) ** 2 / 2
        ever = A / w if M == 0 else (1 - math.exp(-2 * M * A)) / (1 - math.exp(-2 * M * w))
        up = ever - np.pi / w**2 * np.sum(n * np.sin(n * np.pi * B / w) * np.exp(M * B - (rate + M * M / 2) * T) / (rate + M * M / 2))
        odd = n % 2 == 1
        wave = 4 / (n * np.pi) * np.sin(n * np.pi * A / w) * odd
        assert r["p"]["target"] == pytest.approx(up, abs=1e-9) and r["ever"] == pytest.approx(ever) and r["late"] == pytest.approx(ever, abs=1e-9)
        assert r["open"] == pytest.approx(np.sum(wave * np.exp(-rate * T)), abs=1e-9)
        assert r["time"] == pytest.approx(A * B - np.sum(wave * np.exp(-rate * T) / rate), abs=1e-8)
    tails = [-3.0, 0.0, 0.5, 2.99, 3.0, 8.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in tails], "z double").select(horizon.upper_tail(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in tails], rel=1e-11)
    none = spark.range(1).select(horizon.barrier_chances(F.lit(-1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("p"), horizon.neutral_drift(F.lit(1.0), F.lit(2.0), F.lit(0.5), F.lit(1.0)).alias("d")).first()
    assert none["p"] is None and none["d"] == pytest.approx(0.0, abs=1e-9)


#: Queries whose series are long for each part.
DEALT = ["horizon_scaled", "double_barrier", "horizon_outcome"]


@pytest.mark.parametrize("name", DEALT)
def test_parts_are_dealt_and_series_run_in_batches(spark, name):
    """One small file of parts gives as many tasks as a shuffle, and no series is walked term by term in an expression."""
    import tideframe.queries  # noqa: F401
    from tideframe import registry

    found = registry.queries()[name](spark, SMALL)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_scaled_time_is_an_integral_of_survival(spark):
    rows = [(1.0, 2.0, 40.0, 1.0, 0.45), (3.0, 1.5, 0.7, 0.8, 0.3), (9.0, 13.0, 2.0, 1.0, 0.65)]
    table = spark.createDataFrame(rows, "a double, b double, t double, s double, h double")
    a, b, t, s, h = (F.col(x) for x in "abtsh")
    made = table.select("*", horizon.scaled_outcome(a, b, t, s, h)["time"].alias("time")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(128))))
    weight = F.when(F.col("i").isin(0, 128), 1.0).when(F.col("i") % 2 == 1, 4.0).otherwise(2.0)
    part = F.when(F.col("i") == 0, 1.0).otherwise(horizon.survival(a, b, F.pow(F.col("i") * t / 128, 2 * h), s))
    for r in made.groupBy("t", "time").agg((F.sum(weight * part) * F.col("t") / 384).alias("plain")).collect():
        assert r["time"] == pytest.approx(r["plain"], rel=1e-12)
    odd = table.limit(1).select(horizon.scaled_outcome(a, b, t, s, F.lit(1.0))["time"].alias("x"), horizon.survival(a, F.lit(None).cast("double"), t, s).alias("y"), horizon.exit_time(a, b, F.lit(0.0), s).alias("z")).first()
    assert tuple(odd) == (None, None, None)


def test_zero_gamma_by_halving(spark):
    from tideframe.operators import profiles as P

    rng = random.Random(5)
    lines = [("a", 100.0, 70.0 + 2 * i, rng.uniform(0.1, 0.4), 0.2, kind, rng.uniform(1, 9) * (3 if (kind == "put") == (i < 15) else 1)) for i in range(30) for kind in ("call", "put")]
    lines += [("b", 100.0, 100.0, 0.2, 0.2, "call", 1.0)]
    table = spark.createDataFrame(lines, "k string, spot double, strike double, iv double, time double, kind string, open_interest double")
    got = {r["k"]: r["zero_gamma"] for r in P.zero_gamma_exact(table, ["k"]).collect()}

    def net(s):
        def gamma(strike, iv, time):
            d = (math.log(s / strike) + iv * iv * time / 2) / (iv * math.sqrt(time))
            return math.exp(-d * d / 2) / math.sqrt(2 * math.pi) / (s * iv * math.sqrt(time))

        return sum((1 if kind == "call" else -1) * gamma(strike, iv, time) * oi for k, _, strike, iv, time, kind, oi in lines if k == "a")

    assert got["b"] is None
    assert net(got["a"] - 1e-6) * net(got["a"] + 1e-6) < 0
    assert not any(net(80 + 40 * (k - 1) / 40) * net(80 + 40 * k / 40) < 0 for k in range(1, 41) if 80 + k < got["a"])
    pins = P.pin_strength(table, ["k"], there=False).where("k = 'a'").collect()
    assert sum(r["pin"] for r in pins) == pytest.approx(1) and len(pins) == 30


def test_corrected_exponent(spark):
    from tideframe.operators import reports as R

    rows = [("a", q, q**0.2 * 1.1) for q in (2, 4, 8)]
    nulls = [("a", q, 1.1) for q in (2, 4, 8)]
    make = lambda x: spark.createDataFrame(x, "instrument string, q int, vr double")
    got = R.corrected_exponent(make(rows), make(nulls), ["instrument"]).first()
    assert (got["exponent"], got["fit"], got["points"]) == (pytest.approx(0.6), pytest.approx(1.0), 4)


def test_value_area_by_pairs(spark):
    from tideframe.operators import profiles as P

    rng, rows = random.Random(3), []
    for k in range(12):
        rows += [(k, level, rng.randrange(1, 6)) for level in sorted(rng.sample(range(40), rng.randrange(1, 30)))]
    got = {r["k"]: (r["poc"], r["low"], r["high"]) for r in P.paired_value_area(spark.createDataFrame(rows, "k int, level long, periods long"), ["k"]).collect()}
    for k in range(12):
        p = [r[1] for r in rows if r[0] == k]
        c = [r[2] for r in rows if r[0] == k]
        i = min((j for j in range(len(p)) if c[j] == max(c)), key=lambda j: (abs(p[j] - (p[0] + p[-1]) / 2), j))
        a = b = i
        while sum(c[a : b + 1]) < 0.7 * sum(c) and (a > 0 or b < len(p) - 1):
            down = c[a - 1] + (c[a - 2] if a > 1 else 0) if a > 0 else -1
            up = c[b + 1] + (c[b + 2] if b < len(p) - 2 else 0) if b < len(p) - 1 else -1
            if up >= down:
                b = min(b + 2, len(p) - 1)
            else:
                a = max(a - 2, 0)
        assert got[k] == (p[i], p[a], p[b])
