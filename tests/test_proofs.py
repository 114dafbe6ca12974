"""Queries without a SQL twin against plain loops over the same rows."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tideframe.queries  # noqa: F401
from tideframe import registry
from tideframe.operators import bars as B
from tideframe.operators import execution as E
from tideframe.operators import inputs as I
from tideframe.operators import measures as M
from tideframe.operators import resampling as R
from tideframe.operators import search as S
from tideframe.operators import series as X
from tideframe.queries import engine_queries as Q
from tideframe.queries import profile_queries as P

from .conftest import SMALL


#: The replay needs more sessions than the smallest tables have.
ENGINE = "/root/testdata/sf0.01"


def run(spark, name, folder=SMALL):
    return registry.queries()[name](spark, folder)


def sessions_of(frame):
    return {k: g.sort_values("t").reset_index(drop=True) for k, g in frame.toPandas().groupby(["instrument", "session"])}


# the replay


def to_grid(x, tick, up):
    return (math.ceil(x / tick - 1e-9) if up else math.floor(x / tick + 1e-9)) * tick


def plain_replay(g, s, long=None, short=None):
    """Market entries, fixed stop in points, target in risks, one position at a time: bar after bar."""
    rows = g.to_dict("records")
    long = g["long"].fillna(False).tolist() if long is None else long
    short = g["short"].fillna(False).tolist() if short is None else short
    out, bar = [], 0
    while bar < len(rows):
        if long[bar] == short[bar] or rows[bar]["status"] != 0:
            bar += 1
            continue
        w = 1 if long[bar] else -1
        first = bar + 1
        entry = rows[first]["o"] + w * s.slip * s.tick
        stop = to_grid(entry - w * s.stop_x, s.tick, w < 0)
        risk = w * (entry - stop)
        target = to_grid(entry + w * s.target_x * risk, s.tick, w > 0)
        for k in range(first, len(rows)):
            x = rows[k]
            low, high = (x["l"], x["h"]) if w > 0 else (-x["h"], -x["l"])
            opened = w * x["o"]
            if opened <= w * stop:
                price, why = x["o"], "stop"
            elif k > first and opened >= w * target:
                price, why = x["o"], "target"
            elif low <= w * stop and (s.fill != "optimistic" or high < w * target + s.through * s.tick):
                price, why = stop, "stop"
            elif high >= w * target + s.through * s.tick:
                price, why = target, "target"
            elif k == len(rows) - 1:
                price, why = x["c"], "end"
            else:
                continue
            break
        left = price - (0 if why == "target" else w * s.slip * s.tick)
        pnl = w * (left - entry) * s.point_value - s.commission
        out.append((int(rows[bar]["t"]), int(x["t"]), w, round(left, 6), why, round(pnl, 6), round(pnl / (risk * s.point_value), 6)))
        bar = max(k, bar + 1)
    return out


def test_run_against_a_plain_walk(spark):
    groups = sessions_of(Q.frame(spark, ENGINE))
    want = sorted((*key, *x) for key, g in groups.items() for x in plain_replay(g, Q.BASE))
    got = sorted((r["instrument"], r["session"], r["i"], r["exit_t"], 1 if r["side"] == "long" else -1, r["exit"], r["reason"], r["pnl"], r["r"]) for r in run(spark, "execute_run", ENGINE).collect())
    assert len(want) > 40 and got == want


def summary(trades):
    n = len(trades)
    return n, sum(x[-1] for x in trades) / n if n else None


def test_envelope_and_stress_against_a_plain_walk(spark):
    groups = sessions_of(Q.frame(spark, ENGINE))
    for name, settings in (("envelope", [Q.BASE, replace(Q.BASE, fill="optimistic")]), ("stress_grid", E.stress_grid(Q.BASE))):
        got = {r["config"]: (r["n"], r["mean_r"]) for r in run(spark, name, ENGINE).collect()}
        assert sorted(got) == list(range(len(settings)))
        for k, s in enumerate(settings):
            n, mean = summary([x for g in groups.values() for x in plain_replay(g, s)])
            assert got[k][0] == n and got[k][1] == pytest.approx(mean, abs=1e-5)


def test_sweep_against_one_compilation_a_setting(spark):
    want = {}
    for k, value in enumerate([-0.5, -1.0, -1.5, -2.0]):
        for key, g in sessions_of(E.features(Q.compiler(spark, ENGINE), Q.DOCUMENT, {"k": value})).items():
            trades = plain_replay(g, Q.BASE)
            want[k, *key] = (len(trades), round(sum(x[-1] for x in trades), 4))
    got = {(r["config"], r["instrument"], r["session"]): (r["n"], round(r["sum_r"], 4)) for r in run(spark, "sweep_matrix", ENGINE).collect()}
    assert set(got) == set(want) and sum(n for n, _ in want.values()) > 100
    assert all(got[k] == pytest.approx(want[k], abs=2e-4) for k in want)


def test_walk_forward_of_a_sweep(spark):
    """The path from a sweep's records to windows: each choice is the best of its own training sessions."""
    c = Q.compiler(spark, ENGINE)
    trades, points = S.sweep(c, Q.DOCUMENT, {"k": [-0.5, -1.0, -2.0]}, Q.BASE)
    records = E.session_records(trades, c.frame, len(points)).groupBy("config", "session").agg(F.sum("n").alias("n"), F.sum("sum_r").alias("sum_r"))
    first = records.agg(F.min("session")).first()[0]
    matrix = records.select("config", (F.col("session") - first).alias("s"), "n", "sum_r")
    rows = matrix.toPandas()
    got = S.walk_forward(matrix, 12, 6, False, int(rows.s.max())).collect()
    assert got
    for r in got:
        inside = rows[(rows.s >= r["w"] * 6) & (rows.s < r["w"] * 6 + 12)].groupby("config")[["n", "sum_r"]].sum()
        means = (inside.sum_r / inside.n)[inside.n > 0]
        assert r["is_mean"] == pytest.approx(means.max()) and means[r["config"]] == pytest.approx(means.max())


def test_random_null_against_a_plain_walk(spark):
    groups = sessions_of(Q.frame(spark, ENGINE))
    got = {r["draw"]: (r["n"], r["mean_r"]) for r in run(spark, "random_null", ENGINE).collect()}
    for draw in (-1, 0, 7, 19):
        trades = []
        for g in groups.values():
            bars = E.session_arrays(g)
            if not (bars["long"] | bars["short"]).any():
                continue
            long, short = (bars["long"], bars["short"]) if draw < 0 else R.drawn_entries(bars, draw, 1)
            if draw >= 0:  # as many of each side, on bars of their own that can be executed
                assert long.sum() <= bars["long"].sum() and short.sum() <= bars["short"].sum()
                assert not (long & short).any() and not (bars["status"][long | short] != 0).any()
            trades += plain_replay(g, Q.BASE, long.tolist(), short.tolist())
        n, mean = summary(trades)
        assert got[draw][0] == n and got[draw][1] == pytest.approx(mean, abs=1e-5)
    p = run(spark, "random_p_value", ENGINE).first()
    assert p["p"] == pytest.approx((1 + sum(got[d][1] >= got[-1][1] for d in range(20))) / 21, abs=1e-6)


def test_permuted_bars_keep_the_day(spark):
    bars = I.bars(spark, ENGINE)
    real = sessions_of(bars)
    for (name, session), g in sessions_of(R.permuted_bars(bars, 3, 4)).items():
        whole = real[name.split("#")[0], session]
        assert g["t"].tolist() == whole["t"].tolist() and g["c"].iloc[-1] == pytest.approx(whole["c"].iloc[-1])
        moves = lambda x: sorted(zip(x["sessmin"] // 4, (x["c"] - x["o"]).round(6), (x["h"] - x["o"]).round(6), (x["o"] - x["l"]).round(6), x["v"], strict=True))
        assert np.array(moves(g)) == pytest.approx(np.array(moves(whole)), abs=2e-6)
    shuffled = R.permuted_bars(bars, 10, 4)
    want = defaultdict(list)
    for (name, _), g in sessions_of(E.features(Q.Compiler(shuffled, anchor=Q.ANCHOR), Q.DOCUMENT)).items():
        want[int(name.split("#")[1])] += plain_replay(g, Q.BASE)
    got = {r["draw"]: (r["n"], r["mean_r"]) for r in run(spark, "permute_null", ENGINE).collect()}
    assert len(got) == 10
    for draw, (n, mean) in got.items():
        assert (n, mean) == (len(want[draw]), pytest.approx(summary(want[draw])[1], abs=1e-5))


def test_refusals_add_up(spark):
    """Every signal is a trade, or inside one, or refused for one reason."""
    groups = sessions_of(Q.frame(spark, ENGINE))
    got = defaultdict(dict)
    for r in run(spark, "refusals", ENGINE).collect():
        got[r["config"]][r["reason"]] = r["n"]
    both = sum(int((g["long"].fillna(False) & g["short"].fillna(False)).sum()) for g in groups.values())
    assert got[0].get("ambiguous", 0) <= both and "limit" not in got[0] and got[1]["limit"] > 0


def test_a_found_exit_is_the_first_one():
    """The jump to the first bar that matters gives what a step by step replay gives."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = 40
        c = 100 + np.cumsum(rng.normal(0, 1, n))
        o = np.concatenate([[100], c[:-1]]) + rng.normal(0, 0.3, n)
        bars = {"t": np.arange(n), "sessmin": np.arange(n), "o": o, "h": np.maximum(o, c) + rng.random(n), "l": np.minimum(o, c) - rng.random(n), "c": c, "long": rng.random(n) < 0.2, "short": rng.random(n) < 0.2, "status": np.r_[np.zeros(n - 1, int), 1], "atr": np.ones(n), "level": np.full(n, np.nan), "goal": np.full(n, np.nan)}
        s = E.Settings(stop_x=rng.choice([1.0, 3.0]), target_x=rng.choice([1.0, 2.0]), opposite=bool(rng.integers(2)), max_bars=int(rng.choice([5, 1 << 30])), flat=int(rng.choice([30, 1 << 30])), through=float(rng.integers(2)), entry=str(rng.choice(["market", "limit", "stop"])), entry_offset=0.5, valid=3)
        # a trail too wide to matter takes the slow path
        fast, slow = E.replay(bars, s), E.replay(bars, replace(s, trail=1e9))
        assert fast[1] == slow[1] and len(fast[0]) == len(slow[0])
        for a, b in zip(fast[0], slow[0], strict=True):
            assert {k: v for k, v in a.items() if not isinstance(v, float)} == {k: v for k, v in b.items() if not isinstance(v, float)}
            assert [a[k] for k in ("exit", "pnl", "mae", "mfe")] == pytest.approx([b[k] for k in ("exit", "pnl", "mae", "mfe")])


def test_bootstrap_against_index_loops(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=40)]
    for r in R.stationary_bootstrap(spark, values, 12, 5.0, seed=3).collect():
        rng = np.random.default_rng([3, r["draw"]])
        jump, start = rng.random(40) < 1 / 5, None
        start = rng.integers(0, 40, 40)
        at, path = None, []
        for i in range(40):
            at = int(start[i]) if i == 0 or jump[i] else (at + 1) % 40
            path.append((path[-1] if path else 0.0) + values[at])
        peak = worst = 0.0
        for p in path:
            peak = max(peak, p)
            worst = max(worst, peak - p)
        assert (r["mean"], r["total"], r["drawdown"]) == pytest.approx((path[-1] / 40, path[-1], worst))
    fan = R.fan(R.stationary_bootstrap(spark, values, 200, 5.0)).first()
    assert fan["mean"][0] < np.mean(values) < fan["mean"][2]
    days = run(spark, "stationary_bootstrap")
    assert days.count() == 200


def test_break_even_slip(spark):
    rows = spark.createDataFrame([(float(s), 0.3 - 0.1 * s) for s in range(5)], "slip double, mean_r double")
    assert S.break_even_slip(rows).first()["break_even"] == pytest.approx(3.0)
    sheet = spark.createDataFrame([(120, 0.1, 0.97, 0.9, None, 0.2)], "n long, mean_r double, psr double, dsr double, pbo double, os_mean double")
    assert {r["item"]: r["state"] for r in S.verdict(sheet).collect()} == {"trades": "passed", "edge": "passed", "psr": "passed", "dsr": "failed", "pbo": "missing", "out_of_sample": "passed"}


# paths along sessions


def test_zigzag_against_a_plain_loop(spark):
    want = []
    for (name, session), g in sessions_of(I.bars(spark, SMALL)).items():
        x, pivot, way = g["c"].tolist(), 0, 0
        low = high = 0
        for i in range(len(x)):
            if way == 0:
                high, low = (i if x[i] > x[high] else high), (i if x[i] < x[low] else low)
                if x[high] - x[i] >= 20:
                    want.append((name, session, g["t"][high], x[high], True))
                    way, pivot = -1, i
                elif x[i] - x[low] >= 20:
                    want.append((name, session, g["t"][low], x[low], False))
                    way, pivot = 1, i
            elif way * (x[i] - x[pivot]) > 0:
                pivot = i
            elif way * (x[pivot] - x[i]) >= 20:
                want.append((name, session, g["t"][pivot], x[pivot], way > 0))
                way, pivot = -way, i
    got = sorted(tuple(r) for r in run(spark, "zigzag_swings").select("instrument", "session", "t", "price", "is_high").collect())
    assert len(want) > 50 and got == sorted(want)


def test_value_area_against_a_plain_loop(spark):
    profiles = defaultdict(dict)
    for r in P.profile(spark, SMALL).collect():
        profiles[r["instrument"], r["session"]][r["bin"]] = r["volume"]
    got = {(r["instrument"], r["session"]): (r["poc"], r["low"], r["high"], r["held"]) for r in run(spark, "value_area").collect()}
    assert set(got) == set(profiles)
    for key, held in profiles.items():
        poc = min(held, key=lambda b: (-held[b], b))
        bins, total = {poc}, sum(held.values())
        while sum(held.get(b, 0) for b in bins) < 0.7 * total and bins != set(range(min(held), max(held) + 1)):
            up, down = max(bins) + 1, min(bins) - 1
            if down < min(held) or (up <= max(held) and held.get(up, 0) >= held.get(down, 0)):
                bins.add(up)
            else:
                bins.add(down)
        assert got[key] == (poc, min(bins), max(bins), pytest.approx(sum(held.get(b, 0) for b in bins)))


def test_zero_gamma_is_where_the_sum_changes_sign(spark):
    chains = {k: g for k, g in P.chain(spark, SMALL).toPandas().groupby("root")}

    def net(g, s):
        d = (np.log(s / g["strike"]) + g["iv"] ** 2 * g["time"] / 2) / (g["iv"] * np.sqrt(g["time"]))
        gamma = np.exp(-d * d / 2) / math.sqrt(2 * math.pi) / (s * g["iv"] * np.sqrt(g["time"]))
        return (np.where(g["kind"] == "call", 1, -1) * gamma * g["open_interest"] * s * s).sum()

    got = {r["root"]: r["zero_gamma"] for r in run(spark, "zero_gamma").collect()}
    for root, g in chains.items():
        spots = [1500 * (0.8 + 0.4 * k / 40) for k in range(41)]
        nets = [net(g, s) for s in spots]
        changes = [k for k in range(1, 41) if nets[k - 1] * nets[k] < 0]
        assert (root in got) == bool(changes)
        if changes:
            k = changes[0]
            assert spots[k - 1] <= got[root] <= spots[k] and abs(net(g, got[root])) < max(abs(nets[k - 1]), abs(nets[k]))


def test_implied_volatility_round_trip(spark):
    rows = run(spark, "implied_volatility").collect()
    found = [r for r in rows if r["implied"] is not None]
    assert len(found) == len(rows) > 300
    assert all(abs(r["implied"] - r["sigma"]) <= 1e-4 for r in found)


def test_spectrum_against_numpy(spark):
    vectors = np.array([r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("embedding").collect()], float)
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(vectors.T)))[::-1]
    got = [r["eigenvalue"] for r in run(spark, "correlation_spectrum").orderBy("rank").collect()]
    assert got == pytest.approx(want.tolist())
    odd = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([3.0, 0.0],)], "x array<double>")
    assert [r["eigenvalue"] for r in X.correlation_spectrum(odd, "x").orderBy("rank").collect()] == pytest.approx([2.0, 0.0], abs=1e-9)
    assert X.correlation_spectrum(odd.limit(0), "x").count() == 0


def test_hidden_states_find_two_regimes(spark):
    rng = np.random.default_rng(2)
    state, rows = 0, []
    for t in range(600):
        state = state if rng.random() < 0.95 else 1 - state
        rows.append(("a", t, float(rng.normal((-2, 3)[state], (0.5, 1.0)[state]))))
    frame = spark.createDataFrame(rows, "k string, t long, x double")
    fits = [X.hidden_states(frame, ["k"], "t", "x", rounds=n).orderBy("state").collect() for n in (1, 5, 20)]
    levels = [f[0]["log_likelihood"] for f in fits]
    assert levels[0] <= levels[1] <= levels[2]
    low, high = sorted(fits[2], key=lambda r: r["mean"])
    assert (low["mean"], high["mean"]) == pytest.approx((-2, 3), abs=0.2) and (low["sd"], high["sd"]) == pytest.approx((0.5, 1.0), abs=0.15)
    assert low["share"] + high["share"] == pytest.approx(1)
    shares = run(spark, "hmm_fit").groupBy("instrument", "session").agg(F.sum("share").alias("s")).collect()
    assert shares and all(r["s"] == pytest.approx(1) for r in shares)


def test_state_path_against_all_paths(spark):
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.concatenate([rng.normal(0, 1, 5), rng.normal(2, 1, 5)])
        model = X.fit_states(x, 2, 5)
        dense = model.density(x)

        def chance(path, dense=dense, model=model):
            p = model.start[path[0]] * dense[0, path[0]]
            for t in range(1, len(path)):
                p *= model.move[path[t - 1], path[t]] * dense[t, path[t]]
            return p

        assert chance(tuple(model.path(x))) == pytest.approx(max(map(chance, product(range(2), repeat=10))))
    paths = run(spark, "hmm_paths")
    bars = I.bars(spark, SMALL, 600).groupBy("instrument", "session").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    assert paths.groupBy("instrument", "session").agg(F.sum("bars").alias("n")).exceptAll(bars).count() == 0


def test_noise_trades_against_a_plain_walk(spark):
    bars = I.bars(spark, SMALL)
    days = {(r["instrument"], r["session"]): r["dispersion"] for r in M.rolling_dispersion(B.sessions(bars, 24), 5).collect()}
    want = []
    for key, g in sessions_of(bars).items():
        if not days[key]:
            continue
        step, base = days[key] / math.sqrt(24), g["o"][0]
        wide = lambda m, step=step: step * math.sqrt(m + 1) * math.sqrt(2 / math.pi)
        position, waiting, count = None, False, 0
        for r in g[(g["sessmin"] >= 4) & (g["sessmin"] <= 22)].to_dict("records"):
            m, gap = r["sessmin"], r["c"] - base
            if position:
                side, at, price, risk = position
                level = price - side * risk
                if side * ((r["l"] if side > 0 else r["h"]) - level) <= 0:
                    want.append((*key, side, at, round(price, 6), round(risk, 6), m, round(level, 6), True))
                    position, waiting = None, True
                elif m == 22:
                    want.append((*key, side, at, round(price, 6), round(risk, 6), m, round(r["c"], 6), False))
                    position = None
            elif waiting:
                waiting = not abs(gap) < wide(m)
            elif count < 3 and m < 22 and abs(gap) > wide(m):
                position, count = (1 if gap > 0 else -1, m, r["c"], wide(m)), count + 1
        if position:
            want.append((*key, position[0], position[1], round(position[2], 6), round(position[3], 6), int(g["sessmin"].iloc[-1]), round(g["c"].iloc[-1], 6), False))
    got = [tuple(r) for r in run(spark, "noise_trades").select("instrument", "session", "direction", "entry_bar", "entry", "stop", "exit_bar", "exit", "stopped").collect()]
    # at most three trades a session, the one still open at its end included
    assert len(want) > 50 and sorted(got) == sorted(want)
    worst = M.noise_trades(bars, spark.createDataFrame([(*k, v / math.sqrt(24)) for k, v in days.items() if v], "instrument string, session long, sigma double"), 4, 22, fill="extreme")
    assert worst.count() == len(got)


def band_bars(changes, n=12):
    g = pd.DataFrame({"instrument": "a", "session": 1, "t": range(n), "sessmin": range(n), "o": 100.0, "h": 100.5, "l": 99.5, "c": 100.0, "vwap": 100.0, "sd": 2.0})
    for i, row in changes.items():
        g.loc[i, ["o", "h", "l", "c"]] = row
    return g.astype({"session": "int64", "t": "int64", "sessmin": "int32"})


def test_band_trades_of_hand_made_sessions(spark):
    trades = lambda changes, **more: [(r["entry_t"], r["exit_t"], r["side"], r["entry"], r["exit"], r["reason"]) for r in M.band_trades(spark.createDataFrame(band_bars(changes)), 1.5, 2.0, **more).orderBy("entry_t").collect()]
    touch = {3: (102.0, 103.2, 101.8, 102.5)}
    assert trades({**touch, 4: (102.0, 102.2, 101.0, 101.5)}) == [(3, 5, -1, 102.5, 100.0, "target")]
    assert trades({**touch, 4: (102.0, 106.0, 101.0, 105.5)}) == [(3, 4, -1, 102.5, 105.0, "stop")]
    assert trades({**touch, 4: (106.0, 107.0, 105.5, 106.0)}) == [(3, 4, -1, 102.5, 106.0, "stop")]
    assert trades({3: (98.0, 98.2, 96.8, 97.5)}) == [(3, 4, 1, 97.5, 100.0, "target")]
    assert trades(touch, mode="touch") == [(3, 4, -1, 103.0, 100.0, "target")]
    assert trades({3: (102.0, 105.5, 101.8, 102.5)}, mode="touch") == [(3, 3, -1, 103.0, 105.0, "stop")]
    assert trades(touch, warm=4) == [] and trades(touch, lo=5) == [] and trades({3: (102, 103.2, 102, 103.1)}) == []
    flat = {k: (102.0, 102.2, 101.8, 102.0) for k in range(4, 12)}
    assert trades({**touch, **flat}) == [(3, 11, -1, 102.5, 102.0, "end")]
    assert trades({**touch, **flat}, hi=7) == [(3, 6, -1, 102.5, 102.0, "end")]
    assert run(spark, "band_trades").count() > 0


def test_synthetic_sources(spark):
    a, b = (M.synthetic_walk(spark.range(1).sparkSession, 6, 50, 1.0, momentum=0.1, seed=4).orderBy("t").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 300 and (a["h"] >= a[["o", "c"]].max(axis=1)).all() and (a["l"] <= a[["o", "c"]].min(axis=1)).all()
    trades = M.synthetic_trades(spark, 20_000, 0.4, 2.0).agg(F.avg("r")).first()[0]
    assert trades == pytest.approx(0.2, abs=0.05)
