"""Replay of hand-made sessions, one rule each, and bracketing."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from tideframe.operators.execution import Settings, envelope, execute, features, replay
from tideframe.plans.compiler import Compiler
from tideframe.sources.bar_files import driftless_walk

BASE = Settings(tick=0.25, point_value=2.0, stop_x=2.0, target_kind="r", target_x=1.0)


def session(changes=None, n=10, price=100.0, long=(1,), short=()):
    o, h, l, c = (np.full(n, price) for _ in range(4))
    for i, (a, b, d, e) in (changes or {}).items():
        o[i], h[i], l[i], c[i] = a, b, d, e
    flags = lambda at: np.isin(np.arange(n), at)
    status = np.zeros(n, int)
    status[-1] = 1
    return {"t": np.arange(n), "sessmin": np.arange(n), "o": o, "h": h, "l": l, "c": c, "long": flags(long), "short": flags(short), "status": status, "atr": np.full(n, 1.0), "level": np.full(n, np.nan), "goal": np.full(n, np.nan)}


def only(changes, s=BASE, **more):
    trades, _ = replay(session(changes, **more), s)
    assert len(trades) == 1
    return trades[0]


def test_market_entry_and_target():
    x = only({4: (100, 103, 99.5, 101)})
    assert (x["entry"], x["exit"], x["reason"], x["r"], x["entry_t"], x["exit_t"]) == (100, 102, "target", 1.0, 2, 4)


def test_stop_and_gap_through_stop():
    assert only({4: (100, 100.5, 97, 98)})["exit"] == 98
    x = only({4: (95, 96, 94, 95)})
    assert (x["exit"], x["reason"]) == (95, "stop")


def test_both_touched():
    bar = {4: (100, 103, 97, 101)}
    assert only(bar)["reason"] == "stop"
    assert only(bar, replace(BASE, fill="optimistic"))["reason"] == "target"
    assert only(bar, replace(BASE, fill="path"))["reason"] == "stop"
    assert only({4: (100, 103, 97, 99)}, replace(BASE, fill="path"))["reason"] == "target"


def test_short_side_mirrors():
    x = only({4: (100, 100.5, 97, 98)}, long=(), short=(1,))
    assert (x["side"], x["reason"], x["exit"]) == ("short", "target", 98)


def test_limits_and_counts():
    _, counts = replay(session(long=(1,), short=(1,)), BASE)
    assert counts["ambiguous"] == 1
    _, counts = replay(session(long=(9,)), BASE)
    assert counts["expired"] == 1
    trades, counts = replay(session({3: (100, 100, 97, 99), 6: (100, 100, 97, 99)}, long=(1, 4, 7)), replace(BASE, max_losses=1))
    assert len(trades) == 1 and counts["limit"] == 2
    _, counts = replay(session(), replace(BASE, risk_money=1.0))
    assert counts["size"] == 1
    _, counts = replay(session(), replace(BASE, stop_kind="level"))
    assert counts["undefined"] == 1


def test_limit_entry_needs_price():
    s = replace(BASE, entry="limit", entry_offset=1.0, valid=3)
    assert only({3: (100, 100, 99, 100)}, s)["entry"] == 99
    _, counts = replay(session(), s)
    assert counts["expired"] == 1


def test_time_flat_end_and_costs():
    assert only({}, replace(BASE, max_bars=2))["reason"] == "time"
    assert only({}, replace(BASE, flat=5))["reason"] == "flat"
    x = only({}, replace(BASE, commission=1.0, slip=1.0))
    assert x["reason"] == "end" and x["points"] == -0.5 and x["pnl"] == -2.0 and x["cost"] == 2.0


def test_break_even_holds_from_next_bar():
    x = only({3: (100, 101, 100, 101), 5: (100.5, 100.5, 99, 99)}, replace(BASE, break_even_r=0.5, target_x=5.0))
    assert (x["reason"], x["exit"], x["exit_t"]) == ("stop", 100, 4)


def test_bracket_on_driftless_walk(spark):
    bars = driftless_walk(spark, 12, 120)
    frame = features(Compiler(bars), {"trigger": {"bar": "up"}, "mirror": False})
    s = replace(BASE, stop_x=2.0, target_x=1.0, cooldown=5)
    runs = {r["config"]: r["m"] for r in envelope(frame, s).groupBy("config").agg({"r": "avg"}).withColumnRenamed("avg(r)", "m").collect()}
    assert runs[0] <= runs[1]
    again = execute(frame, [s]).agg({"r": "avg"}).first()[0]
    assert again == pytest.approx(runs[0])


def test_known_order_inside_a_bar():
    bars = session({4: (100, 103, 97, 101)})
    bars["low_first"] = np.ones(10, bool)
    assert replay(bars, replace(BASE, fill="known"))[0][0]["reason"] == "stop"
    bars["low_first"][4] = False
    assert replay(bars, replace(BASE, fill="known"))[0][0]["reason"] == "target"
    short = {**bars, "long": bars["short"], "short": bars["long"]}
    assert replay(short, replace(BASE, fill="known"))[0][0]["reason"] == "stop"


def test_known_order_lies_between_the_brackets(spark):
    bars = driftless_walk(spark, 12, 120)
    frame = features(Compiler(bars), {"trigger": {"bar": "up"}, "mirror": False})
    s = replace(BASE, stop_x=2.0, target_x=1.0, cooldown=5)
    runs = {r["config"]: r["avg(r)"] for r in execute(frame, [replace(s, fill=f) for f in ("pessimistic", "known", "optimistic")]).groupBy("config").agg({"r": "avg"}).collect()}
    assert runs[0] <= runs[1] <= runs[2]


def test_orders_wait_until_a_bar():
    s = replace(BASE, entry="limit", entry_offset=1.0, valid=5)
    assert only({4: (100, 100, 99, 100)}, s)["entry_t"] == 4
    _, counts = replay(session({4: (100, 100, 99, 100)}), replace(s, valid_until=4))
    assert counts["expired"] == 1


def test_target_follows_its_level():
    bars = session({6: (100, 102, 100, 101)})
    bars["goal"] = np.array([103.0] * 5 + [101.5] * 5)
    s = replace(BASE, target_kind="level", stop_x=5.0)
    assert replay(bars, s)[0][0]["reason"] == "end"
    x = replay(bars, replace(s, follow=True))[0][0]
    assert (x["reason"], x["exit"], x["exit_t"]) == ("target", 101.5, 6)
