"""Replay of signals as orders and trades: one pass over each session's bars, sessions independent of each other.

State inside a session: at most one position, its stop, extremes, losses and profit so far, and the bar from which a next
signal counts. That is a path, so a (setting, instrument, session) is one group; a session is bounded.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.document import mirror, resolve

TRADES = (
    "config int, instrument string, session long, i long, entry_t long, exit_t long, side string, qty long, entry double, stop double, target double, exit double, reason string, "
    "points double, pnl double, r double, cost double, mae double, mfe double, bars int"
)
#: Bars that the search for an exit looks at together.
RUN = 64
COUNTS = ("ambiguous", "gap", "expired", "limit", "size", "short_stop", "undefined")
REFUSED = "config int, instrument string, session long, reason string, n long"


@dataclass(frozen=True)
class Settings:
    """How signals become trades. Prices in points, costs in money, slip in ticks a leg."""

    tick: float = 0.25
    point_value: float = 2.0
    commission: float = 0.0
    slip: float = 0.0
    fill: str = "pessimistic"  # or optimistic, path (the bar's direction tells), known (the frame's low_first tells)
    entry: str = "market"  # or limit, stop
    entry_offset: float = 0.0
    valid: int = 1
    valid_until: int = 1 << 30  # bar of the session before which a waiting order must fill
    stop_kind: str = "points"  # or atr, swing, level
    stop_x: float = 10.0
    stop_n: int = 5
    min_stop_ticks: float = 1.0
    target_kind: str = "r"  # or points, atr, level, none
    follow: bool = False  # a level target moves with its level, known on the bar before
    target_x: float = 2.0
    contracts: int = 1
    risk_money: float = 0.0
    max_qty: int = 100
    max_per_session: int = 1 << 30
    max_losses: int = 1 << 30
    daily_stop: float = float("inf")
    cooldown: int = 0
    max_bars: int = 1 << 30
    flat: int = 1 << 30
    opposite: bool = False
    break_even_r: float = float("inf")
    trail: float = float("inf")
    through: float = 0.0


def as_lists(bars: dict[str, np.ndarray]) -> dict[str, list]:
    return {k: bars[k].tolist() for k in ("t", "sessmin", "o", "h", "l", "c", "status")}


def replay(bars: dict[str, np.ndarray], s: Settings) -> tuple[list[dict[str, Any]], dict[str, int]]:
    """Trades of one session. bars: t, sessmin, o, h, l, c, long, short, status, atr, level, goal (nan: undefined); lists: the
    same of t, sessmin, o, h, l, c and status as lists, if several replays share them."""
    high, low = bars["h"], bars["l"]
    t, minute, o, h, l, c, status = (bars.get("lists") or as_lists(bars)).values()
    n, out, counts = len(t), [], dict.fromkeys(COUNTS, 0)
    profit, losses, free = 0.0, 0, 0
    still = math.isinf(s.trail) and math.isinf(s.break_even_r) and not (s.follow and s.target_kind == "level")
    timed = s.flat <= minute[-1] if n else False

    def grid(p: float, up: bool) -> float:
        if not math.isfinite(p):
            return math.nan
        return (math.ceil(p / s.tick - 1e-9) if up else math.floor(p / s.tick + 1e-9)) * s.tick

    for i in np.flatnonzero(bars["long"] | bars["short"]).tolist():
        if i < free:
            continue
        if len(out) >= s.max_per_session or losses >= s.max_losses or profit <= -s.daily_stop:
            counts["limit"] += 1
            continue
        if bars["long"][i] and bars["short"][i]:
            counts["ambiguous"] += 1
            continue
        if status[i]:
            counts["gap" if status[i] == 2 else "expired"] += 1
            continue
        way = 1 if bars["long"][i] else -1
        # entry: price, and the bar that fills
        e, price = i + 1, None
        if s.entry == "market":
            price = o[e] + way * s.slip * s.tick
        else:
            order = grid(c[i] - way * s.entry_offset, way < 0) if s.entry == "limit" else grid(c[i] + way * s.entry_offset, way > 0)
            for e in range(i + 1, min(n, i + 1 + s.valid)):
                if minute[e] >= s.valid_until:
                    break
                if s.entry == "limit":
                    if way * (o[e] - order) <= 0:
                        price = o[e]
                    elif way * ((l[e] if way > 0 else h[e]) - order) <= -s.through * s.tick:
                        price = order
                elif way * ((h[e] if way > 0 else l[e]) - order) >= 0:
                    price = (max if way > 0 else min)(o[e], order) + way * s.slip * s.tick
                if price is not None:
                    break
        if price is None:
            counts["expired"] += 1
            continue
        # stop
        if s.stop_kind == "points":
            stop = price - way * s.stop_x
        elif s.stop_kind == "atr":
            stop = price - way * s.stop_x * float(bars["atr"][i])
        elif s.stop_kind == "swing":
            lo = max(0, i + 1 - s.stop_n)
            stop = (min(l[lo : i + 1]) if way > 0 else max(h[lo : i + 1])) - way * s.stop_x
        else:
            stop = float(bars["level"][i]) - way * s.stop_x
        if not math.isfinite(stop):
            counts["undefined"] += 1
            continue
        stop = grid(stop, way < 0)
        risk = way * (price - stop)
        if risk < s.min_stop_ticks * s.tick:
            counts["short_stop"] += 1
            continue
        if s.target_kind == "none":
            target = math.nan
        else:
            goal = s.target_x * risk if s.target_kind == "r" else s.target_x if s.target_kind == "points" else s.target_x * float(bars["atr"][i]) if s.target_kind == "atr" else way * (float(bars["goal"][i]) - price)
            target = grid(price + way * goal, way > 0)
            if not math.isfinite(target) or way * (target - price) <= 0:
                counts["undefined"] += 1
                continue
        qty = s.contracts if s.risk_money <= 0 else int(min(s.max_qty, math.floor(s.risk_money / (risk * s.point_value + s.commission) + 1e-9)))
        if qty < 1:
            counts["size"] += 1
            continue
        now, mae, mfe, k, done, why = stop, 0.0, 0.0, e, None, ""
        aimed = math.isfinite(target)
        if still:
            # nothing moves the stop, so the first bar on which anything may end the trade is found at once, run by run
            k = min(e + s.max_bars, n) - 1
            for lo in range(e, k + 1, RUN):
                part = slice(lo, min(lo + RUN, k + 1))
                stirs = low[part] <= now if way > 0 else high[part] >= now
                if aimed:
                    # an opening beyond the target lies inside the bar's range
                    stirs = stirs | (high[part] >= target if way > 0 else low[part] <= target)
                if timed:
                    stirs = stirs | (bars["sessmin"][part] >= s.flat)
                if s.opposite:
                    stirs = stirs | bars["short" if way > 0 else "long"][part]
                at = int(stirs.argmax())
                if stirs[at]:
                    k = lo + at
                    break
            if k > e:
                top, bottom = max(h[e:k]), min(l[e:k])
                mae, mfe = (min(0.0, bottom - price), max(0.0, top - price)) if way > 0 else (min(0.0, price - top), max(0.0, price - bottom))
        while done is None:
            if s.follow and s.target_kind == "level" and k > e and math.isfinite(goal := float(bars["goal"][k - 1])):
                target = grid(goal, way > 0)
            adverse, better = (l[k], h[k]) if way > 0 else (h[k], l[k])
            hit_stop, hit_target = way * (adverse - now) <= 0, aimed and way * (better - target) >= s.through * s.tick
            opened = k > e or s.entry == "market"
            if minute[k] >= s.flat:
                done, why = o[k], "flat"
            elif opened and way * (o[k] - now) <= 0:
                done, why = o[k], "stop"
            elif opened and aimed and k > e and way * (o[k] - target) >= 0:
                done, why = o[k], "target"
            elif hit_stop or hit_target:
                stop_first = hit_stop and (not hit_target or s.fill == "pessimistic" or (s.fill == "path" and way * (c[k] - o[k]) >= 0) or (s.fill == "known" and bool(bars["low_first"][k]) == (way > 0)))
                done, why = (now, "stop") if stop_first else (target, "target")
            elif k - e + 1 >= s.max_bars:
                done, why = c[k], "time"
            elif s.opposite and bars["short" if way > 0 else "long"][k] and k > e:
                done, why = c[k], "opposite"
            elif k == n - 1:
                done, why = c[k], "end"
            reach = [way * (adverse - price), way * (better - price)]
            if done is not None:
                end = way * (done - price)
                reach = [max(reach[0], min(end, 0.0)) if why == "stop" else reach[0], min(reach[1], max(end, 0.0)) if why == "target" else reach[1]]
            mae, mfe = min(mae, reach[0]), max(mfe, reach[1])
            if done is None:
                # what is moved now holds from the next bar on
                if mfe >= s.break_even_r * risk:
                    now = max(now, price) if way > 0 else min(now, price)
                if math.isfinite(s.trail):
                    now = way * max(way * now, way * grid(price + way * (mfe - s.trail), way < 0))
                k += 1
        legs = int(s.entry != "limit") + int(why != "target")
        left = done - way * s.slip * s.tick * (why != "target")
        points = way * (left - price)
        cost = s.commission + s.tick * s.point_value * s.slip * legs
        pnl = qty * (points * s.point_value - s.commission)
        profit, losses = profit + pnl, losses + (pnl < 0)
        out.append({
            "i": t[i], "entry_t": t[e], "exit_t": t[k], "side": "long" if way > 0 else "short", "qty": qty, "entry": price, "stop": stop, "target": target if aimed else None, "exit": left,
            "reason": why, "points": points, "pnl": pnl, "r": pnl / (qty * risk * s.point_value), "cost": cost, "mae": mae, "mfe": mfe, "bars": k - e + 1,
        })
        free = max(k + s.cooldown, i + 1)
    return out, counts


COLUMNS = ["instrument", "session", "t", "sessmin", "o", "h", "l", "c"]


def wants_range(settings: list[Settings]) -> bool:
    """Whether any of some settings reads the average range."""
    return any("atr" in (s.stop_kind, s.target_kind) for s in settings)


def compiled(compiler: Compiler, document: dict[str, Any], params: dict[str, float] | None = None, average_range: bool = True) -> dict[str, Column]:
    """Columns that replay needs, of a document: long and short signals, executable status, average range (null if not asked
    for), stop and goal levels."""
    document = resolve({k: v for k, v in document.items() if k != "params"}, {**document.get("params", {}), **(params or {})})
    rule = {"setup": document.get("setup", []), "trigger": document["trigger"]}
    domain = compiler.domain(**document.get("domain", {}))
    up = compiler.signal(rule)
    down = compiler.signal({"setup": [mirror(x) for x in rule["setup"]], "trigger": mirror(rule["trigger"])}) if document.get("mirror", True) else F.lit(False)
    some = lambda key: compiler.operand(document[key]) if key in document else F.lit(None).cast("double")
    atr = compiler.operand({"ind": "atr", "n": document.get("atr", 14)}) if average_range else F.lit(None).cast("double")
    stop, goal = some("stop_level"), some("goal_level")
    return {"long": up & domain, "short": down & domain, "status": compiler.executable(), "atr": atr, "level": stop, "goal": goal}


def features(compiler: Compiler, document: dict[str, Any], params: dict[str, float] | None = None, average_range: bool = True) -> DataFrame:
    """Bars with what replay needs of a document."""
    made = compiled(compiler, document, params, average_range)
    known = ["low_first"] if "low_first" in compiler.bars.columns else []  # which extreme of a bar came first, where that is told
    return compiler.frame.select(*COLUMNS, *known, *[c.alias(k) for k, c in made.items()])


def session_arrays(part: pd.DataFrame) -> dict[str, np.ndarray]:
    """What replay needs of one session's feature rows."""
    part = part.sort_values("t")
    bars = {k: part[k].to_numpy() for k in ("t", "sessmin", "o", "h", "l", "c", "status")}
    bars |= {k: part[k].fillna(False).to_numpy(bool) for k in ("long", "short") if k in part} | {k: part[k].to_numpy(float) for k in ("atr", "level", "goal")}
    if "low_first" in part:
        bars["low_first"] = part["low_first"].to_numpy(bool)
    return bars | {"lists": as_lists(bars)}


def firing(frame: DataFrame, keys: list[str], fired: Column, dealt: bool = False) -> DataFrame:
    """Rows of the groups in which something fires; the others never leave the JVM. Series windows leave an instrument's bars
    in one partition, which would do for its sessions too, so they are dealt out anew (unless they are dealt by keys); the
    window and the grouping after it have the same keys and share that shuffle."""
    frame = frame if dealt else frame.repartition(*keys)
    return frame.withColumn("_fired", F.max(fired.cast("int")).over(W.partitionBy(*keys))).where("_fired = 1").drop("_fired")


def execute(frame: DataFrame, settings: list[Settings], by: str | None = None, cells: bool = False) -> DataFrame:
    """Trades of each setting on a feature frame. `by`: a column of the frame that says which setting a row is for; `cells`:
    longs and shorts are arrays with a signal for each setting; else each group is replayed under every setting. Settings are
    few (a sweep's bound); they travel with the function. A group is a session with all its settings, so its size is bounded
    by both, and small groups cost few conversions."""
    plans = [asdict(s) for s in settings]
    names = [x.split()[0] for x in TRADES.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, rows = [], []
        for number, part in pdf.groupby(by, sort=True) if by else [(None, pdf)]:
            bars = session_arrays(part)
            if cells:
                part = part.sort_values("t")
                longs, shorts = (np.stack(part[c].to_numpy()).astype(bool) for c in ("longs", "shorts"))
            for k in [int(number)] if by else range(len(plans)):
                if cells:
                    bars["long"], bars["short"] = longs[:, k], shorts[:, k]
                made, _ = replay(bars, Settings(**plans[k]))
                numbers += [k] * len(made)
                rows += made
        if not rows:
            return pd.DataFrame([], columns=names)
        fixed = {c: [v] * len(rows) for c, v in {"instrument": pdf["instrument"].iloc[0], "session": pdf["session"].iloc[0]}.items()}
        return pd.DataFrame({"config": numbers, **fixed, **{c: [x[c] for x in rows] for c in names[3:]}}, columns=names)

    keys = ["instrument", "session"] + ([by] if by else [])
    any_of = lambda c: F.exists(c, lambda x: x)
    fired = any_of("longs") | any_of("shorts") if cells else F.col("long") | F.col("short")
    return firing(frame, keys, fired, cells).groupBy("instrument", "session").applyInPandas(run, TRADES)


def refusals(frame: DataFrame, settings: list[Settings]) -> DataFrame:
    """How many signals of each session made no trade under each setting, by the reason; only reasons that occur."""
    plans = [asdict(s) for s in settings]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bars, rows = session_arrays(pdf), []
        for k, plan in enumerate(plans):
            rows += [(k, pdf["instrument"].iloc[0], pdf["session"].iloc[0], why, n) for why, n in replay(bars, Settings(**plan))[1].items() if n]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in REFUSED.split(", ")])

    return firing(frame, ["instrument", "session"], F.col("long") | F.col("short")).groupBy("instrument", "session").applyInPandas(run, REFUSED)


RECORDS = "config int, instrument string, session long, n long, sum_r double, sum_r2 double, net double, wins long, losses long"


def cell_records(rows: DataFrame, settings: list[Settings]) -> DataFrame:
    """Sums of the trades of each setting (longs and shorts: arrays with a signal for each) in each session with a signal, made
    where its bars are: trades do not leave the task."""
    plans = [asdict(s) for s in settings]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bars, pdf, out = session_arrays(pdf), pdf.sort_values("t"), []
        longs, shorts = (np.stack(pdf[c].to_numpy()).astype(bool) for c in ("longs", "shorts"))
        for k in np.flatnonzero((longs | shorts).any(axis=0)).tolist():
            made, _ = replay({**bars, "long": longs[:, k], "short": shorts[:, k]}, Settings(**plans[k]))
            r, pnl = [x["r"] for x in made], [x["pnl"] for x in made]
            out.append((k, pdf["instrument"].iloc[0], pdf["session"].iloc[0], len(r), sum(r), sum(x * x for x in r), sum(pnl), sum(x > 0 for x in pnl), sum(x < 0 for x in pnl)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")])

    some = lambda c: F.exists(c, lambda x: x)
    return firing(rows, ["instrument", "session"], some("longs") | some("shorts"), True).groupBy("instrument", "session").applyInPandas(run, RECORDS)


def session_grid(sessions: DataFrame, configs: int) -> DataFrame:
    """Every setting with every session; settings are few."""
    return sessions.select("instrument", "session").distinct().crossJoin(F.broadcast(sessions.sparkSession.range(configs).select(F.col("id").cast("int").alias("config"))))


def with_quiet_sessions(sums: DataFrame, sessions: DataFrame, configs: int) -> DataFrame:
    """Session sums with a row of noughts for each setting and session without trades."""
    return session_grid(sessions, configs).join(sums, ["config", "instrument", "session"], "left").fillna(0, ["n", "sum_r", "sum_r2", "net", "wins", "losses"])


def session_records(trades: DataFrame, sessions: DataFrame, configs: int) -> DataFrame:
    """One row for each setting and session, those without trades included: n, sums of r, r squared, profit, wins, losses."""
    sums = trades.groupBy("config", "instrument", "session").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"), F.sum(F.col("r") * F.col("r")).alias("sum_r2"), F.sum("pnl").alias("net"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses")
    )
    return with_quiet_sessions(sums, sessions, configs)


def envelope(frame: DataFrame, settings: Settings) -> DataFrame:
    """Pessimistic (config 0) and optimistic (config 1) replays of one signal set."""
    return execute(frame, [replace(settings, fill="pessimistic"), replace(settings, fill="optimistic")])


def stress_grid(base: Settings) -> list[Settings]:
    """Slip 0 to 4 ticks, commission 1, 1.5 and 2 times, and fills that need 0 to 2 ticks through the price."""
    return [replace(base, slip=float(slip), commission=base.commission * m, through=float(th)) for slip in range(5) for m in (1.0, 1.5, 2.0) for th in range(3)]
