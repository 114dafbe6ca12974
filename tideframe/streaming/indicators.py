"""Indicators of each instrument over a stream of bars, with typed state, event-time timers and expiry.

Bars wait in the state until the watermark has passed them, so they are taken in order of their time however they arrive
within the delay. What comes later than that is dropped by the watermark, or, if its time was worked off already, by the
processor; it changes nothing. State lives in the checkpoint: a restarted stream goes on where it stopped. An instrument that
is silent for `idle` loses its state and begins anew. The session's state store must be RocksDB's (use_state_store).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "instrument string, ts timestamp, vwap double, atr double, rsi double"
#: bars: taken so far; close: the last one; sums or averages of ranges, gains and losses; the session and its sums.
STATE = "bars long, close double, range double, gain double, loss double, session long, weight double, value double, n long, plain double, last long"
BAR = "h double, l double, c double, v double"
DAY_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that timers and maps need; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def wilder(average: float, x: float, count: int, n: int) -> float:
    """The mean of the first n values, then the recursion that keeps n - 1 parts of n."""
    return average + (x - average) / (count if count <= n else n)


class Indicators(StatefulProcessor):
    """Session VWAP, average true range and relative strength, as operands of bars give them."""

    def __init__(self, n_atr: int, n_rsi: int, idle_ms: int):
        self.n_atr, self.n_rsi, self.idle_ms = n_atr, n_rsi, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "ms long", BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[10] if self.state.exists() else None
        for pdf in rows:
            for ts, *bar in zip(pdf["ts"], pdf["h"], pdf["l"], pdf["c"], pdf["v"], strict=True):
                ms = pd.Timestamp(ts).value // 1_000_000
                if last is None or ms > last:  # the last of equal times counts
                    self.waiting.updateValue((ms,), tuple(map(float, bar)))
                    self.handle.registerTimer(ms)
        return iter(())

    def take(self, s: list, ms: int, h: float, l: float, c: float, v: float) -> tuple:
        """The indicators after one more bar; s, the state, is brought up to it."""
        s[0] += 1
        true = h - l if s[0] == 1 else max(h - l, abs(h - s[1]), abs(l - s[1]))
        s[2] = wilder(s[2], true, s[0], self.n_atr)
        if s[0] > 1:
            s[3] = wilder(s[3], max(c - s[1], 0.0), s[0] - 1, self.n_rsi)
            s[4] = wilder(s[4], max(s[1] - c, 0.0), s[0] - 1, self.n_rsi)
        if s[5] != ms // DAY_MS:
            s[5:10] = [ms // DAY_MS, 0.0, 0.0, 0, 0.0]
        price = (h + l + c) / 3
        s[6], s[7], s[8], s[9] = s[6] + v, s[7] + v * price, s[8] + 1, s[9] + price
        s[1], s[10] = c, ms
        strength = 50.0 if s[3] == s[4] == 0 else 100.0 if s[4] == 0 else 100 - 100 / (1 + s[3] / s[4])
        return s[7] / s[6] if s[6] > 0 else s[9] / s[8], s[2] if s[0] >= self.n_atr else None, strength if s[0] > self.n_rsi else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ripe = sorted((k[0], *bar) for k, bar in self.waiting.iterator() if k[0] <= now)
        state = list(self.state.get()) if self.state.exists() else [0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0, 0.0, None]
        if not ripe:
            if state[10] is not None and now >= state[10] + self.idle_ms and not any(True for _ in self.waiting.keys()):
                self.state.clear()
            return
        rows = []
        for ms, *bar in ripe:
            if state[10] is not None and ms - state[10] > self.idle_ms:
                state = [0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0, 0.0, None]
            rows.append((key[0], pd.Timestamp(ms, unit="ms"), *self.take(state, ms, *bar)))
            self.waiting.removeKey((ms,))
        self.state.update(tuple(state))
        self.handle.registerTimer(state[10] + self.idle_ms)
        out = pd.DataFrame(rows, columns=["instrument", "ts", "vwap", "atr", "rsi"])
        yield out.astype({"vwap": float, "atr": float, "rsi": float})

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, late: str, n_atr: int = 14, n_rsi: int = 14, idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """instrument, ts, vwap, atr, rsi of a stream of bars (instrument, ts, h, l, c, v), each given out once its time is past the
    watermark. Times count in milliseconds, sessions are days of UTC."""
    rows = bars.select("instrument", "ts", "h", "l", "c", "v").withWatermark("ts", late).groupBy("instrument")
    return rows.transformWithStateInPandas(Indicators(n_atr, n_rsi, idle_ms), OUTPUT, "append", "eventTime")
