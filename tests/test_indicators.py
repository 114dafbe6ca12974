"""Streamed indicators against the batch columns of the same bars: out of order, late, after a restart and an expiry."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideframe.plans.compiler import Compiler
from tideframe.streaming import indicators

SCHEMA = "instrument string, ts timestamp, h double, l double, c double, v double"
START = dt.datetime(2024, 1, 2, 22)


def bars(n=120):
    rng, rows = random.Random(5), []
    for name in "ab":
        c = 100.0
        for i in range(n):
            c += rng.randint(-4, 4) / 4
            rows.append((name, START + dt.timedelta(minutes=5 * i), c + rng.random(), c - rng.random(), c, float(rng.randrange(3))))
    return rows


def batch_columns(spark, rows, n_atr, n_rsi):
    """The same by the compiler of operands."""
    table = spark.createDataFrame(rows, SCHEMA).withColumn("t", (F.unix_timestamp("ts") / 300).cast("long"))
    frame = table.withColumns({"session": F.floor(F.col("t") / 288), "sessmin": F.pmod("t", F.lit(288)).cast("int"), "o": F.col("c"), "n": F.lit(1)})
    c = Compiler(frame, expected=288)
    columns = [c.operand({"ind": "vwap", "k": 0}), c.operand({"ind": "atr", "n": n_atr}), c.operand({"ind": "rsi", "n": n_rsi})]
    got = c.frame.select("instrument", "ts", *[x.alias(k) for x, k in zip(columns, ("vwap", "atr", "rsi"), strict=True)])
    return {(r["instrument"], r["ts"]): (r["vwap"], r["atr"], r["rsi"]) for r in got.collect()}


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    indicators.use_state_store(spark)
    yield
    spark.conf.set(key, before)


def run(spark, folder, rows_of_files, delay, **given):
    """Add files, let a query of its own work them off, and give what it wrote; state and output are in the folder."""
    for rows in rows_of_files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    made = indicators.stream_indicators(stream, delay, **given)
    query = made.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(indicators.OUTPUT).parquet(str(folder / "out")).collect()


def close(got, want):
    assert len(got) == len({(r["instrument"], r["ts"]) for r in got})
    for r in got:
        for x, y in zip((r["vwap"], r["atr"], r["rsi"]), want[r["instrument"], r["ts"]], strict=True):
            assert x == (None if y is None else pytest.approx(y, rel=1e-9))


def test_streamed_indicators_equal_columns_after_a_restart(spark, tmp_path, store):
    rows = bars()
    rows.sort(key=lambda r: (r[1], r[0]))
    want = batch_columns(spark, rows, 5, 4)
    rng = random.Random(1)
    files = [rows[i : i + 48] for i in range(0, len(rows), 48)]
    # files are out of order inside, and a bar of each file comes with the next one
    for k, part in enumerate(files):
        rng.shuffle(part)
        if k:
            part.append(files[k - 1].pop(0))
    first = run(spark, tmp_path, files[:3], "150 minutes", n_atr=5, n_rsi=4)
    assert 60 < len(first) < len(rows) / 2
    # a bar older than the watermark changes nothing
    late = [("a", START - dt.timedelta(hours=3), 1.0, 0.0, 0.5, 9.0), ("a", START + dt.timedelta(minutes=10), 500.0, 0.0, 1.0, 9.0)]
    got = run(spark, tmp_path, [[*files[3], *late], files[4]], "150 minutes", n_atr=5, n_rsi=4)
    close(got, want)
    newest = max(r[1] for r in rows)
    assert {(r["instrument"], r["ts"]) for r in got} >= {k for k in want if k[1] < newest - dt.timedelta(minutes=155)} and len(got) > len(first) + 60


def test_silence_clears_the_state(spark, tmp_path, store):
    early = [r for r in bars(30) if r[0] == "a"]
    gap = dt.timedelta(days=3)
    later = [(n, ts + gap, *x) for n, ts, *x in early]
    end = [("b", START + 2 * gap, 2.0, 1.0, 1.5, 1.0)]
    more = [("b", START + 2 * gap + dt.timedelta(minutes=5), 2.0, 1.0, 1.5, 1.0)]
    got = [r for r in run(spark, tmp_path, [early, later, end, more], "30 minutes", n_atr=5, n_rsi=4, idle_ms=86_400_000) if r["instrument"] == "a"]
    close(got, batch_columns(spark, early, 5, 4) | batch_columns(spark, later, 5, 4))
    assert len(got) == 60
