"""Streams against the same rows in one batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideframe.streaming import flows


def rows_of(n=300, seed=3):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 2)
    return [("ab"[i % 2], start + dt.timedelta(seconds=40 * i), 50 + rng.random() * 10, rng.choice(["long", "short"])) for i in range(n)]


SCHEMA = "instrument string, ts timestamp, price double, side string"


def streamed(spark, tmp_path, make, mode="append", parts=3):
    """Rows of a query over a folder whose files are read one by one."""
    rows = rows_of()
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_sliding_consensus(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: flows.stream_consensus(s, "30 minutes", "10 minutes", "5 minutes"), "complete").collect()
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    want = spark.createDataFrame(rows_of(), SCHEMA).groupBy("instrument", F.window("ts", "30 minutes", "10 minutes")).agg(F.sum(side).alias("imbalance"), F.count(F.lit(1)).alias("calls")).collect()
    assert len(want) > 20 and sorted(map(str, got)) == sorted(map(str, want))


def test_running_average(spark, tmp_path):
    got = {(r["instrument"], r["ts"]): r["ema"] for r in streamed(spark, tmp_path, lambda s: flows.stream_average(s.select("instrument", "ts", "price"), 5)).collect()}
    assert len(got) == 300
    for name in "ab":
        prices = [(ts, p) for k, ts, p, _ in rows_of() if k == name]
        value = None
        for i, (ts, p) in enumerate(prices, 1):
            value = sum(x for _, x in prices[:5]) / 5 if i == 5 else value + (p - value) / 3 if i > 5 else None
            assert got[name, ts] == (pytest.approx(value) if value is not None else None)
