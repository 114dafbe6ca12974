"""Streams of calls and ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CALL = r"^\s*(LONG|SHORT|BUY|SELL)\s+([A-Z0-9]+)(?:\s+(.*))?$"


def parse_calls(lines: DataFrame, pseudo: str) -> DataFrame:
    """Calls of tape lines "side instrument note", stamped on arrival; other lines are dropped."""
    side = F.regexp_extract(F.upper("value"), CALL, 1)
    return lines.where(F.length(side) > 0).select(
        F.current_timestamp().alias("ts"), F.lit(pseudo).alias("pseudo"), F.regexp_extract(F.upper("value"), CALL, 2).alias("instrument"), F.when(side.isin("LONG", "BUY"), "long").otherwise("short").alias("side"), F.regexp_extract("value", f"(?i){CALL}", 3).alias("note")
    )


def record_tape(spark: SparkSession, folder: str, out: str, checkpoint: str, pseudo: str):
    """Append the calls of text files that arrive in a folder to a Parquet ledger, each once."""
    calls = parse_calls(spark.readStream.text(folder), pseudo)
    return calls.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Ticks (instrument, ts, price, size) of event files that arrive in a folder."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.regexp_extract("props", r"([0-9]+)", 1).cast("double").alias("size"))


def stream_bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Bars of event-time windows, each given out once its window is past the watermark."""
    return ticks.withWatermark("ts", late).groupBy("instrument", F.window("ts", width)).agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.sum("size").alias("v"), F.count(F.lit(1)).alias("n"))


def stream_consensus(calls: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Long less short calls in sliding windows."""
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    return calls.withWatermark("ts", late).groupBy("instrument", F.window("ts", width, slide)).agg(F.sum(side).alias("imbalance"), F.count(F.lit(1)).alias("calls"))


def stream_average(bars: DataFrame, n: int) -> DataFrame:
    """Running exponential average of each instrument's closes over micro-batches; state: count, average."""
    weight = 2 / (n + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, value = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            count += 1
            value = value + (price - value) / count if count <= n else value + weight * (price - value)
            out.append((key[0], ts, float(value) if count >= n else None))
        state.update((count, float(value)))
        yield pd.DataFrame(out, columns=["instrument", "ts", "ema"])

    return bars.groupBy("instrument").applyInPandasWithState(update, "instrument string, ts timestamp, ema double", "count long, value double", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(changes: DataFrame, path: str, checkpoint: str, key: str, version: str):
    """Keep the last version of each document in a table that each micro-batch writes beside the one before; the table before
    that is deleted, so a reader of the last one is not disturbed and old versions do not pile up."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, target = batch.sparkSession, f"{path}/v{epoch}"
        rows = batch
        if epoch:
            rows = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(batch)
        others = [c for c in batch.columns if c != key]
        rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("d")).select(key, *[F.col(f"d.{c}") for c in others]).write.mode("overwrite").parquet(target)
        if epoch > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{epoch - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
