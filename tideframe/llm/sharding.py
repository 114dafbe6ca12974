"""Shards of near-equal size by sampled splitters.

Rows lie in the order of (group key, row id). Size-weighted samples of those keys give quantile boundaries; they cut the
rows into ranges, a range that turns out overfull is cut again, and exact running sizes inside ranges put every row into
its shard. A group of equal keys keeps together unless it outgrows a small part of a shard, so a group that holds a third
of all rows is spread over ranges and shards like any other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Expected number of sampled keys for each range: a bound on what the driver sees.
SAMPLES_A_RANGE = 48
LEAST_LONG = -(1 << 63)


def uniform(*columns, seed: int):
    """A fixed pseudo-random number in [0, 1) from columns."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def weighted_splitters(rows: DataFrame, key: str, row_id: str, size: str, ranges: int, total: float, seed: int = 1) -> list[tuple[int, int]]:
    """At most ranges - 1 boundaries (key, row id), ascending: quantiles of a sample drawn in proportion to size.

    A boundary lies between keys, but inside a key where that key alone spans more than one quantile. A null key or id
    sorts as the least long. Every row is drawn by itself, rows that repeat an id or are equal included, so the sample is
    bounded by its expected count, ranges * SAMPLES_A_RANGE.
    """
    if ranges < 2 or not total:
        return []
    rate = ranges * SAMPLES_A_RANGE / float(total)
    least = F.lit(LEAST_LONG)
    found = (
        rows.select(F.coalesce(key, least).alias("k"), F.coalesce(row_id, least).alias("i"), F.col(size).cast("double").alias("w"), F.monotonically_increasing_id().alias("row"))
        .where(uniform("k", "i", "row", seed=seed) < F.col("w") * rate)
        .select("k", "i", F.greatest("w", F.lit(1 / rate)).alias("w"))
        .toPandas()
        .sort_values(["k", "i"])
    )
    if not len(found):
        return []
    upto = found.w.cumsum().to_numpy()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    picks = [(int(found.k.iloc[i]), int(found.i.iloc[i])) for i in at]
    heavy = {k for (k, _), (n, _) in zip(picks, picks[1:], strict=False) if k == n}
    return sorted({(k, i if k in heavy else LEAST_LONG) for k, i in picks} | {(k, LEAST_LONG) for k in heavy})


def range_numbers(keys: np.ndarray, ids: np.ndarray, splitters: list[tuple[int, int]]) -> np.ndarray:
    """How many splitters are at or below each (key, id)."""
    if not splitters:
        return np.zeros(len(keys), np.int64)
    k, i = (np.array(x, dtype=np.int64) for x in zip(*splitters, strict=True))
    low, high = np.searchsorted(k, keys, "left"), np.searchsorted(k, keys, "right")
    out = low.copy()
    for a in np.unique(low[low < high]):
        rows = (low == a) & (high > a)
        out[rows] = a + np.searchsorted(i[a : high[rows][0]], ids[rows], "right")
    return out


def range_column(splitters: list[tuple[int, int]], key: str, row_id: str):
    """The range number of each row as a column."""

    @F.pandas_udf("long")
    def number(k: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(k.to_numpy(np.int64), i.to_numpy(np.int64), splitters))

    least = F.lit(LEAST_LONG)
    return number(F.coalesce(F.col(key), least), F.coalesce(F.col(row_id), least))


def shard_by_size(rows: DataFrame, scratch: Scratch, key: str = "key", row_id: str = "doc_id", size: str = "size", shards: int = 16, range_bytes: int = 8 << 20, together: float = 0.01) -> DataFrame:
    """rows with `shard` (0 to shards - 1, int) and `slot` (0, 1, ... inside each shard in key order, long).

    key, row_id and size are longs without nulls. row_id orders the rows of a key; rows that are equal in both lie in one
    range and may swap slots. Every shard's size differs from the mean by the largest row plus `together` of a shard at
    most: groups of equal keys up to that part of a shard stay whole. Other columns pass through. An empty table gives none.
    """
    rows = scratch.cut(rows)  # read several times below, of which only the last needs more than three columns
    light = rows.select(key, row_id, size)
    totals = light.agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).first()
    total = totals["size"] or 0
    ranges = int(min(max(4 * shards, total // range_bytes), 20_000)) if totals["n"] > shards else 1
    splitters = weighted_splitters(light, key, row_id, size, ranges, total)

    def sizes(splitters):
        found = light.groupBy(range_column(splitters, key, row_id).alias("r")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        return {x["r"]: (x["size"], x["n"]) for x in found.collect()}  # one row a range

    held = sizes(splitters)
    over = [r for r, (s, n) in held.items() if s > 2.5 * total / max(1, ranges) and n > 1]
    if over:
        inside = light.where(range_column(splitters, key, row_id).isin(over))
        more = weighted_splitters(inside, key, row_id, size, 4 * sum(int(held[r][0] * ranges // total) for r in over), sum(held[r][0] for r in over), seed=2)
        splitters = sorted({*splitters, *more})
        held = sizes(splitters)
    before, count = {}, {}
    s = n = 0
    for r in sorted(held):
        before[r], count[r] = s, n
        s, n = s + held[r][0], n + held[r][1]
    if not held:
        return rows.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    start = rows.sparkSession.createDataFrame([(r, before[r], count[r]) for r in held], "_r long, _size_before long, _rows_before long")
    inside = W.partitionBy("_r").orderBy(key, row_id).rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy("_r", key)
    placed = (
        rows.withColumn("_r", range_column(splitters, key, row_id))
        .withColumns({"_upto": F.sum(size).over(inside), "_n": F.row_number().over(inside)})
        .withColumns({"_group": F.sum(size).over(group), "_from": F.min(F.col("_upto") - F.col(size)).over(group)})
        .join(F.broadcast(start), "_r")  # one row a range, 20,000 at most before overfull ones are cut
        .withColumn("_small", F.col("_group") <= together * total / shards)
        .withColumn("_mid", F.col("_size_before") + F.when(F.col("_small"), F.col("_from") + F.col("_group") / 2).otherwise(F.col("_upto") - F.col(size) / 2))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_mid") * shards / F.lit(float(total)))).cast("int"))
        .withColumn("_row", F.col("_rows_before") + F.col("_n") - 1)
        .drop("_r", "_upto", "_n", "_group", "_from", "_small", "_mid", "_size_before", "_rows_before")
    )
    placed = scratch.cut(placed)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).drop("_row", "_first")


def text_key(text):
    """A 60-bit key of a text from its MD5, the same for equal texts."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def document_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; a null text has none), CRC-32 and key of each text (null: as empty), the id that
    orders equal texts (a number of its own for each row without doc_id), and columns named in more."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.monotonically_increasing_id())).alias("order_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_key(text).alias("key"),
        *more,
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place of every document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null: no such law).

    A null text counts as an empty one, of size 1. A null doc_id stays null; its rows are placed by text like any other.
    Repeated rows are placed one by one, equal texts next to each other by doc_id. Other columns are ignored; an empty table
    gives no row.
    """
    placed = shard_by_size(document_rows(docs), Scratch(docs.sparkSession), row_id="order_id", shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Every document row, whole, in its shard, as a Parquet table partitioned by shard and sorted by slot. A column of docs
    named shard or slot gives way."""
    whole = document_rows(docs.select("*", F.struct(*[docs[c] for c in docs.columns]).alias("_row_")), "_row_")
    placed = shard_by_size(whole, Scratch(docs.sparkSession), row_id="order_id", shards=shards).select("_row_.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    placed = placed.drop("shard", "slot").withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    rows = placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
