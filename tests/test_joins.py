"""Joins against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideframe import registry
from tideframe.operators import joins as J

from .conftest import SMALL


def test_overlap_counts_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], lo, lo + rng.randrange(6)) for i in range(120) for lo in [rng.randrange(60)]]
    rows += [(200, None, 1, 9), (201, "a", None, 9), (202, "a", 3, None), rows[0]]
    got = J.overlap_counts(spark.createDataFrame(rows, "id long, k string, lo long, hi long"), ["k"], "lo", "hi", "n").collect()
    whole = [(j, r) for j, r in enumerate(rows) if None not in r]
    want = [(r[0], sum(j != i and q[1] == r[1] and q[2] <= r[3] and r[2] <= q[3] for j, q in whole) if None not in r else 0) for i, r in enumerate(rows)]
    assert sorted((r["id"], r["n"]) for r in got) == sorted(want)


def test_overlap_counts_take_every_order(spark):
    got = registry.queries()["trial_overlap_counts"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_all_news_takes_every_event(spark):
    """Where most events are news of weight, few hours of the table are free of them."""
    few, every = (registry.queries()[n](spark, SMALL).where("holds") for n in ("cond_news_anti", "cond_news_anti_all"))
    assert every.count() < few.count()
    hours = spark.read.parquet(f"{SMALL}/events.parquet").where("event_id % 3 >= 1").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).distinct()
    assert every.select(F.explode(F.sequence("t", F.col("t") + 2)).alias("h")).join(hours, "h").count() == 0


def test_fifo_flips_against_single_units(spark):
    """Every unit by itself: the oldest open unit of the other side is closed first."""
    from collections import defaultdict

    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").collect()
    want, books = defaultdict(float), defaultdict(list)
    for r in li:
        side, price, open_ = "B" if r["l_linestatus"] == "O" else "S", float(r["l_extendedprice"]), books[r["l_suppkey"]]
        for _ in range(round(float(r["l_quantity"]))):
            if open_ and open_[0][0] != side:
                first, entry = open_.pop(0)
                want[r["l_suppkey"], "long" if first == "B" else "short", entry, price] += 1
            else:
                open_.append((side, price))
    got = defaultdict(float)
    for r in registry.queries()["fifo_flips"](spark, SMALL).collect():
        got[r["book"], r["side"], r["entry"], r["exit"]] += r["matched"]
    assert len(want) > 1000 and got == want


def test_overlaps_of_small_tables_are_dealt_to_tasks(spark):
    """Every pair of many meeting intervals, from several tasks, though the tables are a few rows in one."""
    rows = spark.createDataFrame([(k, i, i % 90, i % 90 + i % 7) for k in "abcdefgh" for i in range(40)], "k string, id long, lo long, hi long").coalesce(1)
    other = rows.select("k", F.col("id").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    got = J.overlapping(rows, other, ["k"], "lo", "hi", "lo2", "hi2", 4)
    plain = rows.join(other, "k").where("lo <= hi2 and lo2 <= hi")
    assert sorted(got.select("id", "other").collect()) == sorted(plain.select("id", "other").collect())
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("most", [3, 1024])
def test_overlaps_of_alike_intervals_against_a_plain_join(spark, monkeypatch, most):
    """Lists of rows of one interval lose no pair and add none: cut lists, copies, nulls, intervals that end before they begin."""
    monkeypatch.setattr(J, "MOST_ALIKE", most)
    rng = random.Random(3)
    draw = lambda n: [(rng.choice(["a", "b", None]), i // 2, x := rng.choice([None, *range(-12, 12)]), rng.choice([None, *[x + d for d in (-2, 0, 0, 1, 5, 9)]] if x is not None else [1])) for i in range(n)]
    rows = spark.createDataFrame([*draw(250), *[("a", 900 + i, 3, 4) for i in range(10)]], "k string, id long, lo long, hi long")
    other = spark.createDataFrame([*draw(250), *[("a", 900 + i, 4, 4) for i in range(10)]], "k string, other long, lo2 long, hi2 long")
    got = J.overlapping(rows, other, ["k"], "lo", "hi", "lo2", "hi2", 4)
    columns = ["k", "id", "lo", "hi", "other", "lo2", "hi2"]
    plain = rows.join(other, "k").where("lo <= hi2 and lo2 <= hi").select(columns).collect()
    assert len(plain) > 1000 and sorted(got.select(columns).collect()) == sorted(plain)


def test_written_overlaps_of_alike_intervals_are_small(spark, tmp_path):
    """Written pairs of many rows of few intervals take far less than a number each."""
    rows = spark.range(6000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("id"), (F.col("id") % 30).alias("lo"), (F.col("id") % 30 + F.col("id") % 4).alias("hi"))
    other = rows.select("k", F.col("id").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    J.overlapping(rows, other, ["k"], "lo", "hi", "lo2", "hi2", 8).select("id", "other").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    plain = rows.join(other, "k").where("lo <= hi2 and lo2 <= hi").count()
    assert pairs == plain > 1_000_000
    written = sum(f.stat().st_size for f in (tmp_path / "pairs").rglob("*.parquet"))
    print("bytes a pair", written / pairs)
    assert written < pairs // 4
