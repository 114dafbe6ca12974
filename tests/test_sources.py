"""File dialects, cleaning, codecs, and streams over small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideframe.operators import bars as B
from tideframe.operators import inputs as I
from tideframe.sources import bar_files, text, trade_files
from tideframe.streaming import flows

from .conftest import SMALL

WANT = [(29461860, 100.0, 101.5, 99.0, 101.0, 10.0), (29461861, 101.0, 102.0, 100.5, 100.75, 12.0)]
FILES = {
    "iso": "timestamp,open,high,low,close,volume\n2026-01-06 15:00:00,100,101.5,99,101,10\n2026-01-06 15:01:00,101,102,100.5,100.75,12\n",
    "comma_decimals": "Date;Heure;Ouverture;Haut;Bas;Clôture;Volume\n06/01/2026;15:00:00;100,0;101,5;99,0;101,0;10\n06/01/2026;15:01:00;101,0;102,0;100,5;100,75;12\n",
    "epoch": "1767711600,100,101.5,99,101,10\n1767711660,101,102,100.5,100.75,12\n",
    "epoch_ms": "time;open;high;low;close;volume\n1767711600000;100;101.5;99;101;10\n1767711660000;101;102;100.5;100.75;12\n",
    "month_first": "Date\tOpen\tHigh\tLow\tClose\tVolume\n01/06/2026 15:00:00\t100\t101.5\t99\t101\t10\n01/06/2026 15:01:00\t101\t102\t100.5\t100.75\t12\n",
    "repeated": "timestamp,open,high,low,close,volume\n2026-01-06 15:01:00,1,1,1,1,1\n2026-01-06 15:00:00,100,101.5,99,101,10\n2026-01-06 15:01:00,101,102,100.5,100.75,12\n",
}


@pytest.mark.parametrize("name", [k for k in FILES if k != "month_first"])
def test_dialects(spark, tmp_path, name):
    (tmp_path / "f.csv").write_text(FILES[name])
    bars, warnings = bar_files.read_tolerant(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in bars.orderBy("t").collect()] == WANT
    assert warnings.first()["repeated"] == (1 if name == "repeated" else 0)


def test_strict_refuses_slashes(spark, tmp_path):
    (tmp_path / "f.csv").write_text("timestamp,open,high,low,close\n01/06/2026 15:00,1,1,1,1\n")
    with pytest.raises(ValueError):
        bar_files.read_strict(spark, str(tmp_path / "f.csv"))
    (tmp_path / "g.csv").write_text("close,timestamp,open,high,low\n5,2026-01-06T09:31:00,1,6,1\n7,2026-01-06T09:31:00,1,8,1\n1,2026-01-06T20:00:00,1,1,1\n")
    rows = bar_files.read_strict(spark, str(tmp_path / "g.csv")).collect()
    assert [(r["minute"], r["c"]) for r in rows] == [(1, 7.0)]


@pytest.mark.parametrize(("raw", "want"), [("1,234.50", 1234.5), ("1.234,50", 1234.5), ("(25.5)", -25.5), ("1 234,5", 1234.5), ("$12", 12.0), ("1,234", 1234.0), ("12,5", 12.5), ("x", None)])
def test_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(text.number(F.col("s"))).first()[0] == want


def test_assets_round_trip(spark, tmp_path):
    bars = I.bars(spark, SMALL)
    bar_files.write_assets(bars, str(tmp_path / "a"), 10_000)
    back = bar_files.read_assets(spark, str(tmp_path / "a"))
    assert back.count() == bars.count()
    gap = back.join(bars.select("instrument", "t", F.col("c").alias("c0")), ["instrument", "t"]).agg(F.max(F.abs(F.col("c") - F.col("c0")))).first()[0]
    assert gap <= 1e-4


def test_session_key_follows_daylight_saving(spark):
    rows = [(dt.datetime(2026, 1, 5, 22, 59),), (dt.datetime(2026, 1, 5, 23, 0),), (dt.datetime(2026, 7, 6, 22, 0),)]
    keys = [str(r[0]) for r in spark.createDataFrame(rows, "ts timestamp").select(B.session_key(F.col("ts"))).collect()]
    assert keys == ["2026-01-05", "2026-01-06", "2026-07-07"]


def test_trades_and_levels(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Symbol,B/S,Qty,Avg Fill Price,Fill Time,Status,Commission\nNQH6,Buy,2,100.5,2026-01-06 15:00:00,Filled,1.2\nNQH6,Sell,2,101,2026-01-06 15:05:00,Cancelled,0\n")
    rows = trade_files.read_trades(spark, str(tmp_path / "t.csv")).collect()
    assert [(r["root"], r["side"], r["qty"], r["price"]) for r in rows] == [("NQ", "B", 2.0, 100.5)]
    lines = spark.createDataFrame([("HVL : 21450.25",), ("21500 = Max Pain",), ("**Gamma Wall** | 21700",), ("## heading",), ("R1: 3",)], "value string")
    got = {(r["name"], r["price"]) for r in trade_files.parse_levels(lines, 1000.0).collect()}
    assert got == {("HVL", 21450.25), ("MAX PAIN", 21500.0), ("GAMMA WALL", 21700.0)}


def test_journal_is_safe(spark, tmp_path):
    trade_files.write_journal(spark.createDataFrame([("=1+1", 1.5)], "note string, r double").coalesce(1), str(tmp_path / "j"))
    body = "".join(p.read_text() for p in (tmp_path / "j").glob("*.csv"))
    assert "'=1+1;1,5" in body


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.read.parquet(f"{SMALL}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = flows.stream_bars(flows.tick_stream(spark, str(tmp_path / "in"), schema), "1 hour", "0 seconds")
    q = made.writeStream.format("memory").queryName("sb").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["instrument"], r["window"]["start"].timestamp() // 3600): (r["o"], r["h"], r["l"], r["c"], r["n"]) for r in spark.sql("select * from sb").collect()}
    want = {(r["instrument"], r["t"]): (r["o"], r["h"], r["l"], r["c"], r["n"]) for r in I.bars(spark, SMALL).collect()}
    assert set(got.values()) == set(want.values()) and len(got) == len(want)


def test_tape_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("long NQ breakout\nnoise\nSELL ES\n")
    flows.record_tape(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "me").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("instrument").collect()
    assert [(r["instrument"], r["side"], r["note"]) for r in rows] == [("ES", "short", ""), ("NQ", "long", "breakout")]


def test_all_lines_tell_the_date_order(spark, tmp_path):
    """Month-first dates whose first day beyond the 12th comes after more than 2,000 lines."""
    at = [dt.datetime(2026, 3, 10) + dt.timedelta(minutes=2 * i) for i in range(3000)]
    lines = [f"{x:%m/%d/%Y %H:%M};1,5;2,5;1;2;7" for x in at]
    (tmp_path / "m.csv").write_text("\n".join(["time;open;high;low;close;volume", *lines, "no bar at all"]))
    bars, warnings = bar_files.read_tolerant(spark, str(tmp_path / "m.csv"))
    first = int(at[0].replace(tzinfo=dt.UTC).timestamp()) // 60
    assert sorted(r["t"] for r in bars.select("t").collect()) == [first + 2 * i for i in range(3000)]
    got = warnings.first()
    assert (got["lines"], got["unread"], got["ambiguous"]) == (3000, 1, False)
    (tmp_path / "a.csv").write_text("\n".join(["time;open;high;low;close;volume", *lines[:50]]))
    assert bar_files.read_tolerant(spark, str(tmp_path / "a.csv"))[1].first()["ambiguous"]
