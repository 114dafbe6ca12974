"""Contacts with levels and what follows them; levels of pasted texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import inputs as I
from ..registry import register
from ..sources import level_files as L
from .common import r6, r6_sql

GRAMMAR = C.Grammar(start=144, sigma=5.0, rearm=10.0, step=2.0, threshold=25.0)


def flow_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of five minutes with the difference of what odd and even events traded (delta)."""
    ticks = I.ticks(spark, sf_dir)
    delta = ticks.groupBy("instrument", F.floor(F.col("sec") / 300).alias("t")).agg(F.sum(F.when(F.col("event_id") % 2 == 1, F.col("size")).otherwise(-F.col("size"))).alias("delta"))
    return I.bars(spark, sf_dir, 300).join(delta, ["instrument", "t"])


def found_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = flow_bars(spark, sf_dir)
    return C.contacts(bars, C.level_kinds(bars, GRAMMAR), GRAMMAR)


@register("setup_contacts")
def setup_contacts(spark, sf_dir):
    """Contacts of each kind of level; levels and swings follow paths, so tests hold them against a plain loop."""
    rows = found_contacts(spark, sf_dir)
    return rows.select("instrument", "session", "t", "kind", r6(F.col("price"), "price"), "side", F.array_join("confirmed", ",").alias("confirmed"), F.array_join("refuted", ",").alias("refuted"), *[r6(F.col(x), x) for x in ("follow", "best", "worst")])


@register("setup_measures")
def setup_measures(spark, sf_dir):
    """Frequencies and outcomes of the setups over all sessions; held by tests as setup_contacts."""
    sessions = I.bars(spark, sf_dir).select("instrument", "session").distinct().count()
    rows = C.setup_measures(found_contacts(spark, sf_dir), sessions, GRAMMAR)
    return rows.select("kind", "confirmation", "contacts", r6(F.col("a_session"), "a_session"), "held", r6(F.col("held_share"), "held_share"), r6(F.col("lost_share"), "lost_share"), "free_held", *[r6(F.col(x), x) for x in ("p_any", "p_held", "gain", "pain")])


BANDED = """bd AS (SELECT *, sum(v) OVER u AS w, sum((h + l + c) / 3 * v) OVER u / nullif(sum(v) OVER u, 0) AS m, sum((h + l + c) / 3 * ((h + l + c) / 3) * v) OVER u / nullif(sum(v) OVER u, 0) AS q, count(*) OVER s AS all_bars, row_number() OVER (PARTITION BY instrument, session ORDER BY t) AS i, lag(c) OVER u0 AS last_c
FROM fb WINDOW u AS (PARTITION BY instrument, session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u0 AS (PARTITION BY instrument, session ORDER BY t), s AS (PARTITION BY instrument, session)),
lv AS (SELECT *, unnest([m - 2 * sqrt(greatest(q - m * m, 0)), m + 2 * sqrt(greatest(q - m * m, 0))]) AS price FROM bd WHERE w > 0 AND greatest(q - m * m, 0) > 0 AND sessmin >= 144 AND i < all_bars)"""


@register(
    "band_contacts",
    f"WITH {I.TICKS_SQL}, {I.bars_sql(300, 'fb')}, {BANDED} SELECT instrument, session, t, {r6_sql('price', 'price')}, CASE WHEN last_c < price THEN 1 ELSE -1 END AS side FROM lv WHERE price BETWEEN l AND h",
)
def band_contacts(spark, sf_dir):
    """Contacts with the bands two deviations from the session's mean price; each bar's bands are levels of their own."""
    bars = flow_bars(spark, sf_dir)
    return C.contacts(bars, C.band_levels(bars), GRAMMAR).select("instrument", "session", "t", r6(F.col("price"), "price"), "side")


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pasted text for each brand of parts: an expiry, a part's words and price a line, and a table of weights by price."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat_ws(" : ", F.concat(F.col("p_type"), F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" x")), F.format_string("%.2f", "p_retailprice"))
    strike = F.concat_ws(",", F.format_string("%d", F.floor(F.col("p_retailprice") / 50) * 50 + 7), F.format_string("%d", F.col("p_size") * F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", c.alias("x")))), lambda r: r["x"]), "\n")
    body = p.groupBy("p_brand").agg(listed(line).alias("a"), listed(strike).alias("b"))
    return body.select(F.col("p_brand").alias("file"), F.concat(F.lit("# Context\nhorizon: 0 dte\n## Levels\n"), "a", F.lit("\n\n# notes\n900 : not read\n# Data\nStrike,Net gex\n"), "b").alias("value"))


MID = 1400.0


@register(
    "levels_text",
    f"""WITH n AS (SELECT p_brand AS file, '0' || upper(p_type || ' ' || p_partkey || ' X') AS name, round(p_retailprice, 2) AS price, 3 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, count(*) OVER (PARTITION BY p_brand) AS all_lines FROM part),
k AS (SELECT *, quantile_cont(price, 0.5) OVER (PARTITION BY file) AS m FROM n), kept AS (SELECT file, name, price, line FROM k WHERE abs(price - m) <= abs(m) * 20 / 100.0),
w AS (SELECT p_brand AS file, floor(p_retailprice / 50) * 50 + 7.0 AS price, sum(p_size) AS w, min(row_number) AS i, any_value(all_lines) AS all_lines FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_number, count(*) OVER (PARTITION BY p_brand) AS all_lines FROM part) GROUP BY 1, 2),
f AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.file = w.file AND abs(kept.price - w.price) < 0.25)),
r AS (SELECT *, row_number() OVER (PARTITION BY file, price > {MID} ORDER BY w DESC, i) AS r FROM f)
SELECT file, name, price, CAST(line AS INTEGER) AS line FROM kept UNION ALL SELECT file, '0' || CASE WHEN price > {MID} THEN 'R' ELSE 'S' END || r, price, CAST(3 + all_lines + 5 + i AS INTEGER) FROM r WHERE r <= 2""",
)
def levels_text(spark, sf_dir):
    """Levels read from pasted texts: named ones inside the plausible window, and the heaviest strikes around a price."""
    return L.parse_level_texts(pasted(spark, sf_dir), MID)


@register("poc_of_first_half", f"""WITH {I.TICKS_SQL}, {I.bars_sql(300, 'fb')}, p AS (SELECT instrument, session, CAST(floor(c / 2.0 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM fb WHERE sessmin < 144 GROUP BY 1, 2, 3)
SELECT instrument, session, min(bin) FILTER (n = m) * 2.0 AS price FROM (SELECT *, max(n) OVER (PARTITION BY instrument, session) AS m FROM p) GROUP BY 1, 2""")
def poc_of_first_half(spark, sf_dir):
    """The price that most closes of each session's first half met."""
    found = C.profile_levels(flow_bars(spark, sf_dir), GRAMMAR).where("kind = 'control'")
    return found.select("instrument", "session", "price")


