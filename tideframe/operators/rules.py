"""Market filters as columns: rules on daily bars, profile nodes, bands, regimes, and how many of them agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_rules(days: DataFrame, series: list[str], order: str, wick: float = 1.0) -> DataFrame:
    """days (open, high, low, close) with `continuation` (1: the close is above the body of the day before, -1: below it) and
    `rejection` (-1: an upper wick of `wick` bodies at least, else 1: such a lower one); 0: neither. A day without body
    rejects nothing; the first day of a series continues nothing."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    before = W.partitionBy(*series).orderBy(order)
    body = top - bottom
    up = F.when(F.col("close") > F.lag(top).over(before), 1).when(F.col("close") < F.lag(bottom).over(before), -1).otherwise(0)
    back = F.when(body <= 0, 0).when((F.col("high") - top) >= wick * body, -1).when((bottom - F.col("low")) >= wick * body, 1).otherwise(0)
    return days.withColumns({"continuation": up, "rejection": back})


def node_levels(profile: DataFrame, keys: list[str], price: str, volume: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Of each profile: arrays of its low- and high-volume prices (volume at or beyond the order statistic of that rank,
    rounded down) and the price of most volume (the least of several)."""
    group = W.partitionBy(*keys)
    rank, n = F.row_number().over(group.orderBy(volume, price)), F.count(F.lit(1)).over(group)
    rows = profile.withColumns({"_k": rank, "_n": n})
    at = lambda q: F.max(F.when(F.col("_k") == F.floor(q * (F.col("_n") - 1)) + 1, F.col(volume))).over(group)
    rows = rows.withColumns({"_low": at(low), "_high": at(high)})
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(price))))
    return rows.groupBy(*keys).agg(
        pick(F.col(volume) <= F.col("_low")).alias("low_nodes"), pick(F.col(volume) >= F.col("_high")).alias("high_nodes"), F.max_by(price, F.struct(F.col(volume), -F.col(price))).alias("poc")
    )


def low_node_entry(price: Column, side: Column, tolerance: float) -> Column:
    """Whether a price near a low-volume node may be entered: below the point of control with a high-volume node under it for
    a long, the mirror image for a short (columns low_nodes, high_nodes, poc; side 1 or -1)."""
    near = F.exists("low_nodes", lambda x: F.abs(price - x) <= tolerance)
    long = (price < F.col("poc")) & F.exists("high_nodes", lambda x: x < price)
    short = (price > F.col("poc")) & F.exists("high_nodes", lambda x: x > price)
    return near & F.when(side > 0, long).otherwise(short)


def band_reversion(price: Column, mean: Column, sd: Column, bands: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0), most: float = 2.5) -> tuple[Column, Column]:
    """(side, band): the farthest band that a price has reached and the side back to the mean; no side beyond `most`. Both
    null without a deviation or a band reached."""
    z = (price - mean) / sd
    band = F.when(sd > 0, F.greatest(*[F.when(F.abs(z) >= b, F.lit(b)) for b in bands], F.lit(None).cast("double")))
    return F.when(band <= most, F.when(z > 0, -1).otherwise(1)), band


def persistence(at_touch: Column, before: Column) -> Column:
    """Share of resting size that is still there at the touch; nought if none was shown."""
    return F.when(before <= 0, 0.0).otherwise(F.try_divide(at_touch, before))


def gamma_regime(gamma: Column, spot: Column, flip: Column, neutral: float = 0.15) -> Column:
    """"transition" within `neutral` per cent of the flip level, or without gamma; else "reversion" or "momentum" by sign."""
    away = F.when(spot > 0, 100 * (spot - flip) / spot)
    return F.when(F.abs(away) <= neutral, "transition").when(gamma > 0, "reversion").when(gamma < 0, "momentum").otherwise("transition")


def confluence(layers: list[Column], least: float) -> tuple[Column, Column]:
    """(score, passed): the share of layers that are true (null counts as false), and whether it reaches `least`."""
    score = sum((F.coalesce(x, F.lit(False)).cast("int") for x in layers[1:]), F.coalesce(layers[0], F.lit(False)).cast("int")) / len(layers)
    return score, score >= least


def pivot_kinds(swings: DataFrame, series: list[str], order: str) -> DataFrame:
    """Swings (price, is_high) with their kind against the swing before of the same nature: HH, LH, HL or LL; equal counts as
    lower. The first of each nature has none."""
    before = F.lag("price").over(W.partitionBy(*series, "is_high").orderBy(order))
    kind = F.when(F.col("is_high"), F.when(F.col("price") > before, "HH").otherwise("LH")).otherwise(F.when(F.col("price") > before, "HL").otherwise("LL"))
    return swings.withColumn("kind", F.when(before.isNotNull(), kind))


def window_rank(rows: DataFrame, series: list[str], order: str, value: str, width: int) -> DataFrame:
    """rows with the place of a value in the `width` values before it: `rank` between their least and greatest (a half if
    these are equal) and `percentile`, the share of them below it; null until there are so many."""
    past = W.partitionBy(*series).orderBy(order).rowsBetween(-width, -1)
    x, lo, hi = F.col(value), F.min(value).over(past), F.max(value).over(past)
    rows = rows.withColumn("_past", F.when(F.count(value).over(past) == width, F.collect_list(value).over(past)))
    return rows.withColumns(
        {"rank": F.when(F.col("_past").isNotNull(), F.when(hi <= lo, 0.5).otherwise((x - lo) / (hi - lo))), "percentile": F.size(F.filter("_past", lambda y: y < x)) / F.size("_past")}
    ).withColumn("percentile", F.when(F.col("_past").isNotNull(), F.col("percentile"))).drop("_past")


def half_width(spot: Column, sigma: Column, days: Column) -> Column:
    """Half the width of a gamma zone in points; null unless all three are above nought."""
    move = F.exp(F.sqrt(F.lit(2.0) * F.log(F.lit(2.0))) * sigma * F.sqrt(days / 365)) - 1
    return F.when((spot > 0) & (sigma > 0) & (days > 0), spot * move)
