"""Volume profile, market profile, footprint and option exposure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import closed_forms as cf
from ..functions import discrete
from .blocks import running_sums


def volume_by_price(ticks: DataFrame, keys: list[str], price: str, size: str, step: float) -> DataFrame:
    """Volume of each price bin; profiles on the same grid add up."""
    return ticks.groupBy(*keys, F.floor(F.col(price) / step).alias("bin")).agg(F.sum(size).alias("volume"))


def point_of_control(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Bin of most volume, the lowest on a tie, and the total."""
    return profile.groupBy(*keys).agg(F.max_by("bin", F.struct("volume", -F.col("bin"))).alias("poc"), F.sum("volume").alias("total"), F.count(F.lit(1)).alias("bins"))


def value_area(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Point of control and the bins around it that hold a share of the volume, grown towards the larger neighbour (up on a tie).

    Growth depends on the path; a profile has as many rows as its session has price bins, so it is one group.
    """
    schema = ", ".join(f"{k} {dict(profile.dtypes)[k]}" for k in keys) + ", poc long, low long, high long, held double"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(pdf["bin"].astype(int), pdf["volume"].astype(float), strict=True))
        lo_end, hi_end, total = min(held), max(held), sum(held[b] for b in sorted(held))
        poc = min(b for b, v in held.items() if v == max(held.values()))
        lo = hi = poc
        have = held[poc]
        while have < share * total and (lo > lo_end or hi < hi_end):
            up = held.get(hi + 1, 0.0) if hi < hi_end else -1.0
            down = held.get(lo - 1, 0.0) if lo > lo_end else -1.0
            if up >= down:
                hi, have = hi + 1, have + up
            else:
                lo, have = lo - 1, have + down
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], poc, lo, hi, have]], columns=[*keys, "poc", "low", "high", "held"])

    return profile.groupBy(*keys).applyInPandas(grow, schema)


def nodes(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Local peaks and valleys of volume against both neighbours."""
    w = W.partitionBy(*keys).orderBy("bin")
    rows = profile.withColumns({"below": F.lag("volume").over(w), "above": F.lead("volume").over(w)})
    kind = F.when((F.col("volume") > F.col("below")) & (F.col("volume") >= F.col("above")), "high").when((F.col("volume") < F.col("below")) & (F.col("volume") <= F.col("above")), "low")
    return rows.withColumn("node", kind).where("node is not null").drop("below", "above")


def with_empty_bins(profile: DataFrame, keys: list[str]) -> DataFrame:
    """profile with the first and the last empty bin of each gap inside it, of no volume. What lies between them is level."""
    after = F.lead("bin").over(W.partitionBy(*keys).orderBy("bin"))
    rows = profile.select(*keys, "bin", F.col("volume").cast("double").alias("volume"), after.alias("_next"))
    ends = F.when(F.col("_next") - F.col("bin") > 1, F.array_distinct(F.array(F.col("bin") + 1, F.col("_next") - 1)))
    empty = rows.select(*keys, F.explode(ends).alias("bin"), F.lit(0.0).alias("volume"))
    return rows.drop("_next").unionByName(empty)


def saddles(x: np.ndarray) -> np.ndarray:
    """Of each value: the least that lies before it back to the nearest strictly greater one, or to the end of the row.

    A falling stack holds the values that no later one has passed, each with the least value since the one below it; every
    value enters and leaves it once.
    """
    out, stack = np.empty(len(x)), []
    for i, v in enumerate(x.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        out[i] = least
        stack.append((v, least))
    return out


def prominences(x: np.ndarray) -> np.ndarray:
    """How far each value stands above the higher of the two saddles that part it from greater ones."""
    return x - np.maximum(saddles(x), saddles(x[::-1])[::-1])


def prominent_nodes(profile: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """Peaks (`high`) and valleys (`low`) of volume inside each profile whose prominence is at least a part of its greatest
    volume: keys, bin, node, volume, prominence.

    A peak is not below its neighbours and above one of them; its prominence is its height over the higher of the two saddles
    to greater volumes on either side (or to the profile's end). Valleys are the same upside down. Empty bins count as such;
    of a gap its first and last. A profile has as many rows as prices have bins in a session, so it is one group.
    """
    schema = ", ".join(f"{k} {dict(profile.dtypes)[k]}" for k in keys) + ", bin long, node string, volume double, prominence double"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        x, parts = pdf["volume"].to_numpy(float), []
        most = x.max()
        for name, y in (("high", x), ("low", -x)):
            node = np.zeros(len(y), bool)
            node[1:-1] = (y[1:-1] >= y[:-2]) & (y[1:-1] >= y[2:]) & ((y[1:-1] > y[:-2]) | (y[1:-1] > y[2:]))
            p = prominences(y)
            node &= (most > 0) & (p >= least * most)
            parts.append(pdf[node][[*keys, "bin"]].assign(node=name, volume=x[node], prominence=p[node]))
        return pd.concat(parts)

    return with_empty_bins(profile, keys).groupBy(*keys).applyInPandas(find, schema)


#: The greatest local deviation, in parts of the reference.
MOST_SIGMA = 4.0


def local_sigma(volume: Column, mean: Column) -> Column:
    """Local deviation over that of the whole profile: time spent at a price goes with one over the variance there."""
    return F.when(volume > 0, F.least(F.sqrt(mean / volume), F.lit(MOST_SIGMA))).otherwise(F.lit(MOST_SIGMA))


def profile_means(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Each profile's lowest and highest bin and its mean volume a bin, empty ones included."""
    return profile.groupBy(*keys).agg(F.min("bin").alias("low"), F.max("bin").alias("high"), (F.sum("volume") / (F.max("bin") - F.min("bin") + 1)).alias("mean_volume"))


def traversal_times(profile: DataFrame, spans: DataFrame, keys: list[str], step: float, sigma: float) -> DataFrame:
    """spans (keys, start, stop: bins) with the mean time to cross them from end to end: the sum of (step / local sigma) ** 2
    over their bins, in units of sigma's time. Bins outside the profile do not count."""
    means = profile_means(profile, keys)
    told = spans.join(means, keys).withColumns({"_from": F.greatest(F.least("start", "stop"), "low"), "_to": F.least(F.greatest("start", "stop"), "high")})
    bins = profile.join(told, keys).where(F.col("bin").between(F.col("_from"), F.col("_to")))
    slow = F.pow(F.lit(step / sigma) / local_sigma(F.col("volume"), F.col("mean_volume")), 2)
    found = bins.groupBy(*keys, "start", "stop").agg(F.sum(slow).alias("_slow"), F.count(F.lit(1)).alias("_met"))
    empty = F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0)) - F.coalesce("_met", F.lit(0))
    out = told.join(found, [*keys, "start", "stop"], "left")
    return out.select(*keys, "start", "stop", (F.coalesce("_slow", F.lit(0.0)) + empty * (step / sigma / MOST_SIGMA) ** 2).alias("minutes"))


def market_profile(bars: DataFrame, keys: list[str], period: str, tick: float) -> DataFrame:
    """Time periods that touched each price level."""
    level = F.explode(F.sequence(F.floor(F.col("l") / tick), F.floor(F.col("h") / tick))).alias("level")
    return bars.select(*keys, F.col(period).alias("period"), level).groupBy(*keys, "level").agg(F.countDistinct("period").alias("periods"))


def market_profile_summary(bars: DataFrame, keys: list[str], period: str, tick: float) -> DataFrame:
    """Level of most periods (closest to the middle, then the lowest, on a tie), single prints, range and initial balance."""
    profile = market_profile(bars, keys, period, tick)
    ends = profile.groupBy(*keys).agg(F.min("level").alias("low"), F.max("level").alias("high"), F.max("periods").alias("most"), F.count_if(F.col("periods") == 1).alias("single_prints"))
    middle = F.abs(2 * F.col("level") - F.col("low") - F.col("high"))
    poc = profile.join(ends, keys).where("periods = most").groupBy(*keys).agg(F.min_by("level", F.struct(middle, "level")).alias("poc"))
    first = W.partitionBy(*keys)
    balance = bars.withColumn("_f", F.min(period).over(first)).where(F.col(period) <= F.col("_f") + 1).groupBy(*keys).agg(F.floor(F.min("l") / tick).alias("balance_low"), F.floor(F.max("h") / tick).alias("balance_high"))
    return ends.drop("most").join(poc, keys).join(balance, keys).withColumn("extended", (F.col("low") < F.col("balance_low")) | (F.col("high") > F.col("balance_high")))


def paired_value_area(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Levels around the one of most periods that hold a share of all prints, grown by pairs of levels on the fuller side (up
    on a tie): keys, poc, low, high. The first of the greatest counts nearest to the middle, then the lowest, is the start.

    Growth depends on the path; a profile has as many rows as its session's prices have levels, so it is one group.
    """
    schema = ", ".join(f"{k} {dict(profile.dtypes)[k]}" for k in keys) + ", poc long, low long, high long"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        level, count = pdf["level"].to_numpy(), pdf["periods"].to_numpy()
        top, last = count.max(), len(count) - 1
        start = min(np.flatnonzero(count == top).tolist(), key=lambda i: (abs(2 * level[i] - level[0] - level[-1]), i))
        lo = hi = start
        while count[lo : hi + 1].sum() < share * count.sum() and (lo > 0 or hi < last):
            below = count[max(0, lo - 2) : lo].sum() if lo > 0 else -1
            above = count[hi + 1 : hi + 3].sum() if hi < last else -1
            lo, hi = (lo, min(hi + 2, last)) if above >= below else (max(lo - 2, 0), hi)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], level[start], level[lo], level[hi]]], columns=[*keys, "poc", "low", "high"])

    return profile.groupBy(*keys).applyInPandas(grow, schema)


def poor_ends(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a session's highest and lowest levels were met by two periods or more, so that no single print ends them."""
    last = lambda f: f("periods", "level")
    return profile.groupBy(*keys).agg((last(F.max_by) >= 2).alias("poor_high"), (last(F.min_by) >= 2).alias("poor_low"))


def absorption(cells: DataFrame, bars: DataFrame, keys: list[str], series: list[str], order: str) -> DataFrame:
    """Of each bar: volume for a unit of range against the series so far (`z`, null before two bars or without spread), and
    whether the traded delta goes against the bar's move (`absorbed`).

    cells: bid and ask volume of each level of a bar; bars: keys, o, h, l, c.
    """
    sums = cells.groupBy(*keys).agg(F.sum(F.col("bid") + F.col("ask")).alias("volume"), F.sum(F.col("ask") - F.col("bid")).alias("delta"))
    rows = bars.join(sums, keys).withColumn("effort", F.col("volume") / (F.col("h") - F.col("l") + 1))
    # sums about the series' mean keep the digits of its variance
    rows = rows.join(rows.groupBy(*series).agg(F.avg("effort").alias("_mean")), series)
    gap = F.col("effort") - F.col("_mean")
    rows = running_sums(rows.withColumn("_gap", gap), series, order, {"_n": F.lit(1), "_s": F.col("_gap"), "_s2": gap * gap}, inclusive=False)
    variance = (F.col("_s2") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    spread = F.when((F.col("_n") >= 2) & (variance > 1e-15 * F.col("_mean") * F.col("_mean")), F.sqrt(variance))
    z = (F.col("_gap") - F.col("_s") / F.col("_n")) / spread
    move = F.col("c") - F.col("o")
    return rows.select(*keys, "volume", "delta", z.alias("z"), F.when(move != 0, F.signum("delta") == -F.signum(move)).otherwise(F.lit(False)).alias("absorbed"))


def footprint(cells: DataFrame, keys: list[str], ratio: float = 3.0, least: float = 10.0) -> DataFrame:
    """Volume, delta, level of most volume, and diagonal imbalances of a ladder of bid and ask volumes."""
    w = W.partitionBy(*keys).orderBy("level")
    rows = cells.withColumns({"bid_below": F.lag("bid").over(w), "ask_above": F.lead("ask").over(w)})
    buy = (F.col("ask") >= least) & (F.col("ask") >= ratio * F.col("bid_below"))
    sell = (F.col("bid") >= least) & (F.col("bid") >= ratio * F.col("ask_above"))
    return rows.groupBy(*keys).agg(
        F.sum(F.col("bid") + F.col("ask")).alias("volume"), F.sum(F.col("ask") - F.col("bid")).alias("delta"), F.max_by("level", F.struct(F.col("bid") + F.col("ask"), -F.col("level"))).alias("poc"),
        F.count_if(buy).alias("buy_imbalances"), F.count_if(sell).alias("sell_imbalances"),
    )


def footprint_null(cells: DataFrame, bars: DataFrame, keys: list[str], ratio: float = 3.0, least: float = 10.0, clump: float = 1.0, impact: float = 1.0) -> DataFrame:
    """What each bar's ladder shows against chance: imbalances seen and those expected with volumes of levels as they are and
    sides drawn evenly, clump by clump; the share of the extreme levels' volume in the median level's (`exhaustion_high`,
    `exhaustion_low`); the move over its volume's (`impact_z`) and the chance of so small a one (`absorption_p`).

    cells: keys, level, bid, ask; bars: keys, o, c. Neighbours are levels that traded one after the other. A quiet neighbour
    counts as one.
    """
    w = W.partitionBy(*keys).orderBy("level")
    rows = cells.withColumns({"_v": F.col("bid") + F.col("ask"), "_top": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("level"))), "_bottom": F.row_number().over(w)})
    rows = rows.withColumns({"_bid_below": F.lag("bid").over(w), "_ask_above": F.lead("ask").over(w), "_v_below": F.lag("_v").over(w), "_v_above": F.lead("_v").over(w)})
    one = lambda c: F.greatest(F.col(c), F.lit(1.0))
    buy = (F.col("ask") >= least) & (F.col("ask") >= ratio * one("_bid_below"))
    sell = (F.col("bid") >= least) & (F.col("bid") >= ratio * one("_ask_above"))
    chance = lambda c: F.when(F.col(c).isNotNull(), discrete.imbalance_chance(F.col("_v"), F.col(c), ratio, least, clump)).otherwise(0.0)
    rows = rows.withColumn("_chance", chance("_v_below") + chance("_v_above"))
    middle = F.percentile("_v", F.lit(0.5))
    made = rows.groupBy(*keys).agg(
        (F.count_if(buy) + F.count_if(sell)).alias("imbalances"), F.sum("_chance").alias("expected"),
        F.try_divide(F.max(F.when(F.col("_top") == 1, F.col("_v"))), middle).alias("exhaustion_high"), F.try_divide(F.max(F.when(F.col("_bottom") == 1, F.col("_v"))), middle).alias("exhaustion_low"), F.sum("_v").alias("_all"),
    )
    z = discrete.impact_z(F.col("c") - F.col("o"), F.col("_all"), impact)
    out = made.join(bars.select(*keys, "o", "c"), keys).withColumn("impact_z", z)
    return out.select(*keys, "imbalances", "expected", "exhaustion_high", "exhaustion_low", "impact_z", discrete.central_chance(F.col("impact_z")).alias("absorption_p"))


def gamma_exposure(chain: DataFrame, keys: list[str], multiplier: float = 100.0) -> DataFrame:
    """Dealer gamma of each strike for a one per cent move: calls add, puts take."""
    g = cf.gamma(F.col("spot"), F.col("strike"), F.col("iv"), F.col("time")) * F.col("open_interest") * multiplier * F.col("spot") * F.col("spot") * 0.01
    return chain.groupBy(*keys, "strike").agg(F.sum(F.when(F.col("kind") == "call", g).otherwise(-g)).alias("gex"))


def walls(exposure: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The strikes of greatest positive and of most negative exposure, ranked; ties by strike."""
    rank = lambda by: F.row_number().over(W.partitionBy(*keys, "side").orderBy(by, "strike"))
    rows = exposure.withColumn("side", F.when(F.col("gex") > 0, "call").when(F.col("gex") < 0, "put")).where("side is not null")
    return rows.withColumn("rank", rank(F.desc(F.abs("gex")))).where(F.col("rank") <= top)


def zero_gamma(chain: DataFrame, keys: list[str], steps: int = 41, width: float = 0.2) -> DataFrame:
    """Spot at which net exposure changes sign: a grid around the spot, then a line between the two points of the change."""
    grid = chain.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_s", F.col("spot") * (1 - width + 2 * width * F.col("_k") / (steps - 1)))
    g = cf.gamma(F.col("_s"), F.col("strike"), F.col("iv"), F.col("time")) * F.col("open_interest") * F.col("_s") * F.col("_s")
    net = grid.groupBy(*keys, "_k").agg(F.first("_s").alias("s"), F.sum(F.when(F.col("kind") == "call", g).otherwise(-g)).alias("net"))
    w = W.partitionBy(*keys).orderBy("_k")
    net = net.withColumns({"s0": F.lag("s").over(w), "n0": F.lag("net").over(w)}).where("n0 * net < 0")
    return net.groupBy(*keys).agg(F.min_by(F.col("s0") + (F.col("s") - F.col("s0")) * F.col("n0") / (F.col("n0") - F.col("net")), "_k").alias("zero_gamma"))


def zero_gamma_exact(chain: DataFrame, keys: list[str], steps: int = 41, width: float = 0.2, rounds: int = 50) -> DataFrame:
    """Spot at which net exposure changes sign first, upward from the spot less `width`: a grid brackets it, halving finds it.

    A chain's lines are one array, as its strikes are few; null where no sign changes on the grid.
    """
    lines = chain.groupBy(*keys).agg(F.first("spot").alias("_spot"), F.collect_list(F.struct("strike", "iv", "time", "open_interest", F.when(F.col("kind") == "call", 1.0).otherwise(-1.0).alias("way"))).alias("_lines"))

    def net(spot: Column) -> Column:
        part = lambda total, x: total + x["way"] * cf.gamma(spot, x["strike"], x["iv"], x["time"]) * x["open_interest"]
        return F.aggregate("_lines", F.lit(0.0), part)

    at = lambda k: F.col("_spot") * (1 - width + 2 * width * k / (steps - 1))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(at(k).alias("s"), net(at(k)).alias("g")))
    rows = lines.withColumn("_grid", grid)
    turn = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(steps - 1)), lambda k: F.get("_grid", k - 1)["g"] * F.get("_grid", k)["g"] < 0))
    rows = rows.withColumn("_turn", turn).withColumns({"_a": F.get("_grid", F.col("_turn") - 1), "_b": F.get("_grid", F.col("_turn"))}).drop("_grid")

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        same = net(middle) * F.col("_a.g") > 0
        return F.struct(F.when(same, middle).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("_a.s").alias("lo"), F.col("_b.s").alias("hi")), halve)
    return rows.select(*keys, F.when(F.col("_turn").isNotNull(), (found["lo"] + found["hi"]) / 2).alias("zero_gamma"))


def pin_strength(chain: DataFrame, keys: list[str], multiplier: float = 100.0, there: bool = True) -> DataFrame:
    """keys, strike and the share of all unsigned gamma that it holds: of each strike as if the spot were there, or at the
    spot."""
    spot = F.col("strike") if there else F.col("spot")
    g = cf.gamma(spot, F.col("strike"), F.col("iv"), F.col("time")) * F.col("open_interest") * multiplier * spot * spot * 0.01
    held = chain.groupBy(*keys, "strike").agg(F.sum(g).alias("_g"))
    return held.join(held.groupBy(*keys).agg(F.sum("_g").alias("_all")), keys).select(*keys, "strike", F.try_divide(F.col("_g"), F.col("_all")).alias("pin"))
