"""Contacts of price with levels: a level, an event that confirms, one that refutes, and what follows.

A level is a row: a kind, a price and the bars for which it holds. A touch is a contact if the level was left before by a
distance since the last touch, or never touched; that is told by the event before it along the level, so no loop follows a
path. Everything else is read from windows of the session's bars. A session's bars and levels are one group; they have a bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profiles import point_of_control, prominent_nodes, value_area
from .quantiles import exact_quantiles
from .recursions import zigzag

SESSION = ["instrument", "session"]
LEVEL = "instrument, session, kind, price, first, last: the bars (t) for which a level holds"

# Bars that each kind of level is followed for, and what each confirmation expects (-1: price turns back).
HORIZONS = {"control": 60, "value": 60, "low_node": 60, "band": 30, "pivot": 120, "retrace": 45}
EXPECTED = {"absorbed": -1, "rejected": -1, "passed": 1}
# The setups, a kind of level with a confirmation.
SETUPS = (
    ("control", "absorbed"), ("control", "passed"), ("value", "rejected"), ("value", "passed"), ("low_node", "passed"), ("low_node", "rejected"),
    ("band", "rejected"), ("band", "passed"), ("pivot", "rejected"), ("pivot", "passed"), ("retrace", "absorbed"), ("retrace", "rejected"),
)


@dataclass(frozen=True)
class Grammar:
    """start: the first bar of a session that counts; what lies before it makes levels and measures. sigma: deviation of a bar
    in points; rearm: distance that makes a level new; step: of the profile; threshold: of pivots. A bar is heavy from `heavy`
    medians of volume, still up to `still` of its volume's usual move, a wick long from `wick` of the range, flow one-sided
    from `share` of the volume; a confirmation is watched for `watch` bars."""

    start: int
    sigma: float = 1.0
    rearm: float = 3.0
    step: float = 1.0
    threshold: float = 6.0
    heavy: float = 1.5
    still: float = 0.25
    wick: float = 0.6
    share: float = 1 / 3
    watch: int = 15
    horizons: dict[str, int] = field(default_factory=lambda: dict(HORIZONS))


def session_window() -> W:
    return W.partitionBy(*SESSION).orderBy("t")


def _static(found: DataFrame, kind: str, price: Column, ends: DataFrame) -> DataFrame:
    return found.select(*SESSION, F.lit(kind).alias("kind"), price.alias("price")).join(ends, SESSION)


def profile_levels(bars: DataFrame, g: Grammar) -> DataFrame:
    """Point of control, ends of the value area and low nodes of how often closes of the session's first part met each price;
    they hold from the first bar that counts."""
    early = bars.where(F.col("sessmin") < g.start).withColumn("bin", F.floor(F.col("c") / g.step + 0.5))
    profile = early.groupBy(*SESSION, "bin").agg(F.count(F.lit(1)).cast("double").alias("volume"))
    ends = bars.groupBy(*SESSION).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    area = value_area(profile, SESSION)
    price = lambda c, shift=0.0: (F.col(c) + shift) * g.step
    out = _static(point_of_control(profile, SESSION), "control", price("poc"), ends)
    for column, shift in (("low", -0.5), ("high", 0.5)):
        out = out.unionByName(_static(area, "value", price(column, shift), ends))
    return out.unionByName(_static(prominent_nodes(profile, SESSION).where("node = 'low'"), "low_node", price("bin"), ends))


def band_levels(bars: DataFrame, k: float = 2.0) -> DataFrame:
    """The session's volume-weighted mean plus and minus k deviations as of each bar; a level of that bar alone."""
    upto = session_window().rowsBetween(W.unboundedPreceding, 0)
    price = (F.col("h") + F.col("l") + F.col("c")) / 3
    weight = F.sum("v").over(upto)
    rows = bars.withColumns({"_w": weight, "_m": F.try_divide(F.sum(price * F.col("v")).over(upto), weight), "_q": F.try_divide(F.sum(price * price * F.col("v")).over(upto), weight)})
    rows = rows.withColumn("_s", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))).where("_w > 0 and _s > 0")
    sides = F.explode(F.array(F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s")))
    return rows.select(*SESSION, F.lit("band").alias("kind"), sides.alias("price"), F.col("t").alias("first"), F.col("t").alias("last"))


def swing_levels(bars: DataFrame, g: Grammar, kept: int = 3) -> DataFrame:
    """The last `kept` swings of closes from the bar that confirms each (`pivot`), and the edges at 61.8 and 79 % of the last
    confirmed leg, until the next is (`retrace`)."""
    swings = zigzag(bars, SESSION, "t", "c", g.threshold, "told")
    w = W.partitionBy(*SESSION).orderBy("told", "t")
    ends = bars.groupBy(*SESSION).agg(F.max("t").alias("_end"))
    rows = swings.withColumns({"_gone": F.lead("told", kept).over(w), "_next": F.lead("told").over(w), "_from": F.lag("price").over(w)}).join(ends, SESSION)
    until = lambda c: F.coalesce(F.col(c) - 1, F.col("_end"))
    pivots = rows.select(*SESSION, F.lit("pivot").alias("kind"), "price", F.col("told").alias("first"), until("_gone").alias("last"))
    leg = F.col("price") - F.col("_from")
    edges = F.explode(F.array(F.col("price") - 0.618 * leg, F.col("price") - 0.79 * leg))
    zones = rows.where(F.abs(leg) >= g.threshold).select(*SESSION, F.lit("retrace").alias("kind"), edges.alias("price"), F.col("told").alias("first"), until("_next").alias("last"))
    return pivots.unionByName(zones)


def level_kinds(bars: DataFrame, g: Grammar) -> DataFrame:
    """All kinds of levels of each session."""
    return profile_levels(bars, g).unionByName(band_levels(bars)).unionByName(swing_levels(bars, g))


def _measured(bars: DataFrame, g: Grammar) -> DataFrame:
    """bars that can be met, with what their session did before (median volume, usual move for its volume) and after."""
    early = F.col("sessmin") < g.start
    usual = bars.groupBy(*SESSION).agg(
        F.percentile(F.when(early, F.col("v")), F.lit(0.5)).alias("_median"), F.sqrt(F.avg(F.when(early & (F.col("v") > 0), F.pow(F.col("c") - F.col("o"), 2) / F.col("v")))).alias("_impact")
    )
    w = session_window()
    watch = w.rowsBetween(1, g.watch)
    more = {"_last_c": F.lag("c").over(w), "_more": F.lead("t").over(w).isNotNull(), "_c_max": F.max("c").over(watch), "_c_min": F.min("c").over(watch)}
    for h in sorted(set(g.horizons.values())):
        ahead = w.rowsBetween(1, h)
        more |= {f"_c{h}": F.last("c").over(ahead), f"_h{h}": F.max("h").over(ahead), f"_l{h}": F.min("l").over(ahead)}
    return bars.withColumns(more).where(~early & F.col("_more")).join(usual, SESSION)


def contacts(bars: DataFrame, levels: DataFrame, g: Grammar) -> DataFrame:
    """Contacts of bars (instrument, session, t, sessmin, o, h, l, c, v, delta) with levels (see LEVEL).

    One row a contact: instrument, session, t, kind, price, side (1: price came from below), confirmed and refuted (names), and
    over the kind's horizon the move from the contact's close along the side (follow) and its extremes (best, worst). The last
    bar of a session is no contact. Null where a session has nothing to measure by: then only rejections can confirm.
    """
    last = {k: F.col(f"_{k}{h}") for k in "chl" for h in [max(g.horizons.values())]}
    rows = _measured(bars, g).join(levels.distinct(), SESSION).where(F.col("t").between(F.col("first"), F.col("last")))
    rows = rows.withColumn("touched", F.col("price").between(F.col("l"), F.col("h"))).where(F.col("touched") | (F.abs(F.col("c") - F.col("price")) >= g.rearm))
    along = W.partitionBy(*SESSION, "kind", "price").orderBy("t")
    rows = rows.withColumn("_before", F.lag("touched").over(along)).where(F.col("touched") & ~F.coalesce("_before", F.lit(False)))
    side = F.when(F.col("_last_c") < F.col("price"), 1).otherwise(-1)
    past = side * (F.col("c") - F.col("price"))
    body_high, body_low, size = F.greatest("o", "c"), F.least("o", "c"), F.col("h") - F.col("l")
    wick = F.when(size > 0, F.when(side > 0, F.col("h") - body_high).otherwise(body_low - F.col("l")) / size).otherwise(0.0)
    z = F.abs(F.try_divide(F.col("c") - F.col("o"), F.col("_impact") * F.sqrt(F.greatest(F.col("v"), F.lit(1.0)))))
    farthest = F.greatest(side * (F.col("_c_max") - F.col("price")), side * (F.col("_c_min") - F.col("price")))
    nearest = F.least(side * (F.col("_c_max") - F.col("price")), side * (F.col("_c_min") - F.col("price")))
    told = {
        "absorbed": ((F.col("v") >= g.heavy * F.col("_median")) & (F.col("_median") > 0) & (z <= g.still) & (past <= 0), farthest >= g.sigma),
        "rejected": ((wick >= g.wick) & (past <= 0), farthest >= g.sigma),
        "passed": ((past >= g.sigma) & (side * F.try_divide(F.col("delta"), F.col("v")) >= g.share), nearest <= 0),
    }
    names = lambda *tests: F.array_compact(F.array(*[F.when(t, k) for k, t in tests]))
    over = {}
    for k in "chl":
        over[k] = last[k]
        for kind, h in g.horizons.items():
            over[k] = F.when(F.col("kind") == kind, F.col(f"_{k}{h}")).otherwise(over[k])
    up, down = side * (over["h"] - F.col("c")), side * (over["l"] - F.col("c"))
    return rows.select(
        *SESSION, "t", "kind", "price", side.alias("side"), names(*[(k, a) for k, (a, _) in told.items()]).alias("confirmed"), names(*[(k, a & b) for k, (a, b) in told.items()]).alias("refuted"),
        (side * (over["c"] - F.col("c"))).alias("follow"), F.greatest(up, down).alias("best"), F.least(up, down).alias("worst"),
    )


def independent(rows: Column, horizon: Column) -> Column:
    """Of an array of contacts in order of bars (t), those that lie a horizon behind the one taken before: the first, then the
    next that is free."""
    empty = F.filter(rows, lambda x: F.lit(False))

    def take(kept: Column, x: Column) -> Column:
        free = (F.size(kept) == 0) | (x["t"] >= F.element_at(kept, -1)["t"] + horizon)
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(rows, empty, take)


def setup_measures(found: DataFrame, sessions: int, g: Grammar, setups=SETUPS) -> DataFrame:
    """Of each setup: contacts (all and a session), how many are confirmed and of these refuted, independent confirmed ones,
    chances that price goes as expected (of independent contacts, of independent confirmed ones), and medians of the best and
    worst move in the expected way of the latter. Frequencies count all contacts, moves those whose windows do not overlap; of
    contacts at one bar the one with the lowest price goes first. A session's contacts of a setup are one group."""
    told = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confirmation"), F.lit(EXPECTED[c]).alias("way"), F.lit(g.horizons[k]).alias("far")) for k, c in setups])
    rows = found.withColumn("_s", F.explode(F.filter(told, lambda s: s["kind"] == F.col("kind"))))
    held, way = F.array_contains("confirmed", F.col("_s.confirmation")), F.col("_s.way")
    one = F.struct(
        "t", "price", held.alias("held"), F.array_contains("refuted", F.col("_s.confirmation")).alias("lost"), (way * F.col("follow") > 0).cast("double").alias("right"),
        F.when(way > 0, F.col("best")).otherwise(-F.col("worst")).alias("gain"), F.when(way > 0, F.col("worst")).otherwise(-F.col("best")).alias("pain"),
    )
    keys = ["kind", "confirmation"]
    days = rows.groupBy(*SESSION, "kind", F.col("_s.confirmation").alias("confirmation"), F.col("_s.far").alias("far")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    kept = F.filter("all", lambda x: x["held"])
    days = days.select(*keys, "all", independent(F.col("all"), F.col("far")).alias("free"), independent(kept, F.col("far")).alias("free_held"))
    total = lambda c, f: F.sum(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + f(x)))
    flag = lambda name: lambda x: x[name].cast("double")
    sums = days.groupBy(*keys).agg(
        F.sum(F.size("all")).alias("contacts"), total("all", flag("held")).cast("long").alias("held"), total("all", flag("lost")).cast("long").alias("lost"), F.sum(F.size("free_held")).alias("free_held"),
        F.try_divide(total("free", flag("right")), F.sum(F.size("free"))).alias("p_any"), F.try_divide(total("free_held", flag("right")), F.sum(F.size("free_held"))).alias("p_held"),
    )
    moves = days.select(*keys, F.explode("free_held").alias("x")).select(*keys, F.explode(F.create_map(F.lit("gain"), F.col("x.gain"), F.lit("pain"), F.col("x.pain"))).alias("move", "v"))
    middle = exact_quantiles(moves, [*keys, "move"], "v", [0.5], "q").groupBy(*keys).agg(*[F.max(F.when(F.col("move") == m, F.element_at("q", 1))).alias(m) for m in ("gain", "pain")])
    made = sums.join(middle, keys, "left")
    return made.select(
        *keys, "contacts", (F.col("contacts") / sessions).alias("a_session"), "held", (F.col("held") / F.col("contacts")).alias("held_share"), F.try_divide(F.col("lost"), F.col("held")).alias("lost_share"), "free_held", "p_any", "p_held", "gain", "pain"
    )
