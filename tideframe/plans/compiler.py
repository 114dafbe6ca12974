"""Compilation of operands and conditions to columns of a bar frame.

The frame has instrument, t (strictly rising inside an instrument), session, sessmin, o, h, l, c, v, and may have segment, a
number that changes where prices jump (operators.bars.segments). Each distinct operand becomes one column, found again by its
canonical text. Series windows run across sessions of an instrument, but never from one segment into the next; anchored ones
restart with the session. An undefined operand is null, and conditions follow SQL's three-valued logic.

An instrument's bars are not one group: they lie in ranges of whole sessions, each with the bars before it that its operands
reach back to (operators.blocks). How far an operand reaches is known from its document; a recursion reaches as far as its
weights count in a double's digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import SESSION_LEVELS, in_ranges, running_sums, with_places
from ..operators.recursions import decay_length, decaying_sum
from .document import Condition, DocumentError, Operand, canonical, comparable

FIELDS = {
    "close": "c", "open": "o", "high": "h", "low": "l", "volume": "v",
    "hl2": "(h + l) / 2", "hlc3": "(h + l + c) / 3", "range": "h - l", "body": "c - o",
}


#: Rows of a range at least, how many times the reach, and the reach that a frame starts with.
RANGE_ROWS, RANGE_REACHES, FIRST_REACH = 1 << 14, 4, 512


def reach(x) -> int:
    """How many bars before a bar an operand or condition, or a list of them, reads along the series."""
    if isinstance(x, (list, tuple)):
        return max(map(reach, x), default=0)
    if not isinstance(x, dict):
        return 0
    inner = max((reach(v) for v in x.values()), default=0)
    if any(k in x for k in ("cross", "touch", "reject", "break")):
        return inner + 1
    if "for" in x or "within" in x:
        return inner + int(x["for"] if "for" in x else x["within"])
    kind, n = x.get("ind"), x.get("n")
    own = {"sma": lambda: n, "sd": lambda: n, "hh": lambda: n, "ll": lambda: n, "ema": lambda: n + decay_length(1 - 2 / (n + 1)), "tf": lambda: 1}
    own |= {k: lambda: n + 1 + decay_length((n - 1) / n) for k in ("atr", "rsi")}
    if kind == "dist":
        return inner + (reach({"ind": "atr", "n": x.get("n", 14)}) if x.get("unit") == "atr" else 0)
    if kind == "tf":  # its operand reaches along bars of its own frame
        return 1 + int(x.get("lag") or 0)
    return inner + int(own[kind]() if kind in own else 0) + int(x.get("lag") or 0)


def volume_sessions(x) -> set[int]:
    """The numbers of sessions over which an operand or condition, or a list of them, asks for relative volume."""
    if isinstance(x, (list, tuple)):
        return set().union(*map(volume_sessions, x))
    if not isinstance(x, dict):
        return set()
    return volume_sessions(list(x.values())) | ({int(x["n"])} if x.get("ind") == "rvol" else set())


class Compiler:
    """Adds columns to a bar frame.

    anchor: first and last bar of a session that count as anchored. expected: bars of a full session. levels: (session,
    name, price) to join, and if they have them scale and base (a level of scale `index` is raised by its base, and left out
    without one) and adj (added to every level). news: (t, impact). tick: the least price step. rows: of a range, at least; first_reach: how many
    bars before a range it is given at first; an operand that reaches farther has the frame built anew. places: the bars'
    sessions (operators.blocks.session_places), where they are known more cheaply than from the bars.
    """

    def __init__(
        self, bars: DataFrame, anchor: tuple[int, int] = (0, 1 << 30), expected: int = 24, levels: DataFrame | None = None, news: DataFrame | None = None, tick: float = 0.01, rows: int = RANGE_ROWS, first_reach: int = FIRST_REACH,
        places: DataFrame | None = None,
    ):
        self.anchor, self.expected, self.levels, self.news, self.tick, self.rows = anchor, expected, levels, news, tick, rows
        self.bars, self.places, self.calls, self.volumes, self.inner = bars, places, [], [], False
        self.keys = ["instrument", "_range", *(["segment"] if "segment" in bars.columns else [])]
        self._start(max(1, first_reach))

    def _start(self, bars_before: int) -> None:
        """The frame without operands, in ranges with so many bars before each."""
        self.reach, self.names, self.pending = bars_before, {}, {}
        placed = with_places(self.bars, self.places)
        for n in self.volumes:
            past = W.partitionBy("instrument", "sessmin").orderBy("place").rangeBetween(-n, -1)
            placed = placed.withColumn(f"_volume{n}", F.when(F.sum("v").over(past) > 0, F.try_divide(F.col("v"), F.avg("v").over(past))))
        ranged = in_ranges(placed, bars_before, max(self.rows, RANGE_REACHES * bars_before)).drop("n_rows", "before", "place")
        self._frame = ranged.repartition("instrument", "_range").withColumn("anchored", F.col("sessmin").between(*self.anchor))
        first = F.row_number().over(self.inside()) == 1
        self._frame = self._frame.withColumn("edge", (first & F.col("anchored")) | F.lag("t").over(self.series()).isNull())

    def _again(self, bars_before: int) -> None:
        """The same operands and conditions on a frame that reaches so far; columns keep their names."""
        calls, self.calls = self.calls, []
        self._start(bars_before)
        for made, x in calls:
            made(x)

    def _told(self, make, made, x):
        """The column of what was asked for from outside, on a frame that reaches far enough."""
        if self.inner:
            return make(x)
        more = volume_sessions(x).difference(self.volumes)
        if more or reach(x) + 1 > self.reach:
            self.volumes += sorted(more)
            self._again(max(self.reach, 2 * reach(x) + 1 if reach(x) >= self.reach else 0))
        self.calls.append((made, x))
        self.inner = True
        try:
            return make(x)
        finally:
            self.inner = False

    def series(self) -> W:
        return W.partitionBy(*self.keys).orderBy("t")

    @staticmethod
    def inside() -> W:
        return W.partitionBy("instrument", "_range", "session", "anchored").orderBy("t")

    @property
    def frame(self) -> DataFrame:
        """The bars, each once, with all columns added so far."""
        return self._whole().where("_own").drop("_own", "_range", *[f"_volume{n}" for n in self.volumes])

    def _whole(self) -> DataFrame:
        """The ranges with their copies. Columns that do not read each other are added together, so that many operands of one
        kind share a window."""
        if self.pending:
            self._frame, self.pending = self._frame.withColumns(self.pending), {}
        return self._frame

    def add(self, key: str, column: Column) -> str:
        if key not in self.names:
            self.names[key] = f"x{len(self.names)}"
            if not self.pending.keys().isdisjoint(re.findall(r"\bx\d+\b", str(column))):
                self._whole()
            self.pending[self.names[key]] = column
        return self.names[key]

    def prepare(self, x) -> None:
        """Add the operands of documents, conditions and lists of them, before the conditions that read them."""
        if isinstance(x, dict):
            if "ind" in x or "op" in x:
                self.operand(x)
            else:
                self.prepare(list(x.values()))
        elif isinstance(x, list):
            for y in x:
                self.prepare(y)

    def operand(self, x: Operand) -> Column:
        """The column of an operand."""
        if isinstance(x, (int, float)):
            return F.lit(float(x))
        return self._told(self._named_operand, self.operand, {"ind": x} if isinstance(x, str) else x)

    def _named_operand(self, x: dict) -> Column:
        key = canonical(x)
        if key not in self.names:
            self.add(key, self._operand(x))
        return F.col(self.names[key])

    def _operand(self, x: dict) -> Column:
        if "op" in x:
            a, b = self.operand(x["a"]), self.operand(x["b"])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[x["op"]]()
        kind = x["ind"]
        if kind in FIELDS:
            value = F.expr(FIELDS[kind])
        else:
            made = getattr(self, f"_{kind}", None)
            if made is None:
                raise DocumentError(f"no indicator {kind}")
            value = made(x)
        if x.get("lag"):
            base = self.add(canonical({**x, "lag": 0}), value)
            return F.lag(base, int(x["lag"])).over(self.series())
        return value

    def _of(self, x: dict) -> Column:
        return self.operand(x.get("of", "close"))

    def _full(self, x: dict, lo: int, hi: int, fold) -> Column:
        """An aggregate over rows lo to hi, null unless all of them exist and are defined."""
        value, frame = self._of(x), self.series().rowsBetween(lo, hi)
        return F.when(F.count(value).over(frame) == hi - lo + 1, fold(value).over(frame))

    def _sma(self, x: dict) -> Column:
        return self._full(x, 1 - int(x["n"]), 0, F.avg)

    def _sd(self, x: dict) -> Column:
        return self._full(x, 1 - int(x["n"]), 0, F.stddev_pop)

    def _hh(self, x: dict) -> Column:
        return self._full({"of": "high", **x}, -int(x["n"]), -1, F.max)

    def _ll(self, x: dict) -> Column:
        return self._full({"of": "low", **x}, -int(x["n"]), -1, F.min)

    def true_range(self) -> Column:
        before = F.lag("c").over(self.series())
        return F.when(before.isNull(), F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)))

    def _scan(self, value: Column, n: int, keep: float, weight: float, key: str) -> Column:
        """Recursion seeded with the mean of the first n defined values in a row; a gap starts it anew."""
        name = self.add(key + "#in", value)
        gaps = F.sum(F.col(name).isNull().cast("int")).over(self.series().rowsBetween(W.unboundedPreceding, 0))
        run = self.add(key + "#run", gaps)
        order = W.partitionBy(*self.keys, run).orderBy("t")
        place = self.add(key + "#place", F.when(F.col(name).isNotNull(), F.sum(F.col(name).isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))))
        seed = self.add(key + "#seed", F.avg(name).over(order.rowsBetween(1 - n, 0)))
        rank = F.when(F.col(place) >= n, F.col(place) - n)
        term = F.when(F.col(place) > n, F.col(name) * weight).when(F.col(place) == n, F.col(seed))
        helpers, local, carry = decaying_sum(rank, term, keep, [*self.keys, run])
        self._frame = self._whole().withColumns(helpers).withColumn("_local", local)
        out = self.add(key + "#out", F.when(F.col(place) >= n, F.col("_local") + F.coalesce(carry, F.lit(0.0))))
        self._frame = self._whole().drop(*helpers, "_local")
        return F.col(out)

    def _ema(self, x: dict) -> Column:
        n = int(x["n"])
        return self._scan(self._of(x), n, 1 - 2 / (n + 1), 2 / (n + 1), canonical(x))

    def _atr(self, x: dict) -> Column:
        n = int(x["n"])
        return self._scan(self.true_range(), n, (n - 1) / n, 1 / n, canonical(x))

    def _rsi(self, x: dict) -> Column:
        n, value = int(x["n"]), self._of(x)
        step = value - F.lag(value).over(self.series())
        key = canonical(x)
        up = self._scan(F.greatest(step, F.when(step.isNotNull(), F.lit(0.0))), n, (n - 1) / n, 1 / n, key + "#up")
        down = self._scan(F.greatest(-step, F.when(step.isNotNull(), F.lit(0.0))), n, (n - 1) / n, 1 / n, key + "#down")
        return F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + up / down))

    def _vwap(self, x: dict) -> Column:
        """Anchored volume-weighted mean price plus k deviations; equal weights while no volume has come."""
        upto, k = self.inside().rowsBetween(W.unboundedPreceding, 0), float(x.get("k", 0))
        if "vwap#sigma" in self.names:
            return self._band(k)
        price = F.expr(FIELDS["hlc3"])
        total, n = F.sum("v").over(upto), F.count(F.lit(1)).over(upto)
        first = F.first(price).over(upto)
        gap = price - first

        def mean(y: Column) -> Column:
            return F.when(total > 0, F.try_divide(F.sum(F.col("v") * y).over(upto), total)).otherwise(F.sum(y).over(upto) / n)

        # first, mean and deviation are columns that all bands share
        self.add("vwap#first", first)
        m, square = F.col(self.add("vwap#mean", mean(gap))), F.col(self.add("vwap#square", mean(gap * gap)))
        variance = square - m * m
        self.add("vwap#sigma", F.when(variance <= 1e-12, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))))
        return self._band(k)

    def _band(self, k: float, before: bool = False) -> Column:
        """The band k of a bar, or of the bar before it, from the columns that all bands share."""
        names = {"anchored": "anchored", **{c: self.names[f"vwap#{c}"] for c in ("first", "mean", "sigma")}}
        anchored, first, m, sigma = (self._before(x) if before else F.col(x) for x in names.values())
        return F.when(anchored, first + m if k == 0 else F.when(sigma >= self.tick, first + m + k * sigma))

    def _before(self, name: str) -> Column:
        """A column's value on the bar before, which all that ask for it share."""
        key = f"before#{name}"
        return F.col(self.names[key] if key in self.names else self.add(key, F.lag(name).over(self.series())))

    def _rvol(self, x: dict) -> Column:
        """Volume over its mean at the same bar of the n sessions before, as sessions of the instrument follow each other. It is
        made before bars are copied into ranges."""
        return F.col(f"_volume{int(x['n'])}")

    def _sess(self, x: dict) -> Column:
        before = self.inside().rowsBetween(W.unboundedPreceding, -1)
        made = {"high": F.max("h").over(before), "low": F.min("l").over(before), "open": F.first("o").over(self.inside())}
        return F.when(F.col("anchored"), made[x["field"]])

    def _day(self) -> W:
        return W.partitionBy("instrument", "_range", "session")

    def _or(self, x: dict) -> Column:
        lo, hi, day = int(x["from"]), int(x["to"]), self._day()
        within = (F.col("sessmin") >= lo) & (F.col("sessmin") < hi)
        pick = lambda f, c: f(F.when(within, F.col(c))).over(day)
        ends = lambda f, c: f(F.when(within, F.col(c)), F.when(within, F.col("t"))).over(day)
        high, low = pick(F.max, "h"), pick(F.min, "l")
        made = {"high": high, "low": low, "mid": (high + low) / 2, "open": ends(F.min_by, "o"), "close": ends(F.max_by, "c")}
        return F.when(F.col("sessmin") >= hi, made[x["field"]])

    def _at(self, x: dict) -> Column:
        want = int(x["bar"])
        value = F.max(F.when(F.col("sessmin") == want, F.expr(FIELDS[x.get("field", "close")]))).over(self._day())
        return F.when(F.col("sessmin") >= want, value)

    def _prev(self, x: dict) -> Column:
        """Value of the n-th previous complete session: each complete session's value is looked up in order of sessions."""
        n, field = int(x.get("n", 1)), x["field"]
        key = f"prev#{n}#{field}"
        if key not in self.names:
            self.names[key] = f"x{len(self.names)}"
            from ..operators.bars import sessions

            days = sessions(self.bars, self.expected).withColumn("_value", F.col(field))
            ranked = running_sums(days, ["instrument"], "session", {"_before": F.col("complete").cast("int")}, False, SESSION_LEVELS)
            kept = ranked.where("complete").select("instrument", (F.col("_before") + 1).alias("_want"), F.col("_value").alias(self.names[key]))
            found = ranked.select("instrument", "session", (F.col("_before") - (n - 1)).alias("_want")).join(kept, ["instrument", "_want"], "left").drop("_want")
            self._frame = self._whole().join(found, ["instrument", "session"], "left")
        return F.col(self.names[key])

    def _tf(self, x: dict) -> Column:
        """An operand of bars of m bars, as of the last one closed: closed with its last bar's minute, and read until the next
        one closes. It is compiled on its own frame of the wide bars."""
        m, of = int(x["m"]), x.get("of", "close")
        if "'tf'" in str(of):
            raise DocumentError("tf inside tf")
        key = f"tf#{m}#{canonical(of)}"
        if key not in self.names:
            from ..operators.bars import resample

            wide = resample(self.bars, m, [c for c in ("segment",) if c in self.bars.columns])
            # wide bars are numbered by session and place, which rise with time
            wide = wide.withColumns({"t": F.shiftleft(F.col("session").cast("long"), 20) + F.col("bucket"), "sessmin": F.col("bucket")})
            lo, hi = self.anchor
            within = Compiler(wide, (-(-lo // m), hi // m), -(-self.expected // m), self.levels, None, self.tick, self.rows)
            value = within.operand(of)
            made = within.frame.select("instrument", "session", F.col("bucket").alias("_b"), value.alias("_wide"))
            bucket = F.floor(F.col("sessmin") / m).cast("int")
            self._frame = self._whole().withColumn("_b", bucket).join(made, ["instrument", "session", "_b"], "left").withColumn("_last", F.lag("_wide").over(self.series()))
            of_bucket = W.partitionBy(*self.keys, "session", "_b").orderBy("t")
            name = self.add(key, F.when(F.col("sessmin") % m == m - 1, F.col("_wide")).otherwise(F.first("_last").over(of_bucket)))
            self._frame = self._whole().drop("_b", "_wide", "_last")
            return F.col(name)
        return F.col(self.names[key])

    def _levels(self) -> Column:
        """All levels of the session as a sorted array of (price, name)."""
        if self.levels is None:
            raise DocumentError("no levels were given")
        if "levels#" not in self.names:
            self.names["levels#"] = "_levels"
            has = self.levels.columns
            base = F.when(F.col("scale") == "index", F.col("base")).otherwise(0.0) if "scale" in has else F.lit(0.0)
            price = F.col("price") + base + (F.coalesce("adj", F.lit(0.0)) if "adj" in has else F.lit(0.0))
            told = self.levels.select("session", "name", price.alias("price")).where("price is not null")
            days = told.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("price", "name"))).alias("_levels"))
            self._frame = self._whole().join(days, "session", "left")
        return F.col("_levels")

    def _level(self, x: dict) -> Column:
        return F.get(F.filter(self._levels(), lambda y: y["name"] == x["name"]), F.lit(0))["price"]

    def _nearest(self, x: dict) -> Column:
        named = lambda y: y["name"].isin(x["names"]) if x.get("names") else F.lit(True)
        if x["side"] == "above":
            return F.array_min(F.transform(F.filter(self._levels(), lambda y: (y["price"] > F.col("c")) & named(y)), lambda y: y["price"]))
        return F.array_max(F.transform(F.filter(self._levels(), lambda y: (y["price"] < F.col("c")) & named(y)), lambda y: y["price"]))

    def _sessmin(self, x: dict) -> Column:
        return F.when(F.col("anchored"), (F.col("sessmin") - self.anchor[0]).cast("double"))

    def _time(self, x: dict) -> Column:
        return F.col("sessmin").cast("double")

    def _dow(self, x: dict) -> Column:
        """ISO weekday of the session number (day 0 is a Thursday)."""
        return (F.pmod(F.col("session") + 3, F.lit(7)) + 1).cast("double")

    def _dist(self, x: dict) -> Column:
        gap, unit = self.operand(x["a"]) - self.operand(x["b"]), x.get("unit", "points")
        if unit == "points":
            return gap
        if unit == "ticks":
            return gap / self.tick
        if unit == "atr":
            return F.try_divide(gap, self.operand({"ind": "atr", "n": x.get("n", 14)}))
        sigma = self.operand({"ind": "vwap", "k": 1}) - self.operand({"ind": "vwap", "k": 0})
        return F.try_divide(gap, sigma)

    # conditions

    def condition(self, x: Condition) -> Column:
        """The nullable boolean column of a condition."""
        return self._told(self._named_condition, self.condition, x)

    def _named_condition(self, x: Condition) -> Column:
        key = "?" + canonical(x)
        if key not in self.names:
            self.add(key, self._condition(x))
        return F.col(self.names[key])

    def _lagged(self, x: Operand) -> Column:
        if isinstance(x, (int, float)):
            return F.lit(float(x))
        self.operand(x)
        if isinstance(x, dict) and x.get("ind") == "vwap" and not x.get("lag"):
            return self._band(float(x.get("k", 0)), before=True)
        return self._before(self.names[canonical({"ind": x} if isinstance(x, str) else x)])

    def _edged(self, value: Column, *needed: Column) -> Column:
        """False on an edge bar; else null where an operand is undefined now or one bar before."""
        some = needed[0].isNotNull()
        for x in needed[1:]:
            some = some & x.isNotNull()
        return F.when(F.col("edge"), False).when(some, value)

    def _condition(self, x: Condition) -> Column:
        if "all" in x or "any" in x:
            parts = [self.condition(c) for c in x.get("all", x.get("any"))]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if "all" in x else (out | p)
            return out
        if "not" in x:
            return ~self.condition(x["not"])
        if "cmp" in x:
            if not comparable(x["a"], x["b"]):
                raise DocumentError(f"{canonical(x)} compares what differs in kind")
            a, b = self.operand(x["a"]), self.operand(x["b"])
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[x["cmp"]]
        if "cross" in x:
            a, b, p, q = self.operand(x["a"]), self.operand(x["b"]), self._lagged(x["a"]), self._lagged(x["b"])
            return self._edged((p <= q) & (a > b) if x["cross"] == "up" else (p >= q) & (a < b), a, b, p, q)
        if "touch" in x or "reject" in x:
            side = x.get("touch", x.get("reject"))
            level, before = self.operand(x["level"]), self._lagged(x["level"])
            last = self._before("c")
            met = (F.col("l") <= level) & (last > before) if side == "above" else (F.col("h") >= level) & (last < before)
            if "reject" in x:
                met = met & ((F.col("c") > level) if side == "above" else (F.col("c") < level))
            return self._edged(met, level, before, last)
        if "break" in x:
            level, last = self.operand(x["level"]), self._before("c")
            before = self._lagged(x["level"])
            return self._edged((F.col("c") > level) & (last <= before) if x["break"] == "up" else (F.col("c") < level) & (last >= before), level, before, last)
        if "bar" in x:
            return F.col("c") > F.col("o") if x["bar"] == "up" else F.col("c") < F.col("o")
        if "time" in x:
            lo, hi = x["time"]
            s = F.col("sessmin")
            return (s >= lo) & (s < hi) if lo <= hi else (s >= lo) | (s < hi)
        if "news" in x:
            return ~self._near_news(x["news"], int(x.get("before", 0)), int(x.get("after", 0)))
        for key in ("for", "within"):
            if key in x:
                n, inner = int(x[key]), self.condition(x["cond"])
                frame = self.series().rowsBetween(1 - n, 0)
                some = F.max((inner if key == "within" else ~inner).cast("int")).over(frame) == 1
                full = F.count(inner).over(frame) == n
                return F.when(F.coalesce(some, F.lit(False)), key == "within").when(full, key == "for")
        raise DocumentError(f"no condition {canonical(x)}")

    def _near_news(self, impact: int, before: int, after: int) -> Column:
        """Whether news of at least an impact lies from `before` bars before a bar's end to `after` bars after it.

        Each news item is exploded to the bars it covers, so the join is on equal bar numbers.
        """
        if self.news is None:
            raise DocumentError("no news was given")
        key = f"news#{impact}#{before}#{after}"
        if key not in self.names:
            self.names[key] = f"x{len(self.names)}"
            hit = self.news.where(F.col("impact") >= impact).select(F.explode(F.sequence(F.col("t") - 1 - after, F.col("t") - 1 + before)).alias("t")).distinct().withColumn(self.names[key], F.lit(True))
            self._frame = self._whole().join(hit, "t", "left")
        return F.coalesce(F.col(self.names[key]), F.lit(False))

    # signals and domain

    def domain(self, warmup: int = 0, lo: int = 0, hi: int = 1 << 30, weekdays: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)) -> Column:
        """Bars on which a signal may fall."""
        return F.col("anchored") & (F.col("sessmin") - self.anchor[0] >= warmup) & (F.col("sessmin") + 1 >= lo) & (F.col("sessmin") < hi) & self._dow({}).isin(*[float(d) for d in weekdays])

    def executable(self) -> Column:
        """0: the next bar follows in the session; 1: the session ends here; 2: a bar is missing."""
        after = F.lead("t").over(W.partitionBy("instrument", "session").orderBy("t"))
        return F.when(after.isNull(), 1).when(after != F.col("t") + 1, 2).otherwise(0)

    def signal(self, rule: dict) -> Column:
        """Where all of a rule's setup conditions and its trigger are true, on anchored bars."""
        parts = [self.condition(c) for c in rule.get("setup", [])] + [self.condition(rule["trigger"])]
        out = F.col("anchored")
        for p in parts:
            out = out & F.coalesce(p, F.lit(False))
        return out
