"""Windows along a series without one group a series: ranges of whole sessions with a halo, and prefix sums in levels.

A series has no bound, so no window here is keyed by the series alone. Frames that reach a known number of rows back run inside
ranges of about `rows` rows, each with copies of the sessions before it that cover the reach. Running sums run inside blocks of
the order, and what came before a block is added up over block totals, over totals of blocks of blocks, and so on, each of at
most 65,536 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the order inside a block, and of block numbers inside the next level's. Three levels take orders from -2**61 on,
#: below 2**61; one level, for numbers of sessions, from -2**29 on, below 2**29.
BLOCK_BITS, LEVEL_BITS, LEVELS, SESSION_LEVELS = 14, 16, 3, 1


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], inclusive: bool = True, levels: int | None = None) -> DataFrame:
    """rows with running sums along `order` (whole numbers, unique inside keys) of columns without a null's effect: over all
    rows before, and the row itself if inclusive.

    Two passes over the rows: block totals go up the levels and come back as what each block starts from.
    """
    inner = {f"_in_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    names, levels = list(sums), levels or LEVELS
    middle = 1 << (BLOCK_BITS + levels * LEVEL_BITS - 1)  # orders of either sign lie in one block of the last level
    based = rows.withColumns({**inner, "_b0": F.shiftright(F.col(order).cast("long") + F.lit(middle), BLOCK_BITS)})
    totals = [based.groupBy(*keys, "_b0").agg(*[F.sum(f"_in_{k}").alias(f"_s_{k}") for k in names])]
    for level in range(1, levels):
        up = totals[-1].groupBy(*keys, F.shiftright(f"_b{level - 1}", LEVEL_BITS).alias(f"_b{level}"))
        totals.append(up.agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in names]))
    before = None
    for level in reversed(range(levels)):
        part = W.partitionBy(*keys, f"_b{level + 1}").orderBy(f"_b{level}").rowsBetween(W.unboundedPreceding, -1)
        made = totals[level].withColumn(f"_b{level + 1}", F.shiftright(f"_b{level}", LEVEL_BITS))
        made = made.withColumns({f"_p_{k}": F.coalesce(F.sum(f"_s_{k}").over(part), F.lit(0)) for k in names}).drop(*[f"_s_{k}" for k in names])
        if before is not None:
            made = made.join(before.withColumnsRenamed({f"_p_{k}": f"_q_{k}" for k in names}), [*keys, f"_b{level + 1}"])
            made = made.withColumns({f"_p_{k}": F.col(f"_p_{k}") + F.col(f"_q_{k}") for k in names})
        before = made.select(*keys, f"_b{level}", *[f"_p_{k}" for k in names])
    here = W.partitionBy(*keys, "_b0").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = based.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_in_{k}").over(here), F.lit(0)) for k in names})
    out = local.join(before, [*keys, "_b0"])
    return out.withColumns({k: F.col(f"_in_{k}") + F.col(f"_p_{k}") for k in names}).select(*[c for c in rows.columns if c not in names], *names)


#: Bits of the second order column inside a block of running_in_order.
PART_BITS = 20
WHOLE = ("tinyint", "smallint", "int", "bigint")


def in_order_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in blocks that follow each other in the order of several columns: `_head`, the first column's value, and `_part`, a
    range of the second's where that is whole numbers (a range of the only column's as the head where there is one)."""
    kinds = dict(rows.dtypes)
    first, second = order[0], order[1] if len(order) > 1 else None
    head = F.shiftright(F.col(first).cast("long"), BLOCK_BITS) if second is None and kinds[first] in WHOLE else F.col(first)
    part = F.shiftright(F.col(second).cast("long"), PART_BITS) if second is not None and kinds[second] in WHOLE else F.lit(0).cast("long")
    return rows.withColumns({"_head": head, "_part": part})


def running_in_order(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], peaks: dict[str, str] | None = None, whole: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums of columns along an order of several columns (a null counts as 0), running maxima of some of
    these sums (peaks: name of the maximum -> name of the sum), and sums over all rows of the keys (whole).

    Sums and maxima run inside the blocks of in_order_parts; what a block starts from comes from the blocks' totals, first
    along the parts of a head, then along the heads of the keys. Keys and order columns may be null.
    """
    peaks, whole = peaks or {}, whole or {}
    block, every = ["_at", "_block"], {k: F.coalesce(v, F.lit(0)) for k, v in {**sums, **whole}.items()}
    # a block is one value, null keys and all, and rows are dealt by it once: totals, and what comes before rows, meet them there;
    # its hash leads, so that sorts compare numbers, and what it holds is not shuffled beside it
    told = lambda blocks: blocks.withColumn("_block", F.struct(*keys, "_head", "_part")).withColumn("_at", F.xxhash64("_block")).drop("_head", "_part", *keys)
    kept = {**{k: F.col("_block")[k] for k in keys}, **({order[0]: F.col("_block")["_head"]} if len(order) > 1 else {})}
    based = told(in_order_parts(rows, order)).drop(*kept).repartition(*block).withColumns(kept)
    here = W.partitionBy(*block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = based.withColumns({f"_in_{k}": F.sum(every[k]).over(here) for k in sums})
    parts = local.groupBy(*block).agg(*[F.sum(v).alias(f"_s_{k}") for k, v in every.items()], *[F.max(f"_in_{k}").alias(f"_m_{p}") for p, k in peaks.items()]).select("*", "_block.*").drop(*block)

    def carried(totals: DataFrame, group: list[str], by: str, mark: str) -> DataFrame:
        """What comes before each block of a group (sums: _b, maxima: _t), and where its own maxima stand in the group (_m)."""
        past = W.partitionBy(*group).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        made = totals.withColumns({f"_b{mark}_{k}": F.coalesce(F.sum(f"_s_{k}").over(past), F.lit(0)) for k in sums})
        made = made.withColumns({f"_m_{p}": F.col(f"_m_{p}") + F.col(f"_b{mark}_{k}") for p, k in peaks.items()})
        return made.withColumns({f"_t{mark}_{p}": F.max(f"_m_{p}").over(past) for p in peaks})

    parts = carried(parts, [*keys, "_head"], "_part", "0")
    heads = parts.groupBy(*keys, "_head").agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in every], *[F.max(f"_m_{p}").alias(f"_m_{p}") for p in peaks])
    heads = carried(heads, keys, "_head", "1").withColumns({k: F.sum(f"_s_{k}").over(W.partitionBy(*keys)) for k in whole})
    heads = heads.select(*keys, "_head", *[f"_b1_{k}" for k in sums], *[f"_t1_{p}" for p in peaks], *whole)
    before = _joined(parts, heads, [*keys, "_head"])
    tops = {f"_t_{p}": F.greatest(f"_t1_{p}", F.col(f"_b1_{k}") + F.col(f"_t0_{p}")) for p, k in peaks.items()}
    before = before.withColumns({**tops, **{f"_b_{k}": F.col(f"_b0_{k}") + F.col(f"_b1_{k}") for k in sums}})
    before = told(before).select(*block, *[f"_b_{k}" for k in sums], *tops, *whole)
    tall = {f"_h_{p}": F.max(f"_in_{k}").over(here) for p, k in peaks.items()}
    out = local.withColumns(tall).join(before, block)
    made = {**{k: F.col(f"_b_{k}") + F.col(f"_in_{k}") for k in sums}, **{p: F.greatest(f"_t_{p}", F.col(f"_b_{k}") + F.col(f"_h_{p}")) for p, k in peaks.items()}}
    return out.withColumns(made).select(*[c for c in rows.columns if c not in made and c not in whole], *made, *whole)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, a row for every left one; null keys are equal."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    twice = [c for c in right.columns if c in left.columns and c not in keys]
    return left.drop(*twice).join(named, on).drop(*[f"_right_{k}" for k in keys])


def session_places(bars: DataFrame) -> DataFrame:
    """instrument, session, n_rows, before (rows of the instrument's sessions before it), place (number of the session, from 1)."""
    days = bars.groupBy("instrument", "session").agg(F.count(F.lit(1)).alias("n_rows"))
    made = running_sums(days, ["instrument"], "session", {"upto": F.col("n_rows"), "place": F.lit(1)}, levels=SESSION_LEVELS)
    return made.select("instrument", "session", "n_rows", (F.col("upto") - F.col("n_rows")).alias("before"), "place")


#: Estimated bytes of a table up to which what is one row a session of it is broadcast.
SMALL = 64 << 20


def with_places(bars: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """bars with their session's n_rows, before and place. places: session_places of these bars, if known more cheaply.

    A table of places has no more bytes than the bars themselves, so it is broadcast where the plan's estimate of theirs is
    small, and shuffled to them by session else.
    """
    size = int(bars._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    found = session_places(bars) if places is None else places
    return bars.join(F.broadcast(found) if size <= SMALL else found, ["instrument", "session"])


def in_ranges(bars: DataFrame, reach: int, rows: int) -> DataFrame:
    """bars (with n_rows and before of session_places) in ranges: `_range`, and `_own` false on copies that only serve a
    later range. Each row is its own in one range, and that range has the `reach` rows before it, as far as there are any.

    A range begins with a session, so frames inside sessions need no copies. Copies are at most reach / rows + 2 of a row.
    """
    first = F.floor(F.col("before") / rows)
    last = F.floor((F.col("before") + F.col("n_rows") + (reach - 1)) / rows)
    spread = bars.withColumn("_first", first).withColumn("_range", F.explode(F.sequence(F.col("_first"), F.greatest("_first", last))))
    return spread.withColumn("_own", F.col("_range") == F.col("_first")).drop("_first")


def in_order_blocks(rows: DataFrame, order: str, reach: int) -> DataFrame:
    """rows in blocks of a whole-number order: `_block`, and `_own` false on copies that serve the blocks after. Each block has
    all rows that lie up to `reach` before its first in the order."""
    size = max(1 << BLOCK_BITS, 4 * reach)
    at = F.col(order).cast("long")
    spread = rows.withColumn("_first", F.floor(at / size)).withColumn("_block", F.explode(F.sequence(F.col("_first"), F.floor((at + reach) / size))))
    return spread.withColumn("_own", F.col("_block") == F.col("_first")).drop("_first")


def own(rows: DataFrame) -> DataFrame:
    """The rows of in_order_blocks, each once again."""
    return rows.where("_own").drop("_own", "_block")
