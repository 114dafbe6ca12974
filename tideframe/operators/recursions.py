"""Recursions along a series: decaying sums by windows, and swings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decay_length(keep: float) -> int:
    """Steps after which a power of `keep` lies below a double's last digit."""
    return max(1, math.ceil(17 / -math.log10(keep))) if 0 < keep < 1 else 1


def decaying_sum(place: Column, term: Column, keep: float, keys: list[str]) -> tuple[dict[str, Column], Column, Column]:
    """Parts of y[p] = keep * y[p - 1] + term[p], p = 0, 1, ... along each run of rows (keys), by window sums alone.

    Places are cut into blocks so long that keep ** length falls below 1e-17: what lies two blocks back is below the last
    digit, and inside a block sums scaled by powers of keep are exact to rounding. Gives helper columns (to be added first),
    the sum within the block, and the carry of the block before, both read where place is not null.
    """
    length = decay_length(keep)
    block, offset = F.floor(place / length), F.pmod(place, F.lit(length))
    helpers = {"_block": block, "_offset": offset, "_scaled": term * F.pow(F.lit(float(keep)), -offset)}
    inside = W.partitionBy(*keys, "_block").orderBy("_offset").rowsBetween(W.unboundedPreceding, 0)
    local = F.pow(F.lit(float(keep)), F.col("_offset")) * F.sum("_scaled").over(inside)
    before = W.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    carry = F.pow(F.lit(float(keep)), F.col("_offset") + 1) * F.max(F.when(F.col("_offset") == length - 1, F.col("_local"))).over(before)
    return helpers, local, carry


def zigzag(rows: DataFrame, series: list[str], order: str, value: str, threshold: float, told: str | None = None) -> DataFrame:
    """Swings of each series: pivots (order, value, is_high) confirmed by a reversal of at least `threshold`; in a column
    `told`, if named, where along the order each was.

    A pivot depends on the path, so a series (a session: bounded) is one group.
    """
    schema = T.StructType([rows.schema[k] for k in series] + [rows.schema[order], T.StructField("price", T.DoubleType()), T.StructField("is_high", T.BooleanType()), *([T.StructField(told, rows.schema[order].dataType)] if told else [])])
    names = [order, "price", "is_high", *([told] if told else [])]

    def swings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at, x = pdf[order].to_numpy(), pdf[value].to_numpy(dtype=float)
        out: list[tuple] = []
        hi = lo = 0
        way = 0
        for i in range(1, len(x)):
            if way >= 0 and x[i] > x[hi]:
                hi = i
            if way <= 0 and x[i] < x[lo]:
                lo = i
            if way >= 0 and x[hi] - x[i] >= threshold:
                out.append((at[hi], x[hi], True, at[i])[: len(names)])
                way, lo = -1, i
            elif way <= 0 and x[i] - x[lo] >= threshold:
                out.append((at[lo], x[lo], False, at[i])[: len(names)])
                way, hi = 1, i
        made = pd.DataFrame(out, columns=names)
        for k in series:
            made.insert(0, k, pdf[k].iloc[0])
        return made[[*series, *names]]

    return rows.select(*series, order, value).groupBy(*series).applyInPandas(swings, schema)
