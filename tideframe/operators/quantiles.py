"""Exact quantiles of any number of rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import running_sums

#: Rank error of the bounds that are taken first, as one over this of the rows.
ACCURACY = 10_000


#: Tasks that values of one key are dealt to at least.
SALTS = 32


#: Keys whose figures are broadcast to rows, at most.
MOST_KEYS = 1_000


def few_keys(rows: DataFrame, keys: list[str]) -> bool:
    """Whether rows have at most MOST_KEYS different keys; reads the keys' columns."""
    return not keys or rows.select(*keys).distinct().limit(MOST_KEYS + 1).count() <= MOST_KEYS


def join_values(values: DataFrame, told: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    """values with what is told of each key (one row a key), those of a key dealt to several tasks. few: few_keys is known to
    hold, so what is told is broadcast and no value is shuffled; else there should be one row a value of a key."""
    copies = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return values.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(F.broadcast(copies) if few else copies, [*keys, "_salt"]).drop("_salt")


def valued(rows: DataFrame, keys: list[str], value: str, few: bool) -> DataFrame:
    """keys, _v and _c for join_values: rows as they are where keys are few, else how many have each value; nulls do not count."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return known.withColumn("_c", F.lit(1).cast("long")) if few else known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, levels: list[float], name: str = "quantiles", few: bool = False) -> DataFrame:
    """keys, n and an array of the values' quantiles at levels, linear between order statistics; null values do not count.

    Sketches give two values around each quantile, whose rank error has a bound; what lies outside of all such bands is only
    counted, and of the distinct values in a band, with one more on either side, counts are summed up in order. So a task
    sorts about a 2,000th part of the distinct values of a key, and repeated values cost one row. few: few_keys is known to
    hold; rows then meet their bands as they are read, and only values inside bands are told apart.

    A sketch's values depend on the order in which its parts arrive, so a second run of it may give others. They are used in
    one place, where each value is told to lie under, in or over every band; what follows reads only that.
    """
    margin, few = 2.0 / ACCURACY, few or not keys
    ends = [F.lit(min(1.0, max(0.0, x + d))) for x in levels for d in (-margin, margin)]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(*ends), ACCURACY).alias("_ends")).where("_ends is not null")
    told = bounds.select(*keys, *[F.element_at("_ends", j + 1).cast("double").alias(f"_e{j}") for j in range(len(ends))])
    values, v = valued(rows, keys, value, few), F.col("_v")
    joined = join_values(values, told, keys, "_v", few) if keys else values.crossJoin(F.broadcast(told))  # one row
    # a sign a level: under, in or over its band; values in no band that have the same signs are one group
    signs = F.concat(*[F.when(v < F.col(f"_e{j}"), "-").when(v > F.col(f"_e{j + 1}"), "+").otherwise("0") for j in range(0, len(ends), 2)])
    told_apart = F.when(F.col("_signs").contains("0"), v)
    zones = joined.withColumn("_signs", signs).groupBy(*keys, "_signs", told_apart.alias("_v")).agg(F.sum("_c").alias("_c"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("level")) for i, x in enumerate(levels)]))
    levelled = zones.select("*", each.alias("_q")).select(*zones.columns, "_q.*").withColumn("_sign", F.expr("substring(_signs, i + 1, 1)"))
    # a level's values in order: the last of all under its band, each in the band, the first of all over it
    groups = [*keys, "i"]
    parts = levelled.groupBy(*groups, "level", "_sign", F.when(F.col("_sign") == "0", v).alias("_v")).agg(F.sum("_c").alias("_c"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    parts = parts.withColumn("_v", F.when(F.col("_sign") == "-", F.col("_most")).otherwise(F.col("_least")))
    upto = W.partitionBy(*groups).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    band = parts.withColumns({"_upto": F.sum("_c").over(upto), "n": F.sum("_c").over(upto.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    at = (F.col("n") - 1) * F.col("level")

    def ranked(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, v))

    found = band.groupBy(*groups, "n", "level").agg(ranked(F.floor(at)).alias("a"), ranked(F.ceil(at)).alias("b"))
    exact = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    made = found.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", exact.alias("x")))).alias("_all"))
    return made.select(*keys, "n", F.transform("_all", lambda q: q["x"]).alias(name))


def whole_quantiles(rows: DataFrame, value: str, levels: list[float], scale: float = 1.0) -> DataFrame:
    """One row: an array (quantiles) of all rows' quantiles at any number of levels, linear between order statistics, of whole
    numbers over a scale; null values do not count.

    Distinct values are numbered by prefix sums of their counts, so no task holds or sorts them all, and a level is the value
    whose numbers it falls among.
    """
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(F.col(value).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    numbered = running_sums(counts, [], "_v", {"_upto": F.col("_c")})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(levels)]))
    told = known.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select("_n", each.alias("_l")).select(F.col("_l.i").alias("_i"), ((F.col("_n") - 1) * F.col("_l.x")).alias("_at"))
    has = lambda rank: (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
    lower, upper, x = F.floor("_at"), F.ceil("_at"), F.col("_v") / scale
    found = numbered.join(F.broadcast(told), has(lower) | has(upper)).groupBy("_i", "_at").agg(F.max(F.when(has(lower), x)).alias("_a"), F.max(F.when(has(upper), x)).alias("_b"))  # one row a level
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((upper - F.col("_at")) * F.col("_a") + (F.col("_at") - lower) * F.col("_b"))
    return found.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", exact.alias("x")))), lambda q: q["x"]).alias("quantiles"))
