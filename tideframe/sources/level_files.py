"""Pasted level lists: headings switch how the lines after them are read, and each file keeps its lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import bound

# What a level's words are called. The first rule that fits counts: words inside, or the whole of it.
CODES = (
    ("RM", ("macro",), ("rm",)),
    ("HVL", ("flip", "hvl"), ()),
    ("MP", ("max pain", "maxpain"), ("mp",)),
    ("GW", ("gamma wall", "major wall"), ("gw",)),
    ("CR", ("call", "resist"), ("cr",)),
    ("PS", ("put", "support"), ("ps",)),
)


def read_level_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: whole files, as pasted lists are short and their lines belong together."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def clean_number(x: Column) -> Column:
    """A number without what decorates it, but with its sign; a comma before the last one or two digits is a decimal sign,
    else it parts thousands."""
    s = F.regexp_replace(F.regexp_replace(x, "[\\s\\u00a0\\u202f*`$_]", ""), "\\u2212", "-")
    s = bound(s, lambda s: F.when(s.rlike(r"^[-+]?\d+,\d{1,2}$"), F.regexp_replace(s, ",", ".")).otherwise(F.regexp_replace(s, ",", "")))
    return F.when(s.rlike(r"^[-+]?\d+(\.\d+)?$"), s.try_cast("double"))


def clean_tag(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[*`#]", ""), "-", " "), r"\s+", " "))


def code_of(tag: Column, prefix: Column) -> Column:
    """Short name of a level's words, after the expiry's digits; words without a rule are a name in capitals, none is empty."""
    t = F.lower(F.trim(tag))
    code = F.upper(t)
    for name, inside, whole in reversed(CODES):
        fits = F.lit(False)
        for word in inside:
            fits = fits | t.contains(word)
        for word in whole:
            fits = fits | (t == word)
        code = F.when(fits, name).otherwise(code)
    plain = (code == "") | (code == "RM") | (prefix == "") | code.rlike(r"^\d")
    return F.when(t == "", "").when(plain, code).otherwise(F.concat(prefix, code))


def sectioned(texts: DataFrame) -> DataFrame:
    """file, line (from 1), text (trimmed), section, prefix and header of each line that is no heading and not empty.

    A heading's words open a section: context, levels, data, or another that is not read; before the first one levels are read.
    A line of column names with `strike` opens the data that it heads. `prefix`: leading digits of the first line in a context
    that names a horizon, for the whole file.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("value", F.lit("")), "^\\ufeff", ""), "\r\n?", "\n")
    rows = texts.select("file", F.posexplode(F.split(clean, "\n")).alias("line", "text")).select("file", (F.col("line") + 1).alias("line"), F.trim("text").alias("text"))
    low, heading = F.lower("text"), F.col("text").startswith("#")
    names = F.when(low.rlike("level|niveau|zone"), "levels").when(low.rlike("context"), "context").when(low.rlike("data|donn"), "data").otherwise("other")
    head = low.contains("strike") & low.contains(",") & ~heading
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_heading": heading, "_head": head, "section": F.coalesce(F.last(F.when(heading, names).when(head, "data"), True).over(w), F.lit("levels"))})
    header = F.last(F.when(F.col("_head"), F.transform(F.split(low, ","), F.trim)), True).over(w)
    after = F.split(F.col("text"), "[:=|]", 2)
    told = (F.col("section") == "context") & low.contains("horizon") & (F.size(after) > 1)
    digits = F.regexp_extract(clean_tag(F.get(after, F.lit(1))), r"^(\d{1,3})", 1)
    prefix = F.first(F.when(told & (digits != ""), digits), True).over(W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumns({"header": header, "prefix": F.coalesce(prefix, F.lit(""))})
    return rows.where(~F.col("_heading") & ~F.col("_head") & (F.col("text") != "")).drop("_heading", "_head")


def level_lines(texts: DataFrame, band: float = 20.0) -> DataFrame:
    """Every line of the levels sections: file, line, text, prefix, price, tag, why (null where it is read): "no number", or
    "outside" what lies within `band` per cent of the file's median."""
    rows = sectioned(texts).where("section = 'levels'")
    body = F.regexp_replace("text", r"^-\s+", "")  # a dash before a blank is a bullet, not a sign
    rows = rows.withColumn("_parts", F.when(body.contains("="), F.split(body, "=", 2)).when(body.contains(":"), F.split(body, ":", 2)).when(body.contains("|"), F.filter(F.split(body, r"\|"), lambda x: F.trim(x) != "")).otherwise(F.array(body)))
    left, right = F.coalesce(F.get("_parts", F.lit(0)), F.lit("")), F.coalesce(F.get("_parts", F.lit(1)), F.lit(""))
    rows = rows.withColumns({"_left": clean_number(left), "_right": clean_number(right)})
    rows = rows.withColumns({"price": F.coalesce("_left", "_right"), "tag": clean_tag(F.when(F.col("_left").isNotNull(), right).otherwise(left))})
    middle = F.percentile("price", F.lit(0.5)).over(W.partitionBy("file"))
    away = F.abs(F.col("price") - middle) > F.abs(middle) * band / 100
    why = F.when(F.col("price").isNull(), "no number").when(away, "outside")
    return rows.select("file", "line", "text", "prefix", "price", F.when(F.col("price").isNotNull(), F.col("tag")).alias("tag"), why.alias("why"))


def named_levels(lines: DataFrame, tick: float = 0.25) -> DataFrame:
    """file, name, price, line of the read lines: by their words' code, unnamed ones N1, N2, ... in order. A second price under
    one name is name2, a third name3; the same price again (closer than a tick) is the same level."""
    rows = lines.where("why is null").withColumn("code", code_of(F.col("tag"), F.col("prefix")))
    place = F.row_number().over(W.partitionBy("file", F.col("code") == "").orderBy("line"))
    rows = rows.withColumn("code", F.when(F.col("code") == "", F.concat(F.lit("N"), place.cast("string"))).otherwise(F.col("code")))
    found = rows.groupBy("file", "code").agg(F.sort_array(F.collect_list(F.struct("line", "price"))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["price"] - x["price"]) < tick), acc).otherwise(F.concat(acc, F.array(x))))
    each = found.select("file", "code", F.posexplode(kept).alias("k", "x"))
    return each.select("file", F.when(F.col("k") == 0, F.col("code")).otherwise(F.concat("code", (F.col("k") + 1).cast("string"))).alias("name"), "x.price", "x.line")


def ranked_strikes(texts: DataFrame, named: DataFrame, price: float, top: int = 2, tick: float = 0.25) -> DataFrame:
    """file, name, price, line of the data sections' strikes of most weight on either side of a price: R1, R2 above, S1, S2 at
    or below, after the expiry's digits.

    A strike weighs the sum of the absolute figures of its lines, so legs of either sign do not cancel; the figure is the first
    column whose name has `net` or `gex`, else the last. Strikes that are levels already are left out; ties go to the first.
    """
    rows = sectioned(texts).where("section = 'data' and header is not null").withColumn("_cells", F.split("text", ","))
    strike = F.array_position("header", "strike").cast("int") - 1
    figure = F.aggregate(F.sequence(F.size("header") - 1, F.lit(0), F.lit(-1)), F.size("header") - 1, lambda acc, i: F.when(F.get("header", i).rlike("net|gex"), i).otherwise(acc))
    rows = rows.select("file", "line", "prefix", clean_number(F.get("_cells", strike)).alias("price"), F.abs(clean_number(F.get("_cells", figure))).alias("_w")).where("price is not null and _w is not null")
    sums = rows.groupBy("file", "prefix", F.round(F.col("price") / tick).alias("_k")).agg(F.sum("_w").alias("_w"), F.min_by("price", "line").alias("price"), F.min("line").alias("line"))
    taken = named.select("file", F.explode(F.array(*[F.round(F.col("price") / tick) + d for d in (-1, 0, 1)])).alias("_k"), F.col("price").alias("_named"))
    close = sums.join(taken, ["file", "_k"]).where(F.abs(F.col("price") - F.col("_named")) < tick).select("file", "_k").distinct()
    free = sums.join(close, ["file", "_k"], "left_anti").withColumn("_up", F.col("price") > price)
    rank = F.row_number().over(W.partitionBy("file", "_up").orderBy(F.desc("_w"), "line"))
    best = free.withColumn("_r", rank).where(F.col("_r") <= top)
    return best.select("file", F.concat("prefix", F.when(F.col("_up"), "R").otherwise("S"), F.col("_r").cast("string")).alias("name"), "price", "line")


def parse_level_texts(texts: DataFrame, price: float | None = None, band: float = 20.0, tick: float = 0.25, top: int = 2) -> DataFrame:
    """file, name, price, line of pasted texts (file, value): named levels, and, where a price is given, the ranked strikes of
    their data."""
    named = named_levels(level_lines(texts, band), tick)
    return named if price is None else named.unionByName(ranked_strikes(texts, named, price, top, tick))
