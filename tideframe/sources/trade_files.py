"""Trade files, pasted results, levels, ledgers and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import DEAD_STATUS, TRADE_ALIASES, columns_of, instant, number


def read_trades(spark: SparkSession, path: str, sep: str = ",", month_first: bool = False) -> DataFrame:
    """Fills (symbol, root, side B or S, qty, price, ts, commission) of an execution export; dead orders are left out.

    A negative quantity sells. A file of round trips (entry and exit columns, or buy and sell ones) gives two fills a line; of
    bought and sold ones each column says its side. A comma is a decimal sign where another sign parts the columns.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    at = columns_of(raw.columns, TRADE_ALIASES)
    pick = lambda k: F.col(f"`{raw.columns[at[k]]}`") if k in at else F.lit(None).cast("string")
    live = ~F.coalesce(F.lower(pick("status")).rlike(DEAD_STATUS), F.lit(False))
    figure = lambda k: number(pick(k), None if sep == "," else True)
    qty = figure("qty")
    side = F.when(F.lower(pick("side")).rlike("^(b|buy|long|achat)"), "B").when(F.lower(pick("side")).rlike("^(s|sell|short|vente)"), "S").when(qty < 0, "S").when(qty > 0, "B")
    symbol = F.coalesce(pick("symbol"), F.lit(""))
    root = F.regexp_extract(F.upper(symbol), r"^/?([A-Z]{1,4}?)(?:[FGHJKMNQUVXZ]\d{1,2})?(?:[ .-].*)?$", 1)
    common = [symbol.alias("symbol"), root.alias("root"), (F.abs(qty) if "qty" in at else F.lit(1.0)).alias("qty"), F.coalesce(figure("commission"), F.lit(0.0)).alias("commission")]
    leg = lambda s, p, t: F.struct(s.alias("side"), figure(p).alias("price"), instant(pick(t), month_first).alias("ts"))
    legs = None
    if "entry_price" in at and "exit_price" in at:
        legs = leg(side, "entry_price", "entry_time"), leg(F.when(side == "B", "S").otherwise("B"), "exit_price", "exit_time")
    elif "buy_price" in at and "sell_price" in at:
        legs = leg(F.lit("B"), "buy_price", "buy_time"), leg(F.lit("S"), "sell_price", "sell_time")
    if legs:
        both = raw.where(live).select(*common, F.explode(F.array(*legs)).alias("x")).where("qty > 0 and x.side is not null and x.price is not null")
        return both.select("symbol", "root", "x.side", "qty", "x.price", "x.ts", (F.col("commission") / 2).alias("commission"))
    rows = raw.where(live).select(*common, side.alias("side"), figure("price").alias("price"), instant(pick("time"), month_first).alias("ts"))
    return rows.where("qty > 0 and side is not null and price is not null").select("symbol", "root", "side", "qty", "price", "ts", "commission")


def parse_results(lines: DataFrame, risk: float | None = None) -> DataFrame:
    """Pasted results, a line each, as r: date and amount in any order; amounts in money are divided by the risk."""
    amount = F.regexp_extract("value", r"(\(?[-+−]?\s*[$€]?\s*\d[\d\s., ]*\)?)\s*([RrKk$€]?)\s*$", 1)
    day = F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})", 1)
    value = number(F.when(F.length(amount) > 0, amount))
    return lines.select(instant(F.when(F.length(day) > 0, day)).cast("date").alias("day"), (value / risk if risk else value).alias("r")).where("r is not null")


LEVEL = r"^\s*(?:[-*]\s*)?(?:\*\*)?\s*([\p{L}][\p{L}\p{N} _./+-]*?)\s*(?:\*\*)?\s*[:=|]\s*(-?\d[\d\s,.]*)\s*(?:\*\*)?\s*$"
LEVEL_BACK = r"^\s*(?:[-*]\s*)?(-?\d[\d\s,.]*)\s*[:=|]\s*(?:\*\*)?\s*([\p{L}][\p{L}\p{N} _./+-]*?)\s*(?:\*\*)?\s*$"


def parse_levels(lines: DataFrame, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """(name, price) of pasted lines "name : price" or "price = name"; prices outside the plausible window go."""
    name = F.coalesce(F.nullif(F.regexp_extract("value", LEVEL, 1), F.lit("")), F.nullif(F.regexp_extract("value", LEVEL_BACK, 2), F.lit("")))
    price = F.coalesce(F.nullif(F.regexp_extract("value", LEVEL, 2), F.lit("")), F.nullif(F.regexp_extract("value", LEVEL_BACK, 1), F.lit("")))
    rows = lines.select(F.upper(F.trim(F.regexp_replace(name, r"[\s_]+", " "))).alias("name"), number(price).alias("price"))
    return rows.where(F.col("name").isNotNull() & F.col("price").between(low, high))


LEDGER = "ts timestamp, pseudo string, instrument string, side string, outcome double, source string, note string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a ledger; a line that does not fit stops the read."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(LEDGER).csv(path)


def write_ledger(calls: DataFrame, path: str) -> None:
    calls.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.option("header", True).mode("overwrite").csv(path)


def write_journal(rows: DataFrame, path: str) -> None:
    """Semicolons and decimal commas; text that a spreadsheet would take for a formula is quoted by an apostrophe."""
    safe = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind == "string":
            safe.append(F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c).alias(name))
        elif kind in ("double", "float"):
            safe.append(F.translate(c.cast("string"), ".", ",").alias(name))
        else:
            safe.append(c)
    rows.select(*safe).write.option("header", True).option("sep", ";").mode("overwrite").csv(path)


def result_document(trades: DataFrame, order: list[str], most: int = 3000) -> DataFrame:
    """The last trades of each setting as JSON rows, and how many were left out."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("config").orderBy(*[F.desc(c) for c in order]))
    kept = trades.withColumn("_k", rank)
    return kept.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.to_json(F.struct(*trades.columns))))).alias("rows")).withColumn("left_out", F.greatest(F.col("n") - most, F.lit(0)))


def upsert_plan(rows: DataFrame, known: DataFrame, key: str, batch: int = 50) -> DataFrame:
    """Rows not known yet, numbered in batches of at most `batch` writes in order of key.

    Numbers come from counts of key ranges, so no single task sorts all rows.
    """
    fresh = rows.join(known.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    parts = fresh.repartitionByRange(key).sortWithinPartitions(key).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return parts.withColumn("batch", F.concat_ws("-", "_p", F.floor(F.col("_i") / batch))).drop("_p", "_i")
