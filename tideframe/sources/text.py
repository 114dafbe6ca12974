"""Cleaning of numbers, times and headers, as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header aliases of bar and trade files, normalised.
BAR_ALIASES = {
    "time": ["time", "timestamp", "datetime", "date", "ts", "horodatage", "dateheure", "gmttime"],
    "clock": ["heure", "hour", "clock"],
    "o": ["open", "o", "ouverture", "ouv"],
    "h": ["high", "h", "haut", "plushaut", "max"],
    "l": ["low", "l", "bas", "plusbas", "min"],
    "c": ["close", "c", "last", "cloture", "clot", "dernier", "price"],
    "v": ["volume", "vol", "v", "qty"],
}
TRADE_ALIASES = {
    "symbol": ["symbol", "contract", "instrument", "ticker"],
    "side": ["bs", "side", "action", "buysell", "direction"],
    "qty": ["qty", "quantity", "filledqty", "size", "contracts"],
    "price": ["price", "avgfillprice", "avgprice", "fillprice"],
    "time": ["filltime", "timestamp", "time", "datetime", "date"],
    "status": ["status", "state"],
    "commission": ["commission", "fees", "fee"],
    "entry_time": ["entrytime", "opentime"],
    "exit_time": ["exittime", "closetime"],
    "entry_price": ["entryprice", "openprice"],
    "exit_price": ["exitprice", "closeprice"],
    "buy_price": ["buyprice", "boughtprice", "avgbuyprice"],
    "sell_price": ["sellprice", "soldprice", "avgsellprice"],
    "buy_time": ["buytime", "boughttimestamp", "boughttime", "buytimestamp"],
    "sell_time": ["selltime", "soldtimestamp", "soldtime", "selltimestamp"],
    "pnl": ["pl", "pnl", "profit", "netprofit", "profitloss"],
}
DEAD_STATUS = "cancel|reject|expire|work|pend"


def alias(name: str) -> str:
    """A header without accents, case and signs."""
    plain = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]", "", plain.lower())


def columns_of(header: list[str], aliases: dict[str, list[str]]) -> dict[str, int]:
    """Position of each known column in a header; the first alias that is there wins."""
    names = [alias(h) for h in header]
    return {k: names.index(a) for k, options in aliases.items() for a in [next((x for x in options if x in names), None)] if a}


def number(x: Column, decimal_comma: Column | bool | None = None) -> Column:
    """A number from text: blanks, currency signs and thousands marks go, parentheses are a minus; null if it is none.

    Of both signs the last one is the decimal; one comma alone is a decimal if one or two digits, or not three, follow.
    """
    s = F.regexp_replace(F.trim(x), "[\\s\\u00a0\\u202f'$€£R]", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    s = F.regexp_replace(s, "^\\u2212", "-")
    return bound(s, lambda s: _plain_number(s, decimal_comma).try_cast("double"))


def bound(x: Column, use) -> Column:
    """use(x) with x worked out once, however often it is named."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _plain_number(s: Column, decimal_comma: Column | bool | None) -> Column:
    """Digits with a point from digits with commas and points."""
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    both = s.contains(",") & s.contains(".")
    only = s.contains(",") & ~s.contains(".")
    grouped = s.rlike(r"^-?\d{1,3}(,\d{3})+$")
    if decimal_comma is not None:
        grouped = grouped & ~(decimal_comma if isinstance(decimal_comma, Column) else F.lit(decimal_comma))
    plain = F.when(both & comma_last, F.translate(s, ".,", "\x00.")).when(both, F.regexp_replace(s, ",", "")).when(only & grouped, F.regexp_replace(s, ",", "")).when(only, F.translate(s, ",", ".")).otherwise(s)
    return F.regexp_replace(plain, "\x00", "")


def instant(x: Column, month_first: bool = False) -> Column:
    """A UTC timestamp from epoch seconds or milliseconds, ISO with or without zone, packed, dotted or slashed dates."""
    return bound(F.trim(x), lambda s: _instant(s, month_first))


def _instant(s: Column, month_first: bool) -> Column:
    swapped = F.regexp_replace(s, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})", "$3-$1-$2" if month_first else "$3-$2-$1")
    swapped = F.regexp_replace(F.regexp_replace(swapped, r"-(\d)(?=[- T])", "-0$1"), r"-(\d)$", "-0$1")
    swapped = F.regexp_replace(swapped, r"^(\d{4})[./](\d{2})[./](\d{2})", "$1-$2-$3")
    packed = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})[ T]?(\d{2}):?(\d{2}):?(\d{2})?$", "$1-$2-$3 $4:$5:$6")
    packed = F.regexp_replace(packed, ":$", ":00")
    return (
        F.when(s.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double")))
        .when(s.rlike(r"^\d{12,13}$"), F.timestamp_millis(s.try_cast("long")))
        .when(s.rlike(r"^\d{8}[ T]?\d{2}:?\d{2}"), packed.try_cast("timestamp"))
        .otherwise(swapped.try_cast("timestamp"))
    )
