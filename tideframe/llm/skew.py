"""Joins with tables of one row a key, where a few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most keys that are broadcast, and the rows of a key up to which it is always shuffled.
MOST_KEYS, FEW_ROWS = 100_000, 1000


def frequent(count: str, total: int):
    """Whether a key holds so many rows that it is broadcast: there are MOST_KEYS such keys at most among `total` rows."""
    return F.col(count) > max(FEW_ROWS, total // MOST_KEYS)


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with table (one row a key; `count`: how many of `rows`, `total` in all, have that key).

    Rows of frequent keys stay where they are and meet a broadcast of those keys; the others are shuffled by key, so no
    task gets more than a bounded number of one key's rows.
    """
    often = F.broadcast(table.where(frequent(count, total)))
    rare = table.where(~frequent(count, total))
    left = rows.join(F.broadcast(table.where(frequent(count, total)).select(*keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(left.join(rare, keys))
