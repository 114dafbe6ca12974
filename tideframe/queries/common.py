"""Rounding that Spark and DuckDB do alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits).alias(name)


def r6_all(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def r6_sql(x: str, name: str, digits: int = 6) -> str:
    """The same in SQL, minus zero as zero."""
    return f"CASE WHEN round(CAST({x} AS DOUBLE), {digits}) = 0 THEN 0.0 ELSE round(CAST({x} AS DOUBLE), {digits}) END AS {name}"
