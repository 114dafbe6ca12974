"""A filter of ids of bounded size, so that a scan passes few rows on to a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix

#: The most bits (32 MB). With more ids than a tenth of that, more other ids pass; none of the own is ever held back.
MOST_BITS = 1 << 28
WORD = 63


def _places(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and two bits of each id."""
    h = mix(ids.view(U))
    return (h % U(words)).astype(np.int64), (h >> U(40)) % U(WORD), (h >> U(52)) % U(WORD)


def id_filter(ids: DataFrame, column: str) -> "IdFilter":
    """The filter of a column of longs without nulls. The driver sees its words only, MOST_BITS at most."""
    count = ids.count()
    words = int(min(max(1 << 10, count // 4), MOST_BITS // 64))

    @F.pandas_udf("struct<w: long, b: long>")
    def place(x: pd.Series) -> pd.DataFrame:
        word, one, two = _places(x.to_numpy(np.int64), words)
        return pd.DataFrame({"w": word, "b": ((U(1) << one) | (U(1) << two)).view(np.int64)})

    found = ids.select(place(F.col(column)).alias("p")).groupBy("p.w").agg(F.bit_or("p.b").alias("b")).toPandas()
    table = np.zeros(words, U)
    table[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(U)
    return IdFilter(table, ids)


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each id: whether the filter's table may hold it."""
    word, one, two = _places(ids, len(table))
    bits = (U(1) << one) | (U(1) << two)
    return (table[word] & bits) == bits


class IdFilter:
    def __init__(self, table: np.ndarray, ids: DataFrame):
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, column: str) -> Column:
        """True where the id may be one of the filter's; false where it surely is none, or null."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(x: pd.Series) -> pd.Series:
            return pd.Series(may_hold(shared.value, x.fillna(0).to_numpy(np.int64))) & x.notna().to_numpy()

        return test(F.col(column))
