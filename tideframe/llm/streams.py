"""Helpers for functions over iterators of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import tidy


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a stream sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            change[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[lo].as_py() for k in keys)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def with_outputs(rows: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], outputs: str) -> DataFrame:
    """rows and the columns that compute makes of each batch of them (outputs: a DDL string).

    A column of rows with the name of an output gives way to it.
    """
    made = T.StructType.fromDDL(outputs)
    kept = [f for f in rows.schema.fields if f.name not in made.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = compute(batch)
            yield pa.record_batch([batch.column(n) for n in names] + [found[n] for n in made.names], names=names + made.names)

    return rows.select(*[f"`{n}`" for n in names]).mapInArrow(tidy(run), T.StructType(kept + made.fields))
