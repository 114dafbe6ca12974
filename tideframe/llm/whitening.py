"""Whitening of embeddings by merged singular value decompositions.

Vectors become integers on a grid (floor of 256 times an entry); the fit reads each distinct one once. Every partition keeps
all singular values and right vectors of its centred rows, with their mean; two such summaries merge by decomposing their
scaled vectors under one another together with one row that corrects for the difference of the means. Nothing is cut off, so
the last summary has the covariance of all rows, and no product of uncentred values is ever taken. Merges go up a tree of
eight at a time: a task holds eight summaries of width x width numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .scratch import Scratch

GRID = 256
#: Rows that are decomposed or projected at once, and summaries that merge in one task.
BLOCK_ROWS, FAN_IN = 4096, 8


@dataclass
class Summary:
    """n rows: their exact sums, and the singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([x / self.n for x in self.sums])


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of a block of longs."""
    if len(x) * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)]


def summarise(x: np.ndarray) -> Summary:
    """The summary of a block of rows of longs."""
    sums = exact_sums(x)
    mean = np.array([s / len(x) for s in sums])
    _, values, vectors = np.linalg.svd(x - mean, full_matrices=False)
    return Summary(len(x), sums, values, vectors)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both sets of rows: all of either's scaled vectors and one mean-correction row, decomposed anew."""
    shift = np.sqrt(a.n * b.n / (a.n + b.n)) * (a.mean - b.mean)
    stacked = np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, shift])
    _, values, vectors = np.linalg.svd(stacked, full_matrices=False)
    return Summary(a.n + b.n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], values, vectors)


def gridded(table: DataFrame, column: str = "embedding") -> DataFrame:
    """table with x, the longs floor(256 * entry), without rows whose vector is null or holds null or non-finite entries.

    An empty vector has no entries and no components: it goes as well. Entries beyond a long's range take its end.
    """
    wide = F.transform(column, lambda c: c.cast("double"))
    finite = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = table.where(F.col(column).isNotNull() & finite & (F.size(column) > 0))
    return kept.withColumn("x", F.transform(wide, lambda c: F.floor(c * GRID)))


def _blocks(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Blocks of rows of one width: longs as a matrix, and the other columns' rows."""
    for batch in batches:
        lists = batch.column("x")
        widths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        start = np.concatenate([[0], np.cumsum(widths)])
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            for lo in range(0, len(rows), BLOCK_ROWS):
                some = rows[lo : lo + BLOCK_ROWS]
                yield flat[start[some][:, None] + np.arange(width)], [batch.column(o).take(pa.array(some)) for o in others]


SUMMARY = "part long, width int, n long, sums array<decimal(38,0)>, factors array<double>, extra array<double>"


def _row(part: int, width: int, s: Summary) -> dict:
    return {"part": part, "width": width, "n": s.n, "sums": [Decimal(x) for x in s.sums], "factors": s.values.tolist(), "extra": s.vectors.ravel().tolist()}


def _summary(row) -> Summary:
    width = int(row["width"])
    return Summary(int(row["n"]), [int(x) for x in row["sums"]], np.array(row["factors"], float), np.array(row["extra"], float).reshape(-1, width))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """One summary a width of a partition's rows."""
    held: dict[int, Summary] = {}
    for x, _ in _blocks(batches):
        made = summarise(x)
        held[x.shape[1]] = merge(held[x.shape[1]], made) if x.shape[1] in held else made
    part = TaskContext.get().partitionId()
    for width, s in held.items():
        yield pa.RecordBatch.from_pylist([_row(part, width, s)], schema=_ARROW)


_ARROW = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("factors", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64()))])


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    out = None
    for _, row in rows.iterrows():
        s = _summary(row)
        out = s if out is None else merge(out, s)
    first = rows.iloc[0]
    return pd.DataFrame([_row(int(first["part"]) // FAN_IN, int(first["width"]), out)])


def _tree(scratch: Scratch, rows: DataFrame, schema: str, join: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """One row a width of rows (part, width, ...), eight parts at a time."""
    rows = scratch.cut(rows)
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = rows.groupBy("width", F.floor(F.col("part") / FAN_IN).alias("up")).applyInPandas(join, schema)
        parts = -(-parts // FAN_IN)
    return rows


@dataclass
class Whitening:
    """Of one width: rows, their exact sums, eigenvalues (falling) and unit eigenvectors of the covariance (divisor n)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def rank(self) -> int:
        return int((self.eigenvalues > 0).sum())

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they surely fit, else Python's integers."""
        if self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray, components: int) -> np.ndarray:
        """Projections on the first components of eigenvalue over 0, with unit variance."""
        return (deviations.astype(float) / self.n) @ self.components[:components].T / np.sqrt(self.eigenvalues[:components])


def _whitening(s: Summary) -> Whitening:
    width = len(s.sums)
    values, vectors = np.zeros(width), np.zeros((width, width))
    values[: len(s.values)], vectors[: len(s.values)] = s.values, s.vectors
    values[values <= values[0] * width * np.finfo(float).eps] = 0
    # either sign would do; this one does not hang on the order of partitions
    strongest = np.abs(vectors).argmax(axis=1)
    vectors *= np.where(vectors[np.arange(width), strongest] < 0, -1.0, 1.0)[:, None]
    return Whitening(s.n, s.sums, values**2 / s.n, vectors)


SECOND = "part long, width int, n long, sums array<double>, products array<double>"


def _second_moments(shared):
    """Sums and sums of products of all whitened dimensions over a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for x, _ in _blocks(batches):
            model: Whitening = shared.value[x.shape[1]]
            z = model.whitened(model.deviations(x), model.rank)
            n, sums, products = held.get(x.shape[1], (0, 0.0, 0.0))
            held[x.shape[1]] = n + len(z), sums + z.sum(axis=0), products + z.T @ z
        part = TaskContext.get().partitionId()
        for width, (n, sums, products) in held.items():
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "width": pa.array([width], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64())), "products": pa.array([products.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    add = lambda c: np.sum(np.stack(rows[c].to_list()), axis=0).tolist()
    first = rows.iloc[0]
    return pd.DataFrame([{"part": int(first["part"]) // FAN_IN, "width": int(first["width"]), "n": int(rows["n"].sum()), "sums": add("sums"), "products": add("products")}])


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """The whitening of each width of vectors (x, see gridded), over each distinct vector once.

    The driver sees one summary a width, of width x width numbers; widths are those of embedding models, so few.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    distinct = scratch.cut(vectors.select("x").distinct())
    found = _tree(scratch, distinct.mapInArrow(tidy(_summarised), SUMMARY), SUMMARY, _merged).toPandas()
    models = {int(row["width"]): _whitening(_summary(row)) for _, row in found.iterrows()}
    if models:
        shared = spark.sparkContext.broadcast(models)
        for _, row in _tree(scratch, distinct.mapInArrow(tidy(_second_moments(shared)), SECOND), SECOND, _added).toPandas().iterrows():
            model, n = models[int(row["width"])], row["n"]
            mean = np.array(row["sums"]) / n
            if model.rank:
                covariance = np.array(row["products"]).reshape(model.rank, -1) / n - np.outer(mean, mean)
                model.identity_error = float(np.abs(covariance - np.eye(model.rank)).max())
    return models


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(shared, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, (ids,) in _blocks(batches, "vec_id"):
            model: Whitening = shared.value[x.shape[1]]
            rows, count = len(x), min(components, x.shape[1])
            gaps = model.deviations(x)
            least = max(abs(int(gaps.min())), abs(int(gaps.max()))) ** 2 * x.shape[1]
            squares = (gaps if least < 1 << 63 else gaps.astype(object)) ** 2
            deviation = [int(v) if v < 1 << 63 else None for v in squares.sum(axis=1)]
            z = np.full((rows, count), np.nan)
            some = min(count, model.rank)
            z[:, :some] = model.whitened(gaps, some)
            trace = model.eigenvalues.sum()
            explained = model.eigenvalues[:count] / trace if trace > 0 else np.full(count, np.nan)
            each = pa.array(np.repeat(np.arange(rows), count))
            flat = lambda v: pa.array(v.ravel(), pa.float64(), from_pandas=True)  # noqa: E731  nan is null
            yield pa.record_batch(
                {
                    "vec_id": ids.cast(pa.int64()).take(each),
                    "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * count, model.n, np.int64)),
                    "deviation": pa.array(deviation, pa.int64()).take(each),
                    "whitened": flat(z),
                    "explained": flat(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * count, model.identity_error)),
                }
            )

    return run


def whiten(table: DataFrame, components: int = 4) -> DataFrame:
    """Each vector of table (vec_id, embedding) on its first components, whitened.

    One row for each vector that gridded keeps and each component up to `components` and the vectors' width: n (fitted
    vectors), deviation (sum of (n * x - S) ** 2 over dimensions, S being the fitted vectors' sums; exact, null beyond a
    long), whitened, explained (share of the variance), identity_error (largest deviation of the fitted vectors' whitened
    covariance from the identity, over all dimensions that vary).

    Vectors of each width have a fit of their own. A dimension without variance has null as whitened value and explains 0, or
    null where none varies. Equal vectors count once in the fit and come out each; a null vec_id stays; an empty table gives
    no rows; other columns are not read. Equal eigenvalues are numbered in the order that the decomposition gives.
    """
    rows = gridded(table.select("vec_id", "embedding")).select("vec_id", "x")
    shared = table.sparkSession.sparkContext.broadcast(fit(rows))
    return rows.mapInArrow(tidy(_whitened(shared, components)), WHITENED)
