"""Packing along a space-filling curve.

A document's words, hashed to signs, give a vector of few dimensions; its Hilbert key orders documents so that alike ones
lie near each other. Documents are range-partitioned by that key (boundaries from a size-weighted sample, ties broken by
doc_id, so many equal documents spread over ranges), sorted, and laid end to end into sequences. What is left at a
range's end, less than one sequence, is packed again with its neighbours' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, mix, text_slices, tidy
from .sharding import range_numbers, uniform
from .tokens import END_ID, default_path, encoder

DIMENSIONS, BITS = 4, 12
SEQUENCE = 2048


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid point on the Hilbert curve through a cube of side 2 ** bits (points: n x d, unsigned).

    Gray-code construction: high bits first, each level reflects or swaps axes by the corner taken, and the bits are
    then read across the axes.
    """
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(d):
            on = (x[axis] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(points.shape[0], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each text of a run: hashed word vectors, scaled by their length, on a grid. No words: the centre."""
    words = Words(data, offsets)
    signs = mix(words.hashes ^ U(0x5851F42D4C957F2D))
    n = np.maximum(1, words.counts)
    grid = np.empty((len(offsets) - 1, DIMENSIONS), np.int64)
    for axis in range(DIMENSIONS):
        sign = ((signs >> U(axis)) & U(1)).astype(np.int64) * 2 - 1
        upto = np.concatenate([[0], np.cumsum(sign)])
        mean = (upto[words.first[1:]] - upto[words.first[:-1]]) / n
        grid[:, axis] = np.clip((np.arctan(4 * mean) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid, BITS)


def order_ids(doc_id: pa.Array, first: int) -> np.ndarray:
    """The ids that order documents of one key: their own, or an even number of their own for rows without one."""
    spare = mix(np.arange(first, first + len(doc_id), dtype=U) + U(TaskContext.get().partitionId() << 40)).view(np.int64)
    if not doc_id.null_count:
        return doc_id.to_numpy()
    return np.where(doc_id.is_null().to_numpy(zero_copy_only=False), spare, doc_id.fill_null(0).to_numpy())


def _keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        keys = [curve_keys(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
        yield pa.record_batch({"doc_id": order_ids(batch.column("doc_id"), seen), "size": batch.column("size"), "curve": np.concatenate(keys) if keys else np.zeros(0, np.int64)})
        seen += batch.num_rows


def _tokens(path: str, splitters: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path).encode, 0
        for batch in batches:
            ids_of = batch.column("doc_id").cast(pa.int64())
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                doc, curve = ids_of.slice(lo, hi - lo), curve_keys(data, offsets)
                ids, counts = encode(data, offsets)
                ends = np.cumsum(counts + 1)
                joined = np.full(int(ends[-1]), END_ID, np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
                keep = np.ones(len(joined), bool)
                keep[ends - 1] = False
                joined[keep] = ids
                cuts = pa.py_buffer(np.concatenate([[0], ends * joined.itemsize]).astype(np.int64))
                body = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, cuts, pa.py_buffer(joined)])
                part = range_numbers(curve, order_ids(doc, seen + lo), splitters)
                yield pa.record_batch({"doc_id": doc, "part": part, "curve": curve, "n": counts + 1, "ids": body.cast(pa.binary())})
            seen += batch.num_rows

    return run


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, seq long, offset long, full boolean"


class _Filler:
    """Lays documents end to end; gives the pieces of each sequence when it is full, or when closed."""

    def __init__(self, size: int):
        self.size, self.used, self.seq, self.open, self.done = size, 0, 0, [], []

    def add(self, part: int, doc: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.used, len(ids) - at)
            self.open.append((doc, start + at, take, doc_tokens, ids[at : at + take].astype("<u4").tobytes(), part, self.seq, self.used))
            at, self.used = at + take, self.used + take
            if self.used == self.size:
                self.close(True)

    def close(self, full: bool) -> None:
        self.done += [(*x, full) for x in self.open]
        self.seq, self.used, self.open = self.seq + bool(self.open), 0, []

    def batch(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.bool_() if n == "full" else pa.int64() for n in names]
        columns = list(zip(*self.done, strict=True)) or [[]] * len(names)
        self.done = []
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _fill(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, now = _Filler(sequence), None
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            part, doc, n, ids = (batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids"))
            for p, d, tokens, body in zip(part, doc, n, ids, strict=True):
                if p != now:
                    filler.close(False)
                    filler.seq, now = 0, p
                filler.add(p, d, 0, np.frombuffer(body, np.uint16 if len(body) == 2 * tokens else np.uint32), tokens)
                if len(filler.done) >= 2000:
                    yield filler.batch()
        filler.close(False)
        yield filler.batch()

    return run


def _refill(sequence: int):
    """Packs the ends of ranges, in order; a group of 64 ranges shares sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, now = _Filler(sequence), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != now:
                    filler.close(False)
                    filler.seq, now = 0, row["group"]
                filler.add(row["group"], row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
                if len(filler.done) >= 2000:
                    yield filler.batch()
        filler.close(False)
        yield filler.batch()

    return run


def pack_along_curve(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, range_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and the end id 1; null text is empty, so each row gives one id at least. Every id lies in one
    piece. All sequences but the last of 64 neighbouring ranges are full. Equal rows are packed like different ones; a
    null doc_id stays null. Other columns are ignored; an empty table gives no piece.
    """
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    total = sized.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(max(1, total // range_bytes), 20_000))
    splitters = []
    if ranges > 1:
        # a size-weighted sample of rows, each drawn by itself, of which only the keys go to the driver: ranges * 64 about
        rate = ranges * 64 / float(total)
        drawn = sized.where(uniform("doc_id", "size", F.monotonically_increasing_id(), seed=5) < F.col("size") * rate)
        keyed = drawn.mapInArrow(tidy(_keys_only), "doc_id long, size long, curve long")
        keyed = keyed.withColumn("size", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)))
        splitters = splitters_of(keyed.select("curve", "doc_id", "size").toPandas(), ranges)
    tokens = rows.mapInArrow(tidy(_tokens(tokenizer, splitters)), "doc_id long, part long, curve long, n long, ids binary")
    dealt = tokens.repartition("part").sortWithinPartitions("part", "curve", "doc_id", "n", "ids")
    filled = dealt.mapInArrow(tidy(_fill(sequence)), PIECES)
    ends = filled.where("not full").withColumn("group", F.floor(F.col("part") / 64))
    ends = ends.repartition("group").sortWithinPartitions("group", "part", "seq", "offset").mapInArrow(tidy(_refill(sequence)), PIECES)
    whole = filled.where("full").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("seq"))
    rest = ends.withColumn("sequence_id", F.lit(1 << 62) + F.shiftleft("part", 32) + F.col("seq"))
    return whole.unionByName(rest).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def splitters_of(found, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries (curve key, doc_id) of a weighted sample."""
    found = found.sort_values(["curve", "doc_id"])
    if not len(found):
        return []
    upto = found["size"].cumsum().to_numpy()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({(int(found["curve"].iloc[i]), int(found["doc_id"].iloc[i])) for i in at})


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids, but with the CRC-32 of them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
