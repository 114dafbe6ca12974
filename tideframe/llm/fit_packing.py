"""Best-fit-decreasing packing of token ids into fixed-length rows.

Every task packs its own documents, so nothing is shuffled but what tasks leave over. Overlong documents are cut into whole
rows and a rest; rests go, longest first, into the row with the least room that holds them, found in a segment tree over
room sizes. Rows that a task leaves too empty are taken apart and their rests packed once more, from all tasks together, so
padding does not grow with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices, tidy
from .scratch import Scratch
from .tokens import END_ID, default_path, encoder

SEQUENCE = 2048
PAD_ID = 0
#: Tokens of rests that a task holds before it packs them.
HELD_TOKENS = 4 << 20
#: A row filled less than this is packed again with the rests of other tasks.
FULL = 0.98


class RoomTree:
    """A segment tree that counts open rows by room; finds the least room of at least a size."""

    def __init__(self, size: int):
        self.base = 1 << int(size).bit_length()
        self.counts = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        node = room + self.base
        while node:
            self.counts[node] += by
            node >>= 1

    def at_least(self, size: int) -> int | None:
        node = size + self.base
        if self.counts[node]:
            return size
        while node > 1:
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node + (not self.counts[2 * node])
                return node - self.base
            node >>= 1
        return None


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of item numbers, filled best-fit-decreasing (lengths: 1 to size)."""
    tree, rows, by_room = RoomTree(size), [], {}
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        room = tree.at_least(length)
        if room is None:
            row, room = len(rows), size
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(item)
        if room > length:
            by_room.setdefault(room - length, []).append(row)
            tree.add(room - length, 1)
    return rows


ROWS = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, lengths array<long>"
#: A row before it is padded: whether it is settled, and its segments (ids of two bytes each where all of the row fit).
LAID = "settled boolean, sequence_id long, doc_ids array<long>, starts array<long>, lengths array<long>, ids binary"


def narrow(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def wide(body: bytes, tokens: int) -> np.ndarray:
    """The ids of a row of so many tokens."""
    return np.frombuffer(body, "<u2" if len(body) == 2 * tokens else "<u4")


def _laid(rows: list[tuple[bool, list[tuple]]], number: int) -> pa.RecordBatch:
    """Rows of segments (document, start, ids)."""
    lists = lambda f, kind: pa.array([[f(p) for p in pieces] for _, pieces in rows], pa.list_(kind))
    return pa.record_batch(
        [
            pa.array([done for done, _ in rows], pa.bool_()),
            pa.array(range(number, number + len(rows)), pa.int64()),
            lists(lambda p: p[0], pa.int64()),
            lists(lambda p: p[1], pa.int64()),
            lists(lambda p: len(p[2]), pa.int64()),
            pa.array([narrow(np.concatenate([p[2] for p in pieces])) for _, pieces in rows], pa.binary()),
        ],
        names=[x.split()[0] for x in LAID.split(", ")],
    )


class _Packer:
    """Packs rests of documents, in runs of about `held` tokens, and numbers the rows of a task."""

    def __init__(self, size: int, held: int, number: int, last: bool):
        self.size, self.most, self.number, self.last, self.rests, self.tokens = size, held, number, last, [], 0

    def emit(self, rows: list[tuple[bool, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 256):
            yield _laid(rows[at : at + 256], self.number)
            self.number += len(rows[at : at + 256])

    def add(self, doc: int | None, start: int, ids: np.ndarray) -> None:
        self.rests.append((doc, start, ids))
        self.tokens += len(ids)

    def settle(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.tokens < self.most and not force:
            return
        lengths = np.array([len(x[2]) for x in self.rests], np.int64)
        rows = [[self.rests[i] for i in row] for row in best_fit(lengths, self.size)]
        yield from self.emit([(self.last or sum(len(p[2]) for p in row) >= FULL * self.size, row) for row in rows])
        self.rests, self.tokens = [], 0


def _pack(path: str, size: int, held_tokens: int):
    """Rows of each task's own documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, _Packer(size, held_tokens, TaskContext.get().partitionId() << 32, False)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                ids, counts = encode(data, offsets)
                at, whole = 0, []
                for doc, n in zip(doc_ids[lo:hi], counts.tolist(), strict=True):
                    body = np.append(ids[at : at + n], END_ID).astype("<u4")
                    at += n
                    cut = len(body) // size * size
                    whole += [(True, [(doc, k, body[k : k + size])]) for k in range(0, cut, size)]
                    if cut < len(body):
                        packer.add(doc, cut, body[cut:])
                yield from packer.emit(whole)
                yield from packer.settle()
        yield from packer.settle(force=True)

    return run


def _repack(size: int, held_tokens: int):
    """Rows of the rests that tasks left over, padded by the same worker."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, held_tokens, 1 << 62 | TaskContext.get().partitionId() << 32, True)
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = wide(row["ids"], sum(row["lengths"])).astype("<u4"), 0
                for doc, start, n in zip(row["doc_ids"], row["starts"], row["lengths"], strict=True):
                    packer.add(doc, start, ids[at : at + n])
                    at += n
            yield from packer.settle()
        yield from packer.settle(force=True)

    pad = _pad(size)
    return lambda batches: pad(laid(batches))


def _pad(size: int):
    """Laid rows as id matrices, with cumulative lengths and positions that begin anew in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lengths, bodies = part.column("lengths").to_pylist(), part.column("ids").to_pylist()
                ids, place = np.full((part.num_rows, size), PAD_ID, "<u4"), np.zeros((part.num_rows, size), "<u4")
                bounds = [np.concatenate([[0], np.cumsum(x)]).astype(int) for x in lengths]
                for i, (body, cuts) in enumerate(zip(bodies, bounds, strict=True)):
                    ids[i, : cuts[-1]] = wide(body, cuts[-1])
                    place[i, : cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
                columns = [
                    part.column("sequence_id"),
                    pa.array([x[-1] for x in bounds], pa.int32()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([x.tolist() for x in bounds], pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in place], pa.binary()),
                    *[part.column(c) for c in ("doc_ids", "starts", "lengths")],
                ]
                yield pa.record_batch(columns, names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """One row a sequence: its ids padded to `sequence` (little-endian unsigned 32-bit), cumulative segment lengths,
    positions that begin anew in each segment, and each segment's document, first token and length.

    Each document is its ids and the end id 1; a null text is empty. Equal rows are packed like different ones; a null
    doc_id stays null. Other columns are ignored; an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    laid = scratch.cut(rows.mapInArrow(tidy(_pack(tokenizer or default_path(), sequence, held_tokens)), LAID))
    loose = laid.where("not settled")
    tokens = loose.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    pad = lambda df: df.mapInArrow(tidy(_pad(sequence)), ROWS)
    if not tokens:
        return pad(laid)
    again = loose.repartition(int(tokens // held_tokens) + 1, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id").mapInArrow(tidy(_repack(sequence, held_tokens)), ROWS)
    return pad(laid.where("settled")).unionByName(again)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as a Parquet table: id matrix, cumulative lengths and positions."""
    packed.write.parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The rows with CRC-32 in place of the two matrices."""
    return packed.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts", "lengths")
