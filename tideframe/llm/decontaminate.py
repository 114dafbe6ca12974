"""Benchmark passages in documents, up to a few edits.

Texts are lower-cased and their white space becomes single spaces. An item of m characters may differ in
int(m * error_rate) edits; cut into one piece more than that, at least one piece stays exact wherever the item occurs. An
automaton of all pieces finds them; where one lies, Myers' bit-parallel distance of the item to the text around decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .scratch import Scratch

ERROR_RATE = 0.05
#: Items of a block are held by every task; a larger benchmark is matched block by block.
BLOCK_BYTES = 8 << 20
Items = tuple[tuple[int, str], ...]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item's budget + 1 pieces (start, piece), of near-equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(fewest edits, end) of a pattern of m characters anywhere in text; the earliest end among equals."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = every, 0, m
    best = (m, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        plus, minus = down | (~(diagonal | up) & every), up & diagonal
        if plus & high:
            edits += 1
        elif minus & high:
            edits -= 1
        plus, minus = (plus << 1) & every, (minus << 1) & every
        up, down = minus | (~(diagonal | plus) & every), plus & diagonal
        if edits < best[0]:
            best = (edits, end)
    return best


def match_start(masks: dict[str, int], m: int, text: str, end: int, edits: int) -> int:
    """The last start from which text up to `end` is `edits` edits from a pattern, given the masks of the pattern read backward.

    The same recursion runs back from the end; there the match has to begin, so the first row counts text that is left out.
    """
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, now = every, 0, m
    if now == edits:
        return end
    for start in range(end - 1, max(-1, end - m - edits - 1), -1):
        eq = masks.get(text[start], 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        plus, minus = down | (~(diagonal | up) & every), up & diagonal
        if plus & high:
            now += 1
        elif minus & high:
            now -= 1
        if now == edits:
            return start
        plus, minus = (plus << 1 | 1) & every, (minus << 1) & every
        up, down = minus | (~(diagonal | plus) & every), plus & diagonal
    return max(0, end - m - edits)


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: tuple[tuple[int, str], ...], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * error_rate), character_masks(t)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget, _) in enumerate(self.items):
            for start, piece in pieces(text, budget):
                found.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of the best place of each item within its budget, in the normalised text."""
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                starts.setdefault(number, set()).add(end + 1 - length - offset)
        out = []
        for number, places in sorted(starts.items()):
            item, pattern, budget, masks = self.items[number]
            best, done = None, -1
            for place in sorted(places):
                lo, hi = max(0, place - budget), place + len(pattern) + budget
                if hi <= done:
                    continue
                done = hi
                edits, end = best_match(masks, len(pattern), text[lo:hi])
                if edits <= budget and (best is None or edits < best[1]):
                    best = (item, edits, lo + end)
            if best:
                item, edits, end = best
                start = match_start(character_masks(pattern[::-1]), len(pattern), text, end, edits) if edits else end - len(pattern)
                out.append((item, edits, start, end))
        return out


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], error_rate: float) -> Matcher:
    return Matcher(items, error_rate)


def item_blocks(benchmark: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, shortest: int = 1) -> Iterator[Items]:
    """The items, normalised, in blocks of about block_bytes, one after the other: the driver holds one block at a time.

    An item larger than block_bytes is a block by itself. Empty or null items, those without id and those of fewer than
    `shortest` characters match nothing.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    items = scratch.cut(items.withColumn("size", F.octet_length("text").cast("long")))
    small = items.where(F.col("size") <= block_bytes)
    blocks = int((small.agg(F.sum("size")).first()[0] or 0) // block_bytes) + 1
    kept = lambda rows: tuple(sorted((r["item_id"], t) for r in rows if len(t := normal(r["text"])) >= max(1, shortest)))
    for block in range(blocks):
        if found := kept(small.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()):
            yield found
    for row in items.where(F.col("size") > block_bytes).toLocalIterator():
        if found := kept([row]):
            yield found


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, shortest: int = 1) -> DataFrame:
    """One row for each document row and item found in it: doc_id, item_id, edits, match_start, match_end.

    The place is in the normalised text, from match_start up to but not including match_end; the fewest edits count, then the
    earliest end, then the latest start. Very long texts and items are searched whole. An item of fewer than
    1 / error_rate characters has no edits to spare and matches wherever it occurs exactly, so one of a letter or two
    matches nearly all texts: `shortest` leaves such items out. Null texts match nothing; equal rows are matched one by
    one; a null doc_id stays null. Items that share an id are matched as separate texts. Other columns are ignored. A
    benchmark of several blocks is searched one block at a time, each found table written before the next.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, edits int, match_start long, match_end long"

    def search(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # block_bytes, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in matcher.matches(t)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "match_start", "match_end"])

        return rows.mapInArrow(tidy(run), schema)

    blocks = item_blocks(benchmark, scratch, block_bytes, shortest)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], schema)
    if second is None:
        return search(first)
    out = scratch.cut(search(first)).unionByName(scratch.cut(search(second)))
    for items in blocks:
        out = out.unionByName(scratch.cut(search(items)))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, shortest: int = 1) -> DataFrame:
    """The rows of docs, all columns (whatever their names), whose text holds no item. Null and empty texts hold none; very long
    ones are searched whole; repeated rows stay or go together; an empty table, or benchmark, changes nothing. With several
    blocks the rows left by one are written before the next."""
    scratch = Scratch(docs.sparkSession)

    def clean(docs: DataFrame, items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        return docs.mapInArrow(tidy(run), docs.schema)

    waiting, before = None, None
    for items in item_blocks(benchmark, scratch, block_bytes, shortest):
        if waiting is not None:
            docs, last = scratch.cut(clean(docs, waiting)), docs
            if before is not None:
                scratch.drop(last)
            before = docs
        waiting = items
    return docs if waiting is None else clean(docs, waiting)
