"""Hidden Markov language model of words.

Counts of all training words give the vocabulary. The commonest words are symbols of their own; each other word is a
symbol of its ending's class, and the class gives the word by its count, so a text's probability is that of its symbols
times that of its words in their classes. Baum-Welch trains the states: each pass sums expected counts over partitions
of all training segments. The scaled forward recursion gives the
exact probability of each whole text. Counts of common words are broadcast, up to a bound; those of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, Words, mix, text_slices, tidy
from .scratch import Scratch

STATES = 8
#: Words with a symbol of their own, classes of endings, and words whose counts are broadcast.
SYMBOL_WORDS, CLASSES, HEAD_WORDS = 8192, 2048, 60_000
SEGMENT = 256
PASSES = 10
#: Tokens that a Baum-Welch step runs over at once.
EXPECTED_TOKENS = 400_000
#: Counts of the unigram law that each state's emissions are smoothed with: so many, or a part of a state's share of the tokens.
SMOOTHING, SMOOTHED_PART = 300.0, 0.05
END = np.int64(0x3C6EF372FE94F82B)
#: Bytes of text that the forward recursion runs over at once.
RUN_BYTES = 12 << 20


def held_out(fold: int = 2, of: int = 7):
    """Whether a document is kept from learning, by the CRC-32 of its id; without id it is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def word_classes(words: Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    low, last = LOWER[words.data].astype(U), words.end - 1
    code = np.zeros(len(last), U)
    for back in range(3):
        at = last - back
        code = code * U(257) + np.where(at >= words.start, low[np.maximum(at, 0)] + U(1), U(0))
    return (mix(code) % U(CLASSES)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, classes = [np.full(batch.num_rows, END, np.int64)], [np.zeros(batch.num_rows, np.int64)]
        for _, _, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets)
            hashes.append(words.hashes.view(np.int64))
            classes.append(word_classes(words))
        hashes, classes = np.concatenate(hashes), np.concatenate(classes)
        distinct, first, count = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.record_batch({"h": distinct, "g": classes[first], "n": count})


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the head words, ascending
    counts: np.ndarray
    symbols: np.ndarray
    class_logs: np.ndarray  # log10 of each class's count and size, plus 1
    total: int
    distinct: int
    symbol_words: int
    unigram: np.ndarray  # training count of each symbol

    @property
    def size(self) -> int:
        return self.symbol_words + CLASSES


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS, symbol_words: int = SYMBOL_WORDS) -> Vocabulary:
    """Head and class totals of the table of word counts (h, g, n). At most head_words rows reach the driver."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    by_count = counts.groupBy("n").count().where("n > 1").orderBy(F.desc("n")).limit(head_words).collect()
    room, least = head_words, None
    for row in by_count:
        if row["count"] > room:
            break
        room, least = room - row["count"], row["n"]
    head = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas().sort_values(["n", "h"], ascending=[False, True])
    own = min(symbol_words, len(head))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_n[row["g"]], class_v[row["g"]] = row["n"], row["v"]
    g, n = head.g.to_numpy(), head.n.to_numpy()
    np.subtract.at(class_n, g[:own], n[:own])
    np.subtract.at(class_v, g[:own], 1)
    symbols = np.where(np.arange(len(head)) < own, np.arange(len(head)), own + g)
    order = np.argsort(head.h.to_numpy(), kind="stable")
    return Vocabulary(head.h.to_numpy()[order], n[order], symbols[order], np.log10(class_n + class_v + 1), total["n"] or 0, total["v"], own, np.concatenate([n[:own], class_n]))


SYMBOL_ROWS = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, words double, symbols binary, tail_h array<long>, tail_n array<int>"


def _symbols(shared):
    """Each text's symbols, the part of its scores that broadcast counts give, and its words that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        rid = TaskContext.get().partitionId() << 40
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                docs, words = hi - lo, Words(data, offsets)
                ends = words.first[1:] + np.arange(docs)  # each document's end follows its words
                n = len(words.start) + docs
                place = np.ones(n, bool)
                place[ends] = False
                h, g = np.full(n, END, np.int64), np.zeros(n, np.int64)
                h[place], g[place] = words.hashes.view(np.int64), word_classes(words)
                at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
                known = v.hashes[at] == h if len(v.hashes) else np.zeros(n, bool)
                symbol = np.where(known, v.symbols[at] if len(v.hashes) else 0, v.symbol_words + g)
                base = np.where(known, logs[at] if len(v.hashes) else 0, 0.0)
                word = np.where(symbol >= v.symbol_words, base - v.class_logs[g], 0.0)
                cut = np.concatenate([[0], ends + 1])
                tokens = np.diff(cut)
                sums = lambda x: np.add.reduceat(x, cut[:-1])  # noqa: E731  every document has its end
                flat = symbol.astype("<u2").tobytes()
                tail_h, tail_n = [], []
                free = ~known
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    distinct, count = np.unique(h[a:b][free[a:b]], return_counts=True)
                    tail_h.append(distinct)
                    tail_n.append(count)
                lists = np.concatenate([[0], np.cumsum([len(x) for x in tail_h])]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "rid": rid + np.arange(docs),
                        "doc_id": batch.column("doc_id").slice(lo, docs),
                        "held_out": batch.column("held_out").slice(lo, docs),
                        "n_tokens": tokens,
                        "n_known": sums(known.astype(np.int64)),
                        "base": sums(base),
                        "words": sums(word),
                        "symbols": pa.array([flat[2 * a : 2 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                        "tail_h": pa.ListArray.from_arrays(lists, np.concatenate(tail_h)),
                        "tail_n": pa.ListArray.from_arrays(lists, np.concatenate(tail_n).astype(np.int32)),
                    }
                )
                rid += docs

    return run


@dataclass
class Chain:
    start: np.ndarray  # S
    middle: np.ndarray  # S: the state a segment inside a text begins in
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S


def expected_counts(chain: Chain, sequences: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums over sequences: of start states, of moves, and of emissions (symbols x S).

    Columns are tokens, step after step, the longest sequence's first; rows are states. Every step is scaled to one, so
    single precision is enough; sums are in double.
    """
    order = np.argsort([-len(s) for s in sequences], kind="stable").tolist()
    lengths, first = np.array([len(sequences[i]) for i in order]), first[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()  # how many are longer than t
    cut = np.concatenate([[0], np.cumsum(active)]).tolist()
    begin = np.cumsum(lengths) - lengths
    symbols = np.concatenate([sequences[i] for i in order])[np.concatenate([begin[:n] + t for t, n in enumerate(active)])].astype(np.int64)
    seen = np.ascontiguousarray(chain.emit.T, np.float32).take(symbols, axis=1)
    move = chain.move.astype(np.float32)
    forth, alpha = np.ascontiguousarray(move.T), np.empty_like(seen)
    a = np.where(first, chain.start[:, None], chain.middle[:, None]).astype(np.float32)
    for t, n in enumerate(active):
        here = slice(cut[t], cut[t + 1])
        a = (forth @ a[:, :n] if t else a) * seen[:, here]
        scale = a.sum(axis=0)
        a /= scale
        seen[:, here] /= scale
        alpha[:, here] = a
    moves, beta = np.zeros(chain.move.shape), np.ones((len(move), active[-1]), np.float32)
    for t in range(len(active) - 1, 0, -1):
        n, here = active[t], slice(cut[t], cut[t + 1])
        after = beta * seen[:, here]
        moves += alpha[:, cut[t - 1] : cut[t - 1] + n] @ after.T
        alpha[:, here] *= beta
        beta = np.ones((len(move), active[t - 1]), np.float32)
        np.matmul(move, after, out=beta[:, :n])
    alpha[:, : cut[1]] *= beta
    alpha /= alpha.sum(axis=0)
    emissions = np.stack([np.bincount(symbols, g, len(chain.emit)) for g in alpha], axis=1)
    return alpha[:, : cut[1]][:, first].sum(axis=1, dtype=np.float64), moves * chain.move, emissions


def _expect(shared):
    """Expected counts of a partition's segments, as rows kind, index, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        start, moves, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(chain.emit)
        held, first, size = [], [], 0

        def add() -> None:
            nonlocal start, moves, emissions, held, first, size
            if held:
                s, m, e = expected_counts(chain, held, np.array(first))
                start, moves, emissions = start + s, moves + m, emissions + e
            held, first, size = [], [], 0

        for batch in batches:
            for body in batch.column("symbols").to_pylist():
                ids = np.frombuffer(body, "<u2")
                for at in range(0, len(ids), SEGMENT):
                    held.append(ids[at : at + SEGMENT])
                    first.append(at == 0)
                    size += len(held[-1])
                    if size >= EXPECTED_TOKENS:
                        add()
        add()
        used = np.flatnonzero(emissions.any(axis=1))
        index = np.concatenate([[-1], -2 - np.arange(STATES), used])
        values = np.concatenate([start[None], moves, emissions[used]])
        yield pa.record_batch([pa.array(index)] + [pa.array(values[:, s]) for s in range(STATES)], names=["i", *[f"s{s}" for s in range(STATES)]])

    return run


def smoothed_unigram(v: Vocabulary) -> np.ndarray:
    """Training counts of symbols, each with a part of one more: as much as all seen symbols together have, one each at most.
    A small corpus sees few symbols, and whole counts for all the others would outweigh its own."""
    return v.unigram + min(1.0, (np.count_nonzero(v.unigram) + 1) / v.size)


def first_chain(v: Vocabulary, seed: int = 3) -> Chain:
    """States that stay, with emissions of all words, each symbol bent towards some states at random."""
    rng = np.random.default_rng(seed)
    emit = smoothed_unigram(v)[:, None] * rng.gamma(1.0, 1.0, (v.size, STATES))
    move = np.full((STATES, STATES), 0.3 / (STATES - 1))
    np.fill_diagonal(move, 0.7)
    even = np.full(STATES, 1 / STATES)
    return Chain(even, even, move, emit / emit.sum(axis=0))


def train(symbols: DataFrame, v: Vocabulary, passes: int = PASSES, smoothing: float = SMOOTHING) -> Chain:
    """Baum-Welch over the training rows of symbols. What returns to the driver is a row a symbol."""
    chain, context = first_chain(v), symbols.sparkSession.sparkContext
    back = smoothed_unigram(v)
    back /= back.sum()
    names = [f"s{s}" for s in range(STATES)]
    schema = "i long, " + ", ".join(f"{n} double" for n in names)
    rows = symbols.where("not held_out").select("symbols")
    for _ in range(passes):
        shared = context.broadcast(chain)
        found = rows.mapInArrow(tidy(_expect(shared)), schema).groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        i, values = found.i.to_numpy(), found[names].to_numpy()
        shared.destroy()
        if not len(i) or not values.any():
            break
        start, move, emit = np.full(STATES, 1.0), np.full((STATES, STATES), 0.5), np.zeros_like(chain.emit)
        emit[i[i >= 0]] = values[i >= 0]
        for index, row in zip(i[i < 0].tolist(), values[i < 0], strict=True):
            if index == -1:
                start += row
            else:
                move[-2 - index] += row
        use = emit.sum(axis=0)
        emit = (emit + smoothing * back[:, None]) / (use + smoothing)
        chain = Chain(start / start.sum(), (use + 1) / (use + 1).sum(), move / move.sum(axis=1, keepdims=True), emit)
    return chain


def log10_probabilities(chain: Chain, flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence flat[cut[i]:cut[i+1]], by the scaled forward recursion over all at once."""
    order = np.argsort(-np.diff(cut), kind="stable")
    starts, lengths = cut[:-1][order], np.diff(cut)[order]
    out = np.zeros(len(order))
    if not len(order) or not lengths[0]:
        return out
    ends = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many are longer than t
    a = chain.start * chain.emit[flat[starts[: ends[0]]]]
    for t in range(int(lengths[0])):
        n = ends[t]
        if t:
            a = (a[:n] @ chain.move) * chain.emit[flat[starts[:n] + t]]
        c = a.sum(axis=1)
        out[:n] += np.log10(c)
        a /= c[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _forward(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            bodies = batch.column("symbols").to_pylist()
            lo = 0
            while lo < len(bodies):
                hi, size = lo, 0
                while hi < len(bodies) and size < RUN_BYTES:
                    size, hi = size + 3 * len(bodies[hi]), hi + 1
                cut = np.concatenate([[0], np.cumsum([len(b) // 2 for b in bodies[lo:hi]])])
                scores = log10_probabilities(chain, np.frombuffer(b"".join(bodies[lo:hi]), "<u2"), cut)
                part = batch.slice(lo, hi - lo)
                kept = [n for n in part.schema.names if n != "symbols"]
                yield pa.record_batch([part.column(n) for n in kept] + [pa.array(scores)], names=[*kept, "chain"])
                lo = hi

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    base_score is the add-one unigram log10 probability of the module's tokens, score the model's. A null text is empty: its
    end is its one token. A null doc_id stays null and is learned from. Equal rows count and score alike; without training
    rows both scores know no word. Words are told apart by 64-bit hashes. Other columns are ignored; an empty table gives no
    row.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    counts = rows.where("not held_out").select("text").mapInArrow(tidy(_word_counts), "h long, g long, n long")
    counts = scratch.cut(counts.groupBy("h").agg(F.min("g").alias("g"), F.sum("n").alias("n")))
    v = vocabulary(counts)
    symbols = scratch.cut(rows.mapInArrow(tidy(_symbols(spark.sparkContext.broadcast(v))), SYMBOL_ROWS))
    chain = train(symbols, v, smoothing=min(SMOOTHING, max(1.0, SMOOTHED_PART * v.total / STATES)))
    tail = symbols.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("rid", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("m"))
    tail = tail.join(counts.select("h", "n"), "h").groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("tail"), F.sum(F.col("m").cast("long")).alias("tail_known"))
    kept = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "words"]
    scored = symbols.select(*kept, "symbols").mapInArrow(tidy(_forward(spark.sparkContext.broadcast(chain))), ", ".join(x for x in SYMBOL_ROWS.split(", ") if x.split()[0] in kept) + ", chain double")
    more = F.coalesce("tail", F.lit(0.0))
    return scored.join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(v.total + v.distinct + 1)))).alias("base_score"),
        (F.col("chain") + F.col("words") + more).alias("score"),
    )
