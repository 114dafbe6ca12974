"""Language of a text: the mean of hashed subword embeddings, a linear softmax, and a calibrated rejection.

Both layers are trained by stochastic gradient descent in numpy on a bounded sample. A part of the sample sets the
temperature of the scores and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import tidy
from .features import LANGUAGE_BUCKETS, batched, has_letter, subwords
from .streams import with_outputs

#: Documents of each language in the sample, and of all languages together: with more languages than MOST / SAMPLED each
#: has an equal part of MOST, one document at least. No language is left out.
SAMPLED, MOST = 800, 160_000
#: Rows (language, hash) of the sample up to which they are broadcast.
BROADCAST_ROWS = 200_000
WIDTH = 16
EPOCHS = 12
#: The part of right predictions that the rejection may cost.
COST = 0.001
OUTPUTS = "lang_pred string, score double, accepted boolean"
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embedding @ self.output + self.bias

    def scores(self, shares: np.ndarray) -> np.ndarray:
        return softmax(self.logits(shares) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def held_out(fold: int = 0, of: int = 5):
    """Whether a document is kept from learning, by the CRC-32 of its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, share = [], []
        for part in batched(batch.column("text"), subwords):
            for row in part:
                used = np.flatnonzero(row)
                at.append(used.astype("<u2").tobytes())
                share.append(row[used].tobytes())
        yield pa.record_batch({"lang": batch.column("lang"), "doc_id": batch.column("doc_id"), "at": pa.array(at, pa.binary()), "share": pa.array(share, pa.binary())})


def split(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows to learn from, and every fifth to calibrate with, but none that is the first of its language."""
    first: set[str] = set()
    learned, held = [], []
    for i, row in enumerate(rows):
        (held if i % 5 == 0 and row[0] in first else learned).append(row)
        first.add(row[0])
    return learned, held


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model of (language, buckets, shares) rows, of which split tells those that calibrate it."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    size = 2 * LANGUAGE_BUCKETS

    def dense(part: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(part), size), np.float32)
        for i, (_, at, share) in enumerate(part):
            x[i, at] = share
        return x, np.array([number[r[0]] for r in part], np.int64)

    number = {name: i for i, name in enumerate(languages)}
    learned, held = split(rows)
    held = held or learned
    model = Model(languages, rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    for epoch in range(EPOCHS):
        rate = np.float32(4.0 * (1 - epoch / EPOCHS))
        order = rng.permutation(len(learned))
        for lo in range(0, len(order), 32):
            x, y = dense([learned[i] for i in order[lo : lo + 32]])
            hidden = x @ model.embedding
            gap = softmax(hidden @ model.output + model.bias)
            gap[np.arange(len(y)), y] -= 1
            gap /= len(y)
            back = gap @ model.output.T
            model.output -= rate * hidden.T @ gap
            model.bias -= rate * 0.1 * gap.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            model.embedding[used] -= 8 * rate * x[:, used].T @ back
    # the temperature of least loss, then the score that nearly all right predictions reach
    steps, loss, right = [0.25 * 1.25**i for i in range(20)], np.zeros(20), []
    for lo in range(0, len(held), 256):
        x, y = dense(held[lo : lo + 256])
        logits = model.logits(x)
        loss += [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(y)), y])).sum() for t in steps]
    model.temperature = steps[int(loss.argmin())]
    for lo in range(0, len(held), 256):
        x, y = dense(held[lo : lo + 256])
        scores = model.scores(x)
        right.append(scores.max(axis=1)[scores.argmax(axis=1) == y])
    right = np.concatenate(right)
    model.least = float(min(0.5, np.quantile(right, COST))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sampled: int = SAMPLED, fold: int = 0, most: int = MOST) -> Model | None:
    """A model of at most `sampled` documents of each language, `most` of all (one a language at least), and none of the
    held-out fold; None if no document has text and language.

    A language's documents of least hash are drawn, over all of them; the hash is of the id and text, so a document counts
    once however often its row repeats, and the draw does not hang on how rows are dealt.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and length(text) > 0 and doc_id is not null").where(~held_out(fold))
    known = known.withColumn("draw", F.xxhash64("doc_id", "text", F.lit(9)))
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    each = max(1, min(sampled, most // languages))
    # tasks keep a language's least hashes before any of them is shuffled
    least = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    chosen = known.select("lang", "draw").distinct().withColumn("place", least).where(F.col("place") <= each).select("lang", "draw")
    drawn = known.join(F.broadcast(chosen) if languages * each <= BROADCAST_ROWS else chosen, ["lang", "draw"]).dropDuplicates(["lang", "draw"])
    found = drawn.select("doc_id", "lang", "text").mapInArrow(tidy(_sparse_rows), "lang string, doc_id long, at binary, share binary").toPandas().sort_values(["doc_id", "lang", "at", "share"])
    if not len(found):
        return None
    return train([(lang, np.frombuffer(at, "<u2"), np.frombuffer(share, np.float32)) for lang, at, share in zip(found.lang, found["at"], found["share"], strict=True)])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (the calibrated probability, 0 to 1) and accepted (score is not below the rejection).

    A null text and one without letters are "und", score 0, not accepted; so is every text if nothing was learned. The
    text alone decides, so equal texts are alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters, model = has_letter(data, offsets), shared.value
        if model is None:
            return np.full(len(letters), -1), np.zeros(len(letters))
        scores = model.scores(subwords(data, offsets))
        return np.where(letters, scores.argmax(axis=1), -1), np.where(letters, scores.max(axis=1), 0.0)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = list(batched(batch.column("text"), look))
        best, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0))
        names = [*(shared.value.languages if shared.value else []), UNKNOWN]
        least = shared.value.least if shared.value else 2.0
        return {"lang_pred": pa.array([names[i] for i in best.tolist()], pa.string()), "score": pa.array(score.astype(np.float64)), "accepted": pa.array((best >= 0) & (score >= least))}

    return with_outputs(docs, compute, OUTPUTS)
