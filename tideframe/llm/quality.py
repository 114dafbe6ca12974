"""Quality by the vote of the nearest labelled documents.

A bounded sample of labelled documents is turned into latent-semantic vectors: hashed terms and hashed traits of the
text's shape, weighted by inverse document frequency and projected on the leading singular vectors of the sample. They are
broadcast, and every document's cosine with each of them is computed in blocks; the labels of the nearest count by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .features import SHAPE_BUCKETS, STEPS, TERM_BUCKETS, batched, quality_features
from .streams import with_outputs

#: Labelled documents of each label that are kept: the bound of what is broadcast.
LABELLED = 2000
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Length of a text's terms beside its shape, whose own length is about 2.
TERMS = 1.0
#: Neighbours weigh by cosine to this power, about exp(-4 angle**2): a Gaussian kernel of the angle, as all near ones are close to 1.
SHARPNESS = 8
OUTPUTS = "score double, predicted int"


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k places of greatest cosine in each row; of equal ones the earlier places."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(axis=1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k).tolist():
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


@dataclass
class Model:
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, features: np.ndarray) -> np.ndarray:
        """Features by inverse document frequency; the terms scaled to length TERMS, so that long texts count like short ones."""
        out = features * self.weights
        terms = out[:, :TERM_BUCKETS]
        terms *= TERMS / np.maximum(1e-9, np.linalg.norm(terms, axis=1, keepdims=True))
        return out

    def vector(self, features: np.ndarray) -> np.ndarray:
        out = self.weighted(features) @ self.basis
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))

    def score(self, features: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest vectors, weighted by similarity; the prior where nothing is alike."""
        out = np.full(len(features), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for lo in range(0, len(features), 512):
            cosine = self.vector(features[lo : lo + 512]) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(0, np.take_along_axis(cosine, near, 1)).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            share = (weight * self.labels[near]).sum(axis=1) / np.maximum(1e-300, total)
            out[lo : lo + 512] = np.where(total > 1e-9, share, self.prior)
        return np.clip(out, 0, 1)


def held_out(fold: int = 2, of: int = 4):
    """Whether a document is kept from learning, by the CRC-32 of its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold


def fit_rows(x: np.ndarray, labels: np.ndarray, prior: float, seed: int = 11) -> Model:
    """The model of labelled feature rows: the leading singular vectors by a random projection, sharpened three times."""
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    rank = min(RANK, x.shape[1])
    model = Model(idf, np.zeros((x.shape[1], rank), np.float32), np.zeros((0, rank), np.float32), labels, prior)
    if len(x):
        w = model.weighted(x)
        basis = np.random.default_rng(seed).normal(size=(x.shape[1], rank + 16))
        for _ in range(3):
            basis = np.linalg.qr(w.T @ (w @ basis))[0]
        model.basis = (basis @ np.linalg.svd(w @ basis, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
        model.vectors = model.vector(x)
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for part in batched(batch.column("text"), quality_features) for x in part]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "features": pa.array(rows, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, fold: int = 2) -> Model:
    """A model of at most `labelled` documents of each label (drawn by hash of the id), none of the held-out fold.

    Labels other than 0 and 1, null labels and ids, and documents without text do not count; a document labelled twice has
    its lower label. Of an id that occurs with several texts the text of least hash is learned from.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(fold))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 40))
    drawn = known.where(uniform < F.when(F.col("quality") == 1, F.lit(int((1 << 40) * min(1, labelled / max(1, counts.get(1, 0)))))).otherwise(F.lit(int((1 << 40) * min(1, labelled / max(1, counts.get(0, 0)))))))
    # about 2 * labelled rows, by the bound above: of a drawn id's texts the one of least hash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    found = rows.select("doc_id", "text", "quality").mapInArrow(tidy(_feature_rows), "doc_id long, quality int, features binary").toPandas().sort_values("doc_id")
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    x = np.stack([np.frombuffer(b, np.float32) for b in found.features]) if len(found) else np.zeros((0, TERM_BUCKETS + SHAPE_BUCKETS + 7 * STEPS), np.float32)
    return fit_rows(x, found.quality.to_numpy(np.float64), prior if sum(counts.values()) else 0.5)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 at threshold or above).

    The text alone decides; a null or empty one gets the share of label 1 among all labels. Equal texts score alike; of
    neighbours that are equally near those of lower ids vote. Very long texts are read whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column("text")
        parts = [shared.value.score(x) for x in batched(column, quality_features)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        return {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return with_outputs(docs, compute, OUTPUTS)
