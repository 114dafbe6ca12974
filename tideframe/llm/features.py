"""Hashed features of many texts at once: one row of counts for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrays import LOWER, SEPARATOR, U, Words, text_slices

#: Bytes as they count for a text's shape: letters by case, digits, white space and line ends alike, signs as themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[SEPARATOR] = 0x20
SHAPE[0x0A] = SHAPE[0x0D] = 0x0A

SPACED_LOWER = np.where(SEPARATOR, np.uint8(0x20), LOWER)


def gram_counts(codes: np.ndarray, offsets: np.ndarray, size: int, width: int) -> np.ndarray:
    """Counts of hashed runs of `width` bytes inside each document: documents x size, float32."""
    docs, n = len(offsets) - 1, len(codes)
    if n < width:
        return np.zeros((docs, size), np.float32)
    value = np.zeros(n - width + 1, np.uint32)
    for j in range(width):
        value = value * np.uint32(257) + codes[j : n - width + 1 + j]
    value = (value * np.uint32(2654435761)) >> np.uint32(32 - (size.bit_length() - 1))
    doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))[: len(value)]
    inside = np.arange(len(value)) + width <= offsets[1:][doc]
    at = doc[inside] * size + value[inside]
    return np.bincount(at, minlength=docs * size).reshape(docs, size).astype(np.float32)


def word_counts(words: Words, size: int) -> np.ndarray:
    """Counts of hashed whole words of each document: documents x size, float32."""
    docs = len(words.counts)
    at = words.doc * size + (words.hashes >> U(64 - (size.bit_length() - 1))).astype(np.int64)
    return np.bincount(at, minlength=docs * size).reshape(docs, size).astype(np.float32)


LANGUAGE_BUCKETS = 4096


def subwords(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of hashed byte triples and words: documents x 2 * LANGUAGE_BUCKETS; rows sum to 1, or are 0."""
    out = np.hstack([gram_counts(SPACED_LOWER[data], offsets, LANGUAGE_BUCKETS, 3), word_counts(Words(data, offsets), LANGUAGE_BUCKETS)])
    return out / np.maximum(1, out.sum(axis=1, keepdims=True))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter."""
    low = LOWER[data]
    letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


SHAPE_BUCKETS = 512
TERM_BUCKETS = 1024
STEPS = 8


def _step(share: np.ndarray) -> np.ndarray:
    """One of STEPS steps of a share, soft between neighbours: documents x STEPS."""
    at = np.clip(share, 0, 1) * (STEPS - 1)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(STEPS)))


def quality_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: its hashed terms (root of counts), then its shape: hashed runs of character kinds, and measures of
    repetition and make-up. documents x (TERM_BUCKETS + SHAPE_BUCKETS + 7 * STEPS)."""
    words, docs = Words(data, offsets), len(offsets) - 1
    shape = np.sqrt(gram_counts(SHAPE[data], offsets, SHAPE_BUCKETS, 3))
    shape /= np.maximum(1e-9, np.linalg.norm(shape, axis=1, keepdims=True))
    h, n = words.hashes, np.maximum(1, words.counts)

    def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[bounds[1:]] - upto[bounds[:-1]]

    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)])
    size = np.maximum(1, np.diff(offsets))
    upper = per_doc((data >= 65) & (data <= 90), offsets)
    lower = per_doc(((data >= 97) & (data <= 122)) | (data >= 128), offsets)
    signs = per_doc((data > 32) & (data < 127) & ~((SHAPE[data] == 97) | (SHAPE[data] == 65) | (SHAPE[data] == 48)), offsets)
    # equal neighbours two to eight words apart, as repeated lines give
    cycle = np.zeros(docs)
    for gap in range(2, 9):
        same = np.zeros(len(h), bool)
        same[gap:] = (h[gap:] == h[:-gap]) & (words.doc[gap:] == words.doc[:-gap])
        cycle = np.maximum(cycle, per_doc(same, words.first) / n)
    shares = [
        per_doc(again, words.first) / n,
        cycle,
        # distinct words against what an ordinary text of that length has, about n ** 0.85
        1 - distinct / np.maximum(1, n**0.85) * 0.7,
        upper / np.maximum(1, upper + lower),
        np.minimum(1, 3 * signs / size),
        np.minimum(1, np.log1p(words.counts) / 8),
        np.minimum(1, (size / n) / 16),
    ]
    weights = [1.0, 1.0, 1.0, 1.0, 1.0, 0.2, 0.2]
    terms = np.sqrt(word_counts(words, TERM_BUCKETS))
    out = np.hstack([terms, shape, *[w * _step(s) for s, w in zip(shares, weights, strict=True)]]).astype(np.float32)
    out[words.counts == 0] = 0
    return out


#: Documents that are dense rows at once.
DENSE_ROWS = 512


def batched(column: pa.Array, make, width_bytes: int = 1 << 19) -> Iterator[np.ndarray]:
    """make(bytes, offsets) of each run of texts of an Arrow column, bounded in bytes and in rows."""
    for _, _, data, offsets in text_slices(column, width_bytes, DENSE_ROWS):
        yield make(data, offsets)
