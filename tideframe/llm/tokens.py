"""Token ids of whole texts by a public byte-level BPE file.

The tokenizer's own split into pieces is redone for many texts at once on code points; each distinct piece is encoded
once per worker by `tokenizers` and its ids are looked up by hash afterwards, which gives the ids of the whole text, as
a byte-level BPE merges inside pieces only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .arrays import U, mix, span_hashes

LETTER, NUMBER, SPACE = 1, 2, 3
#: The id that ends each document.
END_ID = 1


@lru_cache(maxsize=1)
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and a 64-bit code of each."""
    classes = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for found in regex.finditer(pattern, text):
                classes[lo + found.start() : lo + found.end()] = value
    return classes, mix((np.arange(1, 0x110001, dtype=U)) * U(0xA24BAED4963EE407))


def default_path() -> str:
    """Where the public 50k byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the joined code points of several documents that begin at `first`."""
    n = len(points)
    kind = character_classes()[0][points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    flag = change | begins[:-1]
    # a space right before a run of other characters belongs to that run
    space = points == 0x20
    led = np.zeros(n, bool)
    led[1:] = space[:-1] & ~begins[1:-1]
    flag &= ~(led & (kind != SPACE))
    # the last white-space character before a run stands apart from those before it
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:-1]
    flag |= last
    # contractions
    for i in np.flatnonzero(flag & (points == 0x27)).tolist():
        room = 1
        while room < 4 and i + room < n and not begins[i + room]:
            room += 1
        tail = "".join(map(chr, points[i + 1 : i + room].tolist()))
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail[:2] in ("re", "ve", "ll") else 0
        if size and tail:
            flag[i + 1] = False
            after = i + 1 + size
            if after < n and not begins[after] and kind[after] == LETTER:
                flag[after] = True
    return np.flatnonzero(flag)


class Encoder:
    """Encodes runs of texts; keeps the ids of the pieces met so far, at most `keep` of them."""

    def __init__(self, path: str, keep: int = 1 << 19):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.mask = (1 << 16) - 1
        self.keys, self.value = np.zeros(self.mask + 1, U), np.full(self.mask + 1, -1, np.int32)
        self.pool, self.offset, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece number of each hash, -1 where it is new."""
        at = (hashes & U(self.mask)).astype(np.int64)
        found = np.where(self.keys[at] == hashes, self.value[at], np.int32(-1))
        open_ = np.flatnonzero((found < 0) & (self.value[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            hit = self.keys[at[open_]] == hashes[open_]
            found[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (self.value[at[open_]] >= 0)]
        return found

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        if (self.size + len(hashes)) * 2 > self.mask:
            old = np.flatnonzero(self.value >= 0)
            keys, values = self.keys[old], self.value[old]
            self.mask = (1 << int((self.size + len(hashes)) * 2).bit_length()) - 1
            self.keys, self.value = np.zeros(self.mask + 1, U), np.full(self.mask + 1, -1, np.int32)
            self._place(keys, values)
        self._place(hashes, numbers)
        self.size += len(hashes)

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at = (hashes & U(self.mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.value[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.value[at[won]] = hashes[won], numbers[won]
            left = left[self.value[at[left]] != numbers[left]]
            at[left] = (at[left] + 1) & self.mask

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        table = byte_characters()
        shown = [x.encode("utf-8").decode("latin-1").translate(table) for x in pieces]
        ids = [[t.id for t in self.model.tokenize(x)] for x in shown]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.size + len(ids) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        numbers = np.arange(self.size, self.size + len(ids))
        self.length[numbers] = lengths
        self.offset[numbers] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.put(hashes, numbers)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of UTF-8 texts, joined, and the number of ids of each text (without an end)."""
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        if self.size > self.keep:
            self.clear()
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        first = chars[offsets]
        start = piece_starts(points, first[:-1][first[:-1] < len(points)])
        end = np.append(start[1:], len(points))
        hashes = span_hashes(character_classes()[1][points], start, end)
        number = self.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            self.learn(fresh, [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            number[new] = self.find(hashes[new])
        lengths = self.length[number]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.offset[number] - (ends - lengths), lengths) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, first)]
        return ids, np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    return Encoder(path)
