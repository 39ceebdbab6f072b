"""Whole-text primitives over Arrow string columns, vectorised with numpy.

A slice of a batch is one byte buffer plus row offsets; words are found and hashed
for all rows of the slice at once.  White space is the six ASCII characters
``\\x20 \\x09-\\x0D``; these bytes never occur inside a multi-byte UTF-8 character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a single longer row is a slice of its own.
SLICE_BYTES = 512 << 10


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Cut a record batch into runs of rows holding at most ``most`` text bytes."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.maximum(byte_lengths(batch.column(column)), 1))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    offsets = text_bytes(texts)[1]
    return offsets[1:] - offsets[:-1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and n + 1 offsets; a null row is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if data is None or not size:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; for many short arrays a sort is quicker than np.unique."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


class Words:
    """Finds and hashes words; one per task, so the power tables are built once."""

    BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
    #: The low bytes of a piece that belong to a word with so many left.
    MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, lower: bool = True):
        self.lut = np.arange(256, dtype=np.uint8)
        if lower:
            self.lut[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Start and end byte of each word, and for each row its first word's number."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        word = ~self.space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= ~(word[:-1] & word[1:])
        cut[0] = cut[-1] = True
        first, last = word & cut[:-1], word & cut[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, case folded for A-Z if asked for."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.lut[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def exact(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word that is no sum of powers, so words of two letters in regular patterns differ.

        A word is cut into pieces of eight bytes; each is mixed with its number, and the sum with the length.
        """
        if not len(starts):
            return np.zeros(0, np.uint64)
        pieces = (ends - starts + 7) >> 3
        first = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        at = np.repeat(starts, pieces) + 8 * number
        left = np.minimum(np.repeat(ends, pieces) - at, 8)
        padded = np.concatenate([self.lut[data], np.zeros(8, np.uint8)])
        whole = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at] & self.MASKS[left]
        mixed = mix(mix(whole) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(self.BASE))
        return mix(np.add.reduceat(mixed, first) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of(self, texts: pa.Array):
        """Word hashes of all rows, and n + 1 offsets into them."""
        data, offsets = text_bytes(texts)
        starts, ends, rows = self.spans(data, offsets)
        return self.exact(data, starts, ends), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words has its whole word sequence as its only shingle; a
    row without words has none.
    """
    odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x5851F42D4C957F2D & (2**64 - 1) | 1) for i in range(k)]
    joint = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        joint += words[i : i + len(joint)] * odd[i]
    joint = mix(joint)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(distinct(joint[a : b - k + 1]))
        elif n:
            seed = np.array([n], np.uint64)
            for i in range(n):
                seed = seed + words[a + i : a + i + 1] * odd[i]
            out.append(mix(mix(seed)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
