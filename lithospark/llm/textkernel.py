"""Vectorised word splitting and hashing over Arrow string buffers.

Words are maximal runs of bytes of a word class, found by class changes; each
gets a 64-bit polynomial hash from one prefix sum. Work is done in blocks, so
memory follows the block and not the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
#: Bytes of text that a mapper handles at once.
CHUNK = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random words for a seed."""
    start = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed * 0x632BE59BD9B4E019 % 2**64)
    return mix64(start)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * U64(step)
        step = step * step % 2**64
        filled += take
    return out


_BASE = 0x5851F42D4C957F2D


class Words:
    """Word splitter for one byte class.

    mask: 256 booleans, true for word bytes. fold: hash A-Z as a-z.
    """

    def __init__(self, mask: np.ndarray, fold: bool):
        self.mask = mask.astype(np.uint8)
        self.table = stream(17, 256)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.power = _powers(_BASE, BLOCK + 1)
        self.inverse = _powers(pow(_BASE, -1, 2**64), BLOCK + 1)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and each text's first word (one more at the end)."""
        offsets = offsets.astype(np.int64)
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        inside = self.mask[data]
        before = np.empty(n, np.uint8)
        before[0] = 0
        before[1:] = inside[:-1]
        before[offsets[offsets < n]] = 0
        starts = np.flatnonzero(inside > before)
        after = np.empty(n, np.uint8)
        after[-1] = 0
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = 0
        ends = np.flatnonzero(inside > after) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        out = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = int(np.searchsorted(ends, base + BLOCK, side="right"))
            if j <= i:  # one word longer than a block
                out[i] = self._long(data[base : ends[i]])
                i += 1
                continue
            end = ends[j - 1]
            total = np.empty(end - base + 1, U64)
            total[0] = 0
            np.cumsum(self.table[data[base:end]] * self.power[: end - base], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * self.inverse[s]
            i = j
        return mix64(out)

    def _long(self, word: np.ndarray) -> np.uint64:
        value, factor = 0, 1
        for k in range(0, len(word), BLOCK):
            part = word[k : k + BLOCK]
            value += int(np.sum(self.table[part] * self.power[: len(part)], dtype=U64)) * factor
            factor = factor * pow(_BASE, len(part), 2**64) % 2**64
        return U64(value % 2**64)


def _mask(excluded: list[tuple[int, int]]) -> np.ndarray:
    mask = np.ones(256, bool)
    for low, high in excluded:
        mask[low : high + 1] = False
    return mask


#: Runs without ASCII white space.
SPACE_SEPARATED = [(0x20, 0x20), (0x09, 0x0D)]
#: Runs of digits, letters and everything beyond ASCII.
ALPHANUMERIC = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


def space_words(fold: bool) -> Words:
    return Words(_mask(SPACE_SEPARATED), fold)


def alnum_words(fold: bool) -> Words:
    # A-Z lie in an excluded range, but are word bytes once lower-cased.
    mask = _mask(ALPHANUMERIC)
    if fold:
        mask[65:91] = True
    return Words(mask, fold)


def grams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Multilinear hashes of every k consecutive entries of words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = stream(seed, k) | U64(1)
    total = np.full(n, U64(seed), U64)
    for j in range(k):
        total += words[j : j + n] * factors[j]
    return mix64(total)


def sequence_hash(words: np.ndarray, seed: int) -> int:
    """One hash of a whole sequence, apart from those of grams."""
    factors = stream(seed, len(words)) | U64(1)
    total = int(np.sum(words * factors, dtype=U64)) + 0xA5A5A5A5A5A5A5A5 * (len(words) + 1)
    return int(mix64(np.array([total % 2**64], U64))[0])


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about limit bytes of text, or one text."""
    _, offsets = text_buffer(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Piece:
    """Some whole texts, or a part of a long one, with its words. base: how many words of the text lie before it."""

    begin: int
    end: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    base: int
    last: bool


def pieces(words: Words, column: pa.Array, overlap: int = 0, limit: int = CHUNK) -> Iterator[Piece]:
    """The texts of a column in pieces of about limit bytes.

    A longer text is cut between words; each of its pieces begins with the last
    overlap words of the one before, so runs of overlap + 1 words lie in one
    piece each. Memory follows the limit, or the longest run of that many words.
    """
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        a, end = int(offsets[i]), int(offsets[j])
        if end - a <= limit:
            part = data[a:end]
            yield Piece(i, j, part, *words.split(part, offsets[i : j + 1] - a), 0, True)
            i = j
            continue
        base, room = 0, limit
        while True:
            b = min(end, a + room)
            while b < end:  # to the end of the word
                gap = np.flatnonzero(words.mask[data[b : b + 4096]] == 0)
                b = min(end, b + (int(gap[0]) if len(gap) else 4096))
                if len(gap):
                    break
            part = data[a:b]
            starts, ends, first = words.split(part, np.array([0, b - a]))
            if b < end and len(starts) <= overlap:
                room *= 2
                continue
            yield Piece(i, j, part, starts, ends, first, base, b == end)
            if b == end:
                break
            keep = len(starts) - overlap
            a, base, room = (a + int(starts[keep]) if overlap else b), base + keep, limit
        i = j
