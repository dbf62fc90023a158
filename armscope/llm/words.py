"""Words of whole texts as arrays: positions, 64-bit hashes, hashes of word runs.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions work on an Arrow batch of
texts, in parts of about ``PART_BYTES``; a longer text is a part of its own. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
# Also ASCII punctuation and control codes: what stays are letters, digits and all non-ASCII bytes.
LETTERS_ONLY = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits: a bijection that makes sums and products of hashes independent."""
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; kept and grown as longer texts come."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, PART_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


@dataclass
class Part:
    """Some consecutive rows of a batch and the words of their texts."""

    first_row: int
    n_rows: int
    data: np.ndarray  # the texts' bytes, one after the other
    offsets: np.ndarray  # of the rows, n_rows + 1
    starts: np.ndarray  # of the words
    ends: np.ndarray
    first_word: np.ndarray  # of the rows, n_rows + 1

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.first_word))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash a word; ``lower`` folds A-Z."""
        return self.slices(lower)(self.starts, self.ends)

    def slices(self, lower: bool = False) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function from starts and ends, in bytes, to 64-bit hashes of those slices."""
        data = _LOWER[self.data] if lower else self.data
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
        return lambda starts, ends: mixed((total[ends] - total[starts]) * down[starts])


def parts(texts: pa.Array, part_bytes: int = PART_BYTES, breaks: np.ndarray = _BREAK) -> Iterator[Part]:
    """Cuts a batch of texts (string or binary) into parts; no text crosses a part. breaks: bytes between words."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part_bytes, "right")) - 1)
        own = offsets[row : last + 1] - offsets[row]
        yield _part(row, data[offsets[row] : offsets[last]], own, breaks)
        row = last


def _part(first_row: int, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Part:
    size, inside = len(data), ~breaks[data]
    begins, stops = inside.copy(), inside.copy()
    if size:
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        # Words end at the end of a text, even where the next text begins with a word.
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges]
        edges = offsets[1:][np.diff(offsets) > 0] - 1
        stops[edges] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Part(first_row, len(offsets) - 1, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on; the last k - 1 positions wrap and mean nothing."""
    out, have, block, done = None, 1, hashes, 0
    rest = k
    while True:
        if rest & 1:
            ahead = np.roll(block, -done) if done else block
            out = ahead if out is None else mixed(out * _BASE + ahead)
            done += have
        rest >>= 1
        if not rest:
            return out if k > 1 else hashes
        block = mixed(block * _U(0xD6E8FEB86659FD93) + np.roll(block, -have))
        have *= 2


def sliding(values: np.ndarray, width: int, best: np.ufunc = np.minimum) -> np.ndarray:
    """``best`` of each ``width`` consecutive values: one result for each full window."""
    have, out = 1, values
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    ahead = width - have
    return best(out[: len(out) - ahead], out[ahead:]) if ahead else out


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] values), for all i, as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - first, counts)
