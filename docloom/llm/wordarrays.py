"""Words of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  Nothing here makes a
Python string per word: a word is a (start, end) pair and a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``most`` bytes of text; a longer text stands alone."""
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


#: Ranges of more bytes are hashed one by one.
_CHAINED = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def aligned(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, with two of zeros behind them."""
    out = np.zeros((len(raw) // 8 + 3) * 8, np.uint8)
    out[: len(raw)] = raw
    return out.view("<u8")


def chunk(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, or as many as are ``left``, as numbers."""
    word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    both = (words[word] >> shift) | ((words[word + 1] << (_U(63) - shift)) << _U(1))
    return both & _MASK[np.minimum(left, 8)]


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether ``n`` bytes are alike in both, given as aligned words and places in them."""
    out = np.ones(len(n), bool)
    for k in np.flatnonzero(n > _CHAINED).tolist():
        x, y, m = int(a_at[k]), int(b_at[k]), int(n[k])
        out[k] = np.array_equal(a.view(np.uint8)[x : x + m], b.view(np.uint8)[y : y + m])
    todo = np.flatnonzero((n > 0) & (n <= _CHAINED))
    x, y, left = a_at[todo], b_at[todo], n[todo]
    while len(todo):
        out[todo] &= chunk(a, x, left) == chunk(b, y, left)
        on = left > 8
        todo, x, y, left = todo[on], x[on] + 8, y[on] + 8, left[on] - 8
    return out


class Words:
    """All words of a string column.

    ``doc[i]`` is the row of word i, ``start``/``end`` its byte range,
    ``first[r]:first[r + 1]`` the words of row r.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offsets = utf8(column)
        self.raw = _LOWER[raw] if lower else raw
        inside = ~_SPACE[raw]
        n = len(raw)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        starts[edge] |= inside[edge]
        edge = edge[edge > 0] - 1
        ends[edge] |= inside[edge]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self._aligned: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def aligned(self) -> np.ndarray:
        """The bytes as 64-bit words, with two of zeros behind them."""
        if self._aligned is None:
            self._aligned = aligned(self.raw)
        return self._aligned

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal bytes hash alike wherever they stand.

        Eight bytes after the other are mixed into what came before; a range over
        ``_CHAINED`` bytes is digested whole.
        """
        n = end - start
        h = mix(n.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x2545F4914F6CDD1D))
        todo = np.flatnonzero((n > 0) & (n <= _CHAINED))
        at, left = start[todo], n[todo]
        while len(todo):
            h[todo] = mix(h[todo] ^ chunk(self.aligned, at, left))
            on = left > 8
            todo, at, left = todo[on], at[on] + 8, left[on] - 8
        for k in np.flatnonzero(n > _CHAINED).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self.raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return h

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)


_LANES = np.random.default_rng(77).integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words and the bounds of each row's windows.

    A row with fewer words, but one at least, has one window: all its words.
    """
    h = words.hashes()
    n = np.where(words.count >= size, words.count - size + 1, (words.count > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(bounds[-1], np.uint64)
    if len(h) >= size:
        full = h[: len(h) - size + 1] * _LANES[0]
        for k in range(1, size):
            full += h[k : len(h) - size + 1 + k] * _LANES[k]
        full = mix(full)
    rows = np.flatnonzero(words.count >= size)
    if len(rows):
        take = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.first[:-1], n)
        long = np.repeat(words.count >= size, n)
        out[long] = full[take[long]]
    for r in np.flatnonzero((words.count > 0) & (words.count < size)):
        few = h[words.first[r] : words.first[r + 1]]
        out[bounds[r]] = mix(((few * _LANES[: len(few)]).sum(dtype=np.uint64) + _U(len(few))).reshape(1))[0]
    return out, bounds
