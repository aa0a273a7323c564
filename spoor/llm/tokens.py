"""Vectorised words and content hashes over Arrow string columns.

Everything works on the raw UTF-8 bytes of a whole column at once. A separator is always an ASCII byte, so a byte
scan finds the same words as the regular expressions of the contracts, and no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NON_ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: An odd base, so that it can be divided out of prefix sums modulo 2**64.
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit. Returns a new array."""
    x = x + _STEP
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    """:func:`mix` of one number."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=U64))[0])


def powers(n: int, base: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:  # a longer one is not worth its memory
            _powers[base] = have
    return have[:n]


class Spans:
    """Hashes of any span of a sequence of 64-bit names, from one prefix sum."""

    def __init__(self, names: np.ndarray, seed: int = 0):
        n = len(names)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(names ^ U64(mix_int(seed))) * powers(n, _BASE), dtype=U64, out=self.prefix[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hash of ``names[start : start + length]``; equal spans have equal hashes."""
        sums = self.prefix[start + length] - self.prefix[start]
        inverse = powers(len(self.prefix), _BASE_INV)
        return mix(sums * inverse[start] + np.asarray(length).astype(U64) * _STEP)


class Words:
    """The words of several texts.

    data    : the texts' bytes, one after the other (lower-cased if asked for)
    start   : first byte of each word; ``end`` is the byte after its last
    first   : words of text ``i`` are ``first[i] : first[i + 1]``
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~separators[data]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begin[cuts] = word[cuts]
        stop[cuts - 1] = word[cuts - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (or of the given byte ranges), eight bytes at a time."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        size = end - start
        padded = np.zeros((len(self.data) >> 3) + 3, dtype=U64)
        padded.view(np.uint8)[: len(self.data)] = self.data
        out = mix(size.astype(U64))
        rows: np.ndarray | slice = slice(None)
        at, left = start, size
        while len(at):
            word, shift = at >> 3, ((at & 7) << 3).astype(U64)
            lane = padded[word] >> shift
            lane |= (padded[word + 1] << U64(1)) << (U64(63) - shift)
            short = U64(8) * (8 - np.minimum(left, 8)).astype(U64)
            lane = (lane << short) >> short
            out[rows] = mix(out[rows] ^ (lane * _M1))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            rows = more if isinstance(rows, slice) else rows[more]
            at, left = at[more] + 8, left[more] - 8
        return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low = offsets[0]
    data = np.frombuffer(data, dtype=np.uint8)[low : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - low


def words_of(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    return Words(LOWER[data] if lower else data, offsets, separators)


def slices(column: pa.Array, limit: int = 1 << 21):
    """(first row, rows) such that a run of rows holds about ``limit`` bytes: bounds the working memory.

    A longer text is a run of its own, so none is ever cut.
    """
    _, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop - row
        row = stop
