"""n-grams of word numbers: their hashes, sorted arrays of them in one mapped file for each shard, and packed rows.

A table holds the ascending 64-bit hashes of a shard as buckets by their top bits, some 16 hashes each, and the next 40
bits of each hash; so an n-gram is known by about 58 bits besides its shard. Counts are bytes, larger ones apart.
"""

from __future__ import annotations

import numpy as np
import zstandard

from spoor.llm.shared import load_many, save_many
from spoor.llm.tokens import U64, mix

_ODD = U64(0x9E3779B97F4A7C15 | 1)
_LOW32 = U64(0xFFFFFFFF)
#: Hashes of a bucket, on average.
BUCKET = 16
#: The least count that does not fit into its byte.
LARGE = 255


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the word numbers of each row."""
    out = mix(columns[0].astype(U64))
    for c in columns[1:]:
        out ^= (c.astype(U64) + U64(1)) * _ODD
        out = mix(out)
    return out


def route(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by bits that the tables' buckets are not made of."""
    return ((hashes & _LOW32) * U64(shards)) >> U64(32)


def by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their shards, and where each shard begins among them."""
    small = shard.astype(np.uint16 if shards < 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(shards + 1))


def begins(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)


def summed(
    keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]
) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ascending distinct keys, their columns (equal wherever the key is), and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    new = begins(keys)
    at = order[new]
    return keys[new], [c[at] for c in columns], [np.add.reduceat(v[order], new) if len(new) else v for v in values]


def coded(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and those that do not fit by their places."""
    at = np.flatnonzero(values >= LARGE)
    return {name: np.minimum(values, LARGE).astype(np.uint8), f"{name} at": at.astype(np.uint32), f"{name} large": values[at].astype(np.int64)}


def decoded(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The counts at some places."""
    out = arrays[name][at].astype(np.int64)
    large = np.flatnonzero(out == LARGE)
    if len(large):
        out[large] = arrays[f"{name} large"][np.searchsorted(arrays[f"{name} at"], at[large].astype(np.uint32))]
    return out


def save_table(path: str, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """Writes ascending distinct hashes with columns of counts."""
    bits = max(1, int(len(keys) // BUCKET).bit_length())
    start = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)).astype(np.uint32)
    rest = (keys << U64(bits)) >> U64(24)
    arrays = {"start": start, "rest": (rest >> U64(8)).astype(np.uint32), "check": rest.astype(np.uint8)}
    for name, values in columns.items():
        arrays |= coded(name, values)
    save_many(path, arrays)


class Table:
    """A shard's n-grams, mapped."""

    def __init__(self, path: str):
        self.arrays = load_many(path)
        self.start, self.rest, self.check = (self.arrays[k] for k in ("start", "rest", "check"))
        self.bits = (len(self.start) - 1).bit_length() - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not held."""
        bucket = (hashes >> U64(64 - self.bits)).astype(np.int64)
        rest = (hashes << U64(self.bits)) >> U64(24)
        check, rest = rest.astype(np.uint8), (rest >> U64(8)).astype(np.uint32)
        low, high = self.start[bucket].astype(np.int64), self.start[bucket + 1].astype(np.int64)
        stop = high.copy()
        last = len(self.rest) - 1
        if last < 0:
            return np.full(len(hashes), -1, dtype=np.int64)
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (self.rest[np.minimum(middle, last)] < rest) & (middle < high)
            low = np.where(less, middle + 1, low)
            high = np.where(less, high, np.maximum(middle, low))
        out = np.full(len(hashes), -1, dtype=np.int64)
        rows = np.arange(len(hashes))
        while len(rows):  # a second step only where 32 bits agree and the other 8 do not
            at = low[rows]
            same = (at < stop[rows]) & (self.rest[np.minimum(at, last)] == rest[rows])
            rows, at = rows[same], at[same]
            hit = self.check[at] == check[rows]
            out[rows[hit]] = at[hit]
            rows = rows[~hit]
            low[rows] += 1
        return out

    def counts(self, name: str, at: np.ndarray) -> np.ndarray:
        return decoded(self.arrays, name, at)


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)


def _planes(values: np.ndarray, width: int) -> bytes:
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def pack(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows of word numbers and counts, in order of the second number and then the first; bytes of like weight together."""
    order = np.argsort(columns[1].astype(U64) << U64(32) | columns[0].astype(U64)) if len(columns) > 1 else np.argsort(columns[0])
    columns, values = [c[order].astype(U64) for c in columns], [v[order].astype(U64) for v in values]
    lead = columns[1::-1]
    same = np.ones(len(order), dtype=bool)
    for i, c in enumerate(lead):
        step = c.copy()
        step[1:] -= np.where(same[1:], c[:-1], U64(0))
        same[1:] &= c[1:] == c[:-1]
        lead[i] = step
    parts = [*lead, *columns[2:], *values]
    widths = [_width(p) for p in parts]
    data = bytes(widths) + b"".join(_planes(p, w) for p, w in zip(parts, widths, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(blob: bytes, n: int, columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What :func:`pack` was given, in its order: word numbers of 32 bits, and counts."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = columns + values, []
    for width in data[: columns + values]:
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(raw.reshape(-1).view("<u8"))
        at += n * width
    np.cumsum(out[0], dtype=U64, out=out[0])
    if columns > 1:
        # Steps begin anew wherever the leading number changes.
        new = begins(out[0])
        total = np.cumsum(out[1], dtype=U64)
        out[1] = total - np.repeat(total[new] - out[1][new], np.diff(np.r_[new, n]))
        out[0], out[1] = out[1], out[0]
    return [c.astype(np.uint32) for c in out[:columns]], [v.view(np.int64) for v in out[columns:]]
