"""Sorted keys as byte planes, and how many pieces to deal an input into.

A row for each key would cost Spark some 30 bytes; a blob of sorted keys costs the entropy of the keys. Keys are
stored as differences, byte by byte of equal weight, so that the leading zero bytes vanish in Spark's compression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from spoor.llm.tokens import U64

#: Sizes from here on are Catalyst's way to say that it does not know.
UNKNOWN = 10**18


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of 64-bit values, bytes of the same weight together."""
    values = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(values[:, :width].T).tobytes()


def unplanes(blob: bytes | memoryview, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.reshape(-1).view(U64)


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of 64-bit values with their widths in bytes; the first is ascending and stored as differences."""
    keys, width = columns[0]
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return b"".join([planes(steps, width), *(planes(v.view(U64), w) for v, w in columns[1:])])


def unpack(blob: bytes, n: int, widths: list[int]) -> list[np.ndarray]:
    view, at, out = memoryview(blob), 0, []
    for w in widths:
        out.append(unplanes(view[at : at + n * w], n, w))
        at += n * w
    np.cumsum(out[0], dtype=U64, out=out[0])
    return out


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of ``shards`` equal ranges of the 64-bit numbers begins in ascending ``keys``, and the end."""
    edges = np.array([(i << 64) // shards for i in range(shards)], dtype=U64)
    return np.r_[np.searchsorted(keys, edges, side="left"), len(keys)]


def size_in_bytes(df: DataFrame) -> int:
    """What Catalyst takes the frame's size to be (for files, their bytes); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each_mb: float) -> int:
    """Into how many pieces of ``each_mb`` the input goes: as many as shuffle partitions at least.

    Of a frame whose size Catalyst does not know (one made from rows), as many as it has partitions.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = size_in_bytes(df)
    wanted = size / (each_mb * 1e6) if size < UNKNOWN else df.rdd.getNumPartitions()
    return max(1, least, int(wanted))
