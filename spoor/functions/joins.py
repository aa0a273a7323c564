"""Joins with a list of checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What one broadcast part of a list may hold; a longer list is taken in parts of that size.
BLOCK_BYTES = 32 << 20


def _parts(listed: DataFrame, column: str, block_bytes: int) -> list[DataFrame]:
    size = listed.agg(F.sum(F.octet_length(column) + 64).alias("n")).first()["n"] or 0
    parts = 1 + int(size // block_bytes)
    return [listed if parts == 1 else listed.where(F.pmod(F.xxhash64(column), F.lit(parts)) == i) for i in range(parts)]


def without(rows: DataFrame, listed: DataFrame, column: str, condition: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows for which no row of the list meets the condition. The list is broadcast, part by part; rows never move."""
    for part in _parts(listed, column, block_bytes):
        rows = rows.join(F.broadcast(part), condition, "left_anti")
    return rows


def looked_up(rows: DataFrame, listed: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with the columns of the list's row of the same key; those without one are left out. Broadcast like :func:`without`."""
    return reduce(DataFrame.unionAll, [rows.join(F.broadcast(part), column) for part in _parts(listed, column, block_bytes)])
