"""What the two classifiers share: which rows are held out, and the bounded sample that they learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text has the remainder ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, *, id: str, text: str, each: int, parts: int
) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``each`` labelled rows of either class, and how many there are in all.

    Rows that are held out, and null ids and labels, are never learned from. The rows of least id hash are taken, so
    the sample does not depend on how the tables are dealt. Its ids are bounded by ``2 * each`` and are broadcast.
    An id with two labels counts once, with the larger one.
    """
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{target}`").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"), parts))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id", F.lit(17))
    some = known.where("y = 0").orderBy(order, "id").limit(each).unionAll(known.where("y = 1").orderBy(order, "id").limit(each))
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id").select("id", "text", "y"), {0: counts.get(0, 0), 1: counts.get(1, 0)}
