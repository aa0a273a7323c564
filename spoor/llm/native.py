"""Column expressions for words, shared by the operators that stay within Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
#: After lower-casing; A-Z are no separators before it either.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. Texts of ASCII bytes alone take the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str) -> Column:
    """The words of a text; none for a null. A regular expression finds separators, which leaves empty ends."""
    parts = F.split(F.coalesce(text, F.lit("")), separators, -1)
    return F.array_remove(parts, "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body uses it in a function of elements."""
    return F.transform(F.array(value), body)[0]


def covered(starts: Column, length: int) -> Column:
    """How many places the ranges of ``length`` places from ascending starts cover."""
    zero = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, at: Column) -> Column:
        stop = at.cast("long") + (length - 1)
        return F.struct(
            F.greatest(acc["upto"], stop).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(acc["upto"], at.cast("long") - 1))).alias("n"),
        )

    return F.aggregate(starts, zero, step)["n"]
