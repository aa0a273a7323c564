"""Column expressions for text: trimming, matching, wildcards."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() sees it, for Java's regular expressions.
BLANK = r"[\s\x1C-\x1F]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body names it often or within a function of elements."""
    return F.transform(F.array(value), body)[0]


def one_decimal(value: Column) -> Column:
    """A double with one decimal as C's ``%.1f`` gives it: by its exact value, halves to even.

    Only a number that reads x.x5 can be off: then the sign of what its double is above or below that decides, found by an
    exact product (the number in two halves times 100).
    """
    part = value * F.lit(134217729.0)
    high = part - (part - value)
    hundredths = F.round(value * 100, 0)
    above = (high * 100 - hundredths) + (value - high) * 100
    tie = (F.pmod(hundredths, F.lit(10.0)) == 5) & (F.abs(above) < 1e-6)
    floor = (hundredths - 5) / 10
    even = F.pmod(floor, F.lit(2.0)) == 0
    up = (above > 0) | ((above == 0) & ~even)
    return F.when(tie, (floor + F.when(up, 1.0).otherwise(0.0)) / 10).otherwise(F.round(value, 1))


def ctime(at: Column) -> Column:
    """A timestamp as C's ``ctime`` shows it."""
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def unquoted(text: Column) -> Column:
    """Without white space around it, then without quotes around it."""
    return F.btrim(strip(text), F.lit("\"'"))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return out


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match, ignoring case in all of Unicode."""
    return F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(group))


def newlines(text: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def wildcard(pattern: str) -> str:
    """A shell wildcard as a regular expression for the whole of a name: ``*``, ``?``, ``[set]``, ``[!set]``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append(f"[{'^' + inner[1:] if inner.startswith('!') else inner.replace('^', chr(92) + '^', 1) if inner.startswith('^') else inner}]")
            i = end + 1
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?&~#-])", r"\\\1", c))
    return f"(?s)^(?:{''.join(out)})\\z"


def matches_any(name: Column, patterns: Iterable[str], fold_case: bool = False) -> Column:
    """Whether any wildcard matches the whole name; a list that fits into one expression."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    exact = [p for p in patterns if not re.search(r"[*?\[]", p)]
    loose = [wildcard(p)[len("(?s)^(?:") : -len(")\\z")] for p in patterns if re.search(r"[*?\[]", p)]
    out = F.lit(False)
    if exact:
        own = F.lower(name) if fold_case else name
        out = out | own.isin([p.lower() if fold_case else p for p in exact])
    if loose:
        out = out | name.rlike(f"(?s{'iu' if fold_case else ''})^(?:{'|'.join(loose)})\\z")
    return out
