"""Functions in decompiled pseudo-C: headers by Spark's own functions, bodies by a scan over each file's lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.text import let, strip


def clean_name(name: Column) -> Column:
    """Without a return type and calling convention before it; names of unknown types stay whole."""

    def without(parts: Column) -> Column:
        n, first = F.size(parts), F.get(parts, F.lit(0))
        typed = first.isin(list(fixed.RETURN_TYPES)) | F.get(parts, F.lit(1)).startswith("__")
        tail = lambda k: F.array_join(F.slice(parts, k + 1, F.greatest(n - k, F.lit(0))), " ")
        return F.when((n >= 3) & typed, tail(2)).when((n >= 2) & first.startswith("__"), tail(1)).otherwise(name)

    several = let(F.split(strip(name), r"(?U)[\s\x1C-\x1F]+", -1), without)
    return F.when(~F.contains(name, F.lit(" ")), name).otherwise(several)


def header_name(line: Column) -> Column:
    """The name that a trimmed line gives to a function, by the first pattern whose name is one; else null."""

    def solid(name: Column) -> Column:
        letters = F.replace(name, F.lit(" "), F.lit(""))
        return F.when((F.char_length(letters) > 1) & ~letters.rlike(r"(?U)^\d+$"), name)

    raw = [F.regexp_extract(line, f"(?U){pattern}", 1) for pattern in fixed.HEADERS]
    found = [let(strip(r), lambda x: let(clean_name(x), solid)) for r in raw]
    return F.when(F.contains(line, F.lit("(")), F.coalesce(*found))


def is_call(line: Column) -> Column:
    """A trimmed line that is a statement rather than a header."""
    return line.endswith(";") | F.contains(line, F.lit("="))


def headers(corpus: DataFrame) -> DataFrame:
    """corpus_id, path, file_ord, content and found: array of structs line_no, name of candidate headers."""
    each = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    # Most lines have no parenthesis and are dropped before anything is matched.
    some = F.filter(each, lambda x: F.contains(x["line"], F.lit("(")))
    some = F.transform(some, lambda x: F.struct(x["line_no"].alias("line_no"), strip(x["line"]).alias("line")))
    maybe = F.filter(some, lambda x: ~x["line"].startswith("//") & ~x["line"].startswith("/*") & ~is_call(x["line"]))
    named = F.transform(maybe, lambda x: F.struct(x["line_no"].alias("line_no"), header_name(x["line"]).alias("name")))
    return corpus.select("corpus_id", "path", "file_ord", "content", F.filter(named, lambda x: x["name"].isNotNull()).alias("found"))


class _File:
    """The lines of one file, with where braces open and close by their running balance."""

    def __init__(self, content: str):
        self.lines = content.split("\n")
        opens = np.array([x.count("{") for x in self.lines])
        closes = np.array([x.count("}") for x in self.lines])
        self.balance = np.cumsum(opens - closes)
        self.opened, self.closed = np.r_[0, np.cumsum(opens)], np.r_[0, np.cumsum(closes)]
        self.opening, shut = np.flatnonzero(opens), np.flatnonzero(closes)
        order = np.lexsort((shut, self.balance[shut]))
        self.shut, self.level = shut[order], self.balance[shut][order]

    def end(self, start: int) -> int:
        """The line that closes what opens at or after ``start``; the last one if nothing does."""
        before = self.balance[start - 1] if start else 0
        first = np.searchsorted(self.opening, start)
        if first < len(self.opening):
            low, high = np.searchsorted(self.level, before), np.searchsorted(self.level, before, side="right")
            at = low + np.searchsorted(self.shut[low:high], self.opening[first])
            if at < high:
                return int(self.shut[at])
        return len(self.lines) - 1

    def body(self, start: int, name: str) -> str | None:
        """The text of a function, with what leads up to it; None if it is not a whole function."""
        words = name.split()
        before = [x for x in self.lines[max(0, start - 5) : start] if self._leads(x.strip(), words)]
        stop = self.end(start) + 1
        opens, closes = (
            sum(x.count(brace) for x in before) + many[stop] - many[start] for brace, many in (("{", self.opened), ("}", self.closed))
        )
        if not opens or opens != closes:
            return None
        stripped = "\n".join(before + self.lines[start:stop]).strip()
        top = stripped.split("\n", 5)
        if len(top) < 2:
            return None
        head = "\n".join(top[:5])
        named = all(w in head for w in words) if len(words) > 1 else name in head
        return stripped if named else None

    @staticmethod
    def _leads(line: str, words: list[str]) -> bool:
        low = line.lower()
        return not line or line.startswith("//") or any(w in line for w in words) or any(w in low for w in fixed.LOOKBACK_WORDS)


def _bodies(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = []
        for corpus, path, order, content, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = _File(content or "")
            for at in found or []:
                if (body := file.body(at["line_no"], at["name"])) is not None:
                    rows.append((corpus, path, order, at["line_no"], at["name"], body))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["corpus_id", "path", "file_ord", "line_no", "name", "body"])


def definitions(corpus: DataFrame) -> DataFrame:
    """Every valid definition: corpus_id, path, file_ord, line_no, name, body."""
    return headers(corpus).select("corpus_id", "path", "file_ord", "content", "found").mapInArrow(
        _bodies, "corpus_id string, path string, file_ord string, line_no int, name string, body string"
    )


def functions(found: DataFrame) -> DataFrame:
    """One row for each name: the body of its last definition, the places of its first and last one.

    Places are structs of file_ord and line_no.
    """
    place = F.struct("file_ord", "line_no")
    return found.groupBy("corpus_id", "name").agg(
        F.max_by("body", place).alias("body"), F.min(place).alias("first_ord"), F.max(place).alias("last_ord")
    )


def entry_point(found: DataFrame) -> DataFrame:
    """(corpus_id, name): the first function of the entry file."""
    return found.where(F.col("file_ord").startswith("0")).groupBy("corpus_id").agg(F.min_by("name", F.struct("file_ord", "line_no")).alias("name"))


def brace_balance(lines: DataFrame) -> DataFrame:
    """Lines with ``balance``: braces opened and not closed up to each line's end."""
    from pyspark.sql import Window

    step = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    order = Window.partitionBy("corpus_id", "path").orderBy("line_no")
    return lines.withColumn("balance", F.sum(step.cast("long")).over(order))
