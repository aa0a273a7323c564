"""Indicators in disassembly listings: hashes, strings, addresses, names and paths.

All matching is done by Spark's own functions over whole texts, since strings and some patterns cross lines. All
categories of a text are found in one projection, so no listing is compared with another. ``compat`` keeps known quirks of the
patterns; without it registry keys end at white space and drive paths with two separators count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.joins import without
from spoor.functions.text import all_matches, contains_any, let, unquoted
from spoor.sources.corpus import denylist as default_denylist


def file_hashes(corpus: DataFrame, content: str = "content") -> DataFrame:
    """path and sha256, md5, crc32 from the header of a listing, in lower case; null where absent."""
    return corpus.select("path", *_hashes(F.col(content)))


def _hashes(content: Column) -> list[Column]:
    return [F.lower(F.nullif(F.regexp_extract(content, f"(?iU){p}", 1), F.lit(""))).alias(k) for k, p in fixed.HASHES.items()]


def cleaned(content: Column) -> Column:
    """Without the lines that begin with boilerplate."""
    kept = F.filter(F.split(content, "\n", -1), lambda line: ~line.rlike(f"(?iU)^(?:{fixed.BOILERPLATE})"))
    return F.array_join(kept, "\n")


def strings(content: Column) -> Column:
    """Quoted strings of 5 to 200 characters without format marks, trimmed."""
    found = F.filter(all_matches(content, fixed.STRINGS, 1), lambda s: ~contains_any(s, fixed.BAD_IN_STRINGS))
    return F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))


def searched(corpus: DataFrame) -> DataFrame:
    """path and the text that is searched: the cleaned content and, on lines of their own, its strings."""
    text = corpus.select("path", cleaned(F.col("content")).alias("text"))
    return text.select("path", F.concat(F.col("text"), F.lit("\n"), F.array_join(strings(F.col("text")), "\n")).alias("text"))


def valid_path(path: Column, compat: bool = True) -> Column:
    bad = (F.char_length(path) < 6) | contains_any(path, fixed.BAD_IN_PATHS) | path.rlike(f"(?iU){fixed.GO_MODULE}")
    good = path.rlike(f"(?iU){fixed.SUSPICIOUS_PATH}") | path.startswith("\\\\") | path.startswith("//")
    good = good | F.startswith(F.upper(path), F.lit("HKEY_"))
    if not compat:
        separators = F.greatest(F.regexp_count(path, F.lit(r"\\")), F.regexp_count(path, F.lit("/")))
        good = good | (path.rlike(r"^.:[/\\]") & (separators >= 2))
    return ~bad & good


def path_category(path: Column) -> Column:
    return F.when(F.lower(path).rlike(f"(?iU){fixed.DEPENDENCY}"), "dependency_paths").otherwise("operational_files")


def denied(value: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased value contains a term of the list."""
    return contains_any(F.lower(value), terms)


def valid_indicator(value: Column, category: Column) -> Column:
    """Validity of what is no path, but for the denylist."""
    bad = (F.char_length(value) < 3) | F.contains(value, F.lit("..."))
    for end in fixed.BAD_ENDINGS:
        bad = bad | value.endswith(end)
    formatted = F.lit(False)
    for mark in fixed.FORMATS:
        formatted = formatted | value.startswith(mark) | value.endswith(mark)
    scheme = F.lit(False)
    for start in fixed.SCHEMES:
        scheme = scheme | value.startswith(start)
    own = (
        F.when(category.isin("protocols_full", "urls"), ~formatted & scheme & (F.char_length(value) > 10))
        .when(category == "openssh_full", F.contains(F.lower(value), F.lit("@openssh.com")))
        .when(category == "files", ~value.startswith(".") & F.contains(value, F.lit(".")))
        .otherwise(F.lit(True))
    )
    return ~bad & own


def found_in(text: Column, *, deny: Sequence[str], compat: bool = True, patterns: dict[str, str] | None = None) -> Column:
    """A map of category to the sorted distinct values that are found in a searched text; categories without any are left out."""
    trimmed = lambda found: F.array_distinct(F.transform(found, unquoted))

    def good(category: str, pattern: str) -> Column:
        valid = lambda v: valid_indicator(v, F.lit(category)) & ~denied(v, deny)
        return F.array_sort(F.filter(trimmed(all_matches(text, pattern)), valid))

    def of(named: Column, category: str) -> Column:
        return F.transform(F.filter(named, lambda x: x["category"] == category), lambda x: x["value"])

    def entry(category: str, values: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), values.alias("values"))

    paths = [*fixed.PATHS, fixed.REGISTRY if compat else fixed.REGISTRY_MEANT]
    every = trimmed(F.flatten(F.array(*[all_matches(text, p, 1) for p in paths])))
    every = F.array_sort(F.filter(every, lambda v: valid_path(v, compat)))
    named = F.transform(every, lambda v: F.struct(path_category(v).alias("category"), v.alias("value")))
    both = let(named, lambda x: F.array(*[entry(k, of(x, k)) for k in ("operational_files", "dependency_paths")]))
    single = F.array(*[entry(k, good(k, p)) for k, p in {**fixed.INDICATORS, **(patterns or {})}.items()])
    return F.map_from_entries(F.filter(F.concat(single, both), lambda x: F.size(x["values"]) > 0))


def indicators(
    corpus: DataFrame, *, deny: Sequence[str] | None = None, compat: bool = True, patterns: dict[str, str] | None = None
) -> DataFrame:
    """Distinct (path, category, value) of all listings.

    deny: terms that a value may not contain, which does not hold for paths; patterns: more or other categories.
    """
    deny = default_denylist() if deny is None else deny
    each = searched(corpus).select("path", F.explode(found_in(F.col("text"), deny=deny, compat=compat, patterns=patterns)).alias("category", "values"))
    return each.select("path", "category", F.explode("values").alias("value")).distinct()


def without_denied(iocs: DataFrame, terms: DataFrame) -> DataFrame:
    """Values that contain no term of a table ``term``, for lists that do not fit into an expression."""
    return without(iocs, terms.select("term").distinct(), "term", F.contains(F.lower(F.col("value")), F.col("term")))


def scan(
    corpus: DataFrame, *, deny: Sequence[str] | None = None, compat: bool = True, patterns: dict[str, str] | None = None
) -> DataFrame:
    """A row for each listing with any result: path, hashes, iocs (map of category to sorted values), error.

    Rows with a column ``error`` that is not null are passed on with it. Rows of one path are listings of their own. All is
    one projection.
    """
    deny = default_denylist() if deny is None else deny
    error = F.col("error") if "error" in corpus.columns else F.lit(None).cast("string")
    frame = corpus.select("path", "content", error.alias("error"), cleaned(F.col("content")).alias("text"))
    text = F.concat(F.col("text"), F.lit("\n"), F.array_join(strings(F.col("text")), "\n"))
    frame = frame.select("path", *_hashes(F.col("content")), text.alias("text"), "error")
    iocs = found_in(F.col("text"), deny=deny, compat=compat, patterns=patterns)
    out = frame.select("path", *fixed.HASHES, iocs.alias("iocs"), "error")
    out = out.withColumn("iocs", F.when(F.size("iocs") > 0, F.col("iocs")))
    return out.where(F.coalesce(*fixed.HASHES).isNotNull() | F.col("iocs").isNotNull() | F.col("error").isNotNull())
