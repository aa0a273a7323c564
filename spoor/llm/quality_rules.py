"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.native import SPACES, covered, let, words

SYMBOLS = r"[#*$%&|<>]"
#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with this are was on as by an be it from "
    "der die das und ist den dem von mit für auf nicht ein eine sich des "
    "le la les des une est et du dans que qui pour par pas sur "
    "el los las de que en y por con para una del no se"
).split()


class Rule(NamedTuple):
    """A document fails if the value is below ``least`` or above ``most``; a bound that is None does not count."""

    name: str
    value: str
    least: float | None
    most: float | None


#: Values are SQL over the statistics of :func:`statistics`; a value that is null passes.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("repeated words", "100.0 * n_repeat_words / n_words", None, 50),
    Rule("word length", "1.0 * word_chars / n_words", 2, 20),
    Rule("symbols", "1.0 * n_symbols / n_words", None, 0.1),
    Rule("repeated lines", "1.0 * n_dup_lines / n_lines", None, 0.5),
    Rule("stop words", "1.0 * n_stop_words / n_words", 0.02, None),
    Rule("upper case", "1.0 * n_upper_words / n_words", None, 0.3),
)
#: The first two, which are the base.
BASE = RULES[:2]


def statistics(text: str, word: str, lines: str) -> list[Column]:
    """The statistics of one text, given its words and its lines as columns."""
    w, n = F.col(word), F.size(word)
    has_word = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Windows by hash and place; equal ones stand side by side once sorted.
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    twice = let(
        F.array_sort(windows),
        lambda s: F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"])),
    )
    stop = [*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)]
    return [
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(has_word).cast("long").alias("n_lines"),
        (F.size(has_word) - F.size(F.array_distinct(has_word))).cast("long").alias("n_dup_lines"),
        covered(F.array_sort(F.transform(twice, lambda x: x["i"])), 3).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[A-Z]{2}")).cast("long").alias("n_upper_words"),
    ]


def failed(rules: Sequence[Rule]) -> Column:
    """True if any rule fails."""
    tests = [F.lit(False)]
    for r in rules:
        value = F.expr(r.value.replace(" / n_words", " / nullif(n_words, 0)").replace(" / n_lines", " / nullif(n_lines, 0)"))
        if r.least is not None:
            tests.append(F.coalesce(value < r.least, F.lit(False)))
        if r.most is not None:
            tests.append(F.coalesce(value > r.most, F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def apply_rules(df: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words,
    n_upper_words (long), base_failed and kept (boolean).

    Words are what stands between spaces and control characters of the same kind. A null text counts as empty; it
    has no words and fails. A ratio whose divisor is 0 passes its rule. n_repeat_words counts the words covered by
    windows of three words that stand twice or more in the text, found by 64-bit hashes within it. Columns of these
    names in ``df`` are replaced; rows keep their number, and no row is compared with another.
    """
    rest = [c for c in df.columns if c.lower() not in (*_NEW, "base_failed", "kept")]
    frame = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"), F.col(f"`{text}`").alias("__text"),
        words(F.col(f"`{text}`"), SPACES).alias("__words"), F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1).alias("__lines"),
    )
    frame = frame.select("__row", *statistics("__text", "__words", "__lines"))
    base = failed(BASE)
    return frame.select(
        *[F.col(f"__row.`{c}`").alias(c) for c in rest], *_NEW,
        base.alias("base_failed"), (~base & ~failed(rules)).alias("kept"),
    )


_NEW = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text of ``documents``."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.drop("text")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS p,
         unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) AS h
  FROM w WHERE len(words) >= 3),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win),
rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM twice WHERE c > 1)
  GROUP BY doc_id),
s AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z][A-Z]')))::BIGINT AS n_upper_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT coalesce({verdict}, false) AS kept FROM b
""".replace("{stop}", ", ".join(f"'{x}'" for x in dict.fromkeys([*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)]))).replace(
    "{verdict}",
    " OR ".join(
        f"coalesce({r.value.replace(' / n_words', ' / nullif(n_words, 0)').replace(' / n_lines', ' / nullif(n_lines, 0)')} {op} {bound}, false)"
        for r in RULES
        for op, bound in (("<", r.least), (">", r.most))
        if bound is not None
    ),
)
