"""Benchmark decontamination: a broadcast table of the benchmark's word windows against all training words.

The table is keyed by the longest word of each window, so a window of a text costs one hash probe only where such a
word stands; then the words around it are compared with the window itself. All in Spark's own functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.native import NON_ALNUM, lower_ascii, words

#: What one broadcast table of windows may hold; a larger benchmark is taken in blocks of that size.
BLOCK_BYTES = 32 << 20
#: Stands before the words of each text, so that a text without hits has a row as well. No word holds this byte.
_MARK = "\x00"


def item_windows(items: DataFrame, *, item: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """The distinct windows of all items: win array, n, key (its longest word), off (the key's place), items array.

    An item with fewer words than a window is one window; one without words (or a null text) has none.
    """
    listed = items.select(F.col(f"`{item}`").alias("item"), words(lower_ascii(F.col(f"`{text}`")), NON_ALNUM).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = listed.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    cut = cut.select("item", F.slice("w", F.col("at"), F.lit(window)).alias("win"))
    longest = F.array_max(
        F.transform("win", lambda x, i: F.struct(F.char_length(x).alias("n"), x.alias("x"), (-i).alias("i")))
    )
    found = cut.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("best", longest)
    return found.select(
        "win", F.size("win").alias("n"), F.col("best.x").alias("key"), (-F.col("best.i")).alias("off"), "items"
    )


def _hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """A row for each text with ``mark`` true, and one for each window of the table found in it."""
    marks = docs.sparkSession.range(1).select(
        F.lit(None).cast("array<string>").alias("win"), F.lit(0).alias("n"), F.lit(_MARK).alias("key"),
        F.lit(0).alias("off"), F.lit(None).cast(table.schema["items"].dataType).alias("items"),
    )
    table = F.broadcast(table.unionByName(marks))
    words_ = docs.select("id", "h", "w", F.posexplode(F.concat(F.array(F.lit(_MARK)), F.col("w"))).alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    fits = (start > 0) & (start + F.col("n") - 1 <= F.size("w"))
    same = F.slice(F.col("w"), F.greatest(start, F.lit(1)), F.col("n")) == F.col("win")
    found = words_.join(table, (F.col("word") == F.col("key")) & ((F.col("pos") == 0) | (fits & same)))
    mark = F.col("pos") == 0
    return found.select(
        "id", "h", mark.alias("mark"), F.size("w").cast("long").alias("n_words"),
        F.when(~mark, F.struct(start.cast("long").alias("start"), (start + F.col("n") - 1).cast("long").alias("stop"))).alias("hit"),
        "items",
    )


def _n_hit(hits: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(acc["upto"], x["start"] - 1))
        return F.struct(F.greatest(acc["upto"], x["stop"]).alias("upto"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(hits), zero, step)["n"]


def _leaks(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """(id, h, n_words, items, hits) for each row of ``docs``; see :func:`find_leaks`."""
    table = item_windows(benchmark, item=item, text=item_text, window=window)
    held = F.sum(F.octet_length(F.array_join("win", " ")) + F.size("items") * 16 + 64)
    blocks = 1 + int((table.agg(held.alias("b")).first()["b"] or 0) // block_bytes)
    column = F.col(f"`{text}`")
    listed = docs.select(
        F.col(f"`{id}`").alias("id"), F.xxhash64(column).alias("h"), words(lower_ascii(column), NON_ALNUM).alias("w")
    )
    part = F.pmod(F.xxhash64("win"), F.lit(blocks))
    found = reduce(DataFrame.unionAll, (_hits(listed, table.where(part == i)) for i in range(blocks)))
    # A text that stands k times under one id has k marks in each block and its hits k times.
    whole = found.groupBy("id", "h").agg(
        (F.count_if("mark") / blocks).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"),
    )
    items = F.array_sort(F.transform("found", lambda x: x.cast("string")))
    out = whole.select("id", "h", "copies", "n_words", "hits", items.alias("items"))
    return out.select("id", "h", "n_words", "items", "hits", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: id, text_hash long, n_words, n_hit, n_items long, items (sorted array of
    strings), hits (sorted array of structs start, stop: words from 1), contaminated boolean.

    Words are runs of ASCII letters, digits and other characters than ASCII, A-Z lower-cased. A word is hit if a
    window of ``window`` words of an item (or the whole of a shorter item) covers it. Null texts and texts without
    words have no hits, and so have all if the benchmark is empty. Rows with the same id and text give equal rows;
    null ids are kept. The benchmark's size is checked: windows over ``block_bytes`` are taken in several blocks,
    each broadcast against all texts, and the result is the same.
    """
    out = _leaks(docs, benchmark, id, text, item, item_text, window, block_bytes)
    return out.select(
        F.col("id").alias(id), F.col("h").alias("text_hash"), "n_words", _n_hit(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "hits", (F.size("hits") > 0).alias("contaminated"),
    )


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = BLOCK_BYTES, spans: bool = False,
) -> DataFrame:
    """``docs`` without contaminated documents, or with ``spans`` without the words that are hit.

    A removed word goes with the separators after it; a document that loses nothing stays as it is. All columns
    stay, whatever their names. See :func:`find_leaks` for the rest.
    """
    found = _leaks(docs, benchmark, id, text, item, item_text, window, block_bytes).where(F.size("hits") > 0)
    found = found.select("id", "h", "hits").dropDuplicates(["id", "h"])
    column = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("own"), F.xxhash64(column).alias("hash"),
        column.alias("text"),
    )
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    if not spans:
        return rows.join(found, same, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    # Pieces of a word and the separators after it.
    cut = F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    head = F.regexp_extract("text", r"^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)", 1)
    kept = F.filter(cut, lambda x, i: ~F.exists("hits", lambda h: (h["start"] <= i + 1) & (i + 1 <= h["stop"])))
    text_ = F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(kept, "")))
    joined = rows.join(found, same, "left")
    return joined.select(*[(text_ if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of every text of ``documents`` lie in windows of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS h
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS h
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.h = bw.h AND dw.n = bw.n),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
