"""The call graph of a corpus: calls, missing functions, library filter, execution order."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.joins import without
from spoor.functions.text import matches_any, wildcard
from spoor.operators.functions import clean_name
from spoor.sources.shared import kept, shared_dir

_CALLS = [re.compile(p, re.IGNORECASE | re.MULTILINE) for p in fixed.CALLS]
DEPTH = 100


def calls_in(name: str, body: str) -> dict[str, int]:
    """What a body calls, with the place of the first call that counts.

    A call of itself counts from the tenth line on; a name that looks like a variable around the call does not.
    """
    ends = [m.start() for m in re.finditer("\n", body)]
    own, out = set(name.split()), {}
    for pattern in _CALLS:
        for m in pattern.finditer(body):
            callee, at = m[1], m.start()
            if callee in out and out[callee] <= at or callee in own and bisect_left(ends, at) < 10:
                continue
            near = body[max(0, at - 100) : at + 50]
            if not any(mark.format(callee) in near for mark in fixed.VARIABLE_MARKS):
                out[callee] = at
    return out


def _edges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = [
            (corpus, name, callee, at)
            for corpus, name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for callee, at in calls_in(name, body).items()
        ]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["corpus_id", "src", "dst", "first_pos"])


def calls(functions: DataFrame) -> DataFrame:
    """(corpus_id, src, dst, first_pos), one row for each caller and callee."""
    return functions.select("corpus_id", "name", "body").mapInArrow(_edges, "corpus_id string, src string, dst string, first_pos int")


def missing(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(corpus_id, name) of what is called but not defined."""
    called = edges.select("corpus_id", F.col("dst").alias("name")).distinct()
    return called.join(functions, ["corpus_id", "name"], "left_anti")


def kept_names(functions: DataFrame, missed: DataFrame, patterns: Iterable[str], fold_case: bool = False) -> DataFrame:
    """(corpus_id, name) of defined and missing names that no wildcard of the library matches, from either section."""
    names = functions.select("corpus_id", "name").unionAll(missed.select("corpus_id", "name")).distinct()
    return names.where(~matches_any(F.col("name"), patterns, fold_case))


def without_matches(names: DataFrame, library: DataFrame) -> DataFrame:
    """Names that match no wildcard of a table (``exact``, ``pattern``), for libraries of any size.

    Wildcards that are plain names are an equi-join; the others are broadcast in parts of checked size.
    """
    plain = library.where("exact IS NOT NULL").select(F.col("exact").alias("name")).distinct()
    loose = library.where("exact IS NULL").select("pattern").distinct()
    return without(names.join(plain, "name", "left_anti"), loose, "pattern", F.expr("name RLIKE pattern")).select(*names.columns)


def library_table(spark, patterns: Iterable[tuple[str, str]]) -> DataFrame:
    """(section, exact, pattern) of a library's wildcards: the name itself if it holds none, and the regular expression."""
    rows = [(s, None if re.search(r"[*?\[]", p) else p, wildcard(p)) for s, p in patterns]
    return spark.createDataFrame(rows, "section string, exact string, pattern string")


def kept_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Calls of which both ends are kept."""
    ends = [kept.select("corpus_id", F.col("name").alias(e)) for e in ("src", "dst")]
    return edges.join(ends[0], ["corpus_id", "src"], "left_semi").join(ends[1], ["corpus_id", "dst"], "left_semi")


#: Calls of a corpus that one task walks through; larger corpora go by rounds.
IN_ONE_TASK = 1_000_000


def _walk(key: tuple, calls: pa.Table, roots: pa.Table) -> pa.Table:
    after: dict[str, list[str]] = {}
    for src, dst in zip(calls["src"].to_pylist(), calls["dst"].to_pylist(), strict=True):
        after.setdefault(src, []).append(dst)
    open_ = roots["name"].to_pylist()
    seen = set(open_)
    while open_:
        for name in after.get(open_.pop(), ()):
            if name not in seen:
                seen.add(name)
                open_.append(name)
    return pa.table({"corpus_id": pa.array([key[0].as_py()] * len(seen), pa.string()), "name": pa.array(sorted(seen), pa.string())})


def reachable(edges: DataFrame, roots: DataFrame, functions: DataFrame) -> DataFrame:
    """(corpus_id, name) of defined functions that calls lead to from the roots.

    A corpus of up to ``IN_ONE_TASK`` calls between functions is walked through by one task. Larger ones go by rounds, as
    many as the longest way has calls: each joins the functions found last with the calls and writes what is new.
    """
    spark = edges.sparkSession
    schema = "corpus_id string, name string"
    defined = functions.select("corpus_id", "name")
    inside = kept(edges.join(defined.withColumnRenamed("name", "dst"), ["corpus_id", "dst"], "left_semi").select("corpus_id", "src", "dst"))
    roots = kept(roots.join(defined, ["corpus_id", "name"], "left_semi").select("corpus_id", "name").distinct())
    large = kept(inside.groupBy("corpus_id").agg(F.count("*").alias("n")).where(F.col("n") > IN_ONE_TASK).select("corpus_id"))
    calls, first = (x.join(large, "corpus_id", "left_anti") for x in (inside, roots))
    out = calls.groupBy("corpus_id").cogroup(first.groupBy("corpus_id")).applyInArrow(_walk, schema)
    if large.isEmpty():
        return out
    path, step = shared_dir(spark, "reachable"), 0
    frontier = roots.join(large, "corpus_id", "left_semi")
    while True:
        frontier.write.parquet(f"{path}/{step}")
        frontier = spark.read.schema(schema).parquet(f"{path}/{step}")
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        if frontier.isEmpty():
            return out.unionAll(seen)
        next_ = inside.join(frontier.withColumnRenamed("name", "src"), ["corpus_id", "src"]).select("corpus_id", F.col("dst").alias("name"))
        frontier, step = next_.distinct().join(seen, ["corpus_id", "name"], "left_anti"), step + 1


def preorder(order: list[str], calls_of: dict[str, list[str]], root: str | None, depth: int = DEPTH) -> list[str]:
    """All names: each when it is first come to from the root, then from every name not come to yet.

    A name deeper than ``depth`` is left for later. order: names as they are defined; calls_of: callees in order.
    """
    defined, seen, out = set(order), set(), []
    for start in ([root] if root in defined else []) + order:
        stack = [(start, 0)]
        while stack:
            name, level = stack.pop()
            if name in seen or level > depth or name not in defined:
                continue
            seen.add(name)
            out.append(name)
            stack += [(c, level + 1) for c in reversed(calls_of.get(name, []))]
    return out


def flow(functions: DataFrame, edges: DataFrame, entry: DataFrame) -> DataFrame:
    """(corpus_id, seq, name): the execution order. One corpus is one group, since the order is sequential."""
    out = edges.groupBy("corpus_id", "src").agg(F.array_sort(F.collect_list(F.struct("first_pos", "dst"))).alias("c"))
    out = out.select("corpus_id", F.col("src").alias("name"), F.transform("c", lambda x: x["dst"]).alias("callees"))
    nodes = functions.select("corpus_id", "name", "first_ord").join(out, ["corpus_id", "name"], "left")
    first = entry.select("corpus_id", F.col("name").alias("root"))
    nodes = nodes.join(first, "corpus_id", "left")

    def order(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("first_ord", "name", "callees", "root")]
        rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0]["file_ord"], r[0]["line_no"], r[1]))
        names = preorder([r[1] for r in rows], {r[1]: r[2] or [] for r in rows}, rows[0][3])
        return pa.table({
            "corpus_id": pa.array([table["corpus_id"][0].as_py()] * len(names), pa.string()),
            "seq": pa.array(range(len(names)), pa.int32()), "name": pa.array(names, pa.string()),
        })

    return nodes.groupBy("corpus_id").applyInArrow(order, "corpus_id string, seq int, name string")


def _listed(df: DataFrame, value, order) -> DataFrame:
    """One text for each corpus: values in order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.groupBy("corpus_id").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "\n").alias("text"), F.count("*").alias("n"))


def classification_text(corpora: DataFrame, functions: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, text): names still to be classified, those found first, sorted by their whole names."""
    body = functions.select("corpus_id", "name", (F.trim("body") != "").alias("has"))
    names = kept.join(body, ["corpus_id", "name"], "left").withColumn("found", F.coalesce("has", F.lit(False)))
    shown = clean_name(F.col("name"))
    parts = {}
    for flag in (True, False):
        some = _listed(names.where(F.col("found") == flag), shown, F.col("name"))
        parts[flag] = some.select("corpus_id", F.col("text").alias("t" if flag else "f"))
    out = corpora.select("corpus_id").distinct().join(parts[True], "corpus_id", "left").join(parts[False], "corpus_id", "left")
    head = F.lit(fixed.CLASSIFICATION_HEAD)
    found = F.when(F.col("t").isNotNull(), F.concat(F.lit("=== FOUND FUNCTIONS ===\n"), "t", F.lit("\n\n"))).otherwise("")
    lost = F.when(F.col("f").isNotNull(), F.concat(F.lit("=== MISSING FUNCTIONS ===\n"), "f", F.lit("\n"))).otherwise("")
    none = F.lit(fixed.CLASSIFIED_ALL)
    text = F.when(F.coalesce("t", "f").isNull(), none).otherwise(F.concat(found, lost))
    return out.select("corpus_id", F.concat(head, text).alias("text"))


def code_blocks(order: DataFrame, functions: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, seq, block) of kept functions: what :func:`organized_code` holds of each, for corpora too large for one text."""
    own = functions.join(kept, ["corpus_id", "name"], "left_semi").select("corpus_id", "name", "body").join(order, ["corpus_id", "name"])
    block = F.concat(F.lit("// function name: "), clean_name(F.col("name")), F.lit("\n\n"), "body", F.lit(f"\n\n{'=' * 50}\n"))
    return own.select("corpus_id", "seq", block.alias("block"))


def organized_code(order: DataFrame, functions: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, text): kept functions' bodies in execution order, which is one file of one corpus."""
    text = F.concat(F.lit("=== ORGANIZED CODE ===\ntotal functions included: "), F.col("n").cast("string"), F.lit("\n\n=== FUNCTIONS IN EXECUTION ORDER ===\n\n"), "text", F.lit("\n"))
    return _listed(code_blocks(order, functions, kept), F.col("block"), F.col("seq")).select("corpus_id", text.alias("text"))


def flow_chart(order: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, text): ``src -> dst`` of kept calls in execution order, callees in the order of their calls."""
    own = kept_edges(edges, kept).join(order.withColumnRenamed("name", "src"), ["corpus_id", "src"])
    lines = _listed(own, F.concat("src", F.lit(" -> "), "dst"), F.struct("seq", "first_pos", "dst"))
    return lines.select("corpus_id", F.concat(F.lit("=== FUNCTION CALL GRAPH ===\n"), "text", F.lit("\n")).alias("text"))


def missing_text(corpora: DataFrame, missed: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, text): kept missing functions with their number, without a newline at the end."""
    own = _listed(missed.join(kept, ["corpus_id", "name"], "left_semi"), F.col("name"), F.col("name"))
    out = corpora.select("corpus_id").distinct().join(own, "corpus_id", "left")
    head = F.concat(F.lit("=== MISSING FUNCTIONS ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(") ===\n"))
    return out.select("corpus_id", F.concat(head, F.coalesce("text", F.lit("All functions found!\n"))).alias("text"))


def counts(found: DataFrame, defined: DataFrame, missed: DataFrame, kept: DataFrame) -> DataFrame:
    """(corpus_id, in_entry, functions, kept_found, kept_missing, unclassified), all long: functions of the entry file and of
    all files, kept ones that are defined and that are missing, and both together."""
    entry = found.where(F.col("file_ord").startswith("0")).groupBy("corpus_id").agg(F.countDistinct("name").alias("in_entry"))
    total = defined.groupBy("corpus_id").agg(F.count("*").alias("functions"))
    own = kept.join(defined.select("corpus_id", "name"), ["corpus_id", "name"], "left_semi").groupBy("corpus_id").agg(F.count("*").alias("kept_found"))
    lost = kept.join(missed, ["corpus_id", "name"], "left_semi").groupBy("corpus_id").agg(F.count("*").alias("kept_missing"))
    out = total
    for more in (entry, own, lost):
        out = out.join(more, "corpus_id", "left")
    none = F.lit(0).cast("long")
    in_entry, found_, missing_ = (F.coalesce(c, none).alias(c) for c in ("in_entry", "kept_found", "kept_missing"))
    return out.select("corpus_id", in_entry, "functions", found_, missing_, (found_ + missing_).alias("unclassified"))
