"""Files and tables as corpora: ``corpus_id, path, file_ord, content``, line ends as text mode reads them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.fixed import DENYLIST_FILE, LIBRARY_FILE, LIBRARY_TEMPLATE
from spoor.functions.joins import looked_up
from spoor.functions.text import newlines
from spoor.sources.shared import kept, read_text, write_text

ENTRY = "0"
#: Suffixes of files that Spark's reader of texts unpacks.
_PACKED = ("bz2", "deflate", "gz", "lz4", "passthrough", "snappy", "zst")


def _decoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "content"])


def read_files(spark: SparkSession, directory: str, *, glob: str | None = None, recursive: bool = False, errors: bool = False) -> DataFrame:
    """(path, content) of regular files; bytes that are not UTF-8 are dropped. A file is read whole.

    A file that cannot be read is left out. errors: it has a row with a null content and an ``error`` instead; for that
    files are read a second time, to see which of those listed come up.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(directory)
    files = listed.select("path", "content").mapInArrow(_decoded, "path string, content string")
    files = files.withColumn("content", newlines(F.col("content")))
    if not errors:
        return files
    names = [(unquote(p),) for p in listed.inputFiles()]
    read = listed.where(F.octet_length("content") >= 0).select(_plain(F.col("path")).alias("own"))
    lost = spark.createDataFrame(names, "path string").join(read, _plain(F.col("path")) == F.col("own"), "left_anti")
    return files.withColumn("error", F.lit(None).cast("string")).unionByName(
        lost.select("path", F.lit(None).cast("string").alias("content"), F.lit("the file cannot be read").alias("error"))
    )


def _plain(path: Column) -> Column:
    """A local path without its scheme, which listings write in several ways."""
    return F.regexp_replace(path, "^file:/*", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ordered(files: DataFrame, corpus_id: Column | None = None) -> DataFrame:
    """A corpus in the defined order: the entry file first, then paths by their bytes.

    file_ord is the text that files sort by, 0 or 1 and the path, so that no file has to be numbered: a projection.
    """
    first = F.when(file_name(F.col("path")) == ENTRY, "0").otherwise("1")
    return files.select(
        (F.lit("0") if corpus_id is None else corpus_id).alias("corpus_id"), "path", F.concat(first, "path").alias("file_ord"), "content"
    )


def pseudo_c_directory(spark: SparkSession, directory: str) -> DataFrame:
    """The corpus of a directory; its entry file must be there."""
    corpus = ordered(read_files(spark, directory))
    if corpus.where(file_name(F.col("path")) == ENTRY).isEmpty():
        raise FileNotFoundError(f"{directory}/{ENTRY}")
    return corpus


def listings(spark: SparkSession, path: str, *, recursive: bool = False, single: bool = False, errors: bool = True) -> DataFrame:
    """Disassembly listings: one file with the suffix in any case, or a directory's ``*.asm``. See :func:`read_files` for ``errors``."""
    if single:
        if not path.lower().endswith(".asm"):
            raise ValueError(f"{path} is not a .asm file")
        return read_files(spark, path, errors=errors)
    return read_files(spark, path, glob="*.asm", recursive=recursive, errors=errors)


def samples(spark: SparkSession, directory: str, *, recursive: bool = False) -> DataFrame:
    """(path, length) of the regular files of a directory; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory).select("path", "length")


def lines(corpus: DataFrame) -> DataFrame:
    """(corpus_id, path, file_ord, line_no, line), from line 0."""
    return corpus.select("corpus_id", "path", "file_ord", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))


def denylist(text: str | None = DENYLIST_FILE) -> list[str]:
    """Terms of a list file: trimmed and lower-cased, without blank lines and lines beginning with # or ===.

    No file (None) means that nothing is denied.
    """
    rows = (text or "").split("\n")
    return sorted({r.strip().lower() for r in rows if r.strip() and not r.startswith(("#", "==="))})


def library(text: str = LIBRARY_FILE, *, compat: bool = True) -> list[tuple[str, str]]:
    """(section, wildcard) of a library file.

    compat: a heading of the second section holds the word of the first, and so opens the first again. What is
    left out by either section is the same.
    """
    out, section = [], None
    for row in (r.strip() for r in text.split("\n")):
        if not row or row.startswith("#"):
            continue
        if "===" in row and "FUNCTIONS" in row.upper():
            section = "NON-FUNCTIONS" if "NON-FUNCTIONS" in row.upper() and not compat else "FUNCTIONS"
        elif section:
            out.append((section, row))
    return list(dict.fromkeys(out))


def library_file(path: str) -> list[tuple[str, str]]:
    """The library of a file, which is made from the template where it is absent."""
    text = read_text(path)
    if text is None:
        write_text(path, [LIBRARY_TEMPLATE])
        return []
    return library(text)


def logs(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, content, error) of log files, by name. They are UTF-8 throughout: one that is not has no content but an error."""

    def strict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    rows.append((raw.decode("utf-8"), None))
                except UnicodeDecodeError as wrong:
                    rows.append((None, str(wrong)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))], ["path", "content", "error"]
            )

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    found = found.mapInArrow(strict, "path string, content string, error string")
    return found.select(file_name(F.col("path")).alias("log_id"), newlines(F.col("content")).alias("content"), "error")


def logs_by_line(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(log_id, error) of log files, by name, and (log_id, pos, line) of those without an error: as :func:`logs`, but no log
    is held as a whole. ``pos`` grows along a log: the place of the ``block`` that a line was read in, and a number ``n``.

    Blocks may differ from one reading to the next, so lines are read once and kept. A byte order mark is not part of the
    first line. Of files of one name any one stays. Files that Spark would unpack, by their suffix, are read whole, as they
    stand.
    """
    own, text = F.col("_metadata.file_path").alias("own"), F.col("content").cast("string")
    read = spark.read.text(path).where(~F.col("_metadata.file_name").rlike(rf"\.({'|'.join(_PACKED)})$")).select(
        own, F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"),
        F.col("value").alias("line"), F.is_valid_utf8("value").alias("valid"),
    )
    files = spark.read.format("binaryFile").load(path).select(own, "path")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(_PACKED)}}}").load(path)
    packed = packed.select(own, F.is_valid_utf8(text).alias("valid"), F.posexplode(F.split(newlines(text), "\n", -1)).alias("n", "line"))
    pos = F.struct(F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("n"))
    lines = kept(read.unionAll(packed.select("own", pos, "line", "valid")), "lines")
    wrong = lines.where("NOT valid").select("own").distinct().withColumn("wrong", F.lit(True))
    files = files.select("own", file_name(F.col("path")).alias("log_id")).join(wrong, "own", "left")
    found = kept(files.groupBy("log_id").agg(F.min(F.when(F.col("wrong").isNull(), F.col("own"))).alias("own")), "files")
    error = F.when(F.col("own").isNull(), "the file is not UTF-8")
    return found.select("log_id", error.alias("error")), looked_up(lines, found.where("own IS NOT NULL"), "own").select("log_id", "pos", "line")


def log_lines(whole: DataFrame) -> DataFrame:
    """(log_id, pos, line) of whole logs ``log_id, content``."""
    return whole.select("log_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("log_id", F.col("pos").cast("long"), "line")


def ledger_ids(texts: DataFrame, text: str = "value") -> DataFrame:
    """(link_id) of ledgers that are kept as JSON arrays, a text each; what is no array holds none."""
    ids = F.from_json(F.col(f"`{text}`"), "array<string>")
    return texts.select(F.explode(ids).alias("link_id")).where("link_id IS NOT NULL").distinct()


def ledger(spark: SparkSession, text: str | None) -> DataFrame:
    """(link_id) of a JSON array; anything else is an empty ledger."""
    try:
        ids = json.loads(text or "[]")
        ids = sorted({str(i) for i in ids}) if isinstance(ids, list) else []
    except ValueError:
        ids = []
    return spark.createDataFrame([(i,) for i in ids], "link_id string")
