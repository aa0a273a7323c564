"""Reports on scanned listings: counts as frames, and the text and JSON that users read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.fixed import CATEGORIES, HASHES, PROGRESS, PROGRESS_EVERY


def summary(scanned: DataFrame) -> DataFrame:
    """One row: listings with any result, with indicators, with hashes, with errors."""
    return scanned.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("iocs").isNotNull()).alias("with_iocs"),
        F.count_if(F.coalesce("sha256", "md5", "crc32").isNotNull()).alias("with_hashes"),
        F.count_if(F.col("error").isNotNull()).alias("with_errors"),
    )


def categories(iocs: DataFrame) -> DataFrame:
    """(ord, label, n): values of each category, counted once for each listing."""
    keys = F.create_map(*chain.from_iterable((F.lit(k), F.struct(F.lit(i).alias("ord"), F.lit(v).alias("label"))) for i, (k, v) in enumerate(CATEGORIES.items(), 1)))
    counted = iocs.groupBy("category").agg(F.count("*").alias("n"))
    return counted.select(keys[F.col("category")]["ord"].alias("ord"), keys[F.col("category")]["label"].alias("label"), "n")


def blocks(scanned: DataFrame) -> DataFrame:
    """(path, block): the detail block of each listing, as it stands in the text report."""
    nl = F.lit("\n")
    hashes = F.concat_ws("\n", *[F.concat(F.lit(f"{k.upper()}: "), F.col(k)) for k in HASHES])
    any_hash = F.coalesce(*HASHES).isNotNull()
    parts = [
        F.when(F.col("iocs")[k].isNotNull(), F.concat(F.lit(f"{label}:\n"), F.array_join(F.col("iocs")[k], "\n"), nl))
        for k, label in CATEGORIES.items()
    ]
    detail = F.concat_ws(
        "\n", F.concat(F.lit("File: "), F.col("path")), F.lit("-" * 60),
        F.when(any_hash, F.concat(F.lit("File Hashes:\n"), hashes, nl)), *parts, F.lit(""),
    )
    failed = F.concat(F.lit("ERROR - "), F.col("path"), F.lit("\n  Error: "), F.col("error"), nl)
    return scanned.select("path", F.when(F.col("error").isNotNull(), failed).otherwise(detail).alias("block"))


def text_report(scanned: DataFrame, at: datetime | None = None) -> str:
    """The whole report as one text; see :func:`text_lines`."""
    return "\n".join(text_lines(scanned, at))


def text_lines(scanned: DataFrame, at: datetime | None = None) -> Iterator[str]:
    """The pieces of the report, a line or a listing's block each; blocks go through the driver one after the other."""
    counts = summary(scanned).first()
    iocs = scanned.where("iocs IS NOT NULL").select("path", F.explode("iocs").alias("category", "values"))
    by = categories(iocs.select("path", "category", F.explode("values").alias("value"))).orderBy("ord").collect()
    rule = "=" * 80
    yield from (
        rule, f"Sniffer Report - {at or datetime.now():%Y-%m-%d %H:%M:%S}", rule, "", "SUMMARY", "-" * 40,
        f"Total Files Processed: {counts.total_files}", f"Files with IoCs: {counts.with_iocs}",
        f"Files with Hashes: {counts.with_hashes}", f"Files with Errors: {counts.with_errors}", "",
    )
    if by:
        yield from ("IoC CATEGORIES", "-" * 40, *(f"{r.label}: {r.n}" for r in by), "")
    yield from ("DETAILED RESULTS", rule)
    for r in blocks(scanned).orderBy("path").toLocalIterator():
        yield r.block


def json_rows(scanned: DataFrame) -> DataFrame:
    """(path, json): each listing as an object of its file, hashes and indicators in the order of categories, or its error."""
    hashes = F.when(F.coalesce(*HASHES).isNotNull(), F.struct(*HASHES))
    iocs = F.when(F.col("iocs").isNotNull(), F.struct(*[F.col("iocs")[k].alias(k) for k in CATEGORIES]))
    failed = F.to_json(F.struct(F.col("path").alias("file"), "error"))
    whole = F.to_json(F.struct(F.col("path").alias("file"), hashes.alias("file_hashes"), iocs.alias("iocs")))
    return scanned.select("path", F.when(F.col("error").isNotNull(), failed).otherwise(whole).alias("json"))


def json_report(scanned: DataFrame) -> str:
    """A list of listings, each with its file, hashes and indicators, or its error."""
    return "".join(json_lines(scanned))


def json_lines(scanned: DataFrame) -> Iterator[str]:
    """The pieces of the JSON report, one listing after the other, so that none but the present one is held."""
    first = True
    for r in json_rows(scanned).orderBy("path").toLocalIterator():
        text = json.dumps(json.loads(r["json"]), indent=2)
        yield ("[\n" if first else ",\n") + "\n".join(f"  {line}" for line in text.split("\n"))
        first = False
    yield "[]" if first else "\n]"


def progress(total: int, every: int = PROGRESS_EVERY) -> list[str]:
    """What is told as files are processed: a line for every 25th."""
    return [PROGRESS.format(done=done, total=total) for done in range(every, total + 1, every)]


def progress_rows(files: DataFrame, every: int = PROGRESS_EVERY) -> DataFrame:
    """(done, total, text) of what :func:`progress` tells of a corpus."""
    total = files.count()
    parts = PROGRESS.replace("{done}", "%d").replace("{total}", "%d")
    rows = files.sparkSession.range(every, total + 1, every).select(F.col("id").alias("done"), F.lit(total).cast("long").alias("total"))
    return rows.select("*", F.format_string(parts, "done", "total").alias("text"))
