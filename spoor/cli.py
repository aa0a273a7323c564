"""Command line: ``analyze``, ``sniff``, ``logs``, ``watch`` and ``links``; see ``--help``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import chain

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.operators import callgraph, footprint, irlog, report
from spoor.operators import links as link_operators
from spoor.operators.functions import definitions, entry_point, functions
from spoor.sources.corpus import denylist, ledger, library_file, listings, logs_by_line, pseudo_c_directory, read_files
from spoor.sources.shared import delete_file, file_system, kept, read_text, write_lines, write_text
from spoor.streaming.ledger import monitor

ANALYSIS = ("organized_code.txt", "flow_chart.txt", "missing_functions.txt", "all_functions.txt")


def _joined(parts: Iterable[str], between: str) -> Iterator[str]:
    for i, part in enumerate(parts):
        yield (between if i else "") + part


class Texts(Mapping):
    """The texts of files by name, read when they are asked for."""

    def __init__(self, folder: str, names: Sequence[str]):
        self.folder, self.names = folder, names

    def __getitem__(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(name)
        return read_text(f"{self.folder}/{name}") or ""

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def analyze(
    spark: SparkSession, directory: str, *, library: str = "library.txt", out: str = ".", tell: Callable[[str], None] = lambda _: None
) -> Texts:
    """The four files of the analyzer, written to ``out``; none if no function is found. Files of an earlier run go first.

    Bodies go to their file one by one.
    """
    for name in ANALYSIS:
        delete_file(f"{out}/{name}")
    corpus = pseudo_c_directory(spark, directory)
    found = kept(definitions(corpus), "definitions")
    defined = kept(functions(found), "functions")
    if defined.isEmpty():
        return Texts(out, ())
    edges = kept(callgraph.calls(defined), "calls")
    missed = kept(callgraph.missing(edges, defined), "missing")
    own = kept(callgraph.kept_names(defined, missed, [p for _, p in library_file(library)]), "names")
    order = kept(callgraph.flow(defined, edges, entry_point(found)), "flow")
    first = entry_point(found).first()
    n = callgraph.counts(found, defined, missed, own).first()
    tell(f"processed file '0': found {n.in_entry} functions")
    tell(f"entry point function: {first.name if first else None}")
    tell(f"total functions found across all files: {n.functions}")
    if n.unclassified:
        tell(f"new functions to classify: {n.unclassified}")
    blocks = callgraph.code_blocks(order, defined, own).orderBy("seq").select("block")
    head = f"=== ORGANIZED CODE ===\ntotal functions included: {n.kept_found}\n\n=== FUNCTIONS IN EXECUTION ORDER ===\n\n"
    write_text(f"{out}/organized_code.txt", chain([head], (r.block + "\n" for r in blocks.toLocalIterator())))
    one = corpus.select("corpus_id").limit(1)
    frames = {
        "flow_chart.txt": callgraph.flow_chart(order, edges, own), "missing_functions.txt": callgraph.missing_text(one, missed, own),
        "all_functions.txt": callgraph.classification_text(one, defined, own),
    }
    for name, frame in frames.items():
        row = frame.first()
        write_text(f"{out}/{name}", [row["text"] if row else "=== FUNCTION CALL GRAPH ===\n"])
    return Texts(out, ANALYSIS)


def scanned(spark: SparkSession, path: str, *, recursive: bool = False, deny: str | None = "denylist.txt") -> tuple[DataFrame, int]:
    """The scanned listings of a file or a directory, and how many files there are."""
    terms = read_text(deny) if deny else None
    system, place = file_system(path)
    single = system.get_file_info(place).type == FileType.File
    corpus = listings(spark, path, recursive=recursive, single=single)
    corpus = corpus.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return kept(footprint.scan(corpus, deny=denylist(terms)), "scan"), corpus.select("path").count()


def sniff(spark: SparkSession, path: str, *, recursive: bool = False, form: str = "text", deny: str | None = "denylist.txt") -> str | None:
    """The report on a listing or a directory of them; None if nothing is found."""
    rows, _ = scanned(spark, path, recursive=recursive, deny=deny)
    if rows.isEmpty():
        return None
    return report.json_report(rows) if form == "json" else report.text_report(rows)


def extract(spark: SparkSession, path: str, out: str, *, began: str, ended: str) -> list[str]:
    """The code and the summary of each decompiler log, as files below ``out``; their names."""
    whole, lines = logs_by_line(spark, path)
    return write_lines(irlog.log_files(whole.where("error IS NULL"), lines, F.to_timestamp(F.lit(began)), F.to_timestamp(F.lit(ended))), out)


def fresh_links(spark: SparkSession, directory: str, site: str, known: str | None) -> DataFrame:
    """Download links of the pages of a directory, stored from ``site``, that the ledger file does not hold."""
    pages = read_files(spark, directory, recursive=True).select(F.col("path").alias("page_id"), F.col("content").alias("html"), F.lit(site).alias("url"))
    return link_operators.unseen(link_operators.links(pages, url="url"), ledger(spark, read_text(known) if known else None))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spoor")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze", help="functions and call graph of a directory of pseudo-C")
    one.add_argument("directory")
    one.add_argument("--library", default="library.txt")
    one.add_argument("--out", default=".")
    two = commands.add_parser("sniff", help="indicators in disassembly listings")
    two.add_argument("path")
    two.add_argument("-r", "--recursive", action="store_true")
    two.add_argument("-o", "--output")
    two.add_argument("--denylist", default="denylist.txt")
    two.add_argument("-f", "--format", choices=["json", "text"], default="text")
    three = commands.add_parser("logs", help="code and summary of decompiler logs")
    three.add_argument("path")
    three.add_argument("--out", default=".")
    three.add_argument("--began", required=True, help="when the run began, as YYYY-MM-DD HH:MM:SS")
    three.add_argument("--ended", required=True)
    four = commands.add_parser("watch", help="progress of logs that grow, until a file is there")
    four.add_argument("path")
    four.add_argument("--until", required=True)
    five = commands.add_parser("links", help="download links of stored pages that a ledger does not hold")
    five.add_argument("directory")
    five.add_argument("--site", default="")
    five.add_argument("--ledger")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("spoor").getOrCreate()
    if given.command == "analyze":
        try:
            analyze(spark, given.directory, library=given.library, out=given.out, tell=print)
        except FileNotFoundError:
            print("there is no file called 0", file=sys.stderr)
            return 1
        return 0
    if given.command == "logs":
        print("\n".join(sorted(extract(spark, given.path, os.path.abspath(given.out), began=given.began, ended=given.ended))))
        return 0
    if given.command == "watch":
        monitor(spark, given.path, lambda: os.path.exists(given.until))
        return 0
    if given.command == "links":
        for r in fresh_links(spark, given.directory, given.site, given.ledger).orderBy("page_id", "ord").toLocalIterator():
            print(r["link_id"], r["href"], r["text"])
        return 0
    system, place = file_system(given.path)
    if system.get_file_info(place).type == FileType.NotFound:
        print(f"path '{given.path}' does not exist", file=sys.stderr)
        return 1
    rows, files = scanned(spark, given.path, recursive=given.recursive, deny=given.denylist)
    for text in report.progress(files):
        print(text, file=sys.stderr)
    if rows.isEmpty():
        print(fixed.NOTHING_FOUND)
        return 0
    parts, between = (report.json_lines(rows), "") if given.format == "json" else (report.text_lines(rows), "\n")
    if given.output:
        write_text(given.output, _joined(parts, between))
    else:
        for part in _joined(parts, between):
            sys.stdout.write(part)
        sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
