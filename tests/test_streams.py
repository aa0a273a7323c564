"""Ledgers under new checkpoints and failures, growing logs, files that cannot be read, and commands."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from spoor import cli
from spoor.functions.joins import looked_up, without
from spoor.functions.text import ctime, one_decimal
from spoor.operators import callgraph, footprint, irlog, report
from spoor.operators import functions as fn
from spoor.plans import queries
from spoor.sources import corpus as sources
from spoor.sources.shared import digests, kept, remove_all, write_files, write_lines
from spoor.streaming import ledger


def stream(spark, folder, rows):
    spark.createDataFrame([(x,) for x in rows], "link_id string").write.mode("append").parquet(folder)
    return spark.readStream.schema("link_id string").parquet(folder)


def test_a_new_checkpoint_adds_to_the_ledger(spark, tmp_path):
    asked = []

    def fetch(df):
        asked.append(sorted(r.link_id for r in df.collect()))
        return df.withColumn("status", F.when(F.col("link_id") == "bad", "failed").otherwise("ok"))

    for i, rows in enumerate((["a", "b", "a", "bad"], ["b", "c", "bad"])):
        found = stream(spark, f"{tmp_path}/in{i}", rows)
        ledger.keep_ledger(found, f"{tmp_path}/table", f"{tmp_path}/state{i}", fetch).awaitTermination()
    assert sorted(r.link_id for r in ledger.read_ledger(spark, f"{tmp_path}/table").collect()) == ["a", "b", "c"]
    assert asked == [["a", "b", "bad"], ["bad", "c"]]


def test_a_stream_that_fails_is_started_again(spark, tmp_path):
    found, told, tries = stream(spark, f"{tmp_path}/in", ["a"]), [], []

    def fetch(df):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return df.withColumn("status", F.lit("ok"))

    def start():
        return ledger.keep_ledger(found, f"{tmp_path}/table", f"{tmp_path}/state", fetch)

    assert ledger.keep_on(start, wait=0, tell=told.append) == 2 and len(told) == 2
    assert ledger.read_ledger(spark, f"{tmp_path}/table").count() == 1
    tries.clear()
    found = stream(spark, f"{tmp_path}/in", ["b"])
    with pytest.raises(Exception, match="down"):
        ledger.keep_on(start, wait=0, most=1, tell=told.append)


def test_a_continuous_stream_takes_what_comes_later(spark, tmp_path):
    found = stream(spark, f"{tmp_path}/in", ["a"])
    query = ledger.keep_ledger(found, f"{tmp_path}/table", f"{tmp_path}/state", lambda df: df.withColumn("status", F.lit("ok")), continuous="1 seconds")
    try:
        query.processAllAvailable()
        stream(spark, f"{tmp_path}/in", ["a", "b"])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.link_id for r in ledger.read_ledger(spark, f"{tmp_path}/table").collect()) == ["a", "b"]


def test_growing_logs_are_told_when_they_have_grown(spark, tmp_path):
    log, told, polls = tmp_path / "a.log", [], []
    log.write_text("--- ir for x\n")

    def done():
        polls.append(1)
        if len(polls) == 3:
            log.write_text("--- IR FOR x\n" * 100)
        return len(polls) > 4

    assert ledger.monitor(spark, str(tmp_path), done, every=0, tell=told.append) == {"a.log": (1300, 100)}
    assert told == ["a.log: 1 functions processed, 0.01 KB written", "a.log: 100 functions processed, 1.27 KB written"]


def test_files_that_cannot_be_read_have_an_error(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.asm").write_text("call main.f1\n")
    found = sources.listings(spark, str(tmp_path))
    plain = sources.read_files(spark, str(tmp_path))
    (tmp_path / "b.asm").unlink()
    rows = {r.path.split("/")[-1]: r.error for r in found.collect()}
    assert rows == {"a.asm": None, "b.asm": "the file cannot be read"}
    scan = footprint.scan(found.withColumn("path", F.element_at(F.split("path", "/"), -1)))
    assert report.summary(scan).first().with_errors == 1
    assert json.loads(report.json_report(scan))[1] == {"file": "b.asm", "error": "the file cannot be read"}
    assert plain.count() == 1


def test_rows_of_one_path_are_listings_of_their_own(spark):
    corpus = spark.createDataFrame([("a.asm", "main.f1\n")] * 3 + [("b.asm", None)], "path string, content string")
    assert footprint.scan(corpus).count() == 3 and footprint.indicators(corpus).count() == 1


def test_logs_have_to_be_utf8(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"--- IR FOR f (0x00000001) ---\r\n--- END f ---")
    (tmp_path / "b").write_bytes(b"\xff")
    rows = {r.log_id: (r.content, r.error is None) for r in sources.logs(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("--- IR FOR f (0x00000001) ---\n--- END f ---", True), "b": (None, False)}
    out = tmp_path / "out"
    names = cli.extract(spark, str(tmp_path / "a"), str(out), began="2026-01-01 00:00:00", ended="2026-01-01 00:00:03")
    assert sorted(names) == ["a/ir.txt", "a/ir_summary.txt"] and (out / "a" / "ir.txt").read_text().endswith("--- END")
    assert "3.0 seconds (0.1 minutes)" in (out / "a" / "ir_summary.txt").read_text()


@pytest.fixture
def in_blocks(spark):
    """Files of over 2,000 bytes cannot be read as one value, and texts come in blocks of 1,000."""
    limits = {"spark.sql.sources.binaryFile.maxLength": "2000", "spark.sql.files.maxPartitionBytes": "1000"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_no_log_is_held_as_a_whole(spark, tmp_path, in_blocks):
    text = "banner\n" + "".join(f"--- IR FOR f{k} (0x{k:08X}) ---\n{k}\n--- END f{k} ---\n\n" for k in range(200)) + "FAILED f9 (0x00000009): no\ntail\n"
    (tmp_path / "a").write_text(text)
    out = tmp_path / "out"
    names = cli.extract(spark, str(tmp_path / "a"), str(out), began="2026-01-01 00:00:00", ended="2026-01-01 00:00:03")
    assert sorted(names) == ["a/ir.txt", "a/ir_summary.txt"]
    assert (out / "a" / "ir.txt").read_text() == text[len("banner\n") : text.rindex("--- END") + len("--- END")]
    assert "Processed: 200\n    Successful: 200\n" in (out / "a" / "ir_summary.txt").read_text()
    assert sorted(os.listdir(out)) == ["a"] and sorted(os.listdir(out / "a")) == ["ir.txt", "ir_summary.txt"]


def test_the_query_holds_no_log_as_a_whole(spark, in_blocks):
    assert queries.QUERIES["log_files"](spark, "/root/testdata/sf0.001").count() == 11


def test_logs_by_line_are_those_of_whole_logs(spark, tmp_path):
    start, end = "--- IR FOR f (0x00000001) ---", "--- END f ---"
    texts = {
        "plain": f"x\n{start}\n\n\ny\n{end}\n\n", "crlf": f"{start}\r\na\rb\r\n{end}\r\n", "one line": f"ab {start} c {end} d {end} e",
        "turned%2F": f"{end} {start}", "turned lines": f"{end}\n{start}", "no+end": f"{start}\nx", "no start": end, "within": f"{end} {start}\n{end} x {start}\n",
        "packed.gz": f"é{start}\n\n{end}é", "blank": "\n\n", "é": f"é\u2028{start}é\n{end}",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "wrong").write_bytes(f"{start}\n{end}\n".encode() + b"\xe9\n" + end.encode())
    (tmp_path / "wrong.gz").write_bytes(b"\x1f\x8b\xff")
    whole = sources.logs(spark, str(tmp_path))
    logs, lines = sources.logs_by_line(spark, str(tmp_path))
    assert sorted((r.log_id, r.error is None) for r in logs.collect()) == sorted((r.log_id, r.error is None) for r in whole.collect())
    at = F.lit("2026-01-01").cast("timestamp")
    write_lines(irlog.log_files(logs.where("error IS NULL"), lines, at, at), str(tmp_path / "out"))
    whole = whole.where("error IS NULL")
    expected = {f"{r.log_id}/ir.txt": r.text for r in irlog.isolate(whole).where("ok").collect()}
    counted = whole.select("log_id", at.alias("began"), at.alias("ended")).join(irlog.summary(irlog.events(sources.log_lines(whole))), "log_id", "left")
    texts = irlog.summary_texts(counted.fillna(0, ["processed", "successful", "failed"])).collect()
    expected |= {f"{r.log_id}/ir_summary.txt": r.text for r in texts}
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*.txt")} == expected
    assert len(expected) == 17


def test_of_logs_of_one_name_one_stays(spark, tmp_path):
    for folder, text in (("a", b"--- IR FOR a\n--- END a"), ("b", b"--- IR FOR b\n1\n2\n--- END b"), ("c", b"\xff")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "log").write_bytes(text)
    logs, lines = sources.logs_by_line(spark, f"{tmp_path}/*/log")
    assert [tuple(r) for r in logs.collect()] == [("log", None)]
    assert [r.line for r in irlog.isolated_lines(lines).orderBy("pos").collect()] == ["--- IR FOR a", "--- END"]


def test_files_by_line(spark, tmp_path):
    rows = [("a", (b, n), None if b == n == 1 else f"{b} {n}") for b in range(3) for n in range(3)] + [("b/c", None, "x\ny"), ("e", (0, 0), "")]
    lines = spark.createDataFrame(rows, "name string, pos struct<block: long, n: long>, line string")
    (tmp_path / "a").write_text("old")
    assert sorted(write_lines(lines.orderBy(F.desc("pos")), str(tmp_path))) == ["a", "b/c", "e"]
    assert (tmp_path / "a").read_text().split("\n") == ["0 0", "0 1", "0 2", "1 0", "", "1 2", "2 0", "2 1", "2 2"]
    assert (tmp_path / "b" / "c").read_text() == "x\ny" and (tmp_path / "e").read_text() == ""
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "e"] and write_lines(lines.where("false"), str(tmp_path)) == []
    names = spark.createDataFrame([("a",), ("b/c",)], "name string")
    assert {r.name: r.digest for r in digests(names, str(tmp_path)).collect()}["b/c"] == hashlib.md5(b"x\ny").hexdigest()


def test_rows_are_looked_up_in_parts(spark):
    rows = spark.createDataFrame([(f"n{i}", i) for i in range(40)], "name string, i long")
    listed = spark.createDataFrame([(f"n{i}", -i) for i in range(4, 50)], "name string, j long")
    assert [sorted(r.i + r.j for r in looked_up(rows, listed, "name", size).collect()) for size in (1 << 20, 100)] == [[0] * 36] * 2


def test_one_decimal_is_that_of_c(spark):
    values = [94.25, 94.75, 0.05, 0.15, 0.25, 0.35, 0.45, 33.35, 66.65, 12.34, 99.95, 100.0, 0.0, 2.25, 178.5] + [100 * k / 400 for k in range(401)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("x")).collect()
    assert [f"{r.x:.1f}" for r in rows] == [f"{r.v:.1f}" for r in rows]
    shown = spark.sql("SELECT TIMESTAMP '2026-01-05 03:04:05' AS t").select(ctime(F.col("t"))).first()[0]
    assert shown == "Mon Jan  5 03:04:05 2026"


def test_lists_are_taken_in_parts(spark):
    rows = spark.createDataFrame([(f"n{i}x",) for i in range(40)], "name string")
    listed = spark.createDataFrame([(f"n{i}",) for i in range(4, 40)], "term string")
    left = [sorted(r.name for r in without(rows, listed, "term", F.expr("startswith(name, term)"), size).collect()) for size in (1 << 20, 100)]
    assert left == [["n0x", "n1x", "n2x", "n3x"]] * 2
    assert without(rows, listed.where("false"), "term", F.expr("startswith(name, term)")).count() == 40


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_what_is_reachable_is_the_same_by_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(callgraph, "IN_ONE_TASK", limit)
    edges = spark.createDataFrame([("c", a, b) for a, b in ("ab", "bc", "ca", "de", "cx")] + [("d", "a", "b")], "corpus_id string, src string, dst string")
    functions = spark.createDataFrame([("c", x) for x in "abcde"] + [("d", "a")], "corpus_id string, name string")
    roots = spark.createDataFrame([("c", "a"), ("d", "z")], "corpus_id string, name string")
    assert sorted(tuple(r) for r in callgraph.reachable(edges, roots, functions).collect()) == [("c", "a"), ("c", "b"), ("c", "c")]


def test_bodies_of_many_functions_in_one_file():
    file = fn._File("int f1(int a)\n{\n" + "{\n}\n" * 3 + "}\n}\nint f2(int a)\n{\n")
    assert (file.end(0), file.end(2), file.end(9), file.end(10)) == (8, 3, 12, 12)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "a.asm").write_text("call main.f1\n")
    assert cli.main(["sniff", str(tmp_path)]) == 0 and "Main Functions/Variables: 1" in capsys.readouterr().out
    assert cli.main(["sniff", str(tmp_path), "-f", "json", "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text())[0]["iocs"] == {"main_patterns": ["main.f1"]}
    assert cli.main(["sniff", str(tmp_path / "none")]) == 1 and cli.main(["analyze", str(tmp_path)]) == 1
    (tmp_path / "a.asm").write_text("nothing\n")
    assert cli.main(["sniff", str(tmp_path / "a.asm")]) == 0 and "no IoCs" in capsys.readouterr().out
    assert report.progress(60) == ["Progress: 25/60 files processed", "Progress: 50/60 files processed"]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p.html").write_text('<a href="x?a=1&amp;b=2">Download</a>')
    assert cli.main(["links", str(pages), "--site", "https://h.example/d/"]) == 0
    assert "https://h.example/d/x?a=1&b=2 Download" in capsys.readouterr().out


def test_written_files_replace_older_ones(spark, tmp_path):
    rows = spark.createDataFrame([("a", "new"), ("b/c", None)], "name string, content string")
    (tmp_path / "a").write_text("old")
    assert sorted(write_files(rows, str(tmp_path))) == ["a", "b/c"]
    assert (tmp_path / "a").read_text() == "new" and os.listdir(tmp_path / "b") == ["c"]
    frame = kept(rows)
    assert frame.count() == 2
    remove_all(spark)
    with pytest.raises(Exception, match="(?i)not.exist|does not exist"):
        spark.read.parquet(frame.inputFiles()[0].rsplit("/", 1)[0])
