from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spoor.functions.text import wildcard
from spoor.operators import footprint, report
from spoor.sources.corpus import denylist, library, read_files


def scan(spark, content, **options):
    corpus = spark.createDataFrame([("a.asm", content)], "path string, content string")
    return {(r.category, r.value) for r in footprint.indicators(corpus, **options).collect()}


@pytest.mark.parametrize(
    ("content", "found"),
    [
        ("call main.f1\nx", {("main_patterns", "main.f1")}),
        ("HTTP://EVIL.EXAMPLE/AAAAAA", set()),
        ("socks://h.example/aaaaaaaa", set()),
        ("eq.io", {("domains", "eq.io")}),
        ("x.com", {("domains", "x.com"), ("files", "x.com")}),
        ("user@openssh.com", set()),
        ('"C:\\work\\a\\b.bin"', {("operational_files", "C:\\work\\a\\b.bin")}),
        ('"C:\\data\\a\\b.bin"', set()),
        ("HKEY_X\\Software", set()),
        ("HKEY_X\\CLSID", {("operational_files", "HKEY_X\\CL")}),
        ("", set()),
    ],
)
def test_indicators(spark, content, found):
    assert scan(spark, content) == found


def test_without_compat_the_evident_intent_holds(spark):
    assert ("operational_files", "C:\\data\\a\\b.bin") in scan(spark, '"C:\\data\\a\\b.bin"', compat=False)
    assert ("operational_files", "HKEY_X\\Software") in scan(spark, "HKEY_X\\Software", compat=False)


def test_openssh_needs_another_denylist(spark):
    assert ("openssh_full", "u@openssh.com") in scan(spark, "u@openssh.com", deny=[])


def test_report(spark):
    rows = [("a.asm", f"; Input MD5 : {'A' * 32}\nmain.main\neq.io", None), ("b.asm", "nothing", None), ("c.asm", None, "gone")]
    corpus = spark.createDataFrame(rows, "path string, content string, error string")
    text = report.text_report(footprint.scan(corpus), datetime(2020, 1, 2))
    assert text.split("\n")[5:13] == ["-" * 40, "Total Files Processed: 2", "Files with IoCs: 1", "Files with Hashes: 1", "Files with Errors: 1", "", "IoC CATEGORIES", "-" * 40]
    assert "File: a.asm\n" + "-" * 60 + "\nFile Hashes:\nMD5: " + "a" * 32 + "\n\nDomains:\neq.io\n\nMain Functions/Variables:\nmain.main\n\n" in text
    assert text.endswith("ERROR - c.asm\n  Error: gone\n")


def test_files_are_read_as_text(spark, tmp_path):
    (tmp_path / "a.asm").write_bytes(b"x\r\ny\rz\xff!")
    assert read_files(spark, str(tmp_path), glob="*.asm").first()["content"] == "x\ny\nz!"


def test_lists():
    assert denylist("=== H ===\n# c\n A.com \n\n") == ["a.com"]
    assert denylist(None) == []
    text = "=== FUNCTIONS ===\na\n=== NON-FUNCTIONS ===\nb\n"
    assert {s for s, _ in library(text)} == {"FUNCTIONS"}
    assert {s for s, _ in library(text, compat=False)} == {"FUNCTIONS", "NON-FUNCTIONS"}


def test_wildcards(spark):
    names = spark.createDataFrame([("abc",), ("a.c",), ("xBYTE",)], "n string")
    found = lambda p: {r.n for r in names.where(F.col("n").rlike(wildcard(p))).collect()}
    assert found("a*") == {"abc", "a.c"}
    assert found("a.c") == {"a.c"}
    assert found("*BYTE") == {"xBYTE"}
    assert found("a[!b]c") == {"a.c"}
