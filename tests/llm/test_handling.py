"""Ids of any type, columns whose names clash, nulls, empty tables, repeated rows and long texts, for operators and stages."""

import gzip
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoor.llm import byte_bpe, decontamination, near_dedup, quality_classifier, quality_rules, substring_dedup, toxicity, warc

ITEM = "one two three four five six seven eight nine ten eleven"
LONG = " ".join(f"w{i % 3000} x{i}" for i in range(20_000))
TEXTS = [None, "", " \n", "one", ITEM, ITEM, LONG, LONG + " more", "again " * 40, "some clean words of a text"]
CLASHING = ("score", "predicted", "n_words", "removed", "n_removed", "__own", "__id", "__h", "h", "id", "row", "own", "hash", "i", "n", "batch", "kept", "th", "hits")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 8 else None, t, *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def same_columns(out, docs):
    """Every row of the result is a row of ``docs`` but for the text."""
    rest = [c for c in docs.columns if c != "text"]
    known = {tuple(r[c] for c in rest) for r in docs.collect()}
    rows = out.collect()
    assert out.columns == docs.columns and all(tuple(r[c] for c in rest) in known for r in rows)
    return rows


def test_columns_keep_their_values_whatever_their_names(docs, items):
    assert len(same_columns(decontamination.remove_leaks(docs, items), docs)) == 8
    rows = same_columns(decontamination.remove_leaks(docs, items, spans=True), docs)
    assert sorted(len(r.text or "") for r in rows if r.doc_id in (4, 5)) == [0, 0, 0]
    kept = same_columns(near_dedup.deduplicate(docs), docs)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 9]


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_ids_of_any_type(spark, kind):
    texts = ["good calm words here"] * 3 + ["blargle zorkish words here"] * 3
    rows = spark.createDataFrame([(i, f"{t} {i}", int(i > 2)) for i, t in enumerate(texts * 9)], "doc_id long, text string, y int")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(kind) if kind != "string" else F.concat(F.lit("d"), "doc_id"))
    labels = rows.select("doc_id", F.col("y").alias("toxic"), F.col("y").alias("quality"))
    for module in (toxicity, quality_classifier):
        out = module.score(rows, module.train(rows, labels))
        assert out.count() == 54 and out.schema["doc_id"].dataType.typeName() == {"int": "integer"}.get(kind, kind)
    assert near_dedup.near_duplicates(rows).schema["doc_id"].dataType == rows.schema["doc_id"].dataType
    assert decontamination.find_leaks(rows, rows, item="doc_id").count() == 54


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    labels = [(i, int(i in (4, 6)), 1) for i in range(len(TEXTS))]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "seven eight nine"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs.withColumn("n_chars", F.lit(1)), docs.where("false")):
        known = {tuple(r[c] for c in CLASHING) for r in frame.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            rows = out.collect()
            assert len(rows) <= frame.count() and (out.columns == frame.columns or name == "byte_bpe")
            assert {tuple(r[c] for c in CLASHING) for r in rows} <= known


def test_empty_tables(docs, items):
    none = docs.where("false")
    for out in (
        decontamination.find_leaks(none, items), decontamination.remove_leaks(none, items), near_dedup.near_duplicates(none),
        near_dedup.deduplicate(none), substring_dedup.remove_repeats(none), quality_rules.apply_rules(none), byte_bpe.encode(none),
    ):
        assert out.count() == 0
    assert decontamination.remove_leaks(docs, items.where("false")).count() == docs.count()


@pytest.mark.parametrize("text", ["<a " * 60_000, '<a x=">" ' * 60_000, "<title>" * 60_000, "<!--" * 60_000, "<script>" * 60_000, "<a href='" * 60_000 + ">"])
def test_pages_are_scanned_in_one_pass(text):
    began = time.process_time()
    warc.fields(text)
    warc.plain_text(text)
    assert time.process_time() - began < 8  # some 0.1 to 2 s; the square of the length took minutes


def test_pages_with_quotes_and_unclosed_parts():
    assert warc.plain_text('<p title="a>b">x</p>y < z<br>w') == "x\ny < z\nw"
    assert warc.fields("<a href='l>1'>x</a><A HREF=two>y</A><a name=n>z</a>") == [("outlink", "l>1"), ("outlink", "two")]
    assert warc.plain_text("a<script>b") == "a" and warc.plain_text("a<!-- b") == "a" and warc.plain_text("a <b") == "a <b"
    assert warc.plain_text("<a title='x>y</a><p>z") == "y\nz"


def test_payloads_are_undone():
    page = "<title>é</title>"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1"
    assert warc.page_of(head, page.encode("latin-1")) == page
    assert warc.page_of(head + "\r\nContent-Encoding: gzip", gzip.compress(page.encode("latin-1"))) == page
    raw = zlib.compress(page.encode())[2:-4]
    assert warc.page_of("HTTP/1.1 200 OK\r\nContent-Encoding: deflate", raw) == page
    chunks = b"4\r\n<tit\r\nc;x=y\r\n" + page.encode()[4:16] + b"\r\n1\r\n>\r\n0\r\n\r\n"
    assert warc.page_of("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", chunks) == page
    assert warc.page_of("HTTP/1.1 200 OK\r\nContent-Encoding: gzip", b"plain") == "plain"
    assert warc.page_of("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such", b"x") == "x"
    assert warc.page_of("", b'<meta charset="cp1251">\xe4') == '<meta charset="cp1251">д'


def test_malformed_records():
    whole = b"WARC/1.0\r\nWARC-Type: metadata\r\nno colon\r\nWARC-Target-URI: http://h/\r\n  path\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = warc.parse(b"rubbish\n" + whole + whole.replace(b"Content-Length: 3\r\n", b"") + whole[:-6])
    assert [(r["warc_type"], r["target_uri"], r["block"]) for r in rows] == [("metadata", "http://h/ path", x) for x in (b"abc", b"abc", b"a")]
    assert warc.parse(whole[:20])[0]["block"] == b"" and warc.parse(b"") == [] and warc.parse(b"none") == []
    assert len(warc.parse(gzip.compress(whole) + gzip.compress(whole))) == 2
