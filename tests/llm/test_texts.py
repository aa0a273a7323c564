"""Operators 3, 4, 6, 7, 9, 10 against SQL, brute force and round trips."""

import base64
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from spoor.llm import byte_bpe, decontamination, language_model, license_scan, quality_rules, warc
from spoor.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\x1c", "é É A", "a　b", "mit license MIT-License", "x" * 5000, "The the THE " * 30, "\U0001f600<|endoftext|>"]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, n_words int")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    assert found == sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks(spark, block_bytes):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "Short é item"), (3, None), (4, item), (5, "")], "item_id long, text string")
    texts = [f"a {item.upper()}! b", "so short, É item; short é ITEM", None, "one two", item, item]
    docs = spark.createDataFrame([(i if i < 5 else 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontamination.find_leaks(docs, items, block_bytes=block_bytes).collect()}
    assert found == {(0, 13, 11, "1,4"), (1, 7, 3, "2"), (2, 0, 0, ""), (3, 2, 0, ""), (4, 11, 11, "1,4")}
    assert sorted(r.doc_id for r in decontamination.remove_leaks(docs, items).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontamination.remove_leaks(docs, items, spans=True).collect()}
    assert cut[0] == "a b" and cut[3] == "one two"
    assert decontamination.find_leaks(docs, items.where("false")).where("contaminated").count() == 0


def test_licenses(odd, spark):
    found = license_scan.scan(odd).collect()
    assert len(found) == 20 and {len(r.places) for r in found if r.doc_id % 10 == 6} == {2}
    for r in found:
        assert r.n_words == len(ALNUM.findall((ODD[r.doc_id % 10] or "").translate(LOW)))
    text = "x " + license_scan.TEMPLATES["bsd"][0] + " y Licensed under CC BY-NC 4.0."
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.label, s.covered) for s in row.spans] == [("bsd", 1.0), ("cc-by-nc", 1.0)] and row.score == 1.0


def test_licenses_within_others_and_of_one_word(spark):
    long, short = "licensed under the foo license version 2 or later", "the foo license version 2 or later"
    templates = {"a": [long + " as you like"], "b": [short], "c": ["Unlicensed"]}
    docs = spark.createDataFrame([(1, f"x {long} as you like y"), (2, f"{long} y"), (3, "x isc. Unlicensed y"), (4, "x")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs, templates=templates, phrases={"isc": "isc", "foo license": "foo"}).collect()}
    spans = {i: [(s.label, s.start, s.end, s.covered) for s in r.spans] for i, r in rows.items()}
    assert spans == {1: [("a", 1, 13, 1.0), ("b", 3, 10, 1.0)], 2: [("a", 0, 9, 0.75), ("b", 2, 9, 1.0)], 3: [("c", 2, 3, 1.0)], 4: []}
    assert {i: [(p.label, p.start) for p in r.places] for i, r in rows.items()} == {1: [("foo", 4)], 2: [("foo", 3)], 3: [("isc", 1)], 4: []}


def test_matching_statistics_are_those_of_brute_force():
    automaton = license_scan.Automaton({"a": ["x y x y z", "y z x x y"], "b": ["z z y"]}, {"y z": "p"})
    runs = [[0, 1, 0, 1, 2], [1, 2, 0, 0, 1], [2, 2, 1]]
    order = [t for _, t in sorted(zip(automaton.words.tolist(), range(3), strict=True))]
    del order
    from spoor.llm.tokens import NON_ALNUM, words_of
    import pyarrow as pa

    ids = {w: int(automaton.words.searchsorted(words_of(pa.array([w]), NON_ALNUM).hashes()[0])) for w in "xyz"}
    runs = [[ids["xyz"[i]] for i in r] for r in runs]
    text = [ids[c] for c in "zxyxyzzyyzxxyzzy"]
    found = [n for _, n in automaton.statistics(text)]
    subs = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    for at, n in enumerate(found):
        best = max((k for k in range(at + 2) if tuple(text[at + 1 - k : at + 1]) in subs or k == 0))
        assert n == best


def test_language_model(odd, spark):
    model = language_model.train(odd)
    found = language_model.score(odd, model).collect()
    assert len(found) == 20 and all(r.n_known == r.n_tokens and r.score < 0 for r in found)
    new = spark.createDataFrame([(1, "never seen é"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_model.score(new, model).collect()}
    assert rows[1].n_known == 2 and rows[2].n_tokens == 1 and rows[1].train_tokens == model.tokens
    empty = language_model.train(odd.where("false"))
    assert language_model.score(new, empty).where("n_known = 0").count() == 2


def test_byte_bpe(odd, spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(odd, offsets=True))
    for r in out.collect():
        text = r.text or ""
        ids = own.encode_ordinary(text)
        assert [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] == ids
        assert r.n_tokens == len(ids) == len(r.starts) and bytes(r.decoded) == text.encode()
        assert all(own.decode([t]) in (text[a:b], "�") or "�" in own.decode([t]) for t, a, b in zip(ids, r.starts, r.ends, strict=True))
    half = spark.createDataFrame([(bytearray(own.encode_ordinary("\U0001f600")[0].to_bytes(4, "little")),), (None,)], "ids binary")
    assert [bytes(r.decoded) for r in byte_bpe.decode(half).collect()][1] == b""


def test_a_long_text_is_encoded_in_pieces(monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_A_TIME", 7)
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    ids, sizes = codec.encode(["some words of a text that is longer", None, "short"])
    assert codec.decode(ids[: sizes[0]]).tobytes() == b"some words of a text that is longer" and sizes[1] == 0


def test_quality_rules(odd):
    rows = quality_rules.apply_rules(odd).collect()
    assert len(rows) == 20 and all(r.base_failed for r in rows)
    assert {r.n_repeat_words for r in rows if r.doc_id % 10 == 8} == {90}


def test_warc(spark):
    html = "<html lang=EN><title>A &amp; B</title><script>no</script><p>x<b>y</b></p><a href='/l'>z</a>"
    pages = spark.createDataFrame([(1, "http://h/", html), (2, None, None), (1, "http://h/", html)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    rows = made.collect()
    assert len(rows) == 6
    of = {(r.row, r.warc_type): r for r in rows}
    assert of[1, "conversion"].block.decode() == "A & B\nxy\nz" and of[2, "conversion"].block == b""
    told = of[1, "metadata"].block.decode()
    assert "title: A & B\r\nlanguage: en\r\noutlink: /l\r\n" in told and of[1, "conversion"].record_id in told
    assert of[1, "conversion"].refers_to == of[1, "metadata"].refers_to and "text/html" in of[1, "conversion"].source_headers
    back = warc.parsed(warc.serialized(made).selectExpr("record AS content")).collect()
    keep = lambda r: tuple(bytes(r[c]) if c == "block" else r[c] for c in warc.RECORD)
    assert sorted(map(keep, back), key=repr) == sorted(map(keep, rows), key=repr)
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_crc_is_that_of_the_id_as_text(spark):
    from pyspark.sql import functions as F

    from spoor.llm.learning import held_out

    rows = spark.range(50).select("id", held_out(F.col("id"), 4).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
