"""Operators 4, 5, 7, 8 and 10 on whole tables against plain versions that share no code with them."""

import base64
import hashlib
import html
import math
import re
from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
import pytest
import tiktoken
from test_dedup import WORD
from test_texts import ALNUM, LOW

from spoor.llm import byte_bpe, license_scan, quality_classifier, toxicity, warc
from spoor.llm.queries import QUERIES
from spoor.llm.tokens import mix_int

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
M1, ALL = 0xBF58476D1CE4E5B9, (1 << 64) - 1


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_every_text_is_encoded_as_by_the_ranks(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    for token, i in ranks.items():
        at = codec.token_start[i]
        assert codec.token_bytes[at : at + codec.token_size[i]].tobytes() == token
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(spark, MORE)
    for r in QUERIES["op7_byte_bpe"](spark, MORE).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts.pop(r.doc_id).encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert not texts


def plain_statistics(text):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = len(words), max(len(data), 1)
    many, kinds = max(n, 1), Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    some = lambda of: sum(data.count(c) for c in of)
    upper = lambda b: 65 <= b <= 90
    return [
        n, sum(map(len, words)) / many, sum(len(w) > 12 for w in words) / many, sum(len(w) < 3 for w in words) / many,
        sum(map(upper, data)) / size, sum(len(w) > 1 and upper(w[0]) and upper(w[1]) for w in words) / many, sum(upper(w[0]) for w in words) / many,
        sum(48 <= b <= 57 for b in data) / size, some(b".,") / many, some(b"!") / many, some(b"#*$%&<>") / many, some(b"|") / many,
        sum(b > 127 for b in data) / size, sum(b == 32 or 9 <= b <= 13 for b in data) / size, n / max(len(lines), 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, len(kinds) / many,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1), max(kinds.values(), default=0) / many,
    ]


def test_quality_scores_are_those_of_trees_walked_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = texts_of(spark, SF)
    rows = QUERIES["op8_quality_classifier"](spark, SF).collect()
    assert len(rows) == len(texts) and len(trees.roots) > 5
    for r in rows:
        x, total = plain_statistics(texts[r.doc_id]), trees.bias
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9) and r.predicted == int(r.score >= 0.7)


def plain_terms(text):
    """Hashes of the words and word beginnings of a text, with Python's own numbers."""
    out = set()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        word = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        edge = lambda b: b in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        for _ in range(3):
            word = word[1:] if len(word) > 1 and edge(word[0]) else word
            word = word[:-1] if len(word) > 1 and edge(word[-1]) else word
        for kind, size in enumerate(toxicity.BEGINNINGS):
            if size and len(word) <= size:
                continue
            part = word[:size] if size else word
            h = mix_int(len(part))
            for at in range(0, len(part), 8):
                h = mix_int(h ^ (int.from_bytes(part[at : at + 8], "little") * M1 & ALL))
            out.add((mix_int(h ^ mix_int(size)) >> 24) & ~3 | kind)
    return out


def test_toxicity_scores_are_sums_over_the_terms_of_a_text(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{MORE}/labels.parquet"))
    weight = dict(zip(model.terms.tolist(), model.weights.tolist(), strict=True))
    texts = {i: t for i, t in texts_of(spark, MORE).items() if i % 5 == 0}
    assert len(weight) > 20
    for r in QUERIES["op5_toxicity"](spark, MORE).collect():
        if r.doc_id in texts:
            total = model.bias + sum(weight[t] for t in plain_terms(texts[r.doc_id]) if t in weight)
            assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-6) and r.predicted == int(r.score >= 0.3)


def test_notices_are_those_of_a_plain_search(spark):
    short = {}
    for label, many in license_scan.TEMPLATES.items():
        for t in many:
            w = " ".join(ALNUM.findall(t.translate(LOW)))
            if len(w.split()) <= 10:
                short.setdefault(w, set()).add(label)
    texts, seen = texts_of(spark, MORE), Counter()
    for r in QUERIES["op4_license_scan"](spark, MORE).collect():
        words = f" {' '.join(ALNUM.findall(texts[r.doc_id].translate(LOW)))} "
        found = set().union(*(labels for t, labels in short.items() if f" {t} " in words))
        seen.update(found)
        assert found <= set(r.labels.split(",")) and (not found or r.score == 1.0)
        long = set(r.labels.split(",")) - found - set(r.base_labels.split(","))
        assert long <= {"", *(k for k, many in license_scan.TEMPLATES.items() if any(len(t.split()) > 9 for t in many))}
    assert seen


class Page(HTMLParser):
    """Text, title and links of a page, by the library's parser."""

    def __init__(self, page):
        super().__init__()
        self.hidden, self.text, self.links = 0, [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "svg")
        self.text.append("\n" if tag in warc._BLOCKS else "")
        href = dict(attrs).get("href")
        if tag == "a" and href and not self.hidden:
            self.links.append(" ".join(href.split()))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "svg") and self.hidden > 0
        self.text.append("\n" if tag in warc._BLOCKS else "")

    def handle_data(self, data):
        self.text.append("" if self.hidden else data)


@pytest.mark.parametrize("sf", [SF, MORE])
def test_derivatives_are_those_of_another_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = {(r.page_id, r.warc_type): r for r in QUERIES["op10_warc"](spark, sf).collect()}
    assert len(rows) == 2 * len(pages)
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet")))
    blocks = {(r.row, r.warc_type): bytes(r.block) for r in made.collect()}
    for i, page in pages.items():
        source = (page.html or "").encode()
        parsed = Page(page.html or "")
        lines = [" ".join(x.split()) for x in "".join(parsed.text).split("\n")]
        text = blocks[i, "conversion"].decode()
        assert [" ".join(x.split()) for x in text.split("\n") if x.split()] == [x for x in lines if x]
        told = [x.split(": ", 1) for x in blocks[i, "metadata"].decode().split("\r\n") if x]
        assert [v for k, v in told if k == "outlink"] == [x for x in parsed.links if x]
        title = re.search(r"<title[^>]*>(.*?)</title", page.html or "", re.S)
        assert [v for k, v in told if k == "title"] == [x for x in [" ".join(html.unescape(title[1]).split())] if x] if title else True
        for kind in ("metadata", "conversion"):
            r = rows[i, kind]
            sha1 = "sha1:" + base64.b32encode(hashlib.sha1(source).digest()).decode()
            assert r.payload_digest == sha1 and r.target_uri == page.url and r.refers_to == rows[i, "metadata"].refers_to
            assert r.block_sha256 == hashlib.sha256(blocks[i, kind]).hexdigest() and r.content_length == len(blocks[i, kind])
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(blocks[i, kind]).digest()).decode()


def test_words_of_odd_texts():
    assert WORD.findall("a\x1cb c") == ["a\x1cb", "c"]
