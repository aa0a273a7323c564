"""Operators 4, 5, 6 and the pipeline against brute force and held-out labels."""

import base64
import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_dedup import WORD, brute, repeats
from test_texts import ALNUM, LOW

import corpus_pipeline
from spoor.llm import language_model, license_scan
from spoor.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_phrases_of_every_text(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = rows_of(QUERIES["op4_license_scan"](spark, sf))
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        w = ALNUM.findall((text or "").translate(LOW))
        at = sorted((p, label) for p in range(len(w)) for phrase, label in PHRASES.items() if tuple(w[p : p + len(phrase)]) == phrase)
        r, base = found[i], sorted({label for _, label in at})
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(base))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted({*labels, *base}) and 0 <= r.score <= 1


def test_notices_are_found_with_words_changed(spark):
    texts = {}
    for i, (label, many) in enumerate(license_scan.TEMPLATES.items()):
        words = max(many, key=len).split()
        if len(words) > 20:
            words[len(words) // 2] = "other"
        texts[i] = (label, "before it " + " ".join(words) + " after it")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert texts[r.doc_id][0] in {s.label for s in r.spans}


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOW)), None]  # None: the end


def discounts(counts):
    n = Counter(counts)
    assert all(n[k] for k in (1, 2, 3, 4))
    y = n[1] / (n[1] + 2 * n[2])
    # The model keeps each discount of k at least 0.05 and at most k - 0.05, which few n-grams of four words need.
    of = [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]
    return lambda c: of[min(c, 3)]


class KneserNey:
    """Interpolated modified Kneser-Ney, by the textbook, in dictionaries; n-grams at a text's begin keep their counts."""

    def __init__(self, texts, order):
        self.order = order
        lists = [[BEGIN, *tokens_of(t)] for t in texts]
        self.words = Counter(w for ws in lists for w in ws[1:])
        grams = {order: Counter(tuple(ws[i : i + order]) for ws in lists for i in range(len(ws) - order + 1))}
        for k in range(order - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
            if k > 1:
                grams[k].update(tuple(ws[:k]) for ws in lists if len(ws) >= k)
        self.levels = {}
        for k in range(2, order + 1):
            discount, total, kept = discounts(grams[k].values()), Counter(), Counter()
            for g, c in grams[k].items():
                total[g[:-1]] += c
                kept[g[:-1]] += discount(c)
            self.levels[k] = (grams[k], discount, total, kept)
        low, self.types = discounts(grams[1].values()), len(grams[2])
        self.spare = sum(map(low, grams[1].values())) / self.types
        self.low = lambda w: (grams[1][(w,)] - low(grams[1][(w,)])) / self.types

    def chance(self, *gram):
        if len(gram) == 1:
            return self.low(*gram) + self.spare / (len(self.words) + 1)
        grams, discount, total, kept = self.levels[len(gram)]
        lower, context = self.chance(*gram[1:]), gram[:-1]
        return (grams[gram] - discount(grams[gram]) + kept[context] * lower) / total[context] if total[context] else lower

    def score(self, text):
        ws = [BEGIN, *tokens_of(text)]
        return sum(math.log10(self.chance(*ws[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(ws)))


BEGIN = "begin of a text"


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_is_kneser_ney(spark, order, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_MB", 0.01)  # many shards, common words, several sendings
    monkeypatch.setattr(language_model, "HELD", 3000)
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()
    texts, fresh = [r.text for r in rows[:150]], [*(r.text for r in rows[150:]), "never SEEN", None, "\x1c é " * 50]
    own = KneserNey(texts, order)
    seen = [*own.words, "a word that no text has"]
    contexts = [c for c in own.levels[order][2] if c[-1] is not None][:: 2000 * order]
    for c in [(BEGIN,), ("no such word",), *contexts]:
        assert math.isclose(sum(own.chance(*c, w) for w in seen), 1, rel_tol=1e-9)
    model = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
    docs = spark.createDataFrame(list(enumerate([*texts, *fresh])), "doc_id long, text string")
    found = rows_of(language_model.score(docs, model))
    total, kinds = sum(own.words.values()), len(own.words)
    for i, text in enumerate([*texts, *fresh]):
        ws, r = tokens_of(text), found[i]
        base = sum(math.log10((own.words.get(w, 0) + 1) / (total + kinds + 1)) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in own.words for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own.score(text), rel_tol=1e-9)
    empty = language_model.train(docs.where("false"), order=order)
    assert language_model.score(docs, empty).where("n_known = 0").count() == len(texts) + len(fresh)


def test_language_model_tells_held_out_texts_better_than_single_words(spark):
    rows = QUERIES["op6_language_model"](spark, "/root/testdata/sf0.01").where("held_out AND n_known = n_tokens")
    score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert base < score < 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has but 37 toxic rows to learn from
    rows = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    both = ("toxic = 1", "toxic = 1 AND predicted = 1", "toxic = 0", "toxic = 0 AND predicted = 1")
    toxic, found, clean, taken = rows.agg(*[F.count_if(F.expr(x)) for x in both]).first()
    assert toxic and clean and found >= 0.85 * toxic and taken <= 0.08 * clean


def without_repeats(rows):
    """Rows (id, text, n_chars) without repeated passages: a kept word goes with the separator after it."""
    lists = {i: WORD.findall(t or "") for i, t, _ in rows}
    least = {}
    for i, w in lists.items():
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, text, n in rows:
        w = lists[i]
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        if any(gone):
            parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]?", text)
            text = re.sub(r"[\x20\x09-\x0D]\Z", "", "".join(x for x, g in zip(parts, gone, strict=True) if not g))
            n = len(text)
        out.append((i, text, n))
    return out


def test_pipeline_is_brute_force_from_the_classifier_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    rows = [(r.doc_id, r.text, r.n_chars) for r in first.collect()]
    of = {doc: component for doc, _, component in brute([r[:2] for r in rows], 5)}
    rows = [r for r in rows if of[r[0]] == r[0]]
    before = repeats([r[:2] for r in rows])
    rows = without_repeats(rows)
    assert sorted((i, " ".join(WORD.findall(t or ""))) for i, t, _ in rows) == sorted((x[0], x[3]) for x in before)
    windows = set()
    for (text,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect():
        w = ALNUM.findall((text or "").translate(LOW))
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9))} - {()}
    sizes = {len(w) for w in windows}
    kept = []
    for row in rows:
        w = ALNUM.findall((row[1] or "").translate(LOW))
        if not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1)):
            kept.append(row)
    assert len(kept) < len(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows_of(corpus_pipeline.run(spark, SF))
    assert found.keys() == {r[0] for r in kept}
    for i, text, n in kept:
        ids = own.encode_ordinary(text or "")
        r = found[i]
        assert r.n_chars == n and r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
